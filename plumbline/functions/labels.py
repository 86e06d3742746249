"""Label normalisation, synonym lookup and naming of merged objects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import as_col

# Built-in synonym groups, the preferred name first in each.
SYNONYM_GROUPS = (
    ("monitor", "computer screen", "display", "screen"),
    ("sofa", "couch", "settee"),
    ("desk", "table", "computer desk"),
    ("bin", "rubbish bin", "trash can", "wastebasket"),
)

BUILTIN = {name: group[0] for group in SYNONYM_GROUPS for name in group}
PREFERRED = tuple(group[0] for group in SYNONYM_GROUPS)


def normalize(label: Column | str) -> Column:
    """Lower case, underscores as blanks, single inner blanks, none outside."""
    spaced = F.regexp_replace(F.lower(as_col(label)), r"[_\s\p{Z}]+", " ")
    return F.trim(spaced)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Map lookup in a literal table; null when absent."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(item) for entry in table.items() for item in entry]
    return F.try_element_at(F.create_map(*pairs), key)


def compatible(a: Column | str, b: Column | str, known_a: Column | None = None, known_b: Column | None = None) -> Column:
    """Whether two labels may name one object.

    Equal labels always may. Where the resolver knows both, its answer stands even
    against the built-in groups; otherwise the built-in groups decide.
    """
    na, nb = normalize(a), normalize(b)
    static = F.coalesce(lookup(BUILTIN, na) == lookup(BUILTIN, nb), F.lit(False))
    if known_a is None or known_b is None:
        return (na == nb) | static
    both = known_a.isNotNull() & known_b.isNotNull()
    return F.when(na == nb, True).when(both, known_a == known_b).otherwise(static)


def canonicalise(df: DataFrame, label: str, synonyms: DataFrame, *, name: str = "canonical") -> DataFrame:
    """Left join a `(label, canonical)` dimension; labels it lacks keep their own name."""
    dim = synonyms.select(F.col("label").alias("_known"), F.col("canonical").alias("_canonical"))
    return (
        df.withColumn("_norm", normalize(label))
        .join(dim, F.col("_norm") == F.col("_known"), "left")
        .withColumn(name, F.coalesce("_canonical", "_norm"))
        .drop("_norm", "_known", "_canonical")
    )


def pick_labels(
    df: DataFrame, keys: Sequence[str], label: str, mapped: Column | None = None
) -> DataFrame:
    """One `(keys, label, aliases)` row per key.

    The most frequent name wins; ties go to a group's preferred name, then the shorter,
    then the alphabetically first. `mapped` replaces the name that is voted on. Counting
    per name first keeps a hot key to one row per distinct name.
    """
    name = normalize(label)
    vote = name if mapped is None else F.coalesce(mapped, name)
    counts = df.select(*keys, name.alias("_name"), vote.alias("_vote")).groupBy(
        *keys, "_vote", "_name"
    ).agg(F.count(F.lit(1)).alias("_n"))
    votes = counts.groupBy(*keys, "_vote").agg(
        F.sum("_n").alias("_n"), F.collect_set("_name").alias("_names")
    )
    rank = F.struct(
        -F.col("_n"), F.when(F.col("_vote").isin(*PREFERRED), 0).otherwise(1),
        F.length("_vote"), F.col("_vote"),
    )
    return (
        votes.groupBy(*keys)
        .agg(
            F.min_by("_vote", rank).alias("label"),
            F.array_distinct(F.flatten(F.collect_list("_names"))).alias("_all"),
        )
        .withColumn("aliases", F.array_sort(F.array_except("_all", F.array("label"))))
        .drop("_all")
    )


def merge_classes(groups: Mapping[str, str] | None) -> dict[str, str]:
    """Class of every named label so that compatible labels always share a class.

    `groups` maps known labels to their canonical name. Built-in and known groups that
    share a label fall into one class; a label outside both is its own class.
    """
    parent: dict[str, str] = {}

    def root(name: str) -> str:
        parent.setdefault(name, name)
        while parent[name] != name:
            name = parent[name]
        return name

    for table in (BUILTIN, groups or {}):
        for name, canonical in table.items():
            a, b = sorted((root(name), root(canonical)))
            parent[b] = a
    return {name: root(name) for name in list(parent)}
