"""Quality rules whose thresholds follow each language and source.

Measures are integers. A quantile sketch of a measure is a table of bin counts: values
keep their seven leading bits, so a bin is at most 1/64 of its value wide. Sketches merge
by adding counts, in any order and with the same result, so a language's sketch is the sum
of its sources' sketches. The fences of a language and source are upper (and lower)
quantiles of its sketch, moved out by a multiple of their distance from the median; no fixed
cutoff has a part in them. The sketch of a group is mixed with that of its language as if
PRIOR documents more had the language's distribution, and the language's with that of all
documents in the same way, so small groups lean on what is around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Measure -> (formula, percent of the documents within the upper quantile, reach beyond it in
# distances from the median, has a lower fence too). Rates are per cent or per thousand.
RULES: dict[str, tuple[str, int, int, bool]] = {
    "symbol_rate": ("n_symbols * 100 div n_words", 85, 3, False),
    "dup_line_rate": ("n_dup_lines * 1000 div n_lines", 99, 0, False),
    "repeat_rate": ("n_repeat_words * 1000 div n_words", 99, 0, False),
    "word_length": ("word_chars * 100 div n_words", 85, 3, True),
}
# Documents of the wider distribution that a sketch is mixed with.
PRIOR = 50


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the integer measures of each text; a null text has no words.

    `n_repeat_words` counts the words that lie in a five-word window found twice or more in
    the text. Windows are compared within one text by 64-bit hashes of their words; only
    texts in which two windows agree sort their windows.
    """
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), lambda w: w != "")
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    split = docs.withColumn("_words", words).withColumn("_lines", lines)
    hashes = split.withColumn("n_words", F.size("_words").cast("long")).withColumn("_hash", F.expr("""
        CASE WHEN n_words >= 5 THEN transform(sequence(0, cast(n_words AS INT) - 5),
            i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4]))
        ELSE cast(array() AS array<bigint>) END"""))
    # Windows sorted by hash show repeats as neighbours; their starts, sorted again, cover
    # up to five words each. The array of one array binds the sorted windows to a name.
    repeat_words = """
        CASE WHEN size(array_distinct(_hash)) = size(_hash) THEN 0L ELSE
            aggregate(
                array_sort(flatten(transform(
                    array(array_sort(transform(_hash, (h, i) -> struct(h AS h, i AS i)))),
                    s -> transform(filter(
                        zip_with(
                            zip_with(s, slice(s, 2, size(s)), (x, y) -> struct(x AS x, y.h AS after)),
                            concat(array(cast(null AS bigint)), transform(slice(s, 1, size(s) - 1), z -> z.h)),
                            (xy, before) -> struct(xy.x.i AS i,
                                coalesce(xy.x.h = xy.after, false) OR coalesce(xy.x.h = before, false) AS twice)),
                        e -> e.twice), e -> e.i)))),
                struct(0L AS covered, -5L AS last),
                (acc, i) -> struct(acc.covered + least(5L, i - acc.last) AS covered, cast(i AS bigint) AS last),
                acc -> acc.covered)
        END"""
    measures = {
        "n_words": F.col("n_words"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(F.coalesce(F.col(text_col), F.lit("")))
                      - F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(repeat_words),
    }
    # As the output of a generator the measures are taken once per row; a filter on plain
    # columns would be pushed below them and repeat the splitting within every lambda.
    row = F.struct(*[c.alias(n) for n, c in measures.items()])
    return hashes.select(*docs.columns, F.inline(F.array(row)))


def base_failed() -> Column:
    """The fixed base rule: too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binned(value: str) -> Column:
    """The least value of the bin that a non-negative bigint lies in."""
    drop = f"cast(greatest(length(bin({value})) - 7, 0) AS int)"
    return F.expr(f"shiftleft(shiftright({value}, {drop}), {drop})")


def sketch(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Bin counts of a non-negative bigint `value`: groups, `bin` (its least value), `n`."""
    return rows.withColumn("bin", binned(value)).groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sum of sketches over all groups not named."""
    return sketches.groupBy(*groups, "bin").agg(F.sum("n").alias("n"))


def _same(left: str, right: str, columns: list[str]) -> Column:
    """Equality of columns of two aliased tables; null equals null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def mixed_quantiles(fine: DataFrame) -> DataFrame:
    """`rule`, `lang`, `source` with the bins of the 10th, 50th, 85th and 99th percentile, `p10` to `p99`.

    With u documents up to a bin of t (own), v of s (language) and w of r (all), the mixed
    share is (u + K (v + K w / r) / (s + K)) / (t + K), K = PRIOR. It is compared without
    division, in decimals. Every group has a row for each bin of its rule.
    """
    lang, whole = merged(fine, ["rule", "lang"]), merged(fine, ["rule"])
    groups = fine.select("rule", "lang", "source").distinct()
    grid = (
        groups.alias("g").join(whole.alias("a"), F.col("g.rule") == F.col("a.rule"))
        .join(lang.alias("l"), _same("g", "l", ["rule", "lang"]) & (F.col("a.bin") == F.col("l.bin")), "left")
        .join(fine.alias("f"), _same("g", "f", ["rule", "lang", "source"]) & (F.col("a.bin") == F.col("f.bin")), "left")
        .select("g.*", "a.bin", *[F.coalesce(f"{t}.n", F.lit(0)).cast("decimal(12,0)").alias(n) for t, n in (("f", "n"), ("l", "m"), ("a", "k"))])
    )
    group = Window.partitionBy("rule", "lang", "source")
    along = group.orderBy("bin")
    upto = grid.select("rule", "lang", "source", "bin", *[
        F.sum(c).over(w).cast("decimal(12,0)").alias(name) for c, w, name in (
            ("n", along, "u"), ("m", along, "v"), ("k", along, "w"), ("n", group, "t"), ("m", group, "s"), ("k", group, "r"))
    ])
    share = f"u * r * (s + {PRIOR}) + {PRIOR} * (v * r + {PRIOR} * w)"
    return upto.groupBy("rule", "lang", "source").agg(*[
        F.min(F.expr(f"CASE WHEN 100 * ({share}) >= {p} * ((t + {PRIOR}) * r * (s + {PRIOR})) THEN bin END")).alias(f"p{p}")
        for p in (10, 50, 85, 99)
    ])


def thresholds(measured: DataFrame) -> DataFrame:
    """The fences of each `lang` and `source`, one row per group: `<rule>_high`, and `<rule>_low` where a rule has one.

    They come from the documents that the base rule passes, and are written, so that joins
    know how small they are.
    """
    usable = measured.where(~F.col("base_failed"))
    values = ", ".join(f"'{name}', {formula}" for name, (formula, *_) in RULES.items())
    long = usable.select("lang", "source", F.expr(f"stack({len(RULES)}, {values}) AS (rule, value)"))
    fine = durable(sketch(long, ["rule", "lang", "source"], "value"))
    parts = []
    for name, (_, upper, reach, has_low) in RULES.items():
        mine = F.col("rule") == name
        high = F.col(f"p{upper}")
        parts.append(F.max(F.when(mine, high + reach * (high - F.col("p50")))).alias(f"{name}_high"))
        if has_low:
            low = F.col("p10")
            parts.append(F.max(F.when(mine, low - reach * (F.col("p50") - low))).alias(f"{name}_low"))
    return durable(mixed_quantiles(fine).groupBy("lang", "source").agg(*parts))


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """Add `kept`: not failed by the base rule, and the bin of every measure within its fences.

    `measured` has `lang`, `source`, `base_failed` and the measures. Null languages and
    sources are groups of their own.
    """
    joined = measured.alias("m").join(fences.alias("o"), _same("m", "o", ["lang", "source"]), "left")
    passed = ~F.col("base_failed")
    for name, (formula, _, _, has_low) in RULES.items():
        value = binned(f"(CASE WHEN base_failed THEN 0L ELSE {formula} END)")
        passed &= F.coalesce(value <= F.col(f"{name}_high"), F.lit(True))
        if has_low:
            passed &= F.coalesce(value >= F.col(f"{name}_low"), F.lit(True))
    return joined.select("m.*", passed.alias("kept"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per row of `docs`: `id`, measures, `base_failed`, `kept`.

    Reads id, text, `lang` and `source`; texts are read once, whole, and never shuffled. A
    null or empty text has no words and fails the base rule. Repeated rows and ids are
    judged each; other columns are neither read nor returned; an empty table gives an
    empty result.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), "lang", "source")
    measured = durable(text_measures(narrow, "_text").drop("_text").withColumn("base_failed", base_failed()))
    return judge(measured, thresholds(measured))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `quality` keeps, with all their columns.

    Measures are taken twice, for the thresholds and for the filter: that costs a second
    pass over the texts but moves none of them.
    """
    measured = durable(
        text_measures(docs.select(F.col(text_col).alias("_text"), "lang", "source"), "_text").drop("_text")
        .withColumn("base_failed", base_failed())
    )
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), "lang", "source")
    again = text_measures(rows, "_text").withColumn("base_failed", base_failed())
    return judge(again, thresholds(measured)).where("kept").select("_row.*")
