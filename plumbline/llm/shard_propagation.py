"""Sharding by balanced label propagation.

Documents that share a link start in shards drawn by hash and move, round by round, towards
the shard that holds most of their neighbours. A round joins every linked document with the
places of its links, a table with one row a link of at most as many entries as there are
shards, so that a link of any number of documents gives no pairs. What shards may take is
limited: they accept the moves with the largest gain first, up to the room that they have
and that accepted departures make. A shard that had to turn moves away is no target in the
next round. Documents without links fill the shards up at the end, which makes the sizes
even whatever the links ask for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequences import row_numbers
from ..session import discard, durable

SHARDS = 40
# Bytes of a document besides its text.
OVERHEAD = 16
ROUNDS = 10
# Rounds end when one brings fewer than this share of the linked documents nearer together.
LEAST_GAIN = 0.001
# Moves are ordered by the power of two of their gain.
GAINS = 48
# Fineness of the share of moves that is accepted, and of what leaves an overfull shard.
GRAIN = 1 << 20
CLASSES = 1_024


def _draw(*columns: str | Column, seed: int, size: int = GRAIN) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(size)).cast("int")


@dataclass
class Quotas:
    """What each shard may hold: `rows` counts documents, `bytes` their sizes."""

    law: str
    most: list[float]

    @classmethod
    def of(cls, law: str, shards: int, rows: int, size: int) -> Quotas:
        if law == "rows":
            return cls(law, [rows // shards + (j < rows % shards) for j in range(shards)])
        if law == "bytes":
            return cls(law, [size / shards] * shards)
        raise ValueError(f"no such law: {law}")

    def weight(self) -> Column:
        return F.lit(1).cast("long") if self.law == "rows" else F.col("size")


def accepted_shares(asked: dict[tuple[int, int, int], float], load: list[float], most: list[float]) -> dict[tuple[int, int], float]:
    """The share of moves accepted, by (target, gain); `asked` has weights by (from, target, gain).

    Every target takes the largest gains first, within its room and the accepted departures.
    Departures are first taken to be all that are asked for, and then shrink until they hold.
    """
    shards = range(len(most))
    share = {(to, gain): 1.0 for _, to, gain in asked}
    for _ in range(100):
        leaving = [0.0] * len(most)
        coming: dict[tuple[int, int], float] = {}
        for (source, to, gain), w in asked.items():
            leaving[source] += w * share[to, gain]
            coming[to, gain] = coming.get((to, gain), 0.0) + w
        now = {}
        for to in shards:
            room = max(0.0, most[to] - load[to] + leaving[to])
            for gain in sorted((g for t, g in coming if t == to), reverse=True):
                w = coming[to, gain]
                now[to, gain] = min(share[to, gain], room / w if w else 1.0)
                room -= now[to, gain] * w
        if all(abs(now[k] - share[k]) < 1e-6 for k in share):
            return now
        share = now
    return share


def _asked(state: DataFrame, closed: set[int], most: list[float], seed: int) -> DataFrame:
    """`state` with `to`, the shard each document asks for (its own: none), `gain` in powers of two, and the `key` that draws."""
    each = state.select("node", "w", "shard", F.explode("links").alias("link"))
    seats = each.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"))
    seat = F.struct("n", _draw("link", "shard", seed=seed).alias("draw"), "shard")
    tally = seats.groupBy("link").agg(
        F.sort_array(F.collect_list(seat), asc=False).alias("held"), F.ceil(F.sum("s") / F.lit(float(max(1, min(most))))).cast("int").alias("homes")
    )
    # A link that no shard can hold has as many homes as it needs, those with most of its documents.
    # Documents at home stay, the others draw a home.
    homes = F.slice("held", 1, F.least("homes", F.size("held")))
    own = F.filter(homes, lambda h: h["shard"] == F.col("shard"))
    drawn = F.array(F.element_at(homes, F.pmod(F.xxhash64("node"), F.size(homes)).cast("int") + 1))
    fits = F.col("homes") <= 1
    votes = F.when(fits, F.col("held")).when(F.size(own) > 0, own).otherwise(drawn)
    # All documents of a link that fits draw alike, so that they move together or not at all.
    key = F.when(fits, F.xxhash64("link")).otherwise(F.xxhash64("node"))
    met = each.join(tally, "link").select("node", votes.alias("votes"), key.alias("key"))
    merged = met.groupBy("node").agg(F.flatten(F.collect_list("votes")).alias("votes"), F.min("key").alias("key"))
    shut = F.array(*map(F.lit, sorted(closed))) if closed else F.array().cast("array<int>")
    open_votes = F.filter("votes", lambda v: ~F.array_contains(shut, v["shard"]))

    def of(shard: Column) -> Column:  # a document with several links counts itself once
        same = F.filter("votes", lambda v: v["shard"] == shard)
        itself = F.when(shard == F.col("shard"), 1 - F.size("links")).otherwise(0).cast("long")
        return F.aggregate(same, itself, lambda t, v: t + v["n"])

    best = F.array_max(F.transform(open_votes, lambda v: F.struct(of(v["shard"]).alias("n"), v["draw"].alias("draw"), v["shard"].alias("shard"))))
    gain = F.floor(F.log2(F.greatest(F.col("best.n") - of(F.col("shard")) + 1, F.lit(1)))).cast("int")
    return state.join(merged, "node").withColumn("best", best).select(
        *state.columns, "key", F.coalesce("best.shard", "shard").alias("to"), F.coalesce(F.least(gain, F.lit(GAINS - 1)), F.lit(0)).alias("gain"),
    )


def _cut(state: DataFrame) -> int:
    """Documents that are not in the shard with most documents of their link, over all links."""
    seats = state.select("shard", F.explode("links").alias("link")).groupBy("link", "shard").count()
    apart = seats.groupBy("link").agg((F.sum("count") - F.max("count")).alias("apart"))
    return apart.agg(F.sum("apart")).first()[0] or 0


def propagate(state: DataFrame, most: list[float], *, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """Move the documents of `state` (`node`, `w`, `links`, `shard` and others) near their neighbours.

    The result is a written table with the same columns and `key`. What each round collects
    is one row for each pair of shards and power of two. Shards may exceed `most` by the
    chance of the draws, and by what they held at the start; `level_off` settles that.
    """
    closed: set[int] = set()
    linked, apart = state.count(), _cut(state)
    for number in range(rounds):
        asked = durable(_asked(state, closed, most, seed))
        discard(state)
        load = [0.0] * len(most)
        moves: dict[tuple[int, int, int], float] = {}
        for shard, to, gain, w in asked.groupBy("shard", "to", "gain").agg(F.sum("w")).collect():
            load[shard] += w
            if shard != to:
                moves[shard, to, gain] = float(w)
        share = accepted_shares(moves, load, most)
        closed = {to for (to, _), part in share.items() if part < 0.999}
        table = [share.get((to, gain), 0.0) for to in range(len(most)) for gain in range(GAINS)]
        taken = F.array(*[F.lit(int(part * GRAIN)) for part in table])
        goes = _draw("key", seed=seed + 1 + number) < F.element_at(taken, F.col("to") * GAINS + F.col("gain") + 1)
        state = asked.withColumn("shard", F.when(goes, F.col("to")).otherwise(F.col("shard"))).drop("to", "gain")
        before, apart = apart, _cut(state)
        if not moves or not apart or before - apart < LEAST_GAIN * linked:
            break
        state = state.drop("key")
    return state if "key" in state.columns else durable(state)


def _overfull(state: DataFrame, most: list[float]) -> Column:
    """Whether a document has to leave: shards above their quota give up the last classes of a hash of `key`."""
    load = dict(state.groupBy("shard").agg(F.sum("w")).collect())
    over = [j for j, w in load.items() if w > most[j]]
    kept = [CLASSES] * len(most)
    if over:
        classes = state.where(F.col("shard").isin(over)).groupBy("shard", _draw("key", seed=5, size=CLASSES).alias("c")).agg(F.sum("w").alias("w"))
        held = {j: 0 for j in over}
        for j, c, w in sorted(classes.collect()):  # at most CLASSES rows a shard
            held[j] += w
            if held[j] > most[j]:
                kept[j] = min(kept[j], c)
    return _draw("key", seed=5, size=CLASSES) >= F.element_at(F.array(*map(F.lit, kept)), F.col("shard") + 1)


def level_off(state: DataFrame, free: DataFrame, quotas: Quotas) -> DataFrame:
    """Give every document of `free` and every one that overfull shards give up a place with room.

    These stand in one order, with the documents of a link together, and the room of the
    shards is laid along it: each shard takes the stretch of its room. By `rows` sizes come
    out exact, by `bytes` to one document at either end of a stretch.
    """
    most = quotas.most
    leaves = _overfull(state, most)
    stay = state.where(~leaves)
    load = dict(stay.groupBy("shard").agg(F.sum("w")).collect())
    pool = free.withColumn("key", F.xxhash64("node")).unionByName(state.where(leaves).drop("shard"), allowMissingColumns=True)
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = F.monotonically_increasing_id()  # the partition above 33 bits, the place in it below
    ordered = durable(
        pool.withColumns({"h": _draw("key", seed=6, size=1 << 30), "h2": _draw("node", seed=7, size=1 << 30)})
        .repartitionByRange(parts, "h", "key", "h2", "node").sortWithinPartitions("h", "key", "h2", "node").withColumn("at", placed)
    )
    part = F.shiftright("at", 33).alias("part")
    sums = sorted(ordered.groupBy(part).agg(F.sum("w")).collect())
    starts, total = {}, 0
    for number, w in sums:
        starts[number] = total
        total += w
    room = [max(0.0, m - load.get(j, 0)) for j, m in enumerate(most)]
    ends = [sum(room[:j + 1]) * (total / max(sum(room), 1e-9) if quotas.law == "bytes" else 1) for j in range(len(room) - 1)]
    offsets = state.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "part long, start long")
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("start") + F.sum("w").over(within) - F.col("w") / 2
    filled = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("middle", middle).withColumn(
        "shard", F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]).cast("array<double>"), lambda e: e <= F.col("middle")))
    )
    return stay.select("id", "size", "text_crc32", "node", "shard").unionByName(filled.select("id", "size", "text_crc32", "node", "shard"))


def shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    links: DataFrame | None = None,
    *,
    count: int = SHARDS,
    law: str = "rows",
    rounds: int = ROUNDS,
) -> DataFrame:
    """`id`, `size`, `text_crc32`, `law`, `shard` (from 0), `slot` (from 0 without gaps) of every document.

    `links` has (`id`, `link`): documents with a link in common are neighbours; a document may
    have several. By default documents with equal texts are. The size is the UTF-8 bytes of
    the text and OVERHEAD; a null text has none and equals the empty one. By law `rows` the
    shards' counts differ by one at most, by `bytes` their sizes are near equal. Slots follow
    the id, nulls first. Rows that repeat an id are documents of their own, each with the
    links of the id; a document without links goes where there is room. Links of null tie
    nothing. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    nodes = durable(docs.select(
        F.monotonically_increasing_id().alias("node"), F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"),
    ))
    own = nodes.select("node", F.col("digest").alias("link")) if links is None else (
        nodes.join(links.where("link IS NOT NULL").select("id", "link").distinct(), "id").select("node", "link")
    )
    shared = own.groupBy("link").count().where("count > 1").select("link")
    linked = own.join(shared, "link").groupBy("node").agg(F.sort_array(F.collect_list("link")).alias("links"))
    rows, size = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    quotas = Quotas.of(law, count, rows, size)
    payload = nodes.drop("digest").withColumn("w", quotas.weight())
    all_ = durable(payload.join(linked, "node", "left"))
    discard(nodes)
    state = durable(all_.where("links IS NOT NULL").withColumn("shard", _draw("node", seed=3, size=count)))
    state = propagate(state, quotas.most, rounds=rounds)
    placed = level_off(state, all_.where("links IS NULL").drop("links"), quotas)
    slotted = row_numbers(durable(placed), ["shard"], ["id", "node"], name="slot")
    return slotted.select("id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"))
