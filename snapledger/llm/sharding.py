"""Sharding by sampled splitters.

Rows are ordered by a hash of their text. A size-weighted sample of these keys gives quantile splitters, the splitters cut the rows
into ranges of near equal bytes, and ranges that come out overfull are subdivided: a text whose copies fill a range becomes a range
of its own, many small texts are cut at further sampled splitters, and a text whose copies would fill a whole shard is cut further by a hash of the row's stored
number, so rows that are equal in all else are spread too. Ranges then go to shards, the
largest first, always to the shard with the fewest bytes (law ``bytes``).

Defined results: a null text has size 1 and the checksum of no bytes. Copies of a text stay in one shard unless they hold more bytes
than a shard's equal part. Equal rows are told apart by nothing and take neighbouring slots. An empty table gives no rows. Columns of
the input other than id and text are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm.common import cut

# A range is overfull with this many times its equal part.
FULL = 1.5

def splitters(keyed: DataFrame, total: int, ranges: int, per_range: int = 32) -> np.ndarray:
    """``ranges - 1`` quantiles of a sample of keys in which a row's chance grows with its bytes.

    ``keyed`` has ``_key`` and ``_size``. The sample has about ``ranges * per_range`` keys whatever the input's size; each key stands for
    its bytes, so a row larger than the sampling step keeps its full weight.
    """
    step = max(1.0, total / (ranges * per_range))
    draw = F.pmod(F.xxhash64("_key", "_id", F.lit("splitter")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = F.greatest(F.lit(step), F.col("_size").cast("double"))
    sample = keyed.filter(draw < F.col("_size") / F.lit(step)).select("_key", weight.alias("_weight")).toPandas()
    if sample.empty:
        return np.empty(0, np.int64)
    sample = sample.sort_values("_key")
    mass = sample["_weight"].cumsum().to_numpy()
    at = np.searchsorted(mass, mass[-1] * np.arange(1, ranges) / ranges)
    return np.unique(sample["_key"].to_numpy()[np.minimum(at, len(mass) - 1)])


def _locate(cuts: np.ndarray, key, step: int = 32):
    """Number of splitters at or below the key: first among every ``step``-th of them, then in the stretch that is left."""
    if not len(cuts):
        return F.lit(0).cast("long")

    def held(values) -> F.Column:
        return F.lit([int(v) for v in values]).cast("array<bigint>")

    def below(values) -> F.Column:
        return F.size(F.filter(values, lambda x: x <= key))

    start = below(held(cuts[step - 1 :: step])) * step
    return (start + below(F.slice(held(cuts), start + 1, F.lit(step)))).cast("long")


def _heavy_texts(placed: DataFrame, ranges: list[int], least: float) -> list[tuple[int, int, int]]:
    """(range, key, bytes) of the texts in the given ranges whose copies hold more than ``least``; as few as such bytes fit the ranges."""
    if not ranges:
        return []
    per_text = placed.filter(F.col("_range").isin(ranges)).groupBy("_range", "_key").agg(F.sum("_size").alias("_bytes"))
    return [(r["_range"], r["_key"], r["_bytes"]) for r in per_text.filter(F.col("_bytes") > least).collect()]


def shard(
    df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 64, task_bytes: int = 64 << 20,
    per_range: int = 32,
) -> DataFrame:
    """Rows (id, size, text_crc32, range_id, shard, slot).

    ``ranges_per_shard`` bounds what the driver holds: splitters, range sums and the few overfull texts. ``task_bytes`` bounds what
    one task sorts to number the slots, so ranges of a huge input are numbered in several pieces. ``per_range`` keys are sampled for
    each range; with fewer, more ranges come out overfull and are cut again.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.xxhash64(text).alias("_key"),
    )
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    cuts = splitters(keyed, total, ranges, per_range)
    target, share = max(1.0, total / ranges), max(1.0, total / shards)
    # The row number spreads rows that are equal in all else; it is stored, so a repeated task sees the same one.
    placed = cut(keyed.withColumns({"_range": _locate(cuts, F.col("_key")), "_row": F.monotonically_increasing_id()}))
    while True:
        sums = {r["_range"]: r["_bytes"] for r in placed.groupBy("_range").agg(F.sum("_size").alias("_bytes")).collect()}
        # Overfull ranges: texts that hold most of a range by themselves leave it.
        heavy = _heavy_texts(placed, [k for k, b in sums.items() if b > FULL * target], target / 2)
        for home, _, size in heavy:
            sums[home] -= size
        # What is still overfull is cut at further splitters, sampled among its light texts.
        wide = [k for k, b in sums.items() if b > FULL * target]
        if not wide:
            break
        light = placed.filter(F.col("_range").isin(wide) & ~F.col("_key").isin([key for _, key, _ in heavy]))
        held = sum(sums[k] for k in wide)
        # Ever denser: with all keys in the sample the ranges are exact, and a light text fills no range, so this ends.
        per_range *= 4
        cuts = np.union1d(cuts, splitters(light, held, 2 * int(np.ceil(held / target)), per_range))
        placed = placed.withColumn("_range", _locate(cuts, F.col("_key")))
    spark = df.sparkSession
    names, sizes, piece_of = [], [], {}
    for _, key, size in sorted(heavy):
        piece_of[key] = (len(names), pieces := int(np.ceil(size / target)) if size > share else 1)
        names += [("text", key, i) for i in range(pieces)]
        sizes += [size / pieces] * pieces
    base = len(names)
    order = sorted(sums)
    sizes += [sums[k] for k in order]
    load = [(0.0, s) for s in range(shards)]
    owner = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        used, s = heapq.heappop(load)
        owner[k] = s
        heapq.heappush(load, (used + sizes[k], s))
    # One row per range: bounded by the number of ranges, so Spark may broadcast it.
    plain = spark.createDataFrame([(k, base + i, owner[base + i]) for i, k in enumerate(order)], "_range long, _rid long, _shard int")
    rows = placed.join(F.broadcast(plain), "_range")
    if heavy:
        held = {key: size for _, key, size in heavy}
        own = spark.createDataFrame(
            [(k, first, n, int(np.ceil(held[k] / n / target))) for k, (first, n) in piece_of.items()], "_key long, _first long, _pieces long, _tasks long")
        rows = rows.join(F.broadcast(own), "_key", "left")
        piece = F.pmod(F.xxhash64("_row", F.lit("piece")), F.col("_pieces"))
        rid = F.coalesce(F.col("_first") + piece, F.col("_rid"))
        owners = spark.createDataFrame([(i, owner[i]) for i in range(base)], "_own long, _owner int")
        rows = rows.withColumn("_rid", rid).join(F.broadcast(owners), F.col("_rid") == F.col("_own"), "left")
        rows = rows.withColumns({"_shard": F.coalesce("_owner", "_shard"), "_tasks": F.coalesce("_tasks", F.lit(1))})
    else:
        rows = rows.withColumn("_tasks", F.lit(1))
    return _numbered(rows, max(1, int(np.ceil(1.5 * target / task_bytes)), int(np.ceil(share / (ranges_per_shard * task_bytes)))))


def _numbered(rows: DataFrame, pieces: int) -> DataFrame:
    """Gapless positions within a shard: a row number inside each small piece plus the counts of the pieces before it.

    A range is numbered in ``pieces`` pieces, one that holds the copies of a text in as many times more as it is larger than others.
    """
    part = F.pmod(F.xxhash64("_row", F.lit("slot")), F.col("_tasks") * pieces)
    rows = rows.select("_id", "_size", "_crc", "_key", "_rid", "_shard", part.alias("_part"))
    counts = rows.groupBy("_shard", "_rid", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_rid", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_rid").alias("_r"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_rid", "_part").orderBy("_key", "_id", "_size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, (F.col("_rid") == F.col("_r")) & (F.col("_part") == F.col("_p")))
    return joined.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_rid").alias("range_id"),
        F.col("_shard").cast("int").alias("shard"), (F.col("_offset") + F.col("_rank")).cast("long").alias("slot"),
    )
