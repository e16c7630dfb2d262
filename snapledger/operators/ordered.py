"""Latest-row, previous-row and rank operators that do not put one hot key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.session import ensure_checkpoint_dir


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, by all ``order`` columns descending.

    Written as a rank filter, which Spark turns into a window group limit: every map task reduces each
    key to one row before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def latest_by_aggregate(df: DataFrame, keys: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """Same result as :func:`latest` through ``max_by``; usable where several picks share one pass."""
    values = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*values), F.struct(*order))
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


# A key that has more rows of the sample than this, which is what one range holds, is cut at every row of this number.
SAMPLED = 64


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    value: Column,
    out: str,
    where: Column | None = None,
    reverse: bool = False,
    sampled: DataFrame | None = None,
) -> DataFrame:
    """For every row, ``value`` of the nearest earlier row of its key that satisfies ``where``.

    A plain window would sort a whole key in one task. Here a key is cut into segments: the window runs
    inside (key, segment), one edge row per segment is carried forward across segments, and the two are
    combined. ``segment`` must grow with ``order``, such as a day of the time column; it bounds a task by
    what one key receives in that span. Without one, only keys that hold more than an even share of the rows
    are cut, at sampled rows: what a row is compared with is fixed, so nothing is stored and rows travel once.
    The sample comes from ``sampled`` where reading ``df`` again is dear; it moves the cuts, never the result.
    Key and order columns are plain values then. ``reverse`` looks at later rows instead.
    """
    keys, order = list(keys), list(order)
    boxed = F.struct(value.alias("v"))  # boxed, so a null value still counts as a row
    rows = df.withColumn("_val", boxed if where is None else F.when(where, boxed))

    def along(column: str) -> Column:
        return F.col(column).desc() if reverse else F.col(column).asc()

    def nearest(*parts: str) -> Column:
        inside = Window.partitionBy(*parts).orderBy(*[along(c) for c in order])
        if where is None:
            return F.lag("_val").over(inside)
        return F.last("_val", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))

    pick = F.min_by if reverse else F.max_by
    edge = pick(F.col("_val"), F.when(F.col("_val").isNotNull(), F.struct(*order))).alias("_edge")

    def carried(*parts: str | Column) -> Column:
        across = Window.partitionBy(*parts).orderBy(along("_seg")).rowsBetween(Window.unboundedPreceding, -1)
        return F.last("_edge", ignorenulls=True).over(across).alias("_carry")

    if segment is not None:
        rows = rows.withColumn("_seg", segment)
        carry = rows.groupBy(*keys, "_seg").agg(edge).select(*keys, "_seg", carried(*keys))
        joined = rows.withColumn("_in", nearest(*keys, "_seg")).join(carry, [*keys, "_seg"], "left")
    else:
        cuts, dense = _cuts(df if sampled is None else sampled, keys, order)
        if cuts is None:
            # Dealt by the whole key if its first column alone would fill a task.
            rows = rows.repartition(*keys) if dense else rows
            return rows.withColumn(out, nearest(*keys)["v"]).drop("_val")
        rows = rows.withColumn("_seg", cuts)
        carry = rows.filter("_seg > 0").groupBy("_seg").agg(edge).select("_seg", carried(F.shiftright("_seg", PIECES)))
        # One row per cut at most, so it fits wherever the cuts do.
        joined = rows.repartition(*keys, "_seg").withColumn("_in", nearest(*keys, "_seg")).join(F.broadcast(carry), "_seg", "left")
    found = F.coalesce("_in", "_carry")["v"]
    return joined.withColumn(out, found).drop("_seg", "_val", "_in", "_carry")


# Bits of a segment's number that count the pieces of one key.
PIECES = 20


def _cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[Column | None, bool]:
    """The segment of a row, 0 where its key is not cut, and whether a value of the first key column holds more than an even share.

    Both come from a sample of a fixed number of rows per shuffle partition. The driver holds one row per partition at most for each.
    """
    rows = df.select(*dict.fromkeys([*keys, *order]))
    total = rows.count()
    if not total:
        return None, False
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.sample(min(1.0, SAMPLED * ranges / total), 0)
    ordered = Window.partitionBy(*keys).orderBy(*order)
    first = Window.partitionBy(keys[0]).orderBy(*keys[1:], *order)
    found = some.select(
        *rows.columns, F.xxhash64(*keys).alias("_hash"), F.row_number().over(first).alias("_first"),
        F.row_number().over(ordered).alias("_at"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
    ).filter((F.col("_first") == SAMPLED + 1) | ((F.col("_n") > SAMPLED) & (F.col("_at") % SAMPLED == 0))).collect()
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def of(row, names):
        return F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in names])

    pieces: dict[tuple, list] = {}
    for row in found:
        if row["_n"] > SAMPLED and row["_at"] % SAMPLED == 0:
            pieces.setdefault(tuple(row[c] for c in keys), []).append(row)
    segment = None
    for number, cut in enumerate(pieces.values(), 1):
        same = F.struct(*keys).eqNullSafe(of(cut[0], keys))
        at = F.size(F.filter(F.array(*[of(row, order) for row in cut]), lambda c: c <= F.struct(*order)))
        inside = F.lit(number << PIECES).cast("bigint") + at
        segment = F.when(same, inside) if segment is None else segment.when(same, inside)
    if segment is not None:
        hashes = sorted({row["_hash"] for cut in pieces.values() for row in cut})
        segment = F.when(F.xxhash64(*keys).isin(hashes), segment.otherwise(0)).otherwise(0).cast("bigint")
    return segment, any(row["_first"] == SAMPLED + 1 for row in found)


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position of every row in one total order, without a single-task window.

    Rows are range-partitioned and sorted, written to the checkpoint folder so partition contents are
    fixed even if an executor is lost, and each partition's position is shifted by the row counts of the
    partitions before it. Only one count per partition crosses tasks.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_part", part).join(offsets, "_part")
    position = F.col("_offset") + F.col("_id") - F.shiftleft("_part", 33) + 1
    return numbered.withColumn(out, position.cast("long")).drop("_part", "_offset", "_id")


def top_k(df: DataFrame, order: Sequence[Column], k: int, out: str = "rank", offset: int = 0) -> DataFrame:
    """A numbered page of a sorted result. The first page gathers ``k`` rows; later ones are cut out of the full ranking."""
    if offset:
        return global_rank(df, order, out).filter((F.col(out) > offset) & (F.col(out) <= offset + k))
    page = df.orderBy(*order).limit(k)
    return page.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, out: str, spread: int = 64) -> DataFrame:
    """The first ``limit`` rows of every key, numbered from 1.

    Up to the limit for which Spark reduces a rank filter to a window group limit, every task sends no more than ``limit`` rows of a key
    and one rank is enough. Above it ranks are taken twice: within parts of a key, dealt by the task that reads a row, then among what the
    parts keep. So no task sorts more than a part of a key's rows, whatever the limit. Which part a row falls into does not change the result.
    """
    if limit <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= limit)
    part = F.pmod(F.spark_partition_id(), F.lit(spread))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    some = df.withColumn("_part", part).withColumn(out, F.row_number().over(inner)).filter(F.col(out) <= limit).drop("_part", out)
    return some.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= limit)


def unique_or_fail(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows unchanged, but the job fails if two rows share a key."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate {label} identity"))).otherwise(F.lit(True))
    return grouped.filter(checked.cast("boolean")).select(*keys, "_row.*")
