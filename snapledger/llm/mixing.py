"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Every source is a stream of words: its documents in an order drawn by a hash of id and text, cut into blocks of equal length, the last
one shorter. Slot ``i`` of the mix gets the golden-ratio point ``i / phi mod 1``, and the cumulative targets of the sources say whose
slot it is, so every stretch of the mix has near the target shares. A source's slots are ranked: slot ``r`` takes block ``r mod blocks``
in round ``r div blocks``. A source gets exactly the slots that its target needs: surplus slots, a number that grows with the logarithm
of the slots, go to sources that are short. The last slot of a source is cut where its target ends, so a source takes its target to
the word, and no word is taken more than ``most`` times.

Points are whole numbers modulo 2^40, so they are exact and distinct for up to 2^40 slots. Documents are placed by the sums of the
buckets before theirs and slots by the counts of the stretches before theirs: no source is sorted or numbered in one task. Equal rows
are counted first and then placed in runs, so a third of all rows may be one row.

Defined results: a null text has no words and takes none; a null source is a source, the last one; null ids and repeated rows are
documents of their own, of which some may be taken more often than others; sources without words have target 0; an empty table gives no
rows. Columns other than id, text and source are ignored. Equal inputs give equal results, however the rows are spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK = 4096

POINT_BITS, HALF_BITS = 40, 20
# 2^40 / phi, rounded to an odd number, so that the points of 2^40 slots are all distinct.
STEP = 679_535_556_991
STRETCH = 1 << 14
RUN_BLOCKS = 64
BUCKET_ROWS = 2000


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (id, source, size, turn), read from the texts once; ``turn`` orders the documents of a source."""
    text, key = F.col(text_col).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return cut(df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(key, F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary")).alias("turn"),
    ))


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows (source, source_size, place, target, quota), one per source.

    Sources share ``share`` times all sizes by weight. Those above ``most`` times their size stop there and the rest is shared again: in
    the order of size by weight, the first source that stays below its limit ends the sources that do not.
    """
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    placed = sums.withColumn("place", F.row_number().over(by_name) - 1)
    placed = placed.withColumn("weight", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    limit = F.col("source_size") * F.lit(float(most))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    filled = placed.withColumns({
        "_limit": limit,
        "_left": F.lit(share) * F.sum("source_size").over(everything) - (F.sum(limit).over(by_limit.rowsBetween(Window.unboundedPreceding, 0)) - limit),
        "_rest": F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)),
        "_turn": F.row_number().over(by_limit),
    })
    open_ = F.when(F.col("weight") * F.col("_left") <= F.col("_limit") * F.col("_rest"), F.struct("_turn", "_left", "_rest"))
    found = filled.withColumn("_open", F.min(open_).over(everything))
    target = F.when(F.col("_turn") < F.coalesce(F.col("_open._turn"), F.lit(1 << 30)), F.col("_limit")).otherwise(
        F.col("weight") * F.col("_open._left") / F.col("_open._rest"))
    return found.select("source", "source_size", "place", target.alias("target"), F.floor(target).cast("long").alias("quota"))


def _points(slot: Column) -> Column:
    """``slot * STEP mod 2^40`` without overflow."""
    high, low = F.shiftright(slot, HALF_BITS), slot.bitwiseAND(F.lit((1 << HALF_BITS) - 1))
    upper = F.shiftleft((high * F.lit(STEP)).bitwiseAND(F.lit((1 << HALF_BITS) - 1)), HALF_BITS)
    return (upper + low * F.lit(STEP)).bitwiseAND(F.lit((1 << POINT_BITS) - 1))


def schedule(goals: DataFrame, block: int = BLOCK, cells: int = 4096) -> DataFrame:
    """Rows (slot, place, round, block, words): which block a slot of the mix takes, and how many of its words.

    ``goals`` has a row per source as ``targets`` gives them. A point meets its source by the cells of [0, 1) that the source covers.
    """
    goals = goals.filter("quota > 0")
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    whole, rest = F.floor(F.col("quota") / F.col("source_size")).cast("long"), F.col("quota") % F.col("source_size")
    needs = goals.withColumns({"_blocks": blocks, "_slots": whole * blocks + F.ceil(rest / F.lit(block)).cast("long")})
    total = needs.agg(F.sum("_slots").alias("n")).first()["n"] or 0
    one = float(1 << POINT_BITS)
    upto = F.sum("_slots").over(Window.orderBy("place")).cast("double")
    spans = needs.withColumns({"_to": F.floor(upto / F.lit(float(max(1, total))) * F.lit(one)).cast("long")})
    spans = cut(spans.withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy("place")), F.lit(0))))
    width = (1 << POINT_BITS) // cells
    covered = spans.filter("_from < _to").select("place", "_from", "_to", F.explode(F.sequence(
        F.floor(F.col("_from") / F.lit(width)).cast("long"), F.floor((F.col("_to") - 1) / F.lit(width)).cast("long"))).alias("_cell"))
    points = goals.sparkSession.range(total).select(F.col("id").alias("slot"), _points(F.col("id")).alias("_at"))
    points = points.withColumn("_cell", F.floor(F.col("_at") / F.lit(width)).cast("long"))
    drawn = points.join(covered, "_cell").filter("_from <= _at and _at < _to").select("slot", "place")
    # Ranks within a source: counts of the stretches before, plus the rank inside the stretch.
    stretch = F.floor(F.col("slot") / F.lit(STRETCH)).cast("long")
    drawn = cut(drawn.withColumn("_stretch", stretch))
    counts = drawn.groupBy("place", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("place").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("place", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("place", "_stretch").orderBy("slot")
    ranked = drawn.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["place", "_stretch"])
    ranked = ranked.select("place", "slot", (F.col("_before") + F.col("_in")).alias("_rank"))
    ranked = cut(ranked.join(needs.select("place", "_slots"), "place"))
    # As many slots are surplus as others are short of: a few per source, since the points are spread evenly.
    surplus = ranked.filter("_rank >= _slots").select("slot", F.row_number().over(Window.orderBy("slot")).alias("_nth"))
    held = counts.groupBy("place").agg(F.sum("_n").alias("_held"))
    short = needs.select("place", "_slots").join(held, "place", "left").withColumn("_held", F.coalesce("_held", F.lit(0))).filter("_held < _slots")
    short = short.select("place", "_slots", F.explode(F.sequence(F.col("_held"), F.col("_slots") - 1)).alias("_rank"))
    short = short.withColumn("_nth", F.row_number().over(Window.orderBy(F.col("_rank") / F.col("_slots"), "place")))
    moved = short.join(surplus, "_nth").select("place", "slot", "_rank")
    slots = ranked.filter("_rank < _slots").select("place", "slot", "_rank").unionByName(moved)
    slots = slots.join(needs.select("place", "source_size", "quota", "_blocks"), "place")
    turn, at = F.floor(F.col("_rank") / F.col("_blocks")).cast("long"), F.col("_rank") % F.col("_blocks")
    words = F.least(F.lit(block), F.col("source_size") - at * block, F.col("quota") - turn * F.col("source_size") - at * block)
    return slots.select("slot", "place", turn.alias("round"), at.alias("block"), words.alias("words"))


def _placed(docs: DataFrame, goals: DataFrame, block: int) -> DataFrame:
    """Rows (place, source_size, target, id, turn, size, copy, start): every document with words, at its position in its source."""
    groups = docs.filter("size > 0").groupBy("source", "id", "turn", "size").agg(F.count(F.lit(1)).alias("_copies"))
    names = goals.select(F.col("source").alias("_source"), "place", "source_size", "target")
    groups = cut(groups.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source"))
    rows = groups.count()
    digits = max(1, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    groups = groups.withColumn("_bucket", F.substring("turn", 1, digits))
    words = F.col("size") * F.col("_copies")
    sums = groups.groupBy("place", "_bucket").agg(F.sum(words).alias("_words"))
    before = Window.partitionBy("place").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("place", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("place", "_bucket").orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("_upto", F.sum(words).over(inside)).join(starts, ["place", "_bucket"])
    groups = groups.withColumn("_start", F.col("_start") + F.col("_upto") - words)
    # Runs of copies: one row may stand for a third of all, so it is cut before its copies are made, and the parts are dealt anew.
    length = F.greatest(F.lit(1), F.floor(F.lit(RUN_BLOCKS * block) / F.col("size")).cast("long"))
    runs = groups.withColumn("_length", length)
    runs = runs.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / F.col("_length")).cast("long"))))
    first = F.col("_run") * F.col("_length")
    runs = runs.withColumns({"_first": first, "_last": F.least(first + F.col("_length"), F.col("_copies")) - 1})
    runs = runs.repartition("place", F.floor((F.col("_start") + F.col("_first") * F.col("size")) / F.lit(block)))
    copies = runs.withColumn("copy", F.explode(F.sequence("_first", "_last")))
    start = F.col("_start") + F.col("copy") * F.col("size")
    return copies.select("place", "source_size", "target", "id", "turn", "size", "copy", start.alias("start"))


def _pieces(docs: DataFrame, goals: DataFrame, block: int) -> DataFrame:
    """Every document's part of every block, with the slots that take the block; ``slot`` is null where none does."""
    placed = _placed(docs, goals, block)
    touched = F.sequence(F.floor(F.col("start") / F.lit(block)).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / F.lit(block)).cast("long"))
    parts = placed.withColumn("block", F.explode(touched))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    parts = parts.withColumns({"_low": low, "_high": high})
    slots = schedule(goals, block)
    met = parts.join(slots, ["place", "block"], "left")
    taken = F.greatest(F.least(F.col("_high"), F.coalesce("words", F.lit(0))) - F.col("_low"), F.lit(0))
    return met.withColumns({"_taken": taken, "from_word": F.col("block") * block + F.col("_low") - F.col("start")})


def mixed(docs: DataFrame, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: rows (slot, place, round, id, copy, from_word, n_words), the stretches of documents in each slot.

    ``docs`` as ``sized`` gives them, ``goals`` as ``targets``. A reader takes slots in order and the stretches of a slot as they come.
    """
    return _pieces(docs, goals, block).filter("_taken > 0").select(
        "slot", "place", "round", "id", "copy", "from_word", F.col("_taken").alias("n_words"))


def taken(docs: DataFrame, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (id, size, source_size, target, taken), one per document: the words the mix takes of it, repeats counted."""
    goals = cut(goals)
    same = ["place", "id", "turn", "size", "copy"]
    sums = _pieces(docs, goals, block).groupBy(*same).agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("_taken").alias("taken"))
    names = goals.select(F.col("source").alias("_source"), "source_size", "target")
    empty = docs.filter("size = 0").join(names, F.col("source").eqNullSafe(F.col("_source")))
    out = ["id", "size", "source_size", "target", "taken"]
    return sums.select(*out).unionByName(empty.withColumn("taken", F.lit(0).cast("long")).select(*out))
