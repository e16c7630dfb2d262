"""SimHash near-duplicates with pigeonring filtering.

Fingerprints come from hashed three-word shingles, whole texts, repeats included. Two fingerprints link at ``limit`` or fewer differing
bits. A fingerprint's 64 bits form a ring of ``segments`` segments. If two fingerprints link, then by the pigeonring principle there is
a segment from which every chain of 1, 2, 3, ... consecutive segments differs in at most its proportional share of the limit: a chain
of l segments in at most ``l * limit / segments`` bits. While that share is below one, segments must be equal, so a leading run of
equal segments is the join key; the rest of the chain is tested on the joined pair before the full Hamming count.

Equal fingerprints are one node, so copies make no pairs. A key shared by more than ``bucket`` fingerprints does not make pairs either:
its fingerprints are linked through the 64-bit words at most one bit away, since two fingerprints differ in at most two bits exactly if
both are within one bit of some word. That makes a row per free bit and fingerprint and loses no link.

Defined results: null texts and texts without words have the fingerprint zero and link like any other; a null id is larger than none
(components are named by the smallest id that is not null); repeated rows share a node; an empty table gives no rows. An input column named like the
result stays, and the result, always the last column, takes the next longer free name (``common.free_name``).
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm.common import cut, free_name, per_row
from snapledger.llm.components import components

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SHINGLE, SEED = 3, 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE, block: int = 1 << 14) -> int:
    """Unsigned 64-bit fingerprint; a bit is set if it is set in over half of the shingle hashes."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, block):  # long texts in blocks, so that memory stays bounded
        hashes = [h(b" ".join(words[k : k + shingle]), SEED) for k in range(at, min(n, at + block))]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """All rows and columns, and the fingerprint as a signed long."""

    def run(texts: list[bytes | None]) -> dict:
        found = [fingerprint(t) for t in texts]
        return {"fp": [f - (1 << 64) if f >> 63 else f for f in found]}

    return df.withColumn(free_name(df, out), per_row(run, "fp long")(F.col(text_col).cast("string"))["fp"])


def _run_and_width(limit: int, segments: int) -> tuple[int, int]:
    """Segments at the start of a chain that must be equal, and the bits of a segment."""
    if 64 % segments or segments <= limit:
        raise ValueError("segments must divide 64 and exceed the limit")
    return math.ceil(segments / limit) - 1 if limit else segments, 64 // segments


def _rotated(fp, start):
    """The ring turned so that bit ``start`` comes first."""
    return F.when(start == 0, fp).otherwise(_or(_shl(fp, start), F.call_function("shiftrightunsigned", fp, (64 - start).cast("int"))))


def _shl(x, n):
    return F.call_function("shiftleft", x, n.cast("int"))


def _or(a, b):
    return a.bitwiseOR(b)


def links(nodes: DataFrame, limit: int = 2, segments: int = 8, bucket: int = 64) -> DataFrame:
    """Edges (src, dst) between nodes whose ``fp`` differ in ``limit`` or fewer bits, enough to connect all linked nodes.

    ``nodes`` has one row per distinct ``fp`` (long) and its ``node`` id. Hot keys give edges to the smallest node around each word
    instead of all pairs. The hot path needs ``limit`` 2; with another limit pairs are made for every key.
    """
    run, width = _run_and_width(limit, segments)
    free = 64 - run * width
    starts = F.explode(F.sequence(F.lit(0), F.lit(64 - width), F.lit(width)))
    turned = nodes.select("node", "fp", starts.alias("start")).select("node", "fp", "start", _rotated(F.col("fp"), F.col("start")).alias("ring"))
    keyed = turned.withColumn("key", F.call_function("shiftrightunsigned", F.col("ring"), F.lit(free)))
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = cut(sizes)
    if limit == 2:
        hot = sizes.filter(F.col("n") > bucket).select(F.col("start").alias("s"), F.col("key").alias("k"))
        cold = sizes.filter(F.col("n") <= bucket).select(F.col("start").alias("s"), F.col("key").alias("k"))
    else:
        hot, cold = None, sizes.select(F.col("start").alias("s"), F.col("key").alias("k"))
    same = (F.col("start") == F.col("s")) & (F.col("key") == F.col("k"))
    some = keyed.join(cold, same, "left_semi")
    a = some.select("start", "key", F.col("ring").alias("ring_a"), F.col("node").alias("src"))
    b = some.select(F.col("start").alias("start_b"), F.col("key").alias("key_b"), F.col("ring").alias("ring_b"), F.col("node").alias("dst"))
    differ = F.col("ring_a").bitwiseXOR(F.col("ring_b"))
    passes = F.bit_count(differ) <= limit
    for length in range(run + 1, segments):
        chain = F.call_function("shiftrightunsigned", differ, F.lit(64 - length * width))
        passes = passes & (F.bit_count(chain) <= length * limit // segments)
    on = (F.col("start") == F.col("start_b")) & (F.col("key") == F.col("key_b")) & (F.col("src") < F.col("dst"))
    edges = a.join(b, on & passes).select("src", "dst")
    if hot is not None:
        near = keyed.join(hot, same, "left_semi")
        flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(free - 1)), lambda i: _shl(F.lit(1).cast("long"), i)))
        around = near.select("node", "start", F.explode(flips).alias("flip"), "ring").select(
            "node", "start", F.col("ring").bitwiseXOR(F.col("flip")).alias("word")
        )
        first = around.groupBy("start", "word").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
        first = cut(first.select(F.col("start").alias("s"), F.col("word").alias("w"), "first"))
        star = around.join(first, (F.col("start") == F.col("s")) & (F.col("word") == F.col("w")) & (F.col("node") > F.col("first")))
        edges = edges.unionByName(star.select(F.col("first").alias("src"), F.col("node").alias("dst")))
    return edges.distinct()


def near_duplicates(
    df: DataFrame, limit: int = 2, segments: int = 8, bucket: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, fp, component): the smallest id reachable over links, for every row of the input."""
    rows = cut(_slim(df, id_col, text_col))
    return rows.join(components_of(rows, limit, segments, bucket).select("fp", "component"), "fp").select("id", "fp", "component")


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "_text").select("id", "fp")


def components_of(rows: DataFrame, limit: int = 2, segments: int = 8, bucket: int = 64) -> DataFrame:
    """Rows (fp, root, component, at) per distinct fingerprint of ``rows`` (id, fp); ``at`` is the fingerprint that has the smallest id."""
    groups = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    nodes = groups.select(F.col("fp").alias("node"), "fp")
    linked = components(links(nodes, limit, segments, bucket))
    rooted = groups.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    first = F.min(F.struct(F.col("least").isNull(), F.col("least").alias("id"), F.col("fp").alias("at"))).alias("first")
    named = cut(rooted.groupBy("root").agg(first).select("root", F.col("first.id").alias("component"), F.col("first.at").alias("at")))
    return cut(rooted.join(named, "root").select("fp", "root", "component", "at"))


def deduplicated(df: DataFrame, limit: int = 2, segments: int = 8, bucket: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of every component, with all its columns; of rows that repeat this id, one.

    A component whose ids are all null keeps one row too. The decision is made on ids and fingerprints; texts are shuffled once.
    """
    rows = cut(_slim(df, id_col, text_col))
    classes = components_of(rows, limit, segments, bucket)
    kept = cut(classes.filter("fp = at").select(F.col("fp").alias("_fp_kept"), F.col("component").alias("_id_kept")))

    def same(one: DataFrame, id_name: str, fp_name: str):
        return (one[fp_name] == kept["_fp_kept"]) & one[id_name].eqNullSafe(kept["_id_kept"])

    held = rows.join(kept, same(rows, "id", "fp"), "left_semi")
    repeated = not held.groupBy("id", "fp").count().filter("count > 1").isEmpty()
    fp, turn = free_name(df, "_fp"), free_name(df, "_turn")
    marked = fingerprints(df, text_col, fp)
    found = marked.join(kept, same(marked, id_col, fp), "left_semi")
    if repeated:
        order = Window.partitionBy(id_col, fp).orderBy(F.col(text_col))
        found = found.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1)
    return found.select(*[F.col(f"`{c}`") for c in df.columns])
