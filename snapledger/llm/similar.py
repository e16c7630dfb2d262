"""Near duplicates by the similarity of word shingles.

Two texts link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more, whole texts. Candidates come from two
sides. Fingerprints that pigeonring (:mod:`snapledger.llm.simhash`) links at two or fewer bits are candidates, and all of them are compared exactly.
As two bits miss most pairs of that similarity, candidates are also those that share one of ``BANDS`` keys, each of ``ROWS`` smallest hashes under permutations of their own; a pair of similarity 0.8 shares none with probability
5e-8 and a more similar one less. A candidate of the second side is dropped before the exact comparison only if one-bit samples of the 128 smallest hashes
agree in fewer than ``AGREE`` places, which at similarity 0.8 happens about once in ten million pairs. All others are compared exactly.

Equal shingle sets are one node. No key makes all its pairs: its nodes are compared with a pivot first, in keys of more than ``bucket``
nodes with a few, and pairs inside a component need no comparison after that. What is left of small keys is compared across components.
Nodes of large keys, where many texts share a passage and are not alike, go through an exact prefix filter instead: two sets of the
similarity share one of their rarest shingles, so only nodes that share such a one, in positions and lengths that allow for the
similarity, are compared. No link between components is lost.

Defined results: words are those of ``simhash``; a text of fewer than five words is one shingle; null texts and texts without words are
one node. A null id is larger than none; repeated rows share a node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapledger.llm.common import free_name, per_row, stored
from snapledger.llm.components import components
from snapledger.llm.simhash import _WORD, fingerprint, links

SHINGLE, SEED = 5, 42
BANDS, ROWS = 32, 4
AGREE = 96
PIVOTS = 3
# Counters of shingles among the nodes of large keys; a task receives 2 MB of them.
SLOTS = 1 << 18
_DRAW = np.random.default_rng(SEED)
_PLACE = _DRAW.integers(0, 1 << 63, SHINGLE + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    each = np.fromiter((h(w, SEED) for w in words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width)) * _PLACE[SHINGLE]
    for k in range(width):
        total += each[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def node_of(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), SEED), np.uint64).view(np.int64))


def sketch(found: np.ndarray, block: int = 512) -> tuple[list[int], int, int]:
    """Keys of the bands, and a bit of each smallest hash in two words."""
    low = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(found), block):
        part = found[at : at + block, None] * _FACTOR
        part += _SHIFT
        np.minimum(low, part.min(axis=0), out=low)
    mixed = _mixed(low)
    keys = np.full(BANDS, 1, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * _PLACE[k] + mixed[k::ROWS])
    bits = np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).view(np.int64)
    return keys.view(np.int64).tolist(), int(bits[0]), int(bits[1])


def _nodes(texts: list[bytes | None]) -> dict:
    return {"node": [node_of(shingles(t)) for t in texts]}


def _sketches(texts: list[bytes | None]) -> dict:
    out: dict = {"node": [], "keys": [], "b0": [], "b1": [], "fp": []}
    for t in texts:
        found, fp = shingles(t), fingerprint(t)
        for name, value in zip(out, (node_of(found), *sketch(found), fp - (1 << 64) if fp >> 63 else fp)):
            out[name].append(value)
    return out


def _sets(texts: list[bytes | None]) -> dict:
    found = [shingles(t) for t in texts]
    return {"node": [node_of(x) for x in found], "held": [x.view(np.int64) for x in found]}


def _alike():
    """Whether the sketches of two sides agree well enough to be compared."""
    return F.bit_count(F.col("b0").bitwiseXOR(F.col("c0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("c1"))) <= BANDS * ROWS - AGREE


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """Pairs (src, dst) of nodes whose fingerprints are equal or linked; the smallest node of a fingerprint stands for it."""
    held = stored(rows.select("fp", "node").distinct())
    first = stored(held.groupBy("fp").agg(F.min("node").alias("first")))
    same = held.join(first, "fp").select("first", "node")
    a = first.select(F.col("fp").alias("src"), F.col("first").alias("a"))
    b = first.select(F.col("fp").alias("dst"), F.col("first").alias("b"))
    near = links(first.select(F.col("fp").alias("node"), "fp")).join(a, "src").join(b, "dst").select("a", "b")
    pairs = same.toDF("a", "b").unionByName(near).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def _sets_of(df: DataFrame, lists: DataFrame, pairs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, held) of all nodes of lists and pairs: the texts are read once more, and only these are cut into shingles."""
    asked = lists.select("node").unionByName(pairs.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    named = stored(groups.join(asked, "node").select(F.col("least").alias("_least"), F.col("node").alias("_asked")))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    texts = texts.join(named.select("_least").distinct(), F.col("id").eqNullSafe(F.col("_least")), "left_semi")
    made = texts.select("id", per_row(_sets, "node long,held array<long>")("t").alias("s")).select("id", "s.node", "s.held")
    made = made.join(named, (F.col("node") == F.col("_asked")) & F.col("id").eqNullSafe(F.col("_least")), "left_semi")
    return stored(made.select("node", "held").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) of nodes whose shingle sets have the similarity."""
    sized = pairs.join(sets.select(F.col("node").alias("src"), F.col("held").alias("x")), "src")
    both = sized.join(sets.select(F.col("node").alias("dst"), F.col("held").alias("y")), "dst")
    # i / (x + y - i) >= 0.8 in whole numbers; the smaller side must have 0.8 of the larger one
    sizes = F.least(F.size("x"), F.size("y")) * 5 >= F.greatest(F.size("x"), F.size("y")) * 4
    alike = F.size(F.array_intersect("x", "y")) * 9 >= (F.size("x") + F.size("y")) * 4
    return stored(both.filter(F.when(sizes, alike).otherwise(False)).select("src", "dst"))


def _starred(lists: DataFrame, bucket: int) -> DataFrame:
    """Pairs of every listed node with a pivot of each of its keys, of a hot key with ``PIVOTS``: linear in the lists."""
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "b0", "b1")).alias(f"p{turn}") for turn in range(PIVOTS)]
    each = [F.struct(*[F.col(f"p{turn}.{c}").alias(c) for c in ("node", "b0", "b1")]) for turn in range(PIVOTS)]
    pivots = lists.groupBy("key").agg(F.first("n").alias("m"), *drawn)
    pivots = pivots.select("key", F.explode(F.when(F.col("m") > bucket, F.array_distinct(F.array(*each))).otherwise(F.array(each[0]))).alias("p"))
    pivots = pivots.select("key", F.col("p.node").alias("dst"), F.col("p.b0").alias("c0"), F.col("p.b1").alias("c1"))
    near = lists.join(pivots, "key").filter((F.col("node") != F.col("dst")) & _alike())
    return near.select(F.least("node", "dst").alias("src"), F.greatest("node", "dst").alias("dst")).distinct()


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return rows.join(named, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("_r", "node")).drop("_n", "_r")


def _apart(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` of keys ``by`` that hold several roots, with ``top``, the root of most of them."""
    counts = rows.groupBy(by, "root").agg(F.count(F.lit(1)).alias("m"))
    large = counts.groupBy(by).agg(F.max(F.struct("m", "root")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return rows.join(large.select(by, F.col("top.root").alias("top")), by)


def _across(rows: DataFrame, by: str, extra: list[str], keep) -> DataFrame:
    """Pairs (src, dst) that share a key and not a root: no pair inside the key's largest component is looked at."""
    other = rows.select(by, F.col("node").alias("dst"), F.col("root").alias("root_b"), F.col("b0").alias("c0"), F.col("b1").alias("c1"),
                        *[F.col(c).alias(f"{c}_b") for c in extra])
    differ = (F.col("root") != F.col("root_b")) & ((F.col("root_b") == F.col("top")) | (F.col("node") < F.col("dst"))) & _alike()
    met = rows.filter("root <> top").join(other, by).filter(differ & keep)
    return met.select(F.least("node", "dst").alias("src"), F.greatest("node", "dst").alias("dst"))


def _prefixes(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (node, root, b0, b1, n, at, shingle): the rarest shingles of every node of ``hot``, as many as similar sets cannot avoid.

    Two sets of similarity 0.8 share one of the ``n - ceil(0.8 n) + 1`` first of each in any common order. The order is by how many of these
    nodes hold a shingle, counted in ``SLOTS`` counters of hashed shingles: counters that collide make prefixes longer lists, never wrong.
    """
    held = stored(sets.join(hot.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_semi"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.zeros(SLOTS, np.int64)
        for batch in batches:
            here += np.bincount(batch.column(0).flatten().to_numpy() % SLOTS, minlength=SLOTS)
        slot = np.flatnonzero(here)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(here[slot])], ["slot", "c"])

    # Every task adds up its own shingles, so no row is made per shingle.
    found = held.select("held").mapInArrow(tally, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["c"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rarest = [], []
            for one in batch.column(1):
                h = one.values.to_numpy()
                n = len(h)
                order = np.lexsort((h, counts[h % SLOTS]))
                sizes.append(n)
                rarest.append(h[order[: n - (4 * n + 4) // 5 + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(rarest, pa.list_(pa.int64()))], ["node", "n", "rarest"])

    made = held.select("node", "held").mapInArrow(run, "node long, n int, rarest array<long>")
    named = hot.select(F.col("node").alias("_n"), "root", "b0", "b1")
    each = made.join(named, F.col("node") == F.col("_n")).drop("_n")
    return each.select("node", "root", "b0", "b1", "n", F.posexplode("rarest").alias("at", "shingle"))


def _rooted(df: DataFrame, rows: DataFrame, groups: DataFrame, bucket: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, root) of all nodes that have a link; equal roots, one component."""
    sketches = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("keys", "b0", "b1")])
    lists = sketches.select("node", "b0", "b1", F.explode("keys").alias("key"))
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = stored(lists.join(sizes, "key"))
    near = stored(_by_fingerprint(rows))
    sets = _sets_of(df, lists, near, groups, id_col, text_col)
    first = stored(_starred(lists, bucket).unionByName(near).distinct())
    roots = components(_verified(first, sets))
    open_ = stored(_apart(_with_roots(lists, roots), "key"))
    left = _across(open_.filter(F.col("n") <= bucket), "key", [], F.lit(True))
    hot = stored(open_.filter(F.col("n") > bucket).groupBy("node").agg(*[F.first(c).alias(c) for c in ("root", "b0", "b1")]))
    if not hot.isEmpty():
        # Lengths, and what is left of both sets from the first shared shingle on, must allow for the similarity.
        n, m, rest = F.col("n"), F.col("n_b"), F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
        may = (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (rest * 9 >= (n + m) * 4)
        left = left.unionByName(_across(_apart(stored(_prefixes(hot, sets)), "shingle"), "shingle", ["n", "at"], may))
    left = stored(left.distinct().join(first, ["src", "dst"], "left_anti"))
    if left.isEmpty() or (more := _verified(left, sets)).isEmpty():
        return roots
    # The new links join whole components.
    ends = _with_roots(more.select(F.col("src").alias("node"), "dst"), roots).select(F.col("root").alias("a"), F.col("dst").alias("node"))
    ends = _with_roots(ends, roots).select(F.col("a").alias("src"), F.col("root").alias("dst"))
    joined = components(ends)
    every = roots.unionByName(ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    moved = joined.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return stored(every.join(moved, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")).distinct())


def deduplicated(df: DataFrame, bucket: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of every component, with all its columns; of rows that repeat this id, one.

    A component whose ids are all null keeps one row too.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    made = per_row(_sketches, "node long,keys array<long>,b0 long,b1 long,fp long")("t").alias("s")
    rows = stored(texts.select("id", made).select("id", "s.*"))
    groups = stored(rows.groupBy("node").agg(F.min("id").alias("least")))
    roots = _rooted(df, rows, groups, bucket, id_col, text_col).select(F.col("node").alias("_n"), "root")
    rooted = groups.join(roots, F.col("node") == F.col("_n"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("least").isNull(), F.col("least").alias("id"), F.col("node").alias("at"))).alias("first")
    kept = stored(rooted.groupBy("root").agg(first).select(F.col("first.id").alias("_id_kept"), F.col("first.at").alias("_node_kept")))

    def same(one: DataFrame, id_name: str, node_name: str):
        return (one[node_name] == kept["_node_kept"]) & one[id_name].eqNullSafe(kept["_id_kept"])

    held = rows.select("id", "node").join(kept, same(rows, "id", "node"), "left_semi")
    repeated = not held.groupBy("id", "node").count().filter("count > 1").isEmpty()
    node, turn = free_name(df, "_node"), free_name(df, "_turn")
    marked = df.withColumn(node, per_row(_nodes, "node long")(F.col(text_col).cast("string"))["node"])
    found = marked.join(kept, same(marked, id_col, node), "left_semi")
    if repeated:
        order = Window.partitionBy(id_col, node).orderBy(F.col(text_col))
        found = found.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1)
    return found.select(*[F.col(f"`{c}`") for c in df.columns])
