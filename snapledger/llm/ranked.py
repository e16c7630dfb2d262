"""Ranked lexical search by best positions.

The items of a block are the queries. Every document is read once for the terms that some item asks for; what is gathered is the number of
its terms and the frequency of each asked one. From these rows come the counts of the whole table (documents, terms, documents of each
term). Then every task goes through its documents in segments: a segment has, for every asked term, the list of its documents by falling
impact, and the place of every posting in its list. For one item all its lists are read together, a stretch of each at a time. A document
that is met for the first time is looked up in all lists at once, which gives its whole score and marks its places in the lists as seen.
The best position of a list is the end of its unbroken stretch of seen places. What stands there bounds each unseen document, and these
bounds, weighted and added, are below the bounds of the places read last. Reading stops when the sum is strictly below the score of the
k-th best document so far, so that documents with an equal score still meet. The best of one segment count in the task's next ones, and
the best of all tasks are ranked at the end.

Scores are whole numbers, so results do not depend on how the documents are spread.

Defined results: null texts have no terms; items without a term, or whose terms are in no document, give no rows; repeated items and
documents are ranked each by itself; a null id stands after all others of equal score; an empty table gives no rows. Columns other than
ids and texts are ignored. Ids of documents are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.llm.common import cut, per_row

# Terms are runs of letters and digits of ASCII and of all other characters beyond it; only A to Z are lower-cased.
_SPACED = bytes((b if chr(b).isalnum() or b > 127 else 32) for b in bytes(range(256)).lower())

# Items are searched in blocks of at most so many distinct terms and items: what a task receives is bounded by them.
BLOCK_TERMS, BLOCK_ITEMS = 100_000, 1000
# Places of each list read at first; the stretch doubles while an item goes on.
STRETCH = 16
_LAST = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_SPACED).split() if text else []


class Items(NamedTuple):
    """A block of queries: ids, and for each item the numbers of its terms and how often it asks for them."""

    ids: list
    terms: dict[bytes, int]
    asked: list[np.ndarray]
    times: list[np.ndarray]


def blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text", most_terms: int = BLOCK_TERMS, most_items: int = BLOCK_ITEMS) -> Iterator[Items]:
    """The items, a bounded number at a time."""
    ids, held, asked, times = [], {}, [], []
    for row in items.select(F.col(item_col), F.col(text_col).cast("string").cast("binary")).toLocalIterator():
        found = Counter(terms(bytes(row[1]) if row[1] is not None else None))
        if not found:
            continue
        ids.append(row[0])
        asked.append(np.array([held.setdefault(t, len(held)) for t in found], np.int64))
        times.append(np.array(list(found.values()), np.int64))
        if len(held) >= most_terms or len(ids) >= most_items:
            yield Items(ids, held, asked, times)
            ids, held, asked, times = [], {}, [], []
    if ids:
        yield Items(ids, held, asked, times)


def postings(docs: DataFrame, held: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n, terms, tfs): a document's number of terms, the asked ones it holds and how often."""

    def run(texts: list[bytes | None]) -> dict:
        out: dict = {"n": [], "terms": [], "tfs": []}
        for text in texts:
            words = terms(text)
            # An array, not dictionaries of whole documents: only asked terms are kept.
            found = np.fromiter((k for k in map(held.get, words) if k is not None), np.int64)
            at, tf = np.unique(found, return_counts=True)
            out["n"].append(len(words))
            out["terms"].append(at)
            out["tfs"].append(tf)
        return out

    made = per_row(run, "n long,terms array<long>,tfs array<long>")(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), made.alias("s")).select("id", "s.*")
    return rows.filter("n > 0")


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Segment:
    """Some documents' impact lists, all in one array by (term, falling impact), and the same postings by document."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, docs: int, total: int, width: int):
        doc = np.repeat(np.arange(len(n)), sizes)
        m = 25 + (75 * n * docs) // total
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-self.impact, term))
        self.doc, self.falling = doc[order], self.impact[order]
        self.term, self.first = term, np.concatenate([[0], np.cumsum(sizes)])
        # Where each posting, by document, stands in the lists.
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        counts = np.bincount(term, minlength=width)
        self.start = np.concatenate([[0], np.cumsum(counts)])

    def lookup(self, met: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents, and the places of all their postings with a factor."""
        sizes = self.first[met + 1] - self.first[met]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.first[met] - (ends - sizes), sizes)
        by = factor[self.term[at]]
        sums = np.concatenate([[0], np.cumsum(by * self.impact[at])])
        return sums[ends] - sums[ends - sizes], self.place[at[by > 0]]


def _smallest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The best ``k``: highest scores, equal ones by ascending id."""
    return np.lexsort((ids, -scores))[:k]


def search(segment: Segment, ids: np.ndarray, asked: np.ndarray, factor: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``best`` (scores, ids) improved by a segment's documents, for one item.

    ``asked`` are the numbers of its terms, ``factor`` holds weight times repeats by number, 0 for others.
    """
    asked = asked[(segment.start[asked + 1] > segment.start[asked]) & (factor[asked] > 0)]
    if not len(asked):
        return best
    start, end = segment.start[asked], segment.start[asked + 1]
    by = factor[asked]
    seen = np.zeros(len(segment.doc), bool)
    known = np.zeros(len(ids), bool)
    read, top = start.copy(), start.copy()
    stretch = STRETCH
    scores, names = best
    while True:
        # Sorted access: the next stretch of every list.
        sizes = np.minimum(end - read, stretch)
        upto = np.cumsum(sizes)
        at = np.arange(upto[-1]) + np.repeat(read - (upto - sizes), sizes)
        read = read + sizes
        met = np.unique(segment.doc[at])
        met = met[~known[met]]
        if len(met):
            known[met] = True
            # Direct access: all lists of the documents met.
            found, places = segment.lookup(met, factor)
            seen[places] = True
            scores, names = np.concatenate([scores, found]), np.concatenate([names, ids[met]])
            kept = _smallest(scores, names, k)
            scores, names = scores[kept], names[kept]
        top = _best_positions(seen, top, end)
        if (top == end).all():
            return scores, names
        # The last seen place of the unbroken stretch bounds what follows; a list that is seen to its end holds nothing more.
        bound = int((by * np.where(top < end, segment.falling[np.maximum(top - 1, start)], 0)).sum())
        if len(scores) == k and bound < scores[-1]:
            return scores, names
        stretch *= 2


def _best_positions(seen: np.ndarray, top: np.ndarray, end: np.ndarray, width: int = 64) -> np.ndarray:
    """The first unseen place of every list at or after ``top``."""
    top = top.copy()
    going = np.flatnonzero(top < end)
    while len(going):
        window = top[going, None] + np.arange(width)
        inside = window < end[going, None]
        unseen = ~(seen[np.where(inside, window, 0)] & inside)
        stop = unseen.any(axis=1)
        top[going] += np.where(stop, unseen.argmax(axis=1), width)
        going = going[~stop]
    return np.minimum(top, end)


def _searched(rows: DataFrame, items: Items, weights: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """Rows (item, id, score): the best of every task."""
    asked, times, width = items.asked, items.times, len(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = [(none, none)] * len(asked)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array([_LAST if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            found = batch.column(2)
            sizes = np.diff(found.offsets.to_numpy())
            segment = Segment(batch.column(1).to_numpy(zero_copy_only=False), sizes, found.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), docs, total, width)
            factor = np.zeros(width, np.int64)
            for q, (mine, often) in enumerate(zip(asked, times)):
                factor[mine] = weights[mine] * often
                best[q] = search(segment, ids, mine, factor, k, best[q])
                factor[mine] = 0
        number = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        if len(number):
            score, name = (np.concatenate([b[side] for b in best]) for side in (0, 1))
            made = [pa.array(number, pa.int64()), pa.array(name, pa.int64(), mask=name == _LAST), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["item", "id", "score"])

    return rows.select("id", "n", "terms", "tfs").mapInArrow(run, "item long, id long, score long")


def best(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", **bounds: int) -> DataFrame:
    """Rows (item_id, rank, id, score): the ``k`` documents with the highest scores above 0 of every item."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    out = None
    for block in blocks(items, item_col, item_text_col, **bounds):
        rows = cut(postings(docs, block.terms, id_col, text_col))
        sums = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
        if not sums["docs"]:
            continue
        held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        weights = np.zeros(len(block.terms), np.int64)
        for r in held:
            weights[r["term"]] = weight(sums["docs"], r["df"])
        found = _searched(rows, block, weights, sums["docs"], sums["total"], k).filter("score > 0")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        placed = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
        placed = placed.join(names, "item").select("item_id", "rank", "id", "score")
        out = placed if out is None else out.unionByName(placed)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))
    return out
