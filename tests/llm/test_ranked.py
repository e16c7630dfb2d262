"""The best documents against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from snapledger.llm import ranked

DOCS = "doc_id long, text string, n int, terms string"
ITEMS = "item_id long, text string, rank int"


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, k=10):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        asked = Counter(words(text))
        scores = []
        for i, c, length in held:
            m = 25 + (75 * length * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                    for w, times in asked.items() if w in c)
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, at + 1, None if none else i, -s) for at, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10, **bounds):
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(5)
    right = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    return sorted((tuple(r) for r in ranked.best(left, right, k, **bounds).collect()), key=str)


def planted(seed=1, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcé9Z", k=rng.randint(1, 4))) for _ in range(120)]
    draw = lambda k: " ".join(rng.choices(vocabulary, weights=[1 / (r + 1) for r in range(len(vocabulary))], k=k))
    docs = [(k, draw(rng.randint(0, 60))) for k in range(n)]
    docs += [(1000 + k, "tie tie word") for k in range(40)]  # more equal scores than places
    docs += [(2000, None), (2001, ""), (2002, "-- !!"), (None, "tie tie word"), (3, "again"), (3, "again"), (2003, draw(20_000)), (2004, "a_b Aİ\x00c")]
    items = [(k, draw(rng.randint(1, 30))) for k in range(25)] + [(50, "tie"), (51, "again, AGAIN"), (52, None), (53, "nowhere99x"), (54, ""), (3, "tie"), (3, "tie"), (None, "word")]
    return docs, items


def test_all_places_and_scores(spark):
    docs, items = planted()
    assert found(spark, docs, items) == expected(docs, items)


@pytest.mark.parametrize("bounds", [{"most_terms": 1}, {"most_items": 3}])
def test_blocks_of_items(spark, bounds):
    docs, items = planted(2, 60)
    assert found(spark, docs, items, 4, **bounds) == expected(docs, items, 4)


def test_small_segments_and_stretches(spark, monkeypatch):
    docs, items = planted(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert found(spark, docs, items) == expected(docs, items)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_tables(spark):
    docs, items = planted(4, 20)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []
    assert found(spark, [(1, None), (2, "?!")], items) == []


def segment_of(lists, n=2000):
    """A segment of documents with random frequencies of a few terms."""
    rng = np.random.default_rng(5)
    per = [np.flatnonzero(rng.random(lists) < 0.4) for _ in range(n)]
    sizes = np.array([len(p) for p in per])
    term = np.concatenate(per)
    tf = rng.integers(1, 30, len(term))
    return ranked.Segment(rng.integers(10, 400, n), sizes, term, tf, n, 100 * n, lists), np.arange(n)


def test_reading_stops_early_by_best_positions():
    """Places seen by direct access lift the bound, so less is read than the lists hold, with the same result."""
    segment, ids = segment_of(4)
    factor = np.array([900, 500, 40, 3])
    none = np.empty(0, np.int64)
    looked = []
    whole = segment.lookup

    class Counted:
        def __getattr__(self, name):
            return getattr(segment, name)

        def lookup(self, met, by):
            looked.append(len(met))
            return whole(met, by)

    scores, names = ranked.search(Counted(), ids, np.arange(4), factor, 10, (none, none))
    everything, _ = whole(ids, factor)
    want = np.lexsort((ids, -everything))[:10]
    assert names.tolist() == ids[want].tolist() and scores.tolist() == everything[want].tolist()
    assert sum(looked) < 0.6 * len(ids)


def test_best_positions_pass_what_was_read():
    seen = np.array([1, 1, 0, 1, 1, 1, 1, 0, 0, 1] + [1] * 100, bool)
    got = ranked._best_positions(seen, np.array([0, 3, 8, 9]), np.array([3, 7, 9, 110]))
    assert got.tolist() == [2, 7, 8, 110]
