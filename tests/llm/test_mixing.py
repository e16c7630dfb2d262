"""The schedule and the mix against a plain walk through every source's words."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from snapledger.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, slot int"


def goals_of(sizes):
    """Sharing again until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left / whole > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * left / whole for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def expected(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    goals = goals_of(sizes)
    out, start = [], Counter()
    order = lambda r: (hashlib.md5(f"{'' if r[0] is None else r[0]} {r[1] or ''}".encode()).hexdigest(), r[0] is not None, r[0] or 0)
    for i, t, s in sorted(rows, key=order):
        n, goal = size(t), int(goals[s])
        took = sum(1 for k in range(start[s], start[s] + n) for turn in (0, 1) if turn * sizes[s] + k < goal)
        start[s] += n
        out.append((i, n, sizes[s], goals[s], took))
    return out


def found(spark, rows, block=64):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    docs = mixing.sized(docs)
    return [tuple(r) for r in mixing.taken(docs, mixing.targets(docs), block).collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (*g[:3], g[4]) == (*w[:3], w[4])
        assert g[3] == pytest.approx(w[3])


def planted():
    rng = random.Random(3)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 90))), rng.choice(["a", "b", "é", "", None, "Z"])) for k in range(400)]
    rows += [(900, "one long " * 900, "a"), (901, None, "b"), (902, "", None), (903, " \t\n\x0b ", "Z"), (None, "no id here", "b"), (904, "alone", "tiny")]
    rows += [(905, None, "wordless"), (906, "a b c\x1fd", "b")]
    return rows


def test_words_taken_match_a_walk_through_the_streams(spark):
    rows = planted()
    got = found(spark, rows)
    same(got, expected(rows))
    assert all(took <= 2 * n for _, n, _, _, took in got)


def test_repeated_rows_and_a_hot_row(spark):
    rows = planted() + [(7, "again and again", "a")] * 700 + [(None, "again and again", "a")] * 300
    same(found(spark, rows, 16), expected(rows))


def test_equal_inputs_give_equal_results_however_spread(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in planted() + [(7, "twice", "a")] * 50], SCHEMA)
    results = []
    for frame in (docs.repartition(1), docs.repartition(7, F.rand(1)), docs.orderBy(F.desc("text"))):
        read = mixing.sized(frame)
        results.append(sorted(map(str, mixing.taken(read, mixing.targets(read)).collect())))
    assert results[0] == results[1] == results[2]


def test_the_mix_is_gapless_and_every_stretch_has_the_shares(spark):
    docs = mixing.sized(spark.createDataFrame([(k, "w " * 200, "abc"[k % 3], "x", 1) for k in range(3000)], SCHEMA))
    goals = mixing.targets(docs)
    slots = mixing.schedule(goals, 64).collect()
    assert sorted(r["slot"] for r in slots) == list(range(len(slots)))
    quota = {r["place"]: r["quota"] for r in goals.collect()}
    by = defaultdict(int)
    for r in slots:
        by[r["place"]] += r["words"]
    assert by == quota
    total = sum(quota.values())
    order = [r["place"] for r in sorted(slots, key=lambda r: r["slot"])]
    for at in range(0, len(order) - 400, 400):
        here = Counter(order[at : at + 400])
        for place, words in quota.items():
            assert abs(here[place] - 400 * words / total) <= 6
    # Every slot's words are there, from consecutive documents of its block.
    filled = defaultdict(int)
    for r in mixing.mixed(docs, goals, 64).collect():
        filled[r["slot"]] += r["n_words"]
    assert filled == {r["slot"]: r["words"] for r in slots}


def test_ranks_go_on_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 16)
    rows = planted()
    same(found(spark, rows, 8), expected(rows))


def test_points_are_the_golden_ratio_without_overflow(spark):
    slots = [0, 1, 2, (1 << 20) - 1, 1 << 20, (1 << 39) + 12345, (1 << 40) - 1]
    got = spark.createDataFrame([(s,) for s in slots], "s long").select("s", mixing._points(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in got] == [r["s"] * mixing.STEP % (1 << 40) for r in got]


def test_nothing_in_and_nothing_to_take(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, "a"), (2, "", None)]) in ([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)], [(2, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)])


def test_the_main_path_has_no_python(spark):
    docs = mixing.sized(spark.createDataFrame([(k, "a b", "s", "x", 1) for k in range(9)], SCHEMA))
    plan = mixing.taken(docs, mixing.targets(docs))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
