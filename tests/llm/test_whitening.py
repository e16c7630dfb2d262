"""Whitened vectors against numpy over all distinct vectors at once."""

import math

import numpy as np
import pytest

from snapledger.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component string"


def expected(rows, weights="one", components=16):
    kept = [(i, tuple(int(math.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = list(dict.fromkeys(x for _, x in kept)) if weights == "one" else [x for _, x in kept]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    moved = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(moved.T @ moved / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        apart = [n * c - s for c, s in zip(x, sums)]
        white = np.array(apart, float) / n @ vectors[:, :components] / np.sqrt(values[:components])
        out.setdefault(i, []).append((n, sum(a * a for a in apart), white, values[:components] / values.sum()))
    return out


def check(spark, rows, weights="one", components=16):
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = {}
    for r in whitening.whitened(docs, components, weights).collect():
        got.setdefault(r["id"], []).append(r)
    want = expected(rows, weights, components)
    assert set(got) == set(want)
    signs = {}
    for i, copies in want.items():
        width = len(copies[0][2])
        mine = sorted(got[i], key=lambda r: (r["component"], r["value"]))
        assert len(mine) == width * len(copies)
        for r in mine:
            n, deviation, white, share = copies[0]
            at = r["component"] - 1
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["explained"] == pytest.approx(share[at], rel=1e-9)
            if abs(white[at]) > 1e-6:
                sign = signs.setdefault(at, np.sign(white[at]) * np.sign(r["value"]))
                assert r["value"] * sign == pytest.approx(white[at], rel=1e-6, abs=1e-7)
            assert r["identity_error"] <= 1e-9
    return got


def vectors(seed=1, n=300, d=20):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.geomspace(1, 0.05, d)
    return [(k, [float(c) for c in v]) for k, v in enumerate((rng.normal(size=(n, d)) @ mix).astype(np.float32))]


def test_matches_numpy_over_distinct_vectors(spark):
    rows = vectors()
    rows += [(1000 + k, rows[5][1]) for k in range(400)] + [(5, rows[6][1])]  # one vector in over half of all rows, an id twice
    rows = [r for r in rows if r[0] != 5] + [(None, rows[7][1])]
    rows += [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [float("nan")] + rows[0][1][1:]), (2003, [float("-inf")] + rows[0][1][1:]), (2004, [])]
    check(spark, rows)


def test_counts_as_weights(spark):
    rows = vectors(2, 80, 6)
    rows += [(1000 + k, rows[k % 3][1]) for k in range(50)]
    check(spark, rows, "counts", 4)


def test_fewer_dimensions_than_components(spark):
    rows = vectors(3, 60, 3)
    got = check(spark, rows)
    assert all(len(v) == 3 for v in got.values())


def test_components_without_spread_do_not_exist(spark):
    rows = [(k, [v[0], v[1], 0.25]) for k, v in vectors(4, 40, 4)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    assert {r["component"] for r in whitening.whitened(docs).collect()} == {1, 2}
    assert whitening.whitened(docs.filter("vec_id = 0")).collect() == []
    assert whitening.whitened(docs.filter("false")).collect() == []


def test_several_lengths_are_refused(spark):
    docs = spark.createDataFrame([(1, [0.5], "a", "b"), (2, [0.5, 0.5], "a", "b")], SCHEMA)
    with pytest.raises(ValueError, match="lengths"):
        whitening.whitened(docs)


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[1_000_063, 999_937], [1_000_001, 1_000_000]], np.int64)
    n, sums = 40_000_000, np.array([40_000_000 * 1_000_000 + 17, 40_000_000 * 1_000_000 - 3], dtype=object)
    want = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    if max(want) < 1 << 63:
        assert whitening._deviations(x, n, sums) == want
    with pytest.raises(OverflowError):
        whitening._deviations(x, n * 10_000, sums * 10_000)
