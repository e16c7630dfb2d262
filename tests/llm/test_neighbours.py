"""Links and components of vectors against all pairs in double precision."""

import numpy as np

from snapledger.llm.neighbours import _audit, _starts, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, grp int"


def brute(rows, threshold=0.93):
    def unit(v):
        if v is None or any(x is None for x in v):
            return None
        a = np.array(v, np.float32).astype(np.float64)
        return a / np.linalg.norm(a) if np.isfinite(a).all() and a.any() else None

    units = [unit(r[1]) if r[2] is not None else None for r in rows]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                degree[i] += 1
                degree[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(((r[0], degree[i], least.get(top(i))) for i, r in enumerate(rows)), key=str)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in near_vectors(frame).collect()), key=str)


def test_matches_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        base = rng.normal(size=(60, 16))
        # loose and tight groups, chains near the threshold, and a group larger than a block
        loose = base[:12].repeat(6, 0) + rng.normal(scale=0.22, size=(72, 16))
        tight = base[20][None] + rng.normal(scale=0.05, size=(450, 16))
        wide = base[30][None] + rng.normal(scale=0.26, size=(150, 16))
        for v in np.concatenate([base, loose, tight, wide]):
            rows.append((len(rows), [float(x) for x in v], label))
    rows += [(k + 5000, rows[0][1], 0) for k in range(5)] + [(0, rows[0][1], 0)]
    rows += [(6000, [2 * x for x in rows[0][1]], 0), (6001, [-x for x in rows[0][1]], 0), (6002, None, 0), (6003, [0.0] * 16, 0), (6004, [float("nan")] * 16, 0)]
    rows += [(6005, [float("inf")] + [0.0] * 15, 0), (6006, [None] + [1.0] * 15, 0), (6007, [1.0, 2.0], 0), (6008, [1.0, 2.0], 0), (None, rows[0][1], 0), (6009, [], 0)]
    assert found(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 0)]) == [(1, 0, 1)]
    assert found(spark, [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [0.0, 1.0], 0)]) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_audit_sees_isolated_pairs_beside_a_wide_group(spark):
    rng = np.random.default_rng(5)
    pairs = np.repeat(rng.normal(size=(30, 16)), 2, 0)
    vectors = np.concatenate([np.ones((300, 16)), pairs])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(k, "g", [float(x) for x in v], 0.0) for k, v in enumerate(vectors)]
    balls = spark.createDataFrame(rows, "node long, grp string, vec array<double>, radius double")
    wide = [(i, j) for j in range(300) for i in range(j)]
    whole = [(300 + 2 * k, 301 + 2 * k) for k in range(30)]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    assert _audit(balls, frame(wide + whole), 0.1, 400, 360) == (1.0, [])
    recall, groups = _audit(balls, frame(wide + whole[:24]), 0.1, 400, 360)  # a fifth of the pairs is lost, 0.01 % of all links
    assert abs(recall - 0.8) < 1e-9 and groups == ["g"]


def test_rounds_that_end_early_lose_no_link(spark):
    rng = np.random.default_rng(9)
    pairs = rng.normal(size=(700, 8)).repeat(2, 0) + rng.normal(scale=0.2, size=(1400, 8))
    rows = [(k, [float(x) for x in v], int(k % 3 == 0)) for k, v in enumerate(pairs)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = near_vectors(frame, max_rounds=0, starts=1, goal=1.0, queries=10_000).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_starts_grow_with_the_group():
    angle = float(np.arccos(0.93))
    assert [_starts(n, angle, 3) for n in (0, 100, 1000)] == [3, 3, 3]
    assert 3 < _starts(20_000, angle, 3) < _starts(80_000, angle, 3) < _starts(1 << 40, angle, 3) + 1 == 25
