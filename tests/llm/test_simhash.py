"""Fingerprints by definition, links and components against all pairs."""

import random
import re

import xxhash

from snapledger.llm import simhash
from snapledger.llm.components import components


def by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "A b", "é É\tx y", "a b c", " ".join(rng.choices("abcd", k=500)), " ".join(rng.choices(["x", "yy"], k=40_000))]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == by_definition(t)


def classes(fps, limit=2):
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= limit:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {f: top(f) for f in fps}


def planted(rng, dense):
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1, 1]
    for f in fps[:60]:
        for _ in range(3):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.append(f)
    base = rng.getrandbits(64)
    fps += [base ^ rng.getrandbits(64) & ((1 << dense) - 1) for _ in range(400)]  # many share most segments
    return [signed(f) for f in fps]


def test_components_lose_no_link(spark):
    rng = random.Random(5)
    for bucket, segments, limit, dense in ((64, 8, 2, 24), (2, 8, 2, 24), (10_000, 16, 2, 12), (64, 8, 3, 10), (64, 4, 1, 10), (64, 8, 0, 8)):
        fps = planted(rng, dense)
        rows = spark.createDataFrame([(k * 7 % 1009, f) for k, f in enumerate(fps)] + [(5000, fps[0]), (None, fps[1])], "id long, fp long")
        want, least = classes(set(fps), limit), {}
        for r in rows.collect():
            c = want[r["fp"]]
            if r["id"] is not None:
                least[c] = min(least.get(c, r["id"]), r["id"])
        got = {r["fp"]: r["component"] for r in simhash.components_of(rows, limit, segments, bucket).collect()}
        assert got == {f: least[c] for f, c in want.items()}


def test_near_duplicates_and_kept_rows(spark):
    text = "one two three four five six seven " * 20
    rows = [(9, text, 1), (4, text, 2), (4, text, 2), (7, None, 3), (2, "", 4), (11, "quite another text than that", 5), (None, text, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["id"], r["component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(9, 4), (4, 4), (4, 4), (7, 2), (2, 2), (11, 11), (None, 4)], key=str)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 11]
    nameless = docs.filter("doc_id is null")
    assert [tuple(r) for r in simhash.deduplicated(nameless).collect()] == [(None, text, 6)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.deduplicated(docs.limit(0)).collect() == []


def test_components_of_long_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 500)]
    loop = [(5000, 5000), (6000, 6001), (6001, 6000)]
    found = components(spark.createDataFrame(path + star + loop, "src long, dst long"))
    roots = {}
    for r in found.collect():
        roots.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, roots.values())) == [list(range(301)), list(range(1000, 1500)), [6000, 6001]]
