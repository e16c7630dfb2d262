"""Groups of near copies against exact similarities of all pairs."""

import random

import pytest

import corpus_pipeline as cp
from snapledger.llm import simhash, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept_by_definition(rows):
    sets, parent = [grams(r[1]) for r in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 9 * len(a & b) >= 4 * (len(a) + len(b))):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(least.values())


def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeinorst", k=rng.randint(2, 8)))

    def changed(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = word()
        return words

    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(60, 300))]
        texts += [base] + [changed(base, rng.randint(1, len(base) // 30)) for _ in range(3)]  # on both sides of the limit
    base = [word() for _ in range(200)]
    texts += [changed(base, rng.randint(0, 4)) for _ in range(150)]  # a key of more nodes than a bucket
    line = [word() for _ in range(30)]
    texts += [line + [word() for _ in range(rng.randint(1, 12))] for _ in range(120)]  # common line, few links
    rng.shuffle(texts)
    return [(k, " ".join(t), "aa", "s", 1) for k, t in enumerate(texts)] + [(9000, "a b", "aa", "s", 1), (9001, "A  b", "aa", "s", 1), (9002, "", "aa", "s", 0)]


def test_stage_keeps_one_of_every_group(spark):
    rows = planted()
    want = kept_by_definition(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["doc_id"] for r in cp.duplicates_stage(spark, docs, "").collect()) == want


@pytest.mark.parametrize("bucket", [2, 10_000])
def test_hot_keys_lose_no_link(spark, bucket):
    rows = planted()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["doc_id"] for r in similar.deduplicated(docs, bucket).collect()) == kept_by_definition(rows)


def test_a_common_passage_makes_no_squares(spark, monkeypatch):
    """Texts of one passage and words of their own are not alike; what is compared grows with their number, not its square."""
    asked, whole = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, sets: asked.append(pairs.count()) or whole(pairs, sets))
    counts = []
    for n in (150, 300, 600):
        rng = random.Random(7)
        word = lambda: "".join(rng.choices("abcdeinorst", k=9))  # noqa: B023, E731
        passage = [word() for _ in range(60)]
        rows = [(k, " ".join(passage + [word() for _ in range(18)]), "aa", "s", 1) for k in range(n)]
        asked.clear()
        assert similar.deduplicated(spark.createDataFrame(rows, SCHEMA)).count() == n
        counts.append(sum(asked))
    assert counts[2] <= 4.5 * counts[0] and counts[2] < 600 * 599 / 2 / 5


@pytest.mark.parametrize("share", [0.8, 0.85, 0.9, 0.95])
def test_planted_pairs_are_all_found(spark, share):
    """Pairs whose similarity is this or just above it: 100 of 100, though candidates are drawn by hashes."""
    rng = random.Random(int(share * 100))
    word = lambda: "".join(rng.choices("abcdeinorst", k=8))
    rows = []
    for pair in range(100):
        base = [word() for _ in range(204)]  # 200 shingles; the last of both are exchanged
        other = round(200 * (1 - share) / (1 + share) - 1e-9)
        rows += [(2 * pair, " ".join(base), "aa", "s", 1), (2 * pair + 1, " ".join(base[: 204 - other] + [word() for _ in range(other)]), "aa", "s", 1)]
    kept = {r["doc_id"] for r in similar.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {2 * pair for pair in range(100)} == set(kept_by_definition(rows))


def test_pigeonring_links_are_candidates_and_compared_exactly(spark, monkeypatch):
    """Without any shared key, near fingerprints alone still bring copies together, and only those that are alike."""
    nothing = spark.createDataFrame([], "src long, dst long")
    monkeypatch.setattr(similar, "_starred", lambda *_: nothing)
    monkeypatch.setattr(similar, "_across", lambda *_: nothing)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeinorst", k=8))
    rows = []
    for pair in range(40):
        base = [word() for _ in range(400)]
        rows += [(2 * pair, " ".join(base), "aa", "s", 1), (2 * pair + 1, " ".join([*base[:-1], word()]), "aa", "s", 1)]
    prints = {r[0]: simhash.fingerprint(r[1].encode()) for r in rows}
    linked = [p for p in range(40) if bin(prints[2 * p] ^ prints[2 * p + 1]).count("1") <= 2]
    kept = {r["doc_id"] for r in cp.duplicates_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert len(linked) > 20 and kept == {r[0] for r in rows} - {2 * p + 1 for p in linked}


def test_linked_fingerprints_that_are_not_alike_stay_apart(spark):
    """Repeated words set the fingerprint, and a few others change most of the distinct shingles: one fingerprint, but no link."""
    rows = [(1, "a b c " * 20, "aa", "s", 1), (2, "a b c " * 10 + "x y " + "a b c " * 10, "aa", "s", 1), (3, "1 2 3", "aa", "s", 1)]
    kept = sorted(r["doc_id"] for r in similar.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect())
    assert bin(simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).count("1") <= 2
    assert kept == kept_by_definition(rows) == [1, 2, 3]
