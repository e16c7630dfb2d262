"""Classifiers: accuracy on rows they have not seen, and defined results for odd rows."""

import random

import numpy as np
import pytest

from snapledger.llm import language, quality, toxicity

LETTERS = {"aa": "abcdeinorst", "bb": "uvwxyzkmjéü", "cc": "дежзийкло"}


def words(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))


def test_language_of_unseen_texts():
    rng = random.Random(1)
    rows = [(lang, words(rng, letters, rng.randint(20, 80))) for lang, letters in LETTERS.items() for _ in range(60)]
    model = language.train([t.encode() for _, t in rows], [x for x, _ in rows], steps=60)
    unseen = [(lang, words(rng, letters, n)) for lang, letters in LETTERS.items() for n in (3, 30, 5000)]
    found = model.label([t.encode() for _, t in unseen])
    assert [f[0] for f in found] == [x for x, _ in unseen] and all(0 < s <= 1 for _, s in found)
    assert model.label([None, b"", b"12 3 !", b"\xc2\xa9"]) == [("und", 0.0)] * 4
    # A text gets the same result whatever stands beside it.
    alone = model.label([unseen[2][1].encode()])
    assert alone[0][0] == found[2][0] and abs(alone[0][1] - found[2][1]) < 1e-4


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    h, x = language.HIDDEN, rng.integers(0, 256, (7, 3)).astype(np.uint8)
    table, rec = rng.normal(0, 0.5, (3 * h, 256)), rng.normal(0, 0.5, (3 * h, h))
    weight = rng.normal(size=(7, h, 3))
    value = lambda t, r: float((language._forward(x, t, r)[0].astype(float) * weight).sum())
    _, tape = language._forward(x, table, rec, keep=True)
    g_table, g_rec = np.zeros_like(table), np.zeros_like(rec)
    language._backward(x, tape, rec, weight, g_table, g_rec)
    for at, grad, base in ((("r", 2, 1), g_rec, rec), (("r", 3 * h - 1, 0), g_rec, rec), (("t", 1, x[2, 0]), g_table, table), (("t", 2 * h, x[0, 1]), g_table, table)):
        kind, i, j = at
        up, down = base.copy(), base.copy()
        up[i, j] += 1e-3
        down[i, j] -= 1e-3
        numeric = (value(up, rec) - value(down, rec) if kind == "t" else value(table, up) - value(table, down)) / 2e-3
        assert abs(numeric - grad[i, j]) < 2e-2 * max(1, abs(numeric))


def test_language_rows_and_fit(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, letters, 30), lang) for lang, letters in LETTERS.items() for k in range(20)]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "", None), (902, "x", None)], "doc_id long, text string, lang string")
    out = language.identified(docs, language.fit(docs)).collect()
    assert len(out) == 63 and out[60]["language"]["lang"] == "und" and out[0]["lang"] == "aa"
    assert all(r["language"]["lang"] == "und" for r in language.identified(docs, language.fit(docs.limit(0))).collect())
    assert language.identified(docs.limit(0), language.Model([], [])).collect() == []


BAD = ["idiot", "moron", "scumbag", "worthless"]


def toxic_texts(rng, n):
    out = []
    for k in range(n):
        ws = words(rng, "abcdefghijklmnoprst", rng.choice([5, 40, 300])).split()
        if k % 5 == 0:
            for _ in range(max(1, len(ws) // 40)):
                ws.insert(rng.randint(0, len(ws)), rng.choice(BAD))
        out.append((" ".join(ws), int(k % 5 == 0)))
    return out


@pytest.fixture(scope="module")
def toxic_model():
    rows = toxic_texts(random.Random(1), 700)
    return toxicity.train([t.encode() for t, _ in rows], np.array([y for _, y in rows]))


def test_toxicity_of_unseen_texts_and_misspellings(toxic_model):
    rng = random.Random(9)
    rows = toxic_texts(rng, 300)
    score = toxic_model.scores([t.encode() for t, _ in rows])
    assert np.mean((score >= 0.5) == [y for _, y in rows]) > 0.97
    plain = words(rng, "abcdefghijklmnoprst", 300)
    one = plain + " you worthless idiot " + plain
    a, b, c, d = toxic_model.scores([plain.encode(), one.encode(), one.upper().encode(), b"you idiotts scumbagg"])
    assert a < 0.5 <= min(b, c) and d > a


def test_toxicity_odd_rows(spark, toxic_model):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "?! ..", 0.5), (4, "a plain text", 0.5), (4, "a plain text", 0.5)], "doc_id long, text string, score double")
    out = [r["toxicity"] for r in toxicity.scored(docs, toxic_model).collect()]
    assert out[0] == out[1] == out[2] and out[3] == out[4] and all(0 <= s <= 1 for s in out)
    none = docs.selectExpr("doc_id", "text", "cast(null as int) as toxic")
    assert all(r["toxicity"] < 1e-6 for r in toxicity.scored(docs, toxicity.fit(none)).collect())
    long = b"word " * 200_000 + b"idiot"
    assert toxic_model.scores([long])[0] >= 0.5


def good(rng, n):
    return [words(rng, "abcdeinorst", rng.choice([3, 30, 400])).capitalize() + "." for _ in range(n)]


def poor(rng, n):
    shapes = [lambda t: "!! ".join(t.upper().split()), lambda t: " | ".join(t.split()), lambda t: "$$$ ".join(t.split()), lambda t: (t.split()[0] + " ") * 60]
    return [rng.choice(shapes)(words(rng, "abcdeinorst", rng.choice([15, 50, 300]))) for _ in range(n)]


def test_quality_of_unseen_texts():
    rng = random.Random(4)
    texts, labels = good(rng, 400) + poor(rng, 80), [1] * 400 + [0] * 80
    model = quality.train(quality.matrix([t.encode() for t in texts], [len(t) for t in texts]), np.array(labels, np.float32))
    unseen, truth = good(rng, 200) + poor(rng, 60), np.array([1] * 200 + [0] * 60)
    score = model.scores([t.encode() for t in unseen], [None] * len(unseen))
    assert np.mean((score >= 0.7) == truth) > 0.97


def test_pairs_by_the_square_of_the_sum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3, quality.FEATURES)).astype(np.float64)
    x[:, 12:] = 0
    machine = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 4)))
    gram = machine.factors @ machine.factors.T
    want = [0.3 + row @ machine.weights + sum(gram[i, j] * row[i] * row[j] for i in range(12) for j in range(i)) for row in x]
    assert np.allclose(machine.logits(x), want)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "x", 1), (3, "a b", "3", 0), (3, "a b", "3", 0)], "doc_id long, text string, n_chars string, quality int")
    out = [r["quality_score"] for r in quality.scored(docs, quality.fit(docs)).collect()]
    assert len(out) == 4 and all(0 <= s <= 1 for s in out) and out[2] == out[3]
    assert all(r["quality_score"] == 1.0 for r in quality.scored(docs, quality.fit(docs.limit(0))).collect())


def test_signs_of_numbers_are_no_letters():
    assert [language._lettered(t) for t in ("½ ² ③ Ⅷ 12 _", "", "x", "½a", "é", "ж", "中", "ª")] == [False, False, True, True, True, True, True, True]
