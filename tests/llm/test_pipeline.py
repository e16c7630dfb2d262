"""Each stage of the pipeline against a plain version of it, and odd rows."""

import random

import pytest

import corpus_pipeline as cp
from snapledger.llm import simhash
from snapledger.llm.sentencepiece import encoder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables small enough for plain versions: two languages, poor texts, copies, a benchmark passage, and odd rows."""
    base = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 8)))
    docs, labels = [], []
    for k in range(400):
        lang = "aa" if k % 2 else "bb"
        text = " ".join(word("abcdeinorst" if k % 2 else "uvwxyzkmj") for _ in range(rng.randint(20, 60))) + "."
        if k % 10 == 3:
            text = "!! ".join(text.upper().split())
        docs.append((k, text, lang, "s", len(text)))
        labels.append((k, int(k % 10 != 3), 0))
    passage = " ".join(word("abcdeinorst") for _ in range(14))
    docs += [(500, docs[41][1], "aa", "s", 1), (501, docs[41][1], None, None, None), (502, docs[41][1] + " " + passage, "aa", "s", 3), (7, *docs[7][1:])]
    docs += [(503, None, None, None, None), (504, "", "aa", "s", 0), (505, "12 34", "aa", "s", 5), (None, docs[43][1] + " tail words", "aa", "s", 9)]
    for name, rows, schema in (("documents", docs, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, passage), (2, None)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}.parquet")
    return base


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in cp.STAGES:
        before = docs
        out = stage(spark, docs, folder)
        if name != "tokens":
            assert out.columns == before.columns
        docs = out.cache()
        kept.append([r["doc_id"] for r in docs.collect()])
    language, quality, single, clean, tokens = map(lambda x: sorted(x, key=str), kept)
    assert not {503, 504, 505} & set(language) and len(language) == 405
    poor = {k for k in range(400) if k % 10 == 3}
    assert not poor & set(quality) and set(range(400)) - poor <= set(quality)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: simhash.fingerprint(texts[i].encode()) for i in set(quality)}
    assert 41 in single and not {500, 501} & set(single) and single.count(7) == 1
    for i in single:
        for j in single:
            assert i == j or i is None or j is None or bin(prints[i] ^ prints[j]).count("1") > 2
    assert clean == [i for i in single if i != 502] and tokens == clean


def test_tokens_are_those_of_the_kept_texts(spark, folder):
    out = cp.run(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    model = encoder(cp.public_tokenizers.path("piece_bpe_32k.model"))
    assert out and all(bytes(r["ids"]) == model.encode_packed(texts[r["doc_id"]])[0] for r in out)


def test_stages_take_odd_and_empty_tables(spark, folder):
    odd = spark.createDataFrame([(1, None, None, None, None, "a", 1), (None, "", "x", "y", 3, "b", 2), (2, "12", None, None, -1, "c", 3)], COLUMNS + ", _hits string, language int")
    for name, stage in cp.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert name == "tokens" or out.columns == docs.columns
            assert len(rows) <= docs.count()


def test_clashing_columns_keep_their_values(spark, folder):
    text = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id = 0").first()["text"]
    names = ["_language", "_quality", "_hits", "_fp", "_turn", "_id"]
    docs = spark.createDataFrame([(0, text, "bb", "s", len(text), *names)] * 2, COLUMNS + "".join(f", {n} string" for n in names))
    for name, stage in cp.STAGES[:-1]:
        rows = stage(spark, docs, folder).collect()
        assert rows and len(rows) == (1 if name == "near_duplicates" else 2)
        assert all([r[n] for n in names] == names for r in rows)
