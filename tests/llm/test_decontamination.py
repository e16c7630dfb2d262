"""Multi-pattern search against plain search of all windows."""

import random
import re

from pyspark.sql import functions as F

from snapledger.llm import decontamination as dc


def plain(docs, items, window=10):
    out = {}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, it in items:
            iw = words(it)
            m = min(window, len(iw))
            wins = {tuple(iw[k:k + m]) for k in range(len(iw) - m + 1)} if m else set()
            for k in range(len(ws) - m + 1):
                if m and tuple(ws[k:k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found.add("" if item is None else str(item))
        out[doc] = (len(ws), len(hit), sorted(found))
    return out


def made(seed, vocabulary):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 25]))) for k in range(12)] + [(100, None), (None, text(12)), (3, text(14))]
    docs = []
    for k in range(40):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(items)[1] or "", text(rng.randint(0, 9))]
        docs.append((k, rng.choice([" ", "  ", ", ", "\n"]).join(parts).title()))
    return [*docs, (50, None), (51, ""), (52, "... !!"), (53, docs[0][1])], items


def test_matches_plain_search(spark):
    for seed, vocabulary in ((1, ["a", "b"]), (2, "the of and é straße ÀB x1 42".split()), (3, [f"w{k}" for k in range(300)])):
        docs, items = made(seed, vocabulary)
        frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
        bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_words int")
        for block in (dc.BLOCK_WINDOWS, 17):  # in one pass and in several
            rows = dc.contaminated(frame, bench, block_windows=block).select("doc_id", "hits.*", dc.hit_words(F.col("hits.spans")).alias("n_hit")).collect()
            assert {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in rows} == plain(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    (row,) = dc.contaminated(docs, none).collect()
    assert (row["hits"]["n_words"], list(row["hits"]["spans"]), list(row["hits"]["items"])) == (3, [], [])
    assert dc.contaminated(docs.limit(0), none).collect() == []


def test_items_longer_than_a_block_keep_every_window():
    rng = random.Random(5)
    words = [b"w%d" % rng.randint(0, 30) for _ in range(100)]
    whole = [tuple(words[k:k + 10]) for k in range(91)]
    for most in (1, 7, 90, 91, 200):
        pieces = list(dc._pieces("i", words, 10, most))
        assert [tuple(p[k:k + m]) for _, p, m in pieces for k in range(len(p) - m + 1)] == whole
        assert all(len(p) - m + 1 <= most for _, p, m in pieces)


def test_tables_stay_small():
    """A block's tables take some hundred bytes a window."""
    import pickle
    import tracemalloc
    rng = random.Random(6)
    pieces = [(str(k), [b"word%d" % rng.randint(0, 20_000) for _ in range(400)], 10) for k in range(100)]
    held = pickle.dumps(dc.Matcher(pieces))
    tracemalloc.start()
    kept = pickle.loads(held)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept.classes and used < 500 * 39_100


def test_a_column_of_the_results_name_stays(spark):
    docs = spark.createDataFrame([("a b c", "mine")], "text string, hits string")
    (row,) = dc.contaminated(docs, spark.createDataFrame([(1, "b")], "item_id long, text string")).collect()
    assert row["hits"] == "mine" and list(row[-1]["spans"]) == [1, 2]
    (row,) = dc.contaminated(docs, spark.createDataFrame([(1, "b")], "item_id long, text string"), text_col="hits").collect()
    assert row["hits"] == "mine" and row[-1]["n_words"] == 1
