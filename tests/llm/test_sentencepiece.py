"""The encoder against the library itself."""

import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from snapledger.llm.sentencepiece import encoded, encoder  # noqa: E402

FILE = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)
HARD = ["", " ", "   ", "a", "  a  b ", "\n\n", "aaaa" * 50, " " * 333, "▁x ▁▁", "🙂 ok\x00", "-" * 70, "12345 678", "日本語 テキスト", "é", "�　"]


def same(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    mine = encoder(FILE)
    assert mine.encode(text) == ids
    assert mine.decode(ids) == LIBRARY.decode(ids)
    assert mine.encode_packed(text)[1].decode() == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_joined_pieces_and_long_texts():
    rng = random.Random(1)
    pool = [p.replace("▁", " ") for p in encoder(FILE).pieces[259:]]
    for _ in range(3000):
        same("".join(rng.choice(pool) for _ in range(rng.randint(1, 8))))
    same("".join(rng.choice(pool) for _ in range(20_000)))
    same("x" * 50_000)


def test_rows_keep_their_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "some text", "c"), (3, "some text", "c")]
    found = encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"), FILE).collect()
    assert [(r["doc_id"], r["ids"]) for r in found] == [(1, "a"), (2, "b"), (3, "c"), (3, "c")]
    assert [r["tokens"]["n_tokens"] for r in found][:2] == [2, 2] and found[2]["tokens"]["decoded"] == "some text"
    assert encoded(spark.createDataFrame([], "text string"), FILE, digests=True).collect() == []
