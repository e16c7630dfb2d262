"""Archives: exact round trips, refusals, and which record revisits which."""

import hashlib

import pytest
import zstandard

from snapledger.llm import warc

SCHEMA = "page_id long, url string, html string, id string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def around(spark, rows, **options):
    folder = warc.archive_folder(spark)
    names = warc.write_archives(pages(spark, rows), folder, **options)
    return names, warc.read_archives(spark, folder, names).collect()


def test_round_trip_with_copies_nulls_and_long_payloads(spark):
    same, long = "é" * 80, "x" * 300_000
    rows = [(3, "http://c", same), (1, "http://a b", same), (2, None, same), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (8, "u", long), (None, "u", same), (1, "http://a b", same)]
    _, found = around(spark, rows)
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["id"], []).append(r)
    digest = hashlib.sha256(same.encode()).hexdigest()
    assert [r["kind"] for r in by["1"]] == ["response", "response"]  # a repeated row with the smallest id
    assert all(bytes(r["payload"]).decode() == same for r in by["1"])
    for name in ("2", "3", None):
        (r,) = by[name]
        assert (r["kind"], r["refers_to"], r["digest"], r["payload_bytes"]) == ("revisit", "1", digest, len(same.encode()))
    assert [by[n][0]["kind"] for n in ("4", "5", "6", "7", "8")] == ["response"] * 5
    assert bytes(by["8"][0]["payload"]).decode() == long and by["4"][0]["payload_bytes"] == 0


def test_empty_table_and_rows_without_ids(spark):
    assert around(spark, []) == ([], [])
    _, found = around(spark, [(None, "u", "z" * 200), (None, "u", "z" * 200)])
    assert [(r["kind"], r["id"]) for r in found] == [("response", None)] * 2


def test_small_archives_and_a_dictionary(spark):
    rows = [(k, f"http://a/{k}", f"<html><body><p>page {k} of the same kind</p></body></html>" * 3) for k in range(400)]
    names, found = around(spark, rows, archive_bytes=20_000)
    assert len(names) > 2 and {int(r["id"]): bytes(r["payload"]).decode() for r in found} == {r[0]: r[2] for r in rows}


@pytest.fixture
def record():
    return warc.record("response", "1", "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None)


def frame(*records, dictionary=None):
    return b"".join(warc.write_frames(iter(records), dictionary))


def test_dictionary_frame_is_read_plain_and_compressed(record):
    trained = zstandard.train_dictionary(1 << 10, [record + bytes([65 + k % 26]) * (k % 50) for k in range(300)]).as_bytes()
    plain = frame(record, record, dictionary=trained)
    assert int.from_bytes(plain[:4], "little") == warc.DICTIONARY_MAGIC
    packed = zstandard.compress(trained)
    other = plain[:4] + len(packed).to_bytes(4, "little") + packed + plain[8 + len(trained):]
    for archive in (plain, other):
        assert [r["payload"] for r in warc.read_frames(archive)] == [b"payload"] * 2


@pytest.mark.parametrize("spoil", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"Content-Length: 7", b"Content-Length: 8"),
    lambda r: r.replace(b"payload\r\n", b"paYload\r\n"), lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: rumour"),
    lambda r: r.replace(b"WARC-Date", b"WARC-Type"), lambda r: r.replace(b"WARC-Date:", b"no colon here"), lambda r: r[:-1],
])
def test_bad_records_are_refused(record, spoil):
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(frame(spoil(record))))


def test_bad_archives_are_refused(record):
    good = frame(record)
    for bad in (good[:-3], good + b"junk", warc.DICTIONARY_MAGIC.to_bytes(4, "little") + (99).to_bytes(4, "little") + b"x"):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_frames(bad))
