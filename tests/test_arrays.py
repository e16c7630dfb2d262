"""JSON array files cut into records at any block size, against a reader of whole files."""

import json
import random

import pytest

from snapledger.sources.arrays import load_arrays, read_arrays

NASTY = ['a"b', "\\", "\\\\\"", "[,]", "}{", "é€𝄞", ",", "", "\\\"[", "\n"]


def values(rng, n):
    def one(deep):
        kind = rng.randrange(6 if deep else 4)
        if kind < 2:
            return "".join(rng.choices(NASTY, k=rng.randint(0, 4)))
        if kind == 2:
            return rng.randint(-9, 99)
        if kind == 3:
            return rng.choice([None, True, 1.5])
        return [one(False) for _ in range(3)] if kind == 4 else {rng.choice(NASTY): one(False), "k": one(False)}

    return [one(True) for _ in range(n)]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_records_of_any_block_size(spark, tmp_path, block):
    rng, want = random.Random(block), {}
    for k, n in enumerate((0, 1, 9, 17)):
        held = values(rng, n)
        text = json.dumps(held, ensure_ascii=k % 2 == 0, indent=[None, 2][k // 2])
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
        want[f"f{k}.json"] = held
    (tmp_path / "_skipped.json").write_text("[1]")
    (tmp_path / "empty.json").write_text("")
    rows = sorted((r.path.rsplit("/", 1)[1], r.position, r.raw) for r in read_arrays(spark, f"file://{tmp_path}", block).collect())
    assert [(name, at, json.loads(raw)) for name, at, raw in rows] == [(name, at, v) for name, held in sorted(want.items()) for at, v in enumerate(held)]


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_bad_records_stay(spark, tmp_path, block):
    def read(text):
        (tmp_path / "a.json").write_bytes(text)
        found = load_arrays(spark, f"file://{tmp_path}/a.json", "a STRING, b BIGINT", block).collect()
        return [(r.position, r.record.a if r.record else None, r.corrupt_record) for r in sorted(found, key=lambda r: r.position)]

    assert read(b'\xef\xbb\xbf [ {"a":"x"} , {"a":}, 7,null,,[{"a":"y"}],{"a":"z","b":[1,2]}, {"a":"w"}]\n') == [
        (0, "x", None), (1, None, '{"a":}'), (2, None, "7"), (3, None, "null"), (4, None, ""), (5, None, '[{"a":"y"}]'),
        (6, "z", '{"a":"z","b":[1,2]}'), (7, "w", None)]
    # No end, a bracket too many, an open string: what cannot be told apart is one record.
    assert read(b'[{"a":"x"},{"a":"y"')[1][2] == '{"a":"y"'
    assert read(b'[{"a":"x"},{"a":"y"}},{"a":"z"}]')[1][2] == '{"a":"y"}},{"a":"z"}'
    assert read(b'[{"a":"x"},{"a":"y},{"a":"z"}]')[-1][2] is not None
    assert read(b'{"a":"x"}, 1') == [(0, None, '{"a":"x"}, 1')]
    assert read(b'{"a":"x"}') == [(0, "x", None)]
    assert [r[1] for r in read(b'[{"a":"x"}]\n[{"a":"y"},{"a":"z"}]')] == ["x", "y", "z"]
    assert read(b" [ ]") == [] and read(b"  ") == []


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": str(k)} for k in range(2000)]))
    rows = read_arrays(spark, f"file://{tmp_path}", 1000)
    assert rows.rdd.getNumPartitions() > 20 and rows.select("position").distinct().count() == 2000


def test_a_folder_without_files_has_no_records(spark, tmp_path):
    assert load_arrays(spark, f"file://{tmp_path}", "a STRING").collect() == []
    with pytest.raises(Exception, match="(?i)not.?found|no such file|does not exist"):
        load_arrays(spark, f"file://{tmp_path}/none", "a STRING")
