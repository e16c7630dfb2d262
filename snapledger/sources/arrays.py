"""Files that hold JSON arrays, read record by record in byte ranges.

A first pass reads every block of every file once and says how its quotes, brackets and commas would change the state of a reader that
comes in outside a string or inside one: a few numbers per block, from the data source ``json_array_blocks``. Running sums of them give the
state at the start of every block, so the second pass cuts the records of each block by itself. A file of any size is spread over as many
tasks as it has blocks; a task holds one block, and beyond it only a record that reaches into the next ones.

Defined results: a record is what lies between two separators, the opening bracket of an array and the commas directly inside it; white
space at its ends is left out. Nothing is dropped: a record that is no JSON object of the schema (malformed, a number, null, an array, empty
between commas) stays with its text in ``raw`` and in ``corrupt_record``. If quotes or brackets do not match, all text up to the next
separator that can be told, or to the end of the file, is one such record. Arrays that follow each other in a file are read as one; an empty
array and an empty file have no records; a file that does not begin with a bracket is one record. ``position`` counts the
separators before the record in its file. Bytes that are no UTF-8 become replacement characters. Names that begin with ``_`` or ``.`` are
not read. Paths are those that ``pyarrow.fs`` opens (local or shared files, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from snapledger.session import ensure_checkpoint_dir

BLOCK = 32 << 20
RECORDS = 1024
MOST_TASKS = 8192
BLOCK_DDL = (
    "path string, start long, stop long, is_array boolean, quotes long, change_out long, change_in long,"
    " found_out map<long,long>, found_in map<long,long>"
)
RECORD_DDL = "path string, position long, raw string, is_object boolean"
_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = b'"\\,[]'
_SPACE = b" \t\r\n"
_BOM = b"\xef\xbb\xbf"
# What a byte does to the depth; commas are marked apart.
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_SIGN = _STEP != 0
_SIGN[_COMMA] = True


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


def _backslashes(file, start: int) -> int:
    """How many backslashes end right before ``start``."""
    run, at = 0, start
    while at:
        size = min(at, 4096)
        part = file.read_at(size, at - size)
        here = len(part) - len(part.rstrip(b"\\"))
        run += here
        if here < size:
            break
        at -= size
    return run


def _quotes(block: np.ndarray, carried: int) -> np.ndarray:
    """Places of the quotes no backslash escapes; ``carried`` backslashes stand before the block."""
    places = np.arange(len(block))
    plain = np.maximum.accumulate(np.where(block != _BACKSLASH, places, -1))
    found = np.flatnonzero(block == _QUOTE)
    before = np.where(found > 0, plain[found - 1], -1)
    run = found - 1 - before + np.where(before < 0, carried, 0)
    return found[run % 2 == 0]


def _signs(block: np.ndarray, quotes: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, bytes and depth before of the brackets and commas outside strings, counted from the start of the block."""
    places = np.flatnonzero(_SIGN[block])
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    signs = block[places]
    steps = _STEP[signs]
    return places, signs, np.cumsum(steps) - steps


def _separators(file, start: int, stop: int, inside: int, depth: int) -> tuple[bytes, np.ndarray, int, int]:
    """A block, the places of its separators, and the state after it."""
    data = file.read_at(stop - start, start)
    block = np.frombuffer(data, np.uint8)
    quotes = _quotes(block, _backslashes(file, start))
    places, signs, before = _signs(block, quotes, inside)
    before = before + depth
    cuts = places[((signs == _COMMA) & (before == 1)) | ((signs == _OPEN) & (before == 0))]
    return data, cuts, (inside + len(quotes)) % 2, depth + int(_STEP[signs].sum())


def _summary(file, start: int, stop: int) -> tuple:
    """What the block does to a reader outside a string and to one inside: depth, and separators by the depth it would come in with."""
    block = np.frombuffer(file.read_at(stop - start, start), np.uint8)
    quotes = _quotes(block, _backslashes(file, start))
    changes, found = [], []
    for inside in (0, 1):
        _, signs, before = _signs(block, quotes, inside)
        fits = np.concatenate([1 - before[signs == _COMMA], -before[signs == _OPEN]])
        depths, times = np.unique(fits[fits >= 0], return_counts=True)
        changes.append(int(_STEP[signs].sum()))
        found.append(dict(zip(depths.tolist(), times.tolist())))
    return len(quotes), *changes, *found


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _BlockReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        asked = store.get_file_info(root)
        listed = [asked] if asked.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [i for i in listed if i.is_file and i.size and not any(p[0] in "_." for p in i.path[len(root):].split("/") if p)]
        return [_Range(i.path, at, min(at + self.block, i.size)) for i in files for at in range(0, i.size, self.block)]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None or not hasattr(partition, "path"):  # Spark asks once without a range if there are no files
            return
        with _store(self.path)[0].open_input_file(partition.path) as file:
            head = file.read_at(4096, 0).removeprefix(_BOM).lstrip(_SPACE) if partition.start == 0 else b"["
            yield partition.path, partition.start, partition.stop, head[:1] == b"[", *_summary(file, partition.start, partition.stop)


class JsonArrayBlocks(DataSource):
    """``spark.read.format("json_array_blocks").option("blockSize", n).load(path)``: one row per byte range of every file."""

    @classmethod
    def name(cls) -> str:
        return "json_array_blocks"

    def schema(self) -> str:
        return BLOCK_DDL

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options["path"], int(self.options.get("blockSize", BLOCK)))


def _trimmed(data: bytes, last: bool) -> bytes:
    """A record without white space at its ends; the last one of an array loses the closing bracket."""
    data = data.strip(_SPACE)
    return data[:-1].rstrip(_SPACE) if last and data.endswith(b"]") else data


def _is_object(data: bytes) -> bool:
    """Whether the brackets make one object of all the bytes; Spark's parser would overlook what follows the first one."""
    if data[:1] != b"{":
        return False
    block = np.frombuffer(data, np.uint8)
    places, signs, before = _signs(block, _quotes(block, 0), 0)
    closed = places[before + _STEP[signs] == 0]
    return len(closed) > 0 and int(closed[0]) == len(data) - 1


def _records(file, size: int, row: dict, block: int) -> Iterator[tuple[int, bytes]]:
    """The records whose separator lies in the block."""
    if not row["is_array"]:
        if row["start"] == 0 and (text := file.read_at(size, 0).removeprefix(_BOM).strip(_SPACE)):
            yield 0, text
        return
    data, cuts, inside, depth = _separators(file, row["start"], row["stop"], row["inside"], row["depth"])
    ends = cuts[1:].tolist()
    for k, at in enumerate(cuts.tolist()):
        if k < len(ends):
            part, closed = data[at + 1 : ends[k]], data[ends[k]] == _OPEN
        else:
            # The record goes on behind the block up to the next separator or the end of the file.
            parts, here, closed = [data[at + 1 :]], row["stop"], True
            while here < size:
                more, found, inside, depth = _separators(file, here, min(here + block, size), inside, depth)
                if len(found):
                    parts.append(more[: found[0]])
                    closed = more[found[0]] == _OPEN
                    break
                parts.append(more)
                here += len(more)
            part = b"".join(parts)
        text = _trimmed(part, closed)
        if text or data[at] == _COMMA or not closed:
            yield row["position"] + k, text


def read_arrays(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Rows (path, position, raw, is_object) of all records of the files at ``path``."""
    spark.dataSource.register(JsonArrayBlocks)
    ensure_checkpoint_dir(spark)
    blocks = spark.read.format("json_array_blocks").option("blockSize", block).load(path).checkpoint()
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)

    def so_far(column):
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    outside = F.col("inside") == 0
    states = blocks.withColumn("inside", so_far(F.col("quotes")) % 2)
    states = states.withColumn("depth", so_far(F.when(outside, F.col("change_out")).otherwise(F.col("change_in"))))
    found = F.when(outside, F.try_element_at("found_out", "depth")).otherwise(F.try_element_at("found_in", "depth"))
    states = states.withColumn("position", so_far(F.coalesce(found, F.lit(0))))
    states = states.withColumn("is_array", F.first("is_array").over(whole))
    # One row stands for a whole block of work, so the number of tasks is named and not merged by size.
    tasks = max(1, min(blocks.count(), MOST_TASKS))
    dealt = states.select("path", "start", "stop", "is_array", "inside", "depth", "position").repartition(tasks, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(path)[0]
        for row in (r for b in batches for r in b.to_pylist()):
            with store.open_input_file(row["path"]) as file:
                held: list[tuple[int, bytes]] = []
                for record in _records(file, file.size(), row, block):
                    held.append(record)
                    if len(held) == RECORDS:
                        yield _batch(row["path"], held)
                        held = []
                yield _batch(row["path"], held)

    return dealt.mapInArrow(run, RECORD_DDL)


def _batch(path: str, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    texts = [t.decode("utf-8", "replace") for _, t in held]
    columns = [
        pa.array([path] * len(held), pa.string()), pa.array([p for p, _ in held], pa.int64()), pa.array(texts, pa.string()),
        pa.array([_is_object(t) for _, t in held], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["path", "position", "raw", "is_object"])


def load_arrays(spark: SparkSession, path: str, ddl: str, block: int = BLOCK) -> DataFrame:
    """Records of JSON array files parsed with ``ddl``: path, position, raw, record and corrupt_record (null if the record is good)."""
    rows = read_arrays(spark, path, block)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(F.when(F.col("is_object"), F.col("raw")), f"{ddl}, _corrupt string", options)
    whole = rows.select("path", "position", "raw", "is_object", parsed.alias("parsed"))
    bad = F.when(F.col("is_object"), F.col("parsed._corrupt")).otherwise(F.col("raw"))
    return whole.select("path", "position", "raw", F.col("parsed").dropFields("_corrupt").alias("record"), bad.alias("corrupt_record"))
