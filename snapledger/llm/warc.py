"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are files in a folder that all executors share. A task writes each archive under a name of its own attempt; only the names
that successful tasks report belong to the set, so a repeated or abandoned task adds nothing. Reading loads the dictionary from the
leading skippable frame, decodes one frame per record, and refuses a record whose version line, headers, length, type, digest or end
does not hold.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is a response and the others revisit it.

Defined results: a null payload is an empty one; rows that share the smallest id of a payload are all responses; a null id is written
without a name and never referred to, and rows whose payload has no id at all are responses; an empty table gives no archive and no
rows. Columns other than id, URI and payload are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import cut
from snapledger.session import ensure_checkpoint_dir

DICTIONARY_MAGIC = 0x184D2A5D  # fixed value of the format: the skippable frame that holds a dictionary
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"  # fixed value of the format: a Zstandard frame
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = {"response", "revisit"}
# The epoch: the tables hold no fetch time, and archives of equal rows are equal.
DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20


class WarcError(ValueError):
    """An archive that does not follow the format."""


def record(kind: str, name: str | None, uri: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record; a revisit has no block, only the digest and length of the payload it stands for."""
    fields = [("WARC-Type", kind), ("WARC-Date", DATE), ("WARC-Record-ID", f"<urn:page:{name}>" if name is not None else "<urn:page>")]
    if uri is not None:
        fields.append(("WARC-Target-URI", "".join(uri.split())))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(size))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return head + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields and payload, or WarcError."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise WarcError("no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header {line[:80]!r}")
        key = name.decode("ascii").lower()
        if key in fields:
            raise WarcError(f"repeated header {key}")
        fields[key] = value.strip().decode("utf-8")
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in fields:
            raise WarcError(f"no {key}")
    kind, length = fields["warc-type"], fields["content-length"]
    if kind not in TYPES:
        raise WarcError(f"unknown type {kind}")
    if not length.isdecimal() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("length does not fit the block")
    payload, digest = rest[:-4], fields.get("warc-payload-digest", "")
    if not digest.startswith("sha256:"):
        raise WarcError("no payload digest")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise WarcError("payload does not have its digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or not fields.get("x-payload-length", "").isdecimal()):
        raise WarcError("revisit with a block, or without what it refers to")
    return {"kind": kind, "fields": fields, "payload": payload, "digest": digest[7:]}


def write_frames(records: Iterator[bytes], dictionary: bytes | None, level: int = 3) -> Iterator[bytes]:
    """The bytes of an archive, piece by piece."""
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if dictionary:
        yield DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    for raw in records:
        yield packer.compress(raw)


def read_frames(archive: bytes) -> Iterator[dict]:
    """The records of an archive, one decoded frame at a time."""
    view, at = memoryview(archive), 0
    trained = None
    if len(archive) >= 8 and int.from_bytes(archive[:4], "little") == DICTIONARY_MAGIC:
        size = int.from_bytes(archive[4:8], "little")
        if 8 + size > len(archive):
            raise WarcError("dictionary is cut off")
        held = bytes(view[8 : 8 + size])
        # The dictionary itself may be compressed.
        trained = zstandard.ZstdCompressionDict(zstandard.decompress(held) if held[:4] == FRAME_MAGIC else held)
        at = 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(archive):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one = unpacker.decompressobj()
        parts, step = [], 1 << 16
        while not one.eof:
            if at >= len(archive):
                raise WarcError("frame is cut off")
            piece = view[at : at + step]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield parse(b"".join(parts))


def payload_dictionary(pages: DataFrame, payload_col: str, max_pages: int = 400, size: int = 32 << 10) -> bytes | None:
    """A compression dictionary from about ``max_pages`` payloads drawn by hash; none if there is too little to learn from.

    Only compression depends on the sample, never what is read back. At most 16 KiB of a payload are used.
    """
    n = pages.count()
    if n < 20:
        return None
    share = min(1.0, max_pages / n)
    draw = F.pmod(F.xxhash64(payload_col), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = pages.filter(draw).select(F.substring(payload_col, 1, 16 << 10).alias("p")).limit(2 * max_pages).collect()
    samples = [bytes(r["p"]) for r in rows if r["p"]]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 20 else None
    except zstandard.ZstdError:
        return None


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 100,
    archive_bytes: int = ARCHIVE_BYTES,
) -> list[str]:
    """Write a record per row and return the names of the archives."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= min_bytes)
    shared = large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Cut, so that the join below has a plain shuffle on either side and a payload with very many copies can be split.
    shared = cut(shared.select(F.col("digest").alias("of"), "first"))
    joined = rows.join(shared, (F.col("digest") == F.col("of")) & (F.octet_length("payload") >= min_bytes), "left")
    refers = F.when(F.col("first") != F.coalesce("id", F.lit(None)), F.col("first")).when(F.col("id").isNull(), F.col("first"))
    planned = joined.select(
        F.col("id").cast("string").alias("id"), "uri", "digest", F.octet_length("payload").cast("long").alias("size"),
        refers.cast("string").alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"),
    )
    dictionary = payload_dictionary(rows, "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for r in batch.to_pylist():
                    kind = "revisit" if r["refers_to"] is not None else "response"
                    yield record(kind, r["id"], r["uri"], r["payload"] or b"", r["digest"], r["size"], r["refers_to"])

        def archive(first: bytes, rest: Iterator[bytes]) -> str:
            def until_full() -> Iterator[bytes]:
                yield first
                used = len(first)
                while used < archive_bytes and (one := next(rest, None)) is not None:
                    used += len(one)
                    yield one

            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for piece in write_frames(until_full(), dictionary):
                    out.write(piece)
            return name

        source, names = records(), []
        while (first := next(source, None)) is not None:
            names.append(archive(first, source))
        if names:
            yield pa.RecordBatch.from_pydict({"name": names})

    return sorted(r["name"] for r in cut(planned.mapInArrow(write, "name string")).collect())


def read_archives(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Rows (id, uri, kind, payload, payload_bytes, digest, refers_to) of all records; fails on an archive that breaks the format."""
    schema = "id string, uri string, kind string, payload binary, payload_bytes long, digest string, refers_to string"
    if not names:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names]).select("content")
    fields = [(p.split()[0], {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[p.split()[1]]) for p in schema.split(", ")]

    def name_of(value: str | None) -> str | None:
        return value[10:-1] if value and value.startswith("<urn:page:") else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, used = [], 0
                for one in read_frames(content.as_py()):
                    f = one["fields"]
                    size = len(one["payload"]) if one["kind"] == "response" else int(f["x-payload-length"])
                    rows.append((name_of(f["warc-record-id"]), f.get("warc-target-uri"), one["kind"], one["payload"], size, one["digest"], name_of(f.get("warc-refers-to"))))
                    used += len(one["payload"])
                    if used > 4 << 20 or len(rows) >= 5000:
                        yield _batch(rows, fields)
                        rows, used = [], 0
                if rows:
                    yield _batch(rows, fields)

    return files.mapInArrow(read, schema)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, as a URI."""
    base = ensure_checkpoint_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}"
