"""What the operators of this package share: reading, lineage cuts, row-wise Arrow functions and folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from snapledger.session import ensure_checkpoint_dir


SLICE = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that a lost executor repeats nothing before this point."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder.

    For steps that are repeated: a checkpoint keeps the estimated size of the plan it cuts, and joins multiply estimates, so after some
    rounds of joins the numbers alone fill the driver. A table has the size it has, and small ones are broadcast.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_row(fn: Callable[[list[bytes | None]], dict], schema: str) -> Callable[[Column], Column]:
    """A column function from UTF-8 bytes to the struct ``schema``.

    ``fn`` gets up to ``SLICE`` values of an Arrow batch and returns a list per field. Other columns of the row stay in
    the JVM, whatever their names. The function is marked non-deterministic only to keep a filter on its
    result from running it twice.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        types = _types(schema)
        for batch in batches:
            # In slices, so that a batch is never held several times over.
            for at in range(0, max(1, len(batch)), SLICE):
                out = fn(_bytes(batch.slice(at, SLICE)))
                yield pa.StructArray.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)

    return arrow_udf(run, schema).asNondeterministic()


def _bytes(batch: pa.Array) -> list[bytes | None]:
    return batch.cast(pa.large_binary() if pa.types.is_large_string(batch.type) else pa.binary()).to_pylist()


_ARROW = {
    "string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def _types(schema: str) -> list[pa.DataType]:
    return [_ARROW[part.split()[1]] for part in schema.split(",")]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the next longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: Column, parts: int) -> Column:
    """CRC-32 of the key as text, modulo ``parts``; null keys count as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(df: DataFrame, key: Column, max_rows: int, seed: int = 7) -> DataFrame:
    """About ``max_rows`` rows chosen by a hash of their key, all rows if there are no more than that."""
    n = df.count()
    if n <= max_rows:
        return df
    share = int(1_000_000 * max_rows / n)
    return df.filter(F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1_000_000)) < share)
