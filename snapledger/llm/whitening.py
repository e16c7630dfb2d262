"""Whitening of embeddings, each distinct vector fitted and whitened once.

Entries become whole numbers ``floor(64 * c) + 1000000``. Rows of equal whole vectors are one group, and only groups are computed on: sums,
the weighted centred covariance (a matrix product per task, added up by rows of the matrix), the projection, and the covariance of what
comes out. A group weighs one or the number of its rows. The driver holds one matrix of the vectors' dimension and its eigenvectors; rows
get their group's result by a join.

Sums are exact whole numbers, and vectors are centred before they are multiplied, so the common offset costs no digits. The deviation
of a vector is the sum over dimensions of ``(n * x - S)^2``, exact; one that does not fit into 64 bits is an error.

Defined results: null vectors, empty ones and vectors with a null or non-finite entry give no rows; repeated rows give their rows each.
Vectors of several lengths are an error. Components whose eigenvalue is zero to rounding do not exist, so a table of one distinct vector
gives no rows; nor does an empty table. Null ids stay null. Columns other than id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.llm.common import cut

SCALE, OFFSET = 64.0, 1_000_000
# Rows whose vectors a task multiplies at a time.
BLOCK = 1024
RANK = 1e-13


class Axes(NamedTuple):
    """Of the fit list: number, exact sums per dimension, eigenvectors as columns, eigenvalues, their sum."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, x) of the vectors whose entries are all finite."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.filter((F.size("_v") > 0) & ~F.exists("_v", odd))
    return rows.select("id", F.transform("_v", lambda c: F.floor(c * F.lit(SCALE)).cast("long") + F.lit(OFFSET).cast("long")).alias("x"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _lengths(groups: DataFrame, column: str) -> int:
    """The vectors' length, 0 if there are none."""
    found = groups.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if found["a"] != found["b"]:
        raise ValueError(f"vectors of several lengths: {found['a']} to {found['b']}")
    return found["a"] or 0


def _sums(groups: DataFrame, column: str, weight: str) -> tuple[int, list]:
    """Total weight, and the weighted sum of each dimension; whole numbers stay exact, also beyond 64 bits."""
    entry = F.col("_entry").cast("decimal(38,0)") if dict(groups.dtypes)[column] == "array<bigint>" else F.col("_entry")
    dims = groups.select(weight, F.posexplode(column).alias("_dim", "_entry"))
    # Partial sums per task: as many rows as dimensions leave it.
    found = dims.groupBy("_dim").agg(F.sum(entry * F.col(weight)).alias("s"), F.sum(weight).alias("n")).orderBy("_dim").collect()
    return int(found[0]["n"]) if found else 0, [r["s"] for r in found]


def _covariance(groups: DataFrame, column: str, weight: str, n: int, sums: list, dims: int) -> np.ndarray:
    """The weighted covariance, divisor ``n``. Every task multiplies its own centred vectors; rows of the products are added up by number."""
    centre = np.array([float(s) / n for s in sums])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches):
            moved = _matrix(block.column(0), np.float64) - centre
            by = block.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            part = (moved * by[:, None]).T @ moved
            total = part if total is None else total + part
        if total is not None:
            yield _numbered(np.arange(dims), total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, values in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), np.float64)):
                total[row] = total[row] + values if row in total else values
        if total:
            yield _numbered(np.array(list(total)), np.array(list(total.values())))

    parts = groups.select(column, weight).mapInArrow(products, "row int, entries array<double>")
    # A task gets whole rows of the matrix, so it holds no more than its share of one matrix.
    rows = parts.repartition("row").mapInArrow(added, "row int, entries array<double>").collect()
    out = np.zeros((dims, dims))
    for r in rows:
        out[r["row"]] = r["entries"]
    out /= n
    return (out + out.T) / 2


def _numbered(rows: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    entries = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), entries], ["row", "entries"])


def fit(groups: DataFrame, components: int, weights: str) -> Axes | None:
    """The axes of the largest eigenvalues; none if there are no vectors. ``groups`` has x and copies."""
    dims = _lengths(groups, "x")
    if not dims:
        return None
    fitted = groups.select("x", (F.lit(1) if weights == "one" else F.col("copies")).cast("long").alias("_weight"))
    n, sums = _sums(fitted, "x", "_weight")
    matrix = _covariance(fitted, "x", "_weight", n, sums, dims)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values > max(values[0], 0.0) * dims * RANK).sum())
    kept = min(components, real)
    return Axes(n, [int(s) for s in sums], vectors[:, :kept], values[:kept], float(np.trace(matrix)))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sums of squares; in whole numbers of any size where 64 bits could overflow."""
    reach = max(abs(int(x.max()) * n), abs(int(x.min()) * n)) + max(abs(int(s)) for s in sums)
    if reach < 1 << 62 and len(sums):
        apart = x * n - sums.astype(np.int64)
        if int(np.abs(apart).max()) ** 2 * len(sums) < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
    apart = x.astype(object) * n - sums
    found = (apart * apart).sum(axis=1).tolist()
    if max(found) >= 1 << 63:
        raise OverflowError("a deviation does not fit into 64 bits")
    return found


def projected(groups: DataFrame, axes: Axes) -> DataFrame:
    """``groups`` with deviation and ``white``, the whitened coordinates of each distinct vector."""
    centre = np.array([float(s) / axes.n for s in axes.sums])
    turn = axes.vectors / np.sqrt(axes.values)
    sums = np.array(axes.sums, dtype=object)
    n = axes.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = _matrix(block.column(0), np.int64)
            white = (x.astype(np.float64) - centre) @ turn
            offsets = np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1]
            entries = pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(_deviations(x, n, sums), pa.int64()), entries, block.column(1)],
                                             ["x", "deviation", "white", "copies"])

    return groups.select("x", "copies").mapInArrow(run, "x array<bigint>, deviation long, white array<double>, copies long")


def identity_error(white: DataFrame, components: int, weights: str) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    held = white.select("white", (F.lit(1) if weights == "one" else F.col("copies")).cast("long").alias("_weight"))
    n, sums = _sums(held, "white", "_weight")
    return float(np.abs(_covariance(held, "white", "_weight", n, sums, components) - np.eye(components)).max())


def whitened(df: DataFrame, components: int = 16, weights: str = "one", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, value, explained, identity_error) for every row of ``df`` and component, from 1.

    ``weights``: "one", every distinct vector counts once; "counts", as often as it occurs.
    """
    if weights not in ("one", "counts"):
        raise ValueError(f"weights: {weights}")
    rows = cut(whole(df, id_col, vector_col))
    groups = cut(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")))
    axes = fit(groups, components, weights)
    names = ["id", "component", "n", "deviation", "value", "explained", "identity_error"]
    if axes is None or not len(axes.values):
        kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
        kept = T.StructType([T.StructField(n, t) for n, t in zip(names, [df.schema[id_col].dataType, *kinds])])
        return df.sparkSession.createDataFrame([], kept)
    white = cut(projected(groups, axes))
    error = identity_error(white, len(axes.values), weights)
    share = F.lit([float(v) / axes.trace for v in axes.values])
    # The hash is compared first; the vectors themselves decide.
    keyed = rows.select("id", "x", F.xxhash64("x").alias("_key"))
    joined = keyed.join(white.select(F.xxhash64("x").alias("_key"), "x", "deviation", "white"), ["_key", "x"])
    each = joined.select("id", "deviation", F.posexplode("white").alias("_at", "value"))
    return each.select(
        "id", (F.col("_at") + 1).alias("component"), F.lit(axes.n).cast("long").alias("n"), "deviation", "value",
        F.element_at(share, F.col("_at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
