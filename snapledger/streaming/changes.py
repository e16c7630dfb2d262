"""Live change events from a price stream, with the last known row of every identity in the state store.

Identities are dealt into a fixed number of groups by a hash, and a row of the state store holds the newest rows of one group as a small
Arrow table. A micro-batch reads and writes the groups of the identities it holds and no others, with one vectorised step a group, so a
step's fixed cost is paid per group and not per identity. Columns travel as plain numbers and texts without NULL, beside one number whose
bits say which of them are missing, so a step neither writes nor parses a text per row. The RocksDB provider keeps the groups on disk and
stores only what changed.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from snapledger.operators import diff

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


# Fixed for a checkpoint. More groups: a micro-batch of a few identities rewrites less; fewer: fewer steps.
GROUPS = 1 << 12
MISSING = "_missing"
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _plain(column: Column, kind: T.DataType) -> Column:
    """A value as a number or text without NULL, from which :func:`_restored` gives it back."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return F.coalesce(column.cast("bigint"), F.lit(0).cast("bigint"))
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.coalesce(column.cast("double"), F.lit(0.0))
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.unix_micros(column), F.lit(0).cast("bigint"))
    if isinstance(kind, T.DateType):
        return F.coalesce(F.unix_date(column).cast("bigint"), F.lit(0).cast("bigint"))
    if isinstance(kind, T.DecimalType):
        return F.coalesce(column, F.lit(0).cast(kind))
    if isinstance(kind, (T.StringType, T.TimestampNTZType)):
        return F.coalesce(column.cast("string"), F.lit(""))
    return F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false", **TIMES})


def _restored(column: Column, kind: T.DataType, missing: Column) -> Column:
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        value = F.coalesce(column, F.lit(float("nan"))).cast(kind)  # pandas gives NaN back as NULL
    elif isinstance(kind, T.TimestampType):
        value = F.timestamp_micros(column)
    elif isinstance(kind, T.DateType):
        value = F.date_from_unix_date(column.cast("int"))
    elif isinstance(kind, (T.NumericType, T.BooleanType, T.StringType, T.TimestampNTZType)):
        value = column.cast(kind)
    else:
        value = F.from_json(column, T.StructType([T.StructField("v", kind)]), TIMES)["v"]
    return F.when(~missing, value)


def _packed(rows: Mapping[str, np.ndarray], at: np.ndarray) -> bytes:
    table = pa.table({c: pa.array(v[at]) for c, v in rows.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(stored: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(stored).read_all()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _numbers(values: np.ndarray, sort: bool = False) -> np.ndarray:
    return pd.factorize(values, sort=sort)[0] if values.dtype == object else values


def _stepper(identity: Sequence[str], order: Sequence[str], compared: Sequence[str], bits: int) -> Callable:
    """Pairs of consecutive rows of every identity of a group: the first meets the stored row, the last becomes it.

    Rows at or before the stored one of their identity are late and are ignored. ``bits`` are those of the identity in ``MISSING``.
    """
    columns = [*dict.fromkeys([*identity, *order, *compared]), MISSING]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Spark fills up a batch of states with rows of nothing, of which pandas warns once a batch.
        warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)
        parts = [_unpacked(state.get[0])] if state.exists else []
        known = len(parts[0][MISSING]) if parts else 0
        parts += [{c: f[c].to_numpy() for c in columns} for f in frames]
        rows = {c: np.concatenate([p[c] for p in parts]) for c in columns}
        ids = pd.factorize(rows[MISSING] & bits)[0]
        for c in identity:
            codes, values = pd.factorize(rows[c])
            ids = pd.factorize(ids * (len(values) + 1) + codes + 1)[0]
        turns = [_numbers(rows[c], True) for c in order]
        at = np.lexsort((*reversed(turns), ids))  # stable, so a stored row comes before its equals
        ids, turns, old = ids[at], [t[at] for t in turns], at < known
        bound = np.full(ids[-1] + 1, -1)
        bound[ids[old]] = np.flatnonzero(old)
        bound = bound[ids]
        same = np.logical_and.reduce([t == t[bound] for t in turns])
        kept = old | (bound < 0) | ((np.arange(len(at)) > bound) & ~same)
        at, ids = at[kept], ids[kept]
        if len(at) == known:
            return
        follows = ids[1:] == ids[:-1]
        state.update((_packed(rows, at[np.append(~follows, True)]),))
        first, second = at[:-1][follows], at[1:][follows]
        if len(first):
            shown = [*compared, MISSING]
            yield pd.DataFrame({**{f"i_{c}": rows[c][second] for c in identity}, **{f"b_{c}": rows[c][first] for c in shown},
                                **{f"a_{c}": rows[c][second] for c in shown}})

    return step


def live_changes(history: DataFrame, identity: Sequence[str], order: Sequence[str], groups: int = GROUPS,
                 derived: Callable[[Callable[[str], Column]], Mapping[str, Column]] | None = None) -> DataFrame:
    """Change events of every consecutive pair of rows of a stream, as ``diff.price_history_changes`` gives them for a table.

    ``order`` columns are numbers, texts or timestamps and never NULL. Rows of an identity that are not newer than its stored row
    change nothing. The rows that a micro-batch has of one group of identities are compared at once by one task, so bound the files of a
    micro-batch. ``groups`` stays the same for a checkpoint. ``derived`` as for the table: what it makes is neither moved nor stored.
    """
    names = [*diff.PRICE_FIELDS.values(), *diff.PRICE_TEXT_FIELDS.values(), "snapshot_id", "observed_at"]
    compared = [c for c in (dict.fromkeys(names) if derived is None else history.columns) if c not in identity]
    moved = list(dict.fromkeys([*identity, *order, *compared]))
    types = {f.name: f.dataType for f in history.schema.fields}
    if len(moved) > 63:
        raise ValueError("a price stream has 63 columns at most")
    bit = {c: 1 << n for n, c in enumerate(moved)}
    missing = F.lit(0).cast("bigint")
    for c in moved:
        missing = missing + F.when(F.col(c).isNull(), F.lit(bit[c]).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    group = F.pmod(F.xxhash64(*identity), F.lit(groups)).alias("_group")
    narrow = history.select(group, *[_plain(F.col(c), types[c]).alias(c) for c in moved], missing.alias(MISSING))
    kinds = dict(narrow.dtypes)
    shape = [*[f"`i_{c}` {kinds[c]}" for c in identity], *[f"`{side}_{c}` {kinds[c]}" for side in "ba" for c in [*compared, MISSING]]]
    paired = narrow.groupBy("_group").applyInPandasWithState(
        _stepper(list(identity), list(order), compared, sum(bit[c] for c in identity)), ", ".join(shape), "newest binary", "append",
        GroupStateTimeout.NoTimeout)

    def shown(side: str, c: str) -> Column:
        held = F.col(f"{side}_{c}")
        return _restored(held, types[c], F.col(f"{'a' if side == 'i' else side}_{MISSING}").bitwiseAND(F.lit(bit[c]).cast("bigint")) != 0)

    both = paired.select(*[shown("i", c).alias(c) for c in identity],
                         *[F.struct(*[shown(side, c).alias(c) for c in compared]).alias(name) for side, name in (("b", "before"), ("a", "after"))])

    def of(name: str) -> Callable[[str], Column]:
        return lambda n: F.col(n) if n in identity else F.col(name)[n]

    return diff.price_pair_events(both, identity, of("before"), of("after"), derived)


def change_stream(history: DataFrame, path: str, checkpoint: str, identity: Sequence[str], order: Sequence[str],
                  available_now: bool = True, derived: Callable[[Callable[[str], Column]], Mapping[str, Column]] | None = None) -> StreamingQuery:
    """Append the change events of a price stream to ``path``. States and position survive a restart in ``checkpoint``."""
    conf = history.sparkSession.conf
    for name, value in STATE_STORE.items():
        conf.set(name, value)
    events = live_changes(history, identity, order, derived=derived)
    writer = events.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    query = writer.start(path)
    if available_now:
        query.awaitTermination()
    return query
