"""Change detection between two states, and along a whole history."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.operators.ordered import last_before, unique_or_fail

# Published field name -> column, and the rank of each event type in the event order.
PRICE_FIELDS = {
    "inputPricePer1MTokens": "input",
    "cachedInputPricePer1MTokens": "cached",
    "cacheWritePricePer1MTokens": "cache_write",
    "outputPricePer1MTokens": "output",
}
PRICE_TEXT_FIELDS = {"pricingUnit": "pricing_unit", "sourceUrl": "source_url"}
EVENT_RANK = {
    "model_removed": 0,
    "model_added": 1,
    "price_decreased": 2,
    "price_increased": 3,
    "metadata_changed": 4,
}
CAPABILITY_FIELDS = {
    "contextWindow": "context_window",
    "maxOutputTokens": "max_output_tokens",
    "supportsVision": "supports_vision",
    "supportsToolCalling": "supports_tool_calling",
    "inputModalities": "input_modalities",
    "outputModalities": "output_modalities",
    "displayName": "display_name",
    "modelFamily": "family",
    "modelStage": "stage",
}
LIFECYCLE_FIELDS = {
    "lifecycleState": "state",
    "deprecatedDate": "deprecated_on",
    "retirementDate": "retirement_date",
    "retirementNotBeforeDate": "not_before_date",
    "recommendedReplacement": "replacement",
}

def _event(change_type, field=None, old_num=None, new_num=None, old_text=None, new_text=None) -> Column:
    def col(value, kind):
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return F.struct(
        col(change_type, "string").alias("change_type"),
        col(field, "string").alias("field_name"),
        col(old_num, "double").alias("old_num"),
        col(new_num, "double").alias("new_num"),
        col(old_text, "string").alias("old_text"),
        col(new_text, "string").alias("new_text"),
    )


def price_direction(old: Column, new: Column) -> Column:
    """Event type of one price field, NULL when it did not move; null against a value is metadata."""
    return (
        F.when(old.eqNullSafe(new), None)
        .when(old.isNull() | new.isNull(), "metadata_changed")
        .when(new > old, "price_increased")
        .otherwise("price_decreased")
    )


def price_field_events(old, new, text_fields: Mapping[str, str] = PRICE_TEXT_FIELDS) -> list[Column]:
    """The possible change events between two observations of one identity; NULL where a field did not move.

    ``old`` and ``new`` map a column name to the Column holding it on that side.
    """
    events = []
    for field, name in PRICE_FIELDS.items():
        kind = price_direction(old(name), new(name))
        events.append(F.when(kind.isNotNull(), _event(kind, field, old(name), new(name))))
    for field, name in text_fields.items():
        moved = ~old(name).eqNullSafe(new(name))
        events.append(F.when(moved, _event("metadata_changed", field, old_text=old(name), new_text=new(name))))
    return events


def unpivot(rows: DataFrame, keep: Sequence, events: Sequence[Column]) -> DataFrame:
    """One row per non-null event, with the event's fields as columns.

    The array is built in place and its NULLs are dropped after the explode, which keeps the whole step
    inside generated code.
    """
    exploded = rows.select(*keep, F.explode(F.array(*events)).alias("e")).filter(F.col("e").isNotNull())
    names = [c for c in exploded.columns if c != "e"]
    return exploded.select(*names, "e.*")


def pair_states(prev: DataFrame, curr: DataFrame, identity: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Both states side by side as ``p`` and ``c`` structs; a missing side is NULL."""

    def boxed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*identity, F.struct(*[c for c in df.columns if c not in identity]).alias(name))

    return boxed(prev, "p").join(boxed(curr, "c"), list(identity), how)


def diff_prices(
    prev: DataFrame,
    curr: DataFrame,
    identity: Sequence[str] = ("entity_id", "mode", "tier"),
    entity: Sequence[str] = ("entity_id",),
    compare_currency: bool = False,
    checked: bool = False,
) -> DataFrame:
    """Change events from the previous to the current price state.

    An identity on one side only is added or removed. An entity wholly new or wholly gone gives one event,
    carried by its first identity and without mode and tier; an added or removed tier of a continuing
    entity keeps them. ``checked`` fails the job if either side repeats an identity; leave it off for
    inputs that come from a latest-row operator, which cannot repeat one.
    """
    if checked:
        prev, curr = unique_or_fail(prev, identity, "price"), unique_or_fail(curr, identity, "price")
    return diff_pairs(pair_states(prev, curr, identity), identity, entity, compare_currency)


def diff_pairs(
    pairs: DataFrame,
    identity: Sequence[str] = ("entity_id", "mode", "tier"),
    entity: Sequence[str] = ("entity_id",),
    compare_currency: bool = False,
) -> DataFrame:
    """:func:`diff_prices` for states that are already side by side as ``p`` and ``c``.

    Only added and removed identities have to know whether their whole entity came or went, so only they
    are joined with the entity's presence.
    """
    scope = [c for c in identity if c not in entity]
    texts = dict(PRICE_TEXT_FIELDS, **({"currency": "currency"} if compare_currency else {}))
    has_prev, has_curr = F.col("p").isNotNull(), F.col("c").isNotNull()
    ids = [F.col("p")["snapshot_id"].alias("prev_snapshot_id"), F.col("c")["snapshot_id"].alias("curr_snapshot_id")]

    moves = price_field_events(lambda n: F.col("p")[n], lambda n: F.col("c")[n], texts)
    moved = unpivot(pairs.filter(has_prev & has_curr), [*identity, *ids], moves)

    presence = pairs.groupBy(*entity).agg(
        F.bool_or(has_prev).alias("_any_prev"),
        F.bool_or(has_curr).alias("_any_curr"),
        F.min(F.struct(*scope)).alias("_first"),
    )
    ends = pairs.filter(~(has_prev & has_curr)).select(*identity, *ids).join(presence, list(entity))
    came = F.col("prev_snapshot_id").isNull()
    whole = F.when(came, ~F.col("_any_prev")).otherwise(~F.col("_any_curr"))
    kept = ends.withColumn("_whole", whole).filter(~F.col("_whole") | (F.struct(*scope) == F.col("_first")))
    event = _event(F.when(came, "model_added").otherwise("model_removed"), None, None, None, F.col("prev_snapshot_id"), F.col("curr_snapshot_id"))
    scoped = [F.when(~F.col("_whole"), F.col(c)).alias(c) if c in scope else F.col(c) for c in identity]
    ended = kept.select(*scoped, "prev_snapshot_id", "curr_snapshot_id", event.alias("e")).select(
        *identity, "prev_snapshot_id", "curr_snapshot_id", "e.*")
    return moved.unionByName(ended)


def event_rank() -> Column:
    rank = None
    for kind, position in EVENT_RANK.items():
        test = F.col("change_type") == kind
        rank = F.when(test, position) if rank is None else rank.when(test, position)
    return rank


def event_order(identity: Sequence[str]) -> list[Column]:
    """Identity, then event type rank, then field name (an event without a field sorts as empty)."""
    return [*[F.col(c).asc_nulls_first() for c in identity], event_rank(), F.coalesce("field_name", F.lit("")).asc()]


def _comparable(column: Column, is_array: bool) -> Column:
    return F.array_sort(column) if is_array else column


def _as_json(column: Column, kind: str) -> Column:
    """A value of any field as JSON text, so all fields share one column; NULL stays NULL."""
    if kind.startswith("array"):
        return F.to_json(column)
    if kind in ("string", "date"):
        return F.when(column.isNotNull(), F.concat(F.lit('"'), column.cast("string"), F.lit('"')))
    return column.cast("string")


def _diff_fields(prev, curr, identity, fields: Mapping[str, str], asserted=None) -> DataFrame:
    kinds = dict(curr.dtypes)
    pairs = pair_states(prev, curr, identity, "inner")
    events = []
    for field, name in fields.items():
        is_array = kinds[name].startswith("array")
        old, new = F.col("p")[name], F.col("c")[name]
        moved = ~_comparable(old, is_array).eqNullSafe(_comparable(new, is_array))
        if asserted is not None:
            moved = moved & asserted(field, lambda n: F.col("c")[n])
        value = F.struct(
            F.lit(field).alias("field_name"),
            _as_json(old, kinds[name]).alias("old_value"),
            _as_json(new, kinds[name]).alias("new_value"),
        )
        events.append(F.when(moved, value))
    return unpivot(pairs, identity, events)


def diff_capabilities(prev: DataFrame, curr: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Field changes of entities present on both sides. Arrays compare as bags; absence is silent."""
    return _diff_fields(prev, curr, identity, CAPABILITY_FIELDS)


def lifecycle_asserted(field: str, value) -> Column:
    """Whether the current record speaks about a field at all."""
    if field == "retirementNotBeforeDate":
        return value("not_before_observation").isin("date", "explicitly_unannounced")
    if field == "recommendedReplacement":
        return F.coalesce(value("replacement_observed"), F.lit(False))
    return value(LIFECYCLE_FIELDS[field]).isNotNull()


def diff_lifecycle(prev: DataFrame, curr: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Field changes the current record asserts; a field it does not publish never changes."""
    return _diff_fields(prev, curr, identity, LIFECYCLE_FIELDS, lifecycle_asserted)


def price_history_changes(
    history: DataFrame, identity: Sequence[str], order: Sequence[str], segment: Column | None = None,
    derived: Callable[[Callable[[str], Column]], Mapping[str, Column]] | None = None, sampled: DataFrame | None = None,
) -> DataFrame:
    """Change events of every consecutive pair in an append-only price history.

    See :func:`last_before` for ``segment`` and ``sampled``. Only the compared columns travel through the shuffles. ``derived`` gives the
    columns that follow from the stored ones, from a function that maps a name to the Column holding it; they are made for both rows of a
    pair after rows are paired, and then all other columns of ``history`` travel.
    """
    names = [*PRICE_FIELDS.values(), *PRICE_TEXT_FIELDS.values(), "snapshot_id"]
    if derived is None:
        history = history.select(*dict.fromkeys([*identity, *order, *names, "observed_at"]))
        kept = names
    else:
        kept = [c for c in history.columns if c not in identity]
    paired = last_before(history, identity, order, segment, F.struct(*kept), "before", sampled=sampled)

    def before(name: str) -> Column:
        return F.col(name) if name in identity else F.col("before")[name]

    return price_pair_events(paired.filter(F.col("before").isNotNull()), identity, before, F.col, derived)


def price_pair_events(pairs: DataFrame, identity: Sequence[str], before, after, derived=None) -> DataFrame:
    """Change events of rows that hold an observation and the one before it.

    ``before`` and ``after`` map a column name to the Column holding it on that side. See :func:`price_history_changes` for ``derived``.
    """
    if derived is None:
        old, new = before, after
    else:
        # Made once per pair: several events show the same text.
        names = [*PRICE_FIELDS.values(), *PRICE_TEXT_FIELDS.values(), "snapshot_id"]
        texts = {"_old": derived(before), "_new": derived(after)}
        pairs = pairs.withColumns({f"{side}_{n}": texts[side][n] for side in texts for n in names if n in texts[side]})

        def old(n):
            return F.col(f"_old_{n}") if n in texts["_old"] else before(n)

        def new(n):
            return F.col(f"_new_{n}") if n in texts["_new"] else after(n)

    ids = [old("snapshot_id").alias("prev_snapshot_id"), new("snapshot_id").alias("curr_snapshot_id")]
    return unpivot(pairs, [*identity, after("observed_at").alias("observed_at"), *ids], price_field_events(old, new))


def identity_violations(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Identities that occur more than once, with their row counts."""
    return df.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
