"""Entities with their current evidence: assembly, filters, order, facets, comparison, facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions import labels, text, values
from snapledger.functions.text import trim_text
from snapledger.operators.current import newest_domain

END_OF_LIFE = ("deprecated", "retired")
# Evidence older than this is stale.
STALE_HOURS = 48


def entries(entities: DataFrame, prices: DataFrame, capabilities: DataFrame, lifecycle: DataFrame, now: Column) -> DataFrame:
    """One row per entity with its price, capability and lifecycle evidence; any of them may be absent.

    Each side arrives with one row per entity, so the three left joins never multiply rows.
    """
    joined = (
        entities.join(prices, "entity_id", "left").join(capabilities, "entity_id", "left").join(lifecycle, "entity_id", "left")
    )
    verified = F.greatest("price_observed_at", "capability_observed_at", "lifecycle_observed_at")
    return joined.withColumns({
        "end_of_life": F.coalesce(F.col("lifecycle_state").isin(*END_OF_LIFE), F.lit(False)),
        "last_verified_at": verified,
        "age_minutes": values.age_minutes(verified, now),
        "newest_domain": newest_domain([
            ("pricing", F.col("price_observed_at")), ("capability", F.col("capability_observed_at")),
            ("lifecycle", F.col("lifecycle_observed_at")),
        ])["domain"],
    })


@dataclass(frozen=True)
class Filters:
    """Constraints on entries. An unknown value never satisfies one; an empty or false entry is none."""

    providers: Sequence[str] = ()
    max_input_price: float | None = None
    max_output_price: float | None = None
    min_context_window: int | None = None
    min_max_output_tokens: int | None = None
    vision_required: bool = False
    tool_calling_required: bool = False
    active_only: bool = False
    lifecycle_states: Sequence[str] = ()
    families: Sequence[str] = ()
    stages: Sequence[str] = ()
    input_modalities: Sequence[str] = ()
    output_modalities: Sequence[str] = ()
    search: str | None = None


def folded(wanted: Sequence[str]) -> list[str]:
    return sorted({v.strip().lower() for v in wanted if v.strip()})


def member(column: str, wanted: Sequence[str]) -> Column | None:
    names = folded(wanted)
    return F.lower(trim_text(column)).isin(names) if names else None


def has_modalities(column: str, wanted: Sequence[str]) -> Column | None:
    names = folded(wanted)
    if not names:
        return None
    seen = F.transform(F.col(column), lambda m: F.lower(trim_text(m)))
    return (F.size(seen) > 0) & (F.size(F.array_except(F.array(*[F.lit(n) for n in names]), seen)) == 0)


def found_in(wanted: str | None, columns: Sequence[str] = ("model_name", "display_name", "api_id")) -> Column | None:
    needle = (wanted or "").strip().lower()
    if not needle:
        return None
    # The separator is a line break, which a search text cannot contain after trimming to one line.
    return F.lower(F.concat_ws("\n", *columns)).contains(needle)


def predicates(f: Filters) -> list[Column]:
    """The filter as a list of conditions Catalyst can push down one by one."""
    tests = [
        member("provider", f.providers),
        F.col("input_price") <= f.max_input_price if f.max_input_price is not None else None,
        F.col("output_price") <= f.max_output_price if f.max_output_price is not None else None,
        F.col("context_window") >= f.min_context_window if f.min_context_window is not None else None,
        F.col("max_output_tokens") >= f.min_max_output_tokens if f.min_max_output_tokens is not None else None,
        F.col("supports_vision") if f.vision_required else None,
        F.col("supports_tool_calling") if f.tool_calling_required else None,
        # Dropping observed end of life keeps entities whose lifecycle nobody publishes.
        ~F.col("end_of_life") if f.active_only else None,
        member("lifecycle_state", f.lifecycle_states),
        member("family", f.families),
        member("stage", f.stages),
        has_modalities("input_modalities", f.input_modalities),
        has_modalities("output_modalities", f.output_modalities),
        found_in(f.search),
    ]
    return [t for t in tests if t is not None]


def apply_filters(rows: DataFrame, f: Filters) -> DataFrame:
    for test in predicates(f):
        rows = rows.filter(test)
    return rows


def catalog_filter(
    rows: DataFrame, *, supports_vision: bool | None = None, supports_tool_calling: bool | None = None,
    min_context_window: int | None = None, input_modality: str | None = None, output_modality: str | None = None,
    family: str | None = None, stage: str | None = None, search: str | None = None,
) -> DataFrame:
    """The catalog's own filter: here ``False`` asks for an observed false, and a family matches as text."""
    def any_is(column: str, wanted: str | None) -> Column | None:
        return F.exists(column, lambda m: F.lower(m) == wanted.lower()) if wanted else None

    tests = [
        F.col("supports_vision") == supports_vision if supports_vision is not None else None,
        F.col("supports_tool_calling") == supports_tool_calling if supports_tool_calling is not None else None,
        F.col("context_window") >= min_context_window if min_context_window is not None else None,
        any_is("input_modalities", input_modality),
        any_is("output_modalities", output_modality),
        F.lower("family").contains(family.lower()) if family else None,
        F.lower("stage") == stage.lower() if stage else None,
        found_in(search),
    ]
    for test in tests:
        if test is not None:
            rows = rows.filter(test)
    return rows


def entry_order(sort: str = "provider") -> list[Column]:
    """Unknown values last in both directions; ties by provider, name and id."""
    ties = [F.col("provider").asc(), F.col("model_name").asc(), F.col("entity_id").asc()]
    first = {
        "provider": [],
        "input_price": [F.col("input_price").asc_nulls_last()],
        "output_price": [F.col("output_price").asc_nulls_last()],
        "context_window": [F.col("context_window").desc_nulls_last()],
        "last_verified": [F.col("last_verified_at").desc_nulls_last()],
    }[sort]
    return first + ties


def facets(rows: DataFrame, columns: Sequence[str] = ("provider", "lifecycle_state", "family", "stage")) -> DataFrame:
    """Counts per facet value in one pass over the unfiltered rows; an unknown value is no choice."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    flat = rows.select(F.explode(pairs).alias("f")).select("f.*")
    return flat.filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("entities"))


def unique_keys(rows: DataFrame, key: Column) -> DataFrame:
    """Key to entity, without the keys two entities claim."""
    counted = rows.groupBy(F.lower(key).alias("model_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.first("entity_id").alias("entity_id"))
    return counted.filter("_n = 1").drop("_n")


def evidence_quality(observed_at: Column, degraded: Column, now: Column, stale_hours: int = STALE_HOURS) -> Column:
    old = F.unix_micros(now) - F.unix_micros(observed_at.cast("timestamp")) > stale_hours * 3_600_000_000
    return (
        F.when(degraded, "degraded").when(observed_at.isNull(), "unknown").when(old, "stale").otherwise("current")
    )


def catalog_quality(rows: DataFrame, quality: str = "quality") -> DataFrame:
    """One quality for a whole result: its worst telling member."""
    q = F.col(quality)
    flags = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(q == "degraded"), F.lit(False)).alias("degraded"),
        F.coalesce(F.bool_and(q == "unknown"), F.lit(True)).alias("unknown"),
        F.coalesce(F.bool_or(q == "stale"), F.lit(False)).alias("stale"),
    )
    return flags.select(
        F.col("n").alias("entities"),
        F.when(F.col("degraded"), "degraded").when(F.col("unknown"), "unknown").when(F.col("stale"), "stale")
        .otherwise("current").alias("quality"),
    )


def lifecycle_active(state: Column, end_of_life: Column) -> Column:
    """Tri-state: unknown while no lifecycle is published."""
    return F.when(state.isNotNull(), ~end_of_life)


# Compared fields in reading order with the evidence domain of each.
COMPARED = (
    ("inputPricePer1MTokens", "input_price", "pricing"),
    ("outputPricePer1MTokens", "output_price", "pricing"),
    ("cachedInputPricePer1MTokens", "cached_price", "pricing"),
    ("currency", "currency", "pricing"),
    ("pricingUnit", "pricing_unit", "pricing"),
    ("contextWindow", "context_window", "capability"),
    ("maxOutputTokens", "max_output_tokens", "capability"),
    ("supportsVision", "supports_vision", "capability"),
    ("supportsToolCalling", "supports_tool_calling", "capability"),
    ("inputModalities", "input_modalities", "capability"),
    ("outputModalities", "output_modalities", "capability"),
    ("lifecycleState", "lifecycle_state", "lifecycle"),
    ("deprecationDate", "deprecated_on", "lifecycle"),
    ("retirementDate", "retirement_date", "lifecycle"),
    ("retirementNotBeforeDate", "not_before_date", "lifecycle"),
    ("recommendedReplacement", "replacement", "lifecycle"),
    ("lastVerifiedAt", "last_verified_at", "lifecycle"),
)


def _shown(rows: DataFrame, column: str) -> Column:
    kind = dict(rows.dtypes)[column]
    if kind.startswith("array"):
        return F.when(F.size(column) > 0, F.array_join(column, ","))
    if kind == "timestamp":
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return F.col(column).cast("string")


def compare(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Aligned comparison in long form: one row per (field, wanted entity) with its value and evidence time.

    ``wanted`` has ``entity_id`` and ``position``; a wider table is one pivot over known ids away.
    """
    observed = {"pricing": "price_observed_at", "capability": "capability_observed_at", "lifecycle": "lifecycle_observed_at"}
    cells = F.array(*[
        F.struct(
            F.lit(n).alias("field_order"), F.lit(field).alias("field"), F.lit(domain).alias("domain"),
            _shown(rows, column).alias("value"), F.col(observed[domain]).alias("observed_at"),
        )
        for n, (field, column, domain) in enumerate(COMPARED)
    ])
    chosen = rows.join(wanted.select("entity_id", "position"), "entity_id")
    flat = chosen.select("entity_id", "position", F.explode(cells).alias("c")).select("entity_id", "position", "c.*")
    return flat.withColumn("known", F.col("value").isNotNull())


def unresolved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ids no entity carries."""
    return wanted.join(rows.select("entity_id"), "entity_id", "left_anti")


def facts(rows: DataFrame, modalities: Sequence[str] = ("text", "image", "audio", "video")) -> DataFrame:
    """Every answerable question per entity: observed, unsupported or unknown.

    A modality outside the observed list is unsupported only if the source says its list is complete;
    conflicting capability evidence answers nothing.
    """
    conflicted = F.coalesce("conflicted", F.lit(False))

    def fact(field: str, value: Column, modality: str | None = None, capability: bool = False, status: Column | None = None) -> Column:
        state = status if status is not None else F.when(value.isNotNull(), "observed").otherwise("unknown")
        if capability:
            state = F.when(conflicted, "unknown").otherwise(state)
        return F.struct(
            F.lit(field).alias("field"), F.lit(modality).cast("string").alias("modality"), state.alias("status"),
            F.when(state == "observed", value).cast("string").alias("value"),
        )

    def flag(column: str) -> Column:
        return F.when(F.col(column), "supported").when(~F.col(column), "not supported")

    def modality_facts(field: str, column: str) -> list[Column]:
        seen = F.coalesce(F.col(column), F.array().cast("array<string>"))
        out = [fact(field, F.when(F.size(seen) > 0, F.array_join(seen, ", ")), None, True)]
        for name in modalities:
            listed = F.array_contains(seen, name)
            closed = F.col("statement").isNotNull() & (F.size(seen) > 0)
            state = F.when(listed, "observed").when(closed, "unsupported").otherwise("unknown")
            out.append(fact(field, F.when(listed, "supported"), name, True, state))
        return out

    price = [F.when(F.col(c).isNotNull(), F.concat(values.money(F.col(c)), F.lit(f" {w}"))) for c, w in
             (("input_price", "input"), ("output_price", "output"))]
    every = [
        fact("context_window", F.col("context_window").cast("string"), None, True),
        fact("max_output_tokens", F.col("max_output_tokens").cast("string"), None, True),
        fact("input_price", F.when(F.col("input_price").isNotNull(), values.money(F.col("input_price")))),
        fact("output_price", F.when(F.col("output_price").isNotNull(), values.money(F.col("output_price")))),
        fact("price", F.nullif(F.concat_ws(", ", *price), F.lit(""))),
        fact("vision", flag("supports_vision"), None, True),
        fact("tool_calling", flag("supports_tool_calling"), None, True),
        *modality_facts("input_modality", "input_modalities"),
        *modality_facts("output_modality", "output_modalities"),
        fact("lifecycle", F.col("lifecycle_state")),
    ]
    return rows.select("entity_id", F.explode(F.array(*every)).alias("f")).select("entity_id", "f.*")


# --- change feed -----------------------------------------------------------------------------------------


def feed_items(evidence: DataFrame) -> DataFrame:
    """Change evidence as display rows."""
    kind = F.col("kind")
    return evidence.select(
        "event_id", "provider", "provider_name", "category", "kind", "field_name", "detected_at", "significance", "summary",
        F.concat_ws(":", F.lower(trim_text("provider")), F.lower(trim_text("model_name"))).alias("model_key"),
        labels.value_text(F.col("old_text"), F.col("old_num")).alias("before"),
        labels.value_text(F.col("new_text"), F.col("new_num")).alias("after"),
        labels.percent_label(F.col("percent_change")).alias("delta"),
        labels.direction(kind).alias("direction"),
        labels.tone(kind).alias("tone"),
        labels.tier_of_score(F.col("significance")).alias("tier"),
        labels.lookup(kind, labels.TYPE_LABELS, kind).alias("type_label"),
        labels.lookup(F.col("category"), labels.CATEGORY_LABELS, F.col("category")).alias("category_label"),
    )


def filter_feed(items: DataFrame, provider: str | None = None, category: str | None = None, since: Column | None = None) -> DataFrame:
    if provider:
        items = items.filter(F.col("provider") == provider)
    if category:
        items = items.filter(F.col("category") == category)
    return items.filter(F.col("detected_at") >= since) if since is not None else items


def mark_watched(items: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Items with a flag for the watched models; nothing is dropped or repeated."""
    keys = watchlist.select("model_key").distinct().withColumn("_w", F.lit(True))
    return items.join(keys, "model_key", "left").withColumn("watched", F.coalesce("_w", F.lit(False))).drop("_w")


def watched_first() -> list[Column]:
    return [F.col("watched").desc(), F.col("detected_at").desc(), F.col("event_id").asc()]
