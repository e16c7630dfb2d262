"""Change evidence over time: build, filter, order, measure, compare."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions import labels, text
from snapledger.functions.values import age_minutes, price_delta, to_fixed
from snapledger.operators.ordered import top_k

# Display names of known providers.
PROVIDER_NAMES = {"anthropic": "Anthropic", "google": "Google", "openai": "OpenAI", "xai": "xAI"}
# Hours covered by each relative range; ytd and all are computed.
RANGE_HOURS = {"24h": 24, "7d": 168, "14d": 336, "30d": 720, "60d": 1440, "90d": 2160, "180d": 4320}


def build_evidence(changes: DataFrame) -> DataFrame:
    """Stored change events as classified, scored and summarised evidence."""
    raw, field = F.col("change_type"), F.col("field_name")
    absolute, percent = price_delta(F.col("old_num"), F.col("new_num"))
    group = labels.category(raw, field)
    priced = (group == "pricing") & field.isNotNull()
    derived = F.struct(
        labels.published_type(raw, field).alias("kind"),
        group.alias("category"),
        F.when(priced, absolute).alias("absolute_change"),
        F.when(priced, percent).alias("percent_change"),
    )
    # Derived once per row: a filter on a generated column is not rewritten in terms of its inputs, so the
    # many uses below read a value. Filters on stored columns still pass through to the scan.
    slugged = changes.withColumn("provider", text.provider_slug(F.col("provider")))
    staged = slugged.select("*", F.inline(F.array(derived)))
    staged = staged.withColumns({
        "provider_name": labels.lookup(F.col("provider"), PROVIDER_NAMES, F.col("provider")),
        "authority": labels.authority(F.col("category")),
    })
    kind, delta = F.col("kind"), F.col("percent_change")
    return staged.withColumns({
        "significance": labels.significance(kind, F.col("category"), delta, F.col("model_name")).cast("int"),
        "confidence": labels.confidence(F.col("authority")),
        "summary": labels.sentence(kind, F.col("model_name"), F.col("provider_name"), field, F.col("old_text"),
                                   F.col("new_text"), F.col("old_num"), F.col("new_num"), delta),
    })


def resolve_range(
    relative: str | None = "30d", since: datetime | None = None, until: datetime | None = None,
    reference: datetime | None = None,
) -> tuple[datetime | None, datetime | None]:
    """Inclusive bounds of a query. An explicit bound replaces the relative range altogether."""
    if since is not None or until is not None:
        return since, until
    reference = reference or datetime.now(timezone.utc).replace(tzinfo=None)
    if relative == "all":
        return None, None
    if relative == "ytd":
        return reference.replace(month=1, day=1, hour=0, minute=0, second=0, microsecond=0), reference
    return reference - timedelta(hours=RANGE_HOURS.get(relative or "30d", RANGE_HOURS["30d"])), reference


def _instant(value: datetime | str) -> Column:
    # As text, so neither side's machine time zone takes part.
    shown = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(shown).cast("timestamp")


def in_window(df: DataFrame, since, until, column: str = "detected_at") -> DataFrame:
    """Rows inside inclusive bounds; on a table stored by day only the folders of these days are read."""
    stored_by_day = "day" in df.columns
    if since is not None:
        df = df.filter(F.col(column) >= _instant(since))
        df = df.filter(F.col("day") >= F.to_date(_instant(since))) if stored_by_day else df
    if until is not None:
        df = df.filter(F.col(column) <= _instant(until))
        df = df.filter(F.col("day") <= F.to_date(_instant(until))) if stored_by_day else df
    return df


def _as_list(value: str | Sequence[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def match_provider(df: DataFrame, wanted: str | Sequence[str] | None) -> DataFrame:
    """Rows of the wanted providers under any alias; nothing wanted, or ``all``, keeps everything."""
    names = _as_list(wanted)
    if not names or "all" in names:
        return df
    folded = sorted({text.PROVIDER_ALIASES.get(n.strip().lower(), n.strip().lower()) for n in names})
    return df.filter(text.provider_slug(F.col("provider")).isin(folded))


def match_name(df: DataFrame, models: str | Sequence[str] | None = None, family: str | None = None,
               columns: Sequence[str] = ("model_name",)) -> DataFrame:
    """Rows whose name or display name contains a wanted text."""

    def contains_any(wanted: str) -> Column:
        hit = F.lit(False)
        for column in columns:
            hit = hit | F.coalesce(F.lower(column).contains(wanted), F.lit(False))
        return hit

    if family:
        df = df.filter(contains_any(family.lower()))
    names = [m.strip().lower() for m in _as_list(models)]
    if names:
        any_hit = F.lit(False)
        for name in names:
            any_hit = any_hit | contains_any(name)
        df = df.filter(any_hit)
    return df


@dataclass(frozen=True)
class TemporalQuery:
    provider: str | Sequence[str] | None = None
    model: str | Sequence[str] | None = None
    family: str | None = None
    relative: str = "30d"
    since: datetime | None = None
    until: datetime | None = None
    categories: Sequence[str] = ()
    types: Sequence[str] = ()
    significant_only: bool = False
    min_significance: int | None = None
    limit: int = 100
    offset: int = 0
    ascending: bool = False
    reference: datetime | None = None

    def floor(self) -> int:
        wanted = self.min_significance or 0
        return max(self.min_significance if self.min_significance is not None else 80, 80) if self.significant_only else wanted


def filter_evidence(evidence: DataFrame, q: TemporalQuery) -> DataFrame:
    rows = in_window(evidence, *resolve_range(q.relative, q.since, q.until, q.reference))
    rows = match_name(match_provider(rows, q.provider), q.model, q.family)
    if q.categories:
        rows = rows.filter(F.col("category").isin(list(q.categories)))
    if q.types:
        rows = rows.filter(F.col("kind").isin(list(q.types)))
    return rows.filter(F.col("significance") >= q.floor()) if q.floor() else rows


def evidence_order(ascending: bool = False) -> list[Column]:
    at = F.col("detected_at").asc() if ascending else F.col("detected_at").desc()
    return [at, F.col("provider").asc(), F.col("model_name").asc(), F.col("kind").asc(), F.col("event_id").asc()]


def evidence_page(evidence: DataFrame, q: TemporalQuery) -> DataFrame:
    return top_k(filter_evidence(evidence, q), evidence_order(q.ascending), q.limit, offset=q.offset)


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def event_metrics(evidence: DataFrame) -> DataFrame:
    """All event counters in one aggregate."""
    kind = F.col("kind")
    return evidence.agg(
        F.count(F.lit(1)).alias("total_events"),
        _count(kind == "price_increased").alias("price_increases"),
        _count(kind == "price_decreased").alias("price_decreases"),
        _count(kind == "model_added").alias("models_added"),
        _count(kind == "model_removed").alias("models_removed"),
        _count(kind == "lifecycle_transition").alias("lifecycle_transitions"),
        _count(kind == "deprecation_scheduled").alias("deprecations_scheduled"),
        _count(kind.isin("retirement_scheduled", "retirement_not_before_scheduled")).alias("retirements_scheduled"),
        _count(kind == "replacement_recommended").alias("replacements_announced"),
    )


def provider_metrics(evidence: DataFrame) -> DataFrame:
    group = F.col("category")
    return evidence.groupBy("provider", "provider_name").agg(
        F.count(F.lit(1)).alias("total"),
        _count(group == "pricing").alias("price_changes"),
        _count(group.isin("lifecycle", "deprecations", "retirements", "replacements")).alias("lifecycle_changes"),
        _count(F.col("kind") == "model_added").alias("additions"),
        _count(F.col("kind") == "model_removed").alias("removals"),
    )


def category_metrics(evidence: DataFrame) -> DataFrame:
    """Counts per category, zero where a category has no event."""
    spark = evidence.sparkSession
    every = spark.createDataFrame([(c,) for c in labels.CATEGORIES], "category string")
    counts = evidence.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("bigint").alias("events"))


def timeline(evidence: DataFrame) -> DataFrame:
    """Events per UTC day."""
    return evidence.groupBy(F.to_date("detected_at").alias("day")).agg(F.count(F.lit(1)).alias("events"))


def timeline_members(evidence: DataFrame) -> DataFrame:
    """The events of each day as rows with the day's count, instead of one array per day."""
    dated = evidence.withColumn("day", F.to_date("detected_at"))
    return dated.join(timeline(evidence), "day")


def compare_providers(evidence: DataFrame, wanted: Sequence[str] = tuple(PROVIDER_NAMES), since=None, until=None) -> DataFrame:
    """One row of statistics per wanted provider, also for one without events.

    Distinct names are counted by grouping per (provider, name) first, so no provider's name set is ever
    held in one task.
    """
    spark = evidence.sparkSession
    folded = [text.PROVIDER_ALIASES.get(p.strip().lower(), p.strip().lower()) for p in wanted]
    asked = spark.createDataFrame(
        [(p, PROVIDER_NAMES.get(p, p.upper())) for p in dict.fromkeys(folded)], "provider string, provider_name string"
    )
    rows = in_window(evidence, since, until)
    kind = F.col("kind")
    down, percent = kind == "price_decreased", F.abs("percent_change")
    retired = kind.isin("retirement_scheduled", "retirement_not_before_scheduled") | (
        (kind == "lifecycle_transition") & (F.col("new_text") == "retired")
    )
    named = rows.groupBy(
        "provider", "model_name", F.when(kind == "replacement_recommended", F.col("new_text")).alias("replacement")
    ).agg(
        F.count(F.lit(1)).alias("events"),
        _count(down).alias("reductions"),
        _count(kind == "price_increased").alias("increases"),
        F.sum(F.when(down, percent)).alias("reduction_sum"),
        F.count(F.when(down, percent)).alias("reduction_n"),
        F.bool_or(kind == "model_added").alias("launched"),
        F.bool_or(kind == "deprecation_scheduled").alias("deprecated"),
        F.bool_or(F.coalesce(retired, F.lit(False))).alias("retired"),
        F.bool_or(kind == "replacement_recommended").alias("replaced"),
    )
    # One more level joins the replacement variants of a name; each (name, replacement) stays one replacement.
    per_name = named.groupBy("provider", "model_name").agg(
        *[F.sum(c).alias(c) for c in ("events", "reductions", "increases", "reduction_sum", "reduction_n")],
        *[F.bool_or(c).alias(c) for c in ("launched", "deprecated", "retired")],
        F.count_if("replaced").alias("replacements"),
    )
    stats = per_name.groupBy("provider").agg(
        *[F.sum(c).alias(c) for c in ("events", "reductions", "increases", "reduction_sum", "reduction_n", "replacements")],
        F.count_if("launched").alias("launches"),
        F.count_if("deprecated").alias("deprecations"),
        F.count_if("retired").alias("retirements"),
    )
    joined = asked.join(stats, "provider", "left")
    counted = ("events", "reductions", "increases", "launches", "deprecations", "retirements", "replacements")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counted})
    # How much each kind of event takes off the score.
    penalty = (F.col("reductions") * 5 + F.col("increases") * 8 + F.col("deprecations") * 6
               + F.col("retirements") * 10 + F.col("launches") * 4)
    return filled.select(
        "provider", "provider_name", *counted,
        to_fixed(F.try_divide("reduction_sum", "reduction_n"), 1).alias("mean_reduction_percent"),
        F.greatest(F.lit(20), F.least(F.lit(100), 100 - penalty)).cast("bigint").alias("stability_score"),
    )


def with_impact(evidence: DataFrame) -> DataFrame:
    """Every event with the reason it matters."""
    reason = labels.impact_reason(F.col("kind"), F.col("field_name"), F.col("new_text"), F.col("percent_change"))
    return evidence.withColumn("impact_reason", reason)


def significant_changes(evidence: DataFrame, k: int = 10, min_score: int = 75, since=None, until=None) -> DataFrame:
    """The k highest-scoring events with a reason; ties go to the newest, then to the smallest id."""
    rows = in_window(evidence, since, until).filter(F.col("significance") >= min_score)
    order = [F.col("significance").desc(), F.col("detected_at").desc(), F.col("event_id").asc()]
    return with_impact(top_k(rows, order, k))


def narrative_counts(evidence: DataFrame) -> DataFrame:
    """The counts a written summary of a period restates."""
    kind = F.col("kind")
    scheduled = ("deprecation_scheduled", "retirement_scheduled", "retirement_not_before_scheduled")
    return evidence.agg(
        F.count(F.lit(1)).alias("events"),
        _count(kind == "model_added").alias("additions"),
        _count(kind == "price_decreased").alias("reductions"),
        _count(kind == "price_increased").alias("increases"),
        _count(kind.isin(*scheduled)).alias("scheduled"),
        _count((kind == "lifecycle_transition") & (F.col("new_text") == "retired")).alias("retirements"),
        _count(kind == "replacement_recommended").alias("replacements"),
    )


def evidence_span(df: DataFrame, now: Column, column: str = "detected_at") -> DataFrame:
    """Oldest and newest observation of a result and the age of the oldest, in whole minutes."""
    spans = df.agg(F.min(column).alias("oldest"), F.max(column).alias("newest"))
    return spans.withColumn("max_age_minutes", age_minutes(F.col("oldest"), now))
