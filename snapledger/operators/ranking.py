"""Constraint checks and cost ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions import text
from snapledger.functions.values import round_cost
from snapledger.operators.ordered import global_rank, top_k, top_per_key

SATISFIED, UNSATISFIED, UNKNOWN, NOT_APPLICABLE = "satisfied", "unsatisfied", "unknown", "not_applicable"
METRICS = {"lowest_total_cost": "total_cost", "lowest_input_cost": "input_cost", "lowest_output_cost": "output_cost"}


@dataclass(frozen=True)
class Request:
    """A monthly workload and its requirements. A false or empty requirement is none."""

    input_tokens: int = 0
    output_tokens: int = 0
    min_context_window: int | None = None
    min_max_output_tokens: int | None = None
    vision_required: bool = False
    tool_calling_required: bool = False
    active_only: bool = False
    providers: Sequence[str] = ()
    exclude_providers: Sequence[str] = ()
    exclude_ids: Sequence = ()
    priority: str = "lowest_total_cost"
    currency: str = "USD"
    limit: int | None = None


def _provider_in(names: Sequence[str]) -> Column:
    wanted = sorted({text.PROVIDER_ALIASES.get(n.strip().lower(), n.strip().lower()) for n in names})
    return text.provider_slug(F.col("provider")).isin(wanted)


def _asked(asked: bool, observed: Column | None, passes: Column) -> Column:
    """Status of one requirement; ``observed`` None means its evidence is always there."""
    if not asked:
        return F.lit(NOT_APPLICABLE)
    verdict = F.when(passes, SATISFIED).otherwise(UNSATISFIED)
    return verdict if observed is None else F.when(observed.isNull(), UNKNOWN).otherwise(verdict)


def requirement_checks(r: Request) -> Column:
    """All eight requirements as array of (requirement, status), in a fixed order."""
    context, output = F.col("context_window"), F.col("max_output_tokens")
    vision, tools = F.col("supports_vision"), F.col("supports_tool_calling")
    statuses = {
        "provider_allowed": _asked(bool(r.providers), None, _provider_in(r.providers or [""])),
        "provider_not_excluded": _asked(bool(r.exclude_providers), None, ~_provider_in(r.exclude_providers or [""])),
        "model_not_excluded": _asked(bool(r.exclude_ids), None, ~F.col("entity_id").isin(list(r.exclude_ids) or [None])),
        "lifecycle_active": _asked(r.active_only, None, ~F.col("end_of_life")),
        "min_context_window": _asked(r.min_context_window is not None, context, context >= (r.min_context_window or 0)),
        "min_max_output_tokens": _asked(r.min_max_output_tokens is not None, output, output >= (r.min_max_output_tokens or 0)),
        "vision": _asked(r.vision_required, vision, vision),
        "tool_calling": _asked(r.tool_calling_required, tools, tools),
    }
    return F.array(*[F.struct(F.lit(n).alias("requirement"), s.alias("status")) for n, s in statuses.items()])


def failing(checks: Column) -> Column:
    return F.filter(checks, lambda c: c["status"].isin(UNSATISFIED, UNKNOWN))


def component_cost(tokens: Column, price: Column) -> Column:
    """No tokens cost nothing even without a price; tokens without a price cost an unknown amount."""
    return F.when(tokens == 0, 0.0).when(price.isNotNull(), round_cost(tokens / 1_000_000 * price))


def with_costs(rows: DataFrame, input_tokens: Column, output_tokens: Column, currency: str) -> DataFrame:
    """Adds both component costs, the total, and why an incomplete cost is incomplete.

    An unstated currency is comparable; a stated different one is not, and is never converted.
    """
    has_tier = F.col("price_snapshot_id").isNotNull()
    foreign = has_tier & F.coalesce(F.upper("currency") != currency.upper(), F.lit(False))
    usable = has_tier & ~foreign
    priced = rows.withColumns({
        "input_cost": component_cost(input_tokens, F.when(usable, F.col("input_price"))),
        "output_cost": component_cost(output_tokens, F.when(usable, F.col("output_price"))),
    })
    complete = F.col("input_cost").isNotNull() & F.col("output_cost").isNotNull()
    exclusion = (
        F.when(complete, None).when(~has_tier, "no_pricing_evidence").when(foreign, "currency_not_comparable")
        .when(F.col("input_cost").isNull(), "input_price_unobserved").otherwise("output_price_unobserved")
    )
    return priced.withColumns({
        "total_cost": round_cost(F.col("input_cost") + F.col("output_cost")), "cost_exclusion": exclusion,
    })


def candidates(rows: DataFrame, r: Request) -> DataFrame:
    """Every entity with its checks, costs, metric and class. Nothing is dropped.

    ``bucket`` is where a result lists it; ``eligibility`` says why it is not ranked.
    """
    costed = with_costs(rows, F.lit(r.input_tokens), F.lit(r.output_tokens), r.currency)
    checked = costed.withColumn("checks", requirement_checks(r)).withColumn("failing", failing(F.col("checks")))
    eligible = F.size("failing") == 0
    metric = F.col(METRICS[r.priority])
    bucket = F.when(eligible & metric.isNotNull(), "ranked").when(eligible, "eligible_without_cost").otherwise("excluded")
    all_unknown = F.forall("failing", lambda c: c["status"] == UNKNOWN)
    eligibility = (
        F.when(F.col("bucket") == "ranked", "eligible").when(F.col("bucket") == "eligible_without_cost", "unavailable_pricing")
        .when(all_unknown, "unknown_evidence").otherwise("excluded")
    )
    return checked.withColumns({"eligible": eligible, "metric": metric, "bucket": bucket}).withColumn("eligibility", eligibility)


def rank_order() -> list[Column]:
    """Metric, total, input, output, larger context, provider, name, id: a total order."""
    rising = [F.col(c).asc_nulls_last() for c in ("metric", "total_cost", "input_cost", "output_cost")]
    return [*rising, F.col("context_window").desc_nulls_last(), *[F.col(c).asc() for c in ("provider", "model_name", "entity_id")]]


def _order_struct() -> Column:
    """The same order as one comparable struct, for ``min_by``."""
    far = F.lit(float("inf"))
    rising = [F.coalesce(F.col(c), far) for c in ("metric", "total_cost", "input_cost", "output_cost")]
    context = F.coalesce(-F.col("context_window").cast("double"), far)
    return F.struct(*rising, context, "provider", "model_name", "entity_id")


def ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Ranked candidates; an entity without a metric is absent, not last."""
    rankable = rows.filter("bucket = 'ranked'")
    return top_k(rankable, rank_order(), limit) if limit else global_rank(rankable, rank_order())


def winner_gap(rows: DataFrame, k: int = 10) -> DataFrame:
    """The first k with the distance of each to the next one."""
    page = top_k(rows.filter("bucket = 'ranked'"), rank_order(), k + 1)
    following = F.lead("metric").over(Window.orderBy("rank"))
    return page.withColumn("gap_to_next", round_cost(following - F.col("metric"))).filter(F.col("rank") <= k)


def result_counts(rows: DataFrame) -> DataFrame:
    """Size of each bucket and why there is no ranking, if there is none."""
    counted = rows.agg(
        F.count(F.lit(1)).alias("considered"),
        F.count_if("eligible").alias("eligible"),
        F.count_if(F.col("bucket") == "ranked").alias("ranked"),
        F.count_if(F.col("bucket") == "eligible_without_cost").alias("eligible_without_cost"),
        F.count_if(F.col("bucket") == "excluded").alias("excluded"),
    )
    reason = (
        F.when(F.col("ranked") > 0, None).when(F.col("considered") == 0, "no_models")
        .when(F.col("eligible") == 0, "no_eligible_models").otherwise("no_comparable_pricing")
    )
    return counted.withColumn("insufficiency", reason)


def best_per_provider(rows: DataFrame, providers: Sequence[str]) -> DataFrame:
    """The first-ranked entity of each asked provider, or why it has none."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(p,) for p in providers], "asked string").withColumn(
        "slug", text.provider_slug(F.col("asked")))
    best = rows.groupBy(text.provider_slug(F.col("provider")).alias("slug")).agg(
        F.min_by(F.struct("entity_id", "metric"), F.when(F.col("bucket") == "ranked", _order_struct())).alias("choice"),
        F.count_if(F.col("bucket") == "eligible_without_cost").alias("unpriced"),
        F.count_if(F.col("bucket") == "excluded").alias("excluded"),
    )
    reason = (
        F.when(F.col("choice").isNotNull(), None).when(F.col("unpriced") > 0, "no_comparable_price")
        .when(F.col("excluded") > 0, "all_failed_a_requirement").otherwise("no_models")
    )
    return asked.join(best, "slug", "left").select(
        "asked", F.col("choice.entity_id").alias("entity_id"), F.col("choice.metric").alias("metric"), reason.alias("reason"))


def rank_by_context(rows: DataFrame) -> DataFrame:
    """Eligible entities by context window, largest first. An unknown window cannot win."""
    usable = rows.filter(F.col("eligible") & F.col("context_window").isNotNull())
    return global_rank(usable, [F.col("context_window").desc(), F.col("model_key").asc(), F.col("entity_id").asc()])


def rank_workloads(rows: DataFrame, workloads: Sequence[tuple[str, int, int]], k: int, currency: str = "USD") -> DataFrame:
    """The k cheapest entities of every workload (name, input tokens, output tokens).

    The workloads are a literal array in the plan, so each entity is read once; only the best k of every part of a workload's rows
    reach the last ranking.
    """
    specs = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(i).cast("bigint").alias("input"), F.lit(o).cast("bigint").alias("output"))
        for n, i, o in workloads
    ])
    spread = rows.withColumn("_w", F.explode(specs)).withColumn("workload", F.col("_w.name"))
    costed = with_costs(spread, F.col("_w.input"), F.col("_w.output"), currency).withColumn("metric", F.col("total_cost"))
    return top_per_key(costed.filter(F.col("metric").isNotNull()).drop("_w"), ["workload"], rank_order(), k, "rank")
