"""Current-evidence reads, temporal queries, the change feed, source health and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.functions import labels, text
from snapledger.operators import details, explorer, health, provenance, temporal
from snapledger.operators.ordered import global_rank, latest, top_k
from snapledger.operators.temporal import TemporalQuery
from snapledger.plans.explore import current_entries
from snapledger.queries.history import KEY, NEWEST_SQL, ORDER, _latest_sql, day, sql_day, sql_stamp, stamp
from snapledger.queries.registry import query
from snapledger.queries.scalars import (
    EVIDENCE, NOW, PROVIDER_NAMES, SQL_DIRECTION, SQL_PCT_LABEL, SQL_TIER, evidence, lit_ts, sql_case, sql_fixed, sql_price_text,
)
from snapledger.queries.sqlviews import cte
from snapledger.sources import tables, views

ENTRY_SQL = """select *, greatest(price_observed_at, capability_observed_at, lifecycle_observed_at) as last_verified_at,
  coalesce(lifecycle_state in ('deprecated','retired'), false) as end_of_life from (
  select p_partkey as entity_id, p_brand as provider, p_name as model_name, pp.mode as price_mode, pp.tier as price_tier,
    pp.snapshot_id as price_snapshot_id, pp.input as input_price, pp.cached as cached_price, pp.output as output_price,
    pp.currency, pp.pricing_unit, pp.source_url as price_url, pp.observed_at as price_observed_at,
    c.display_name, c.api_id, c.family, c.stage, c.context_window, c.max_output_tokens, c.supports_vision, c.supports_tool_calling,
    c.input_modalities, c.output_modalities, c.statement, case when c.entity_id is not null then false end as conflicted, c.observed_at as capability_observed_at,
    l.state as lifecycle_state, l.deprecated_on, l.retirement_date, l.not_before_date, l.replacement, l.observed_at as lifecycle_observed_at
  from part left join prim pp on pp.entity_id = p_partkey left join v_capability c on c.entity_id = p_partkey left join life l on l.entity_id = p_partkey)"""
PRIMARY_SQL = """select * exclude (rn) from (select *, row_number() over (partition by entity_id order by case when mode = 'n' then 0 else 1 end,
  case tier when 'f' then 0 when 'x' then 1 else 50 end, mode, tier) as rn from cur) where rn = 1"""
ENTRIES = cte(
    "v_price_obs", "v_capability", "v_lifecycle",
    cur=_latest_sql("v_price_obs"), prim=PRIMARY_SQL,
    life=_latest_sql("v_lifecycle", "true", "entity_id", "observed_at desc, run_id desc"), entry=ENTRY_SQL,
)


def entries(spark, folder):
    part = tables.load(spark, folder, "part")
    entities = part.select(
        F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("provider"), F.col("p_name").alias("model_name"))
    capabilities = views.capabilities(spark, folder).drop("provider", "lifecycle_state")
    return current_entries(
        entities, views.price_lines(spark, folder), capabilities, views.lifecycle_obs(spark, folder),
        lit_ts(NOW), ORDER, ["observed_at", "run_id"], "n", ("f", "x"), lambda rows: views.price_shown(spark, folder, rows),
    )


@query(
    "e4_entity_evidence",
    ENTRIES + f"select entity_id, provider, price_snapshot_id, input_price, output_price, context_window, supports_vision,"
    f" lifecycle_state, {sql_stamp('last_verified_at')}, end_of_life from entry",
)
def e4_entity_evidence(spark, folder):
    return entries(spark, folder).select(
        "entity_id", "provider", "price_snapshot_id", "input_price", "output_price", "context_window", "supports_vision",
        "lifecycle_state", stamp("last_verified_at"), "end_of_life",
    )


@query(
    "g14_newest_domain",
    ENTRIES + """select entity_id, case when last_verified_at is null then null when price_observed_at = last_verified_at then 'pricing'
  when capability_observed_at = last_verified_at then 'capability' else 'lifecycle' end as newest_domain from entry""",
)
def g14_newest_domain(spark, folder):
    return entries(spark, folder).select("entity_id", "newest_domain")


@query(
    "g18_unique_keys",
    cte("v_change") + "select model_key, min(entity_id) as entity_id from (select distinct lower(model_name) as model_key, entity_id"
    " from v_change) group by 1 having count(*) = 1",
)
def g18_unique_keys(spark, folder):
    rows = views.changes(spark, folder).select("model_name", "entity_id").distinct()
    return explorer.unique_keys(rows, F.upper("model_name"))


@query(
    "g19_entity_freshness",
    ENTRIES + f"select entity_id, {sql_stamp('last_verified_at')}, greatest(cast(floor((epoch_us(timestamp '{NOW}') - epoch_us(last_verified_at))"
    " / 60000000.0) as bigint), 0) as age_minutes from entry",
)
def g19_entity_freshness(spark, folder):
    return entries(spark, folder).select("entity_id", stamp("last_verified_at"), "age_minutes")


def _filtered(name: str, where: str, f: explorer.Filters) -> None:
    @query(name, ENTRIES + f"select entity_id, provider, input_price, context_window from entry where {where}")
    def build(spark, folder):
        return explorer.apply_filters(entries(spark, folder), f).select("entity_id", "provider", "input_price", "context_window")


_filtered("h1_provider_filter", "lower(provider) in ('brand#1', 'brand#7')", explorer.Filters(providers=(" Brand#1", "BRAND#7 ", " ")))
_filtered("h2_bounds_filter", "input_price <= 50000 and output_price <= 40 and context_window >= 1000 and max_output_tokens >= 12",
          explorer.Filters(max_input_price=50000, max_output_price=40, min_context_window=1000, min_max_output_tokens=12))
_filtered("h3_required_capability", "supports_vision and supports_tool_calling", explorer.Filters(vision_required=True, tool_calling_required=True))
_filtered("h4_active_only", "not end_of_life", explorer.Filters(active_only=True))
_filtered("h5_state_family_stage", "lifecycle_state in ('active','deprecated') and family in ('en','fr') and stage = 'ga'",
          explorer.Filters(lifecycle_states=("active", "deprecated"), families=("EN", "fr"), stages=("GA",)))
_filtered("h6_modalities_filter", "list_has_all(input_modalities, ['text','image']) and list_contains(output_modalities, 'text')",
          explorer.Filters(input_modalities=("Text", "image"), output_modalities=("text",)))
_filtered("h7_search_filter", "contains(model_name, 'ring') or contains(lower(display_name), 'ring') or contains(lower(api_id), 'ring')",
          explorer.Filters(search="RING "))


@query(
    "h8_catalog_filter",
    cte("v_capability") + "select entity_id, context_window, family from v_capability where supports_vision = false and context_window >= 100"
    " and contains(family, 'e') and list_contains(input_modalities, 'text')",
)
def h8_catalog_filter(spark, folder):
    rows = views.capabilities(spark, folder).withColumn("model_name", F.col("display_name"))
    kept = explorer.catalog_filter(rows, supports_vision=False, min_context_window=100, family="E", input_modality="TEXT")
    return kept.select("entity_id", "context_window", "family")


@query(
    "h13_active_sources",
    cte("v_source") + "select source_id, kind from v_source where is_active",
)
def h13_active_sources(spark, folder):
    return views.sources(spark, folder).filter(F.col("is_active").eqNullSafe(True)).select("source_id", "kind")


@query(
    "h16_three_state_labels",
    cte("v_capability") + "select entity_id, case when supports_vision then 'Supported' when not supports_vision then 'Not supported' else 'Unknown' end as vision,"
    " case when supports_tool_calling then 'Supported' when not supports_tool_calling then 'Not supported' else 'Unknown' end as tools from v_capability",
)
def h16_three_state_labels(spark, folder):
    return views.capabilities(spark, folder).select(
        "entity_id", labels.three_state_label(F.col("supports_vision")).alias("vision"),
        labels.three_state_label(F.col("supports_tool_calling")).alias("tools"),
    )


QUALITY_SQL = """select *, case when family = 'de' then 'degraded' when last_verified_at is null then 'unknown'
  when epoch_us(timestamp '2024-01-03') - epoch_us(last_verified_at) > 48 * 3600000000 then 'stale' else 'current' end as quality from entry"""


def _quality_rows(spark, folder):
    rows = entries(spark, folder)
    quality = explorer.evidence_quality(F.col("last_verified_at"), F.coalesce(F.col("family") == "de", F.lit(False)), lit_ts("2024-01-03"))
    return rows.withColumn("quality", quality)


@query("h17_evidence_quality", ENTRIES + f"select entity_id, quality from ({QUALITY_SQL})")
def h17_evidence_quality(spark, folder):
    return _quality_rows(spark, folder).select("entity_id", "quality")


@query(
    "h17_catalog_quality",
    ENTRIES + f"select provider, count(*) as entities, case when bool_or(quality = 'degraded') then 'degraded' when bool_and(quality = 'unknown') then 'unknown'"
    f" when bool_or(quality = 'stale') then 'stale' else 'current' end as quality from (select 'all' as provider, quality from ({QUALITY_SQL})) group by 1",
)
def h17_catalog_quality(spark, folder):
    return explorer.catalog_quality(_quality_rows(spark, folder)).withColumn("provider", F.lit("all"))


@query(
    "i1_sort_input_price",
    ENTRIES + "select entity_id, input_price, row_number() over (order by input_price asc nulls last, provider, model_name, entity_id) as rank from entry",
)
def i1_sort_input_price(spark, folder):
    rows = entries(spark, folder).select("entity_id", "provider", "model_name", "input_price")
    return global_rank(rows, explorer.entry_order("input_price")).select("entity_id", "input_price", "rank")


@query(
    "i1_sort_context",
    ENTRIES + "select entity_id, context_window, row_number() over (order by context_window desc nulls last, provider, model_name, entity_id) as rank from entry",
)
def i1_sort_context(spark, folder):
    rows = entries(spark, folder).select("entity_id", "provider", "model_name", "context_window")
    return global_rank(rows, explorer.entry_order("context_window")).select("entity_id", "context_window", "rank")


@query(
    "i7_explorer_limit",
    ENTRIES + "select entity_id, provider, row_number() over (order by provider, model_name, entity_id) as rank from entry"
    " order by provider, model_name, entity_id limit 500",
)
def i7_explorer_limit(spark, folder):
    rows = entries(spark, folder).select("entity_id", "provider", "model_name")
    return top_k(rows, explorer.entry_order(), 500).select("entity_id", "provider", "rank")


@query(
    "j5_facets",
    ENTRIES + """select facet, value, count(*) as entities from (select 'provider' as facet, provider as value from entry
  union all select 'lifecycle_state', lifecycle_state from entry union all select 'family', family from entry
  union all select 'stage', stage from entry) where value is not null group by 1, 2""",
)
def j5_facets(spark, folder):
    return explorer.facets(entries(spark, folder))


@query(
    "j12_entity_rates",
    cte("v_price_obs", cur=_latest_sql("v_price_obs"))
    + f"select entity_id, mode, tier, input, cached, output, {sql_stamp('max(observed_at) over (partition by entity_id)', 'last_verified_at')} from cur",
)
def j12_entity_rates(spark, folder):
    # Rates stay rows; the per-entity time joins on, so no array of unknown length is built.
    state = latest(views.price_obs(spark, folder), KEY, ORDER)
    newest = state.groupBy("entity_id").agg(F.max("observed_at").alias("last_verified_at"))
    return state.join(newest, "entity_id").select("entity_id", "mode", "tier", "input", "cached", "output", stamp("last_verified_at"))


# --- temporal queries ------------------------------------------------------------------------------------


def _window(name: str, where: str, q: TemporalQuery) -> None:
    @query(name, EVIDENCE + f"select event_id, provider, kind, significance from evidence where {where}")
    def build(spark, folder):
        return temporal.filter_evidence(evidence(spark, folder), q).select("event_id", "provider", "kind", "significance")


from datetime import datetime  # noqa: E402

REFERENCE = datetime(2024, 1, 20)
_window("h9_time_window", "detected_at >= timestamp '2024-01-13' and detected_at <= timestamp '2024-01-20'",
        TemporalQuery(relative="7d", reference=REFERENCE))
_window("h9_year_to_date", "detected_at >= timestamp '2024-01-01' and detected_at <= timestamp '2024-01-20'",
        TemporalQuery(relative="ytd", reference=REFERENCE))
_window("h10_provider_alias", "provider in ('anthropic', 'xai')", TemporalQuery(relative="all", provider=("Claude", "grok")))
_window("h11_name_filter", "contains(model_name, '-pro') and (contains(model_name, 'model-1') or contains(model_name, 'model-2'))",
        TemporalQuery(relative="all", family="-PRO", model=("Model-1", "model-2")))
_window("h12_category_significance", "category in ('pricing','retirements') and kind in ('price_decreased','retirement_scheduled') and significance >= 80",
        TemporalQuery(relative="all", categories=("pricing", "retirements"), types=("price_decreased", "retirement_scheduled"), significant_only=True))

_ORDER_SQL = "detected_at desc, provider, model_name, kind, event_id"


@query("i2_temporal_order", EVIDENCE + f"select event_id, row_number() over (order by {_ORDER_SQL}) as rank from evidence")
def i2_temporal_order(spark, folder):
    rows = evidence(spark, folder).select("event_id", "detected_at", "provider", "model_name", "kind")
    return global_rank(rows, temporal.evidence_order()).select("event_id", "rank")


@query(
    "i3_temporal_page",
    EVIDENCE + f"select event_id, rank from (select event_id, row_number() over (order by {_ORDER_SQL}) as rank from evidence"
    " where detected_at >= timestamp '2023-12-21' and detected_at <= timestamp '2024-01-20') where rank > 200 and rank <= 300",
)
def i3_temporal_page(spark, folder):
    page = temporal.evidence_page(evidence(spark, folder), TemporalQuery(relative="30d", reference=REFERENCE, limit=100, offset=200))
    return page.select("event_id", "rank")


_SIG_ORDER = "significance desc, detected_at desc, event_id"


@query(
    "i4_significant_changes",
    EVIDENCE + f"select event_id, significance, row_number() over (order by {_SIG_ORDER}) as rank from evidence where significance >= 75"
    f" order by {_SIG_ORDER} limit 10",
)
def i4_significant_changes(spark, folder):
    return temporal.significant_changes(evidence(spark, folder)).select("event_id", "significance", "rank")


_SQL_NUM = "regexp_replace(regexp_replace(printf('%.8f', {0}), '0+$', ''), '\\.$', '')"
# The published reasons.
IMPACT_SQL = f"""case when kind = 'model_added' then 'New model release introduced to provider catalog'
  when kind = 'price_decreased' and percent_change <> 0 then 'Major price reduction of ' || {_SQL_NUM.format('abs(percent_change)')} || '% on ' || field_name
  when kind = 'price_increased' and percent_change <> 0 then 'Price increase of ' || {_SQL_NUM.format('percent_change')} || '% on ' || field_name
  when kind = 'lifecycle_transition' and new_text = 'retired' then 'Model lifecycle officially shut down / retired'
  when kind in ('retirement_scheduled','retirement_not_before_scheduled') then 'Retirement date scheduled for ' || new_text
  when kind = 'deprecation_scheduled' then 'Deprecation announced with effective date ' || new_text
  when kind = 'replacement_recommended' then 'Migration path designated to ' || new_text
  else 'Significant operational update observed' end"""


@query(
    "i5_impact_reason",
    EVIDENCE + f"select event_id, {IMPACT_SQL} as impact_reason from evidence",
)
def i5_impact_reason(spark, folder):
    return temporal.with_impact(evidence(spark, folder)).select("event_id", "impact_reason")


KIND_COUNTS = [
    ("price_increases", "kind = 'price_increased'"), ("price_decreases", "kind = 'price_decreased'"), ("models_added", "kind = 'model_added'"),
    ("models_removed", "kind = 'model_removed'"), ("lifecycle_transitions", "kind = 'lifecycle_transition'"),
    ("deprecations_scheduled", "kind = 'deprecation_scheduled'"),
    ("retirements_scheduled", "kind in ('retirement_scheduled','retirement_not_before_scheduled')"),
    ("replacements_announced", "kind = 'replacement_recommended'"),
]


@query("j1_event_metrics", EVIDENCE + "select count(*) as total_events, " + ", ".join(f"count(*) filter ({c}) as {n}" for n, c in KIND_COUNTS) + " from evidence")
def j1_event_metrics(spark, folder):
    return temporal.event_metrics(evidence(spark, folder))


@query(
    "j2_provider_metrics",
    EVIDENCE + "select provider, provider_name, count(*) as total, count(*) filter (category = 'pricing') as price_changes,"
    " count(*) filter (category in ('lifecycle','deprecations','retirements','replacements')) as lifecycle_changes,"
    " count(*) filter (kind = 'model_added') as additions, count(*) filter (kind = 'model_removed') as removals from evidence group by 1, 2",
)
def j2_provider_metrics(spark, folder):
    return temporal.provider_metrics(evidence(spark, folder))


@query(
    "j3_category_metrics",
    EVIDENCE + "select c.category, count(e.event_id) as events from (values " + ", ".join(f"('{c}')" for c in labels.CATEGORIES)
    + ") c(category) left join evidence e on e.category = c.category group by 1",
)
def j3_category_metrics(spark, folder):
    return temporal.category_metrics(evidence(spark, folder))


@query("j4_timeline", EVIDENCE + f"select {sql_day('detected_at', 'day')}, count(*) as events from evidence group by 1")
def j4_timeline(spark, folder):
    return temporal.timeline(evidence(spark, folder)).select(day("day"), "events")


@query(
    "j4_timeline_members",
    EVIDENCE + f"select event_id, {sql_day('detected_at', 'day')}, count(*) over (partition by cast(detected_at as date)) as events from evidence",
)
def j4_timeline_members(spark, folder):
    return temporal.timeline_members(evidence(spark, folder)).select("event_id", day("day"), "events")


COMPARE_SQL = """select p.provider, p.provider_name, count(e.event_id) as events, count(*) filter (kind = 'price_decreased') as reductions,
  count(*) filter (kind = 'price_increased') as increases, count(distinct case when kind = 'model_added' then model_name end) as launches,
  count(distinct case when kind = 'deprecation_scheduled' then model_name end) as deprecations,
  count(distinct case when kind in ('retirement_scheduled','retirement_not_before_scheduled') or (kind = 'lifecycle_transition' and new_text = 'retired') then model_name end) as retirements,
  count(distinct case when kind = 'replacement_recommended' then model_name || ' > ' || new_text end) as replacements,
  avg(abs(percent_change)) filter (kind = 'price_decreased') as mean_raw
from (values ('anthropic','Anthropic'), ('google','Google'), ('openai','OpenAI'), ('nobody','NOBODY')) p(provider, provider_name)
left join (select * from evidence where {window}) e on e.provider = p.provider group by 1, 2"""
WHOLE_SQL = COMPARE_SQL.format(window="true")
COMPARED = ("Claude", "gemini", "openai", "nobody")
STABILITY_SQL = "greatest(20, least(100, 100 - (reductions * 5 + increases * 8 + deprecations * 6 + retirements * 10 + launches * 4))) as stability_score"


@query(
    "j6_compare_providers",
    EVIDENCE + "select provider, provider_name, events, reductions, increases, launches, deprecations, retirements, replacements,"
    f" {sql_fixed('mean_raw', 1)} as mean_reduction_percent from ({WHOLE_SQL})",
)
def j6_compare_providers(spark, folder):
    return temporal.compare_providers(evidence(spark, folder), COMPARED).drop("stability_score")


@query(
    "j7_stability_score",
    EVIDENCE + f"select provider, {STABILITY_SQL} from ({WHOLE_SQL})",
)
def j7_stability_score(spark, folder):
    return temporal.compare_providers(evidence(spark, folder), COMPARED).select("provider", "stability_score")


# A window is the operator's parameter; in half an hour the score is neither at its floor nor at its ceiling.
NARROW = ("2024-01-05 00:00:00", "2024-01-05 00:30:00")


@query(
    "j7_stability_in_window",
    EVIDENCE + f"select provider, {STABILITY_SQL} from ({COMPARE_SQL.format(window=f"detected_at >= timestamp '{NARROW[0]}' and detected_at <= timestamp '{NARROW[1]}'")})",
)
def j7_stability_in_window(spark, folder):
    return temporal.compare_providers(evidence(spark, folder), COMPARED, *NARROW).select("provider", "stability_score")


@query(
    "j14_evidence_span",
    EVIDENCE + f"select {sql_stamp('min(detected_at)', 'oldest')}, {sql_stamp('max(detected_at)', 'newest')},"
    f" cast(floor((epoch_us(timestamp '{NOW}') - epoch_us(min(detected_at))) / 60000000.0) as bigint) as max_age_minutes from evidence",
)
def j14_evidence_span(spark, folder):
    return temporal.evidence_span(evidence(spark, folder), lit_ts(NOW)).select(stamp("oldest"), stamp("newest"), "max_age_minutes")


@query(
    "j15_distinct_provenance",
    cte("v_price_obs") + f"select snapshot_id, source_url, {sql_stamp('observed_at')} from v_price_obs group by 1, 2, observed_at",
)
def j15_distinct_provenance(spark, folder):
    obs = views.price_obs(spark, folder)
    rows = provenance.distinct_provenance(obs.unionByName(obs))
    return rows.select("snapshot_id", "source_url", stamp("observed_at"))


@query(
    "n4_narrative_counts",
    EVIDENCE + """select count(*) as events, count(*) filter (kind = 'model_added') as additions, count(*) filter (kind = 'price_decreased') as reductions,
  count(*) filter (kind = 'price_increased') as increases, count(*) filter (kind in ('deprecation_scheduled','retirement_scheduled','retirement_not_before_scheduled')) as scheduled,
  count(*) filter (kind = 'lifecycle_transition' and new_text = 'retired') as retirements, count(*) filter (kind = 'replacement_recommended') as replacements from evidence""",
)
def n4_narrative_counts(spark, folder):
    return temporal.narrative_counts(evidence(spark, folder))


# --- change feed -----------------------------------------------------------------------------------------


def _sql_value(text_column: str, number: str) -> str:
    trimmed = f"trim({text_column})"
    shown = f"case when lower({trimmed}) in ('active','legacy','deprecated','retired','preview') then upper({trimmed}[1]) || {trimmed}[2:] else nullif({trimmed}, '') end"
    return f"coalesce({sql_price_text(number)}, {shown})"


FEED_SQL = f"""select event_id, provider, category, detected_at, lower(provider) || ':' || lower(model_name) as model_key, {_sql_value('old_text', 'old_num')} as before,
  {_sql_value('new_text', 'new_num')} as after, {SQL_PCT_LABEL} as delta, {SQL_DIRECTION} as direction, {sql_case('kind', labels.TONES, 'null')} as tone, {SQL_TIER} as tier from evidence"""
FEED_OUT = ["event_id", "model_key", "before", "after", "delta", "direction", "tone", "tier"]


@query("h15_feed_items", EVIDENCE + f"select {', '.join(FEED_OUT)} from ({FEED_SQL})")
def h15_feed_items(spark, folder):
    return explorer.feed_items(evidence(spark, folder)).select(*FEED_OUT)


@query("h14_feed_filter", EVIDENCE + f"select event_id, after from ({FEED_SQL}) where provider = 'openai' and category = 'pricing' and detected_at >= timestamp '2024-01-15'")
def h14_feed_filter(spark, folder):
    items = explorer.filter_feed(explorer.feed_items(evidence(spark, folder)), "openai", "pricing", lit_ts("2024-01-15"))
    return items.select("event_id", "after")


@query("h18_evidence_domain", cte("v_change") + f"select event_id, {sql_case('change_type', labels.DOMAINS, chr(39) + 'other' + chr(39))} as domain from v_change")
def h18_evidence_domain(spark, folder):
    return views.changes(spark, folder).select("event_id", labels.evidence_domain(F.col("change_type")).alias("domain"))


# The watchlist: models that ever had an event worth more than 200.
WATCH_SQL = "select distinct lower(provider) || ':' || lower(model_name) as model_key from evidence where old_num > 200"


def watchlist(spark, folder):
    return explorer.feed_items(evidence(spark, folder).filter("old_num > 200")).select("model_key")


@query("e8_watched_split", EVIDENCE + f"select event_id, coalesce(w.model_key is not null, false) as watched from ({FEED_SQL}) f left join ({WATCH_SQL}) w using (model_key)")
def e8_watched_split(spark, folder):
    items = explorer.mark_watched(explorer.feed_items(evidence(spark, folder)), watchlist(spark, folder))
    return items.select("event_id", "watched")


@query(
    "i6_watched_first",
    EVIDENCE + f"select event_id, watched, row_number() over (order by watched desc, detected_at desc, event_id) as rank from"
    f" (select event_id, detected_at, w.model_key is not null as watched from ({FEED_SQL}) f left join ({WATCH_SQL}) w using (model_key))",
)
def i6_watched_first(spark, folder):
    items = explorer.mark_watched(explorer.feed_items(evidence(spark, folder)), watchlist(spark, folder))
    return global_rank(items.select("event_id", "watched", "detected_at"), explorer.watched_first()).select("event_id", "watched", "rank")


# --- source health ---------------------------------------------------------------------------------------

HEALTH_NOW, STALENESS = "2001-08-02", 525600
NEWEST_RUN = "select * exclude (rn) from (select *, row_number() over (partition by source_id order by started_at desc, run_id desc) as rn from v_run) where rn = 1"
NEWEST_INCIDENT = "select * exclude (rn) from (select *, row_number() over (partition by source_id order by created_at desc, run_id desc) as rn from v_incident) where rn = 1"
# Health by incident state, whether a repair was tried, and state of the newest run; NULL stands for any, the first row that fits counts.
HEALTH_CASES = """(values (1, 'open', true, null, 'healing'), (2, 'healing', true, null, 'healing'), (3, 'open', null, null, 'quarantined'),
  (4, 'needs_review', null, null, 'needs_review'), (5, 'resolved', null, 'succeeded', 'recovered'), (6, null, null, 'succeeded', 'healthy'),
  (7, null, null, 'partial', 'degraded'), (8, null, null, 'failed', 'quarantined'), (9, null, null, null, 'healthy')) k(turn, incident_state, tried, run_state, health)"""
HEALTH_SQL = f"""select source_id, any_value(columns(s.* exclude (source_id))), any_value(r.run_id) as run_id, any_value(r.status) as run_status, any_value(r.started_at) as started_at,
  any_value(r.completed_at) as completed_at, any_value(r.records_accepted) as records_accepted, any_value(i.incident_id) as incident_id,
  any_value(i.status) as incident_status, arg_min(k.health, k.turn) as health
from v_source s left join newest_run r using (source_id) left join newest_incident i using (source_id)
join {HEALTH_CASES} on (k.incident_state is null or k.incident_state = i.status) and (k.tried is null or k.tried = (i.healing_attempt_count > 0))
  and (k.run_state is null or k.run_state = r.status) group by source_id"""
SUCCESS_SQL = "select source_id, arg_max(coalesce(completed_at, started_at), (started_at, run_id)) as last_success_at from v_run where status = 'succeeded' group by 1"
RECOVERY_SQL = """select source_id, count(*) filter (status not in ('open','healing','needs_review')) as resolved_incidents, max(resolved_at) as last_recovered_at,
  cast(sum(coalesce(n, 0)) as bigint) as healing_attempts from v_incident left join
  (select incident_id, count(distinct attempt_number) as n from v_repair group by 1) using (incident_id) group by 1"""
VIEW_SQL = f"""select h.*, last_success_at, cast(floor((epoch_us(timestamp '{HEALTH_NOW}') - epoch_us(last_success_at)) / 60000000.0) as bigint) as age_minutes,
  last_recovered_at, coalesce(resolved_incidents, 0) as resolved_incidents, coalesce(healing_attempts, 0) as healing_attempts
from health h left join success using (source_id) left join recovery using (source_id)"""
HEALTH = cte("v_run", "v_source", "v_incident", "v_repair", newest_run=NEWEST_RUN, newest_incident=NEWEST_INCIDENT, health=HEALTH_SQL,
             success=SUCCESS_SQL, recovery=RECOVERY_SQL, health_view=VIEW_SQL)
FRESH_SQL = f"case when age_minutes is null then 'unknown' when age_minutes > {STALENESS} then 'stale' when age_minutes > {STALENESS} / 2 then 'aging' else 'fresh' end"


def gate_health(spark, folder):
    return health.gate_health(views.sources(spark, folder), views.runs(spark, folder), views.incidents(spark, folder))


def health_view(spark, folder):
    return health.health_view(
        views.sources(spark, folder), views.runs(spark, folder), views.incidents(spark, folder), views.repair_attempts(spark, folder),
        lit_ts(HEALTH_NOW), F.lit(STALENESS))


@query("g5_source_health", HEALTH + f"select source_id, kind, run_id as last_run_id, run_status as last_run_status, {sql_stamp('started_at', 'last_run_started_at')}, records_accepted from health")
def g5_source_health(spark, folder):
    rows = health.source_health(views.sources(spark, folder), views.runs(spark, folder))
    return rows.select(
        "source_id", "kind", F.col("run.run_id").alias("last_run_id"), F.col("run.status").alias("last_run_status"),
        stamp("run.started_at", "last_run_started_at"), F.col("run.records_accepted").alias("records_accepted"),
    )


@query("g6_gate_health", HEALTH + "select source_id, incident_id, health from health")
def g6_gate_health(spark, folder):
    return gate_health(spark, folder).select("source_id", F.col("incident.incident_id").alias("incident_id"), "health")


@query(
    "g7_health_view",
    HEALTH + f"select source_id, health, age_minutes, {FRESH_SQL} as freshness, {sql_stamp(f'last_success_at + to_minutes({STALENESS})', 'stale_after')},"
    f" {sql_stamp('last_recovered_at')}, resolved_incidents from health_view",
)
def g7_health_view(spark, folder):
    return health_view(spark, folder).select(
        "source_id", "health", "age_minutes", "freshness", stamp("stale_after"), stamp("last_recovered_at"), "resolved_incidents")


@query("j16_healing_attempts", HEALTH + "select source_id, healing_attempts from health_view")
def j16_healing_attempts(spark, folder):
    return health_view(spark, folder).select("source_id", "healing_attempts")


@query(
    "g8_first_per_key",
    cte("v_repair") + "select incident_id, arg_min(attempt_id, (started_at, attempt_id)) as attempt_id from v_repair group by 1",
)
def g8_first_per_key(spark, folder):
    attempts = views.repair_attempts(spark, folder)
    return attempts.groupBy("incident_id").agg(F.min_by("attempt_id", F.struct("started_at", "attempt_id")).alias("attempt_id"))


FAILURES_SQL = """select r.source_id, count(*) filter (status not in ('running','skipped','succeeded') and (ok is null or (started_at, run_id) > ok)) as consecutive_failures
from v_run r left join (select source_id, max((started_at, run_id)) as ok from v_run where status = 'succeeded' group by 1) using (source_id) group by 1"""


@query("g9_consecutive_failures", cte("v_run") + FAILURES_SQL)
def g9_consecutive_failures(spark, folder):
    return health.consecutive_failures(views.runs(spark, folder))


@query(
    "g10_attempt_summary",
    cte("v_run", failures=FAILURES_SQL)
    + """select source_id, arg_max(run_id, (started_at, run_id)) as last_attempt, arg_max(run_id, (started_at, run_id)) filter (status <> 'running') as last_completed,
  arg_max(run_id, (started_at, run_id)) filter (status = 'succeeded') as last_success, any_value(consecutive_failures) >= 3 as needs_attention
from v_run join failures using (source_id) group by 1""",
)
def g10_attempt_summary(spark, folder):
    rows = health.attempt_summary(views.runs(spark, folder))
    return rows.select("source_id", *[F.col(f"{c}.run_id").alias(c) for c in ("last_attempt", "last_completed", "last_success")], "needs_attention")


@query(
    "j8_fleet_counts",
    HEALTH + f"""select count(*) as total, count(*) filter (is_active) as enabled, count(*) filter (health = 'healthy') as healthy,
  count(*) filter (health = 'recovered') as recovered, count(*) filter (health in ('healthy','recovered')) as operational,
  count(*) filter (health = 'degraded') as degraded, count(*) filter (health = 'quarantined') as quarantined, count(*) filter (health = 'healing') as healing,
  count(*) filter (health = 'needs_review') as needs_review, count(*) filter ({FRESH_SQL} = 'stale') as stale,
  count(*) filter (incident_status in ('open','healing','needs_review')) as open_incidents,
  count(*) filter (incident_status not in ('open','healing','needs_review')) as recovered_incidents from health_view""",
)
def j8_fleet_counts(spark, folder):
    return health.fleet_counts(health_view(spark, folder))


RUN_HEALTH = "case run_status when 'succeeded' then 'healthy' when 'partial' then 'degraded' when 'failed' then 'down' else 'unknown' end"


@query(
    "j9_provider_status",
    HEALTH + f"select source_id // 4 as provider_id, case max(case s when 'down' then 3 when 'degraded' then 2 when 'healthy' then 1 else 0 end) when 3 then 'down' when 2 then 'degraded'"
    f" when 1 then 'healthy' else 'unknown' end as status, count(*) as sources, cast(sum(records_accepted) as bigint) as accepted_records from (select *, {RUN_HEALTH} as s from health) group by 1",
)
def j9_provider_status(spark, folder):
    # Four sources a provider, so that the worst of them is not always the worst there is.
    sources = gate_health(spark, folder).withColumn("provider_id", F.floor(F.col("source_id") / 4))
    return health.provider_status(sources).select("provider_id", "status", "sources", "accepted_records")


@query(
    "j10_ecosystem_status",
    HEALTH + f"""select *, case when sources = 0 then 'unknown' when affected = 0 then case when healthy > 0 then 'healthy' else 'unknown' end
  when affected <= greatest(1, floor(sources * 0.2)) then 'operational' else 'degraded' end as status from (
  select count(*) as sources, count(*) filter (s in ('degraded','down')) as affected, count(*) filter (s = 'healthy') as healthy from (select {RUN_HEALTH} as s from health))""",
)
def j10_ecosystem_status(spark, folder):
    return health.ecosystem_status(gate_health(spark, folder))


@query(
    "j11_dashboard_totals",
    HEALTH.rstrip() + f", " + cte("v_price_obs", "v_change")[5:] + f"""select (select count(distinct entity_id) from v_price_obs) as priced_entities, (select count(*) from part) as entities,
  (select count(*) from v_change where detected_at >= timestamp '2024-01-29') as changes_24h,
  (select count(*) from v_change where detected_at >= timestamp '2024-01-23' and change_type in ('price_increased','price_decreased')) as price_changes_7d,
  (select count(*) from v_change where detected_at >= timestamp '2024-01-23' and change_type in ('lifecycle_changed','model_removed')) as lifecycle_changes_7d,
  count(*) filter (run_status = 'failed') as active_alerts, {sql_stamp('max(completed_at)', 'last_refresh')} from health""",
)
def j11_dashboard_totals(spark, folder):
    totals = health.dashboard_totals(
        views.price_obs(spark, folder), tables.load(spark, folder, "part"), views.changes(spark, folder), gate_health(spark, folder), lit_ts("2024-01-30"))
    return totals.withColumn("last_refresh", F.date_format("last_refresh", "yyyy-MM-dd HH:mm:ss"))


@query(
    "j13_run_counts",
    cte("v_run_header") + """select *, case when total - skipped = 0 then 'noop' when succeeded = total - skipped then 'completed' when succeeded = 0 then 'failed' else 'partial' end as outcome from (
  select count(*) as total, count(*) filter (s = 'succeeded') as succeeded, count(*) filter (s = 'failed') as failed, count(*) filter (s = 'quarantined') as quarantined,
  count(*) filter (s = 'skipped') as skipped from (select case status when 'partial' then 'quarantined' when 'running' then 'skipped' else status end as s from v_run_header))""",
)
def j13_run_counts(spark, folder):
    status = F.when(F.col("status") == "partial", "quarantined").when(F.col("status") == "running", "skipped").otherwise(F.col("status"))
    return health.fleet_run_status(views.run_headers(spark, folder).withColumn("status", status))


@query(
    "j17_degraded_providers",
    HEALTH + "select distinct provider_id from health where is_active and kind in ('models','pricing') and run_status in ('failed','partial')",
)
def j17_degraded_providers(spark, folder):
    return health.degraded_providers(gate_health(spark, folder))


@query(
    "e13_source_match",
    HEALTH + """select c.source_id, coalesce(u.source_id, k.source_id) as matched_source, coalesce(u.health, k.health) as health
from (select source_id, provider_id, kind, case when kind = 'pricing' then source_url else 'https://moved.example.com/' || source_id end as source_url from v_source) c
left join (select source_url, min(source_id) as source_id, arg_min(health, source_id) as health from health group by 1) u using (source_url)
left join (select provider_id, kind, min(source_id) as source_id, arg_min(health, source_id) as health from health group by 1, 2) k
  on k.provider_id = c.provider_id and k.kind = c.kind""",
)
def e13_source_match(spark, folder):
    configured = views.sources(spark, folder).select(
        "source_id", "provider_id", "kind",
        F.when(F.col("kind") == "pricing", F.col("source_url")).otherwise(F.concat(F.lit("https://moved.example.com/"), "source_id")).alias("source_url"))
    rows = health.match_health(configured, gate_health(spark, folder))
    return rows.select("source_id", F.col("match.source_id").alias("matched_source"), F.col("match.health").alias("health"))


@query(
    "l6_run_view",
    cte("v_run") + """select run_id, case status when 'running' then 'pending' when 'failed' then 'failed' else case when records_rejected > 0 then 'partial' else 'passed' end end as validation,
  greatest(epoch_ms(completed_at) - epoch_ms(started_at), 0) as duration_ms from (select * from v_run where completed_at is not null)
  union all select run_id, case status when 'running' then 'pending' end, null from v_run where completed_at is null""",
)
def l6_run_view(spark, folder):
    return health.run_view(views.runs(spark, folder)).select("run_id", "validation", "duration_ms")


@query(
    "l8_source_detail",
    cte("v_run", "v_price_obs", "v_incident", "v_repair") + f"""select source_id, 'incident' as item, incident_id as ref, cast(rn as int) as rn from (
  select *, row_number() over (partition by source_id order by created_at desc, run_id desc) as rn from v_incident) where rn <= 5
union all select source_id, 'repair', attempt_id, cast(rn as int) from (select i.source_id, p.attempt_id, row_number() over (partition by i.source_id order by p.started_at desc, p.attempt_id desc) as rn
  from v_repair p join v_incident i using (incident_id)) where rn <= 5
union all select source_id, 'run', cast(run_id as varchar) as ref, cast(rn as int) as rn from (select *, row_number() over (partition by source_id order by started_at desc, run_id desc) as rn from v_run) where rn <= 5
union all select source_id, 'observation', snapshot_id, cast(row_number() over (partition by source_id order by {NEWEST_SQL}) as int) from (
  select *, row_number() over (partition by source_id, entity_id, mode, tier order by {NEWEST_SQL}) as first_of_key from (
  select o.*, r.source_id, row_number() over (partition by r.source_id order by {NEWEST_SQL.replace('run_id', 'o.run_id')}) as rn from v_price_obs o join v_run r on r.run_id = o.run_id) where rn <= 20) where first_of_key = 1""",
)
def l8_source_detail(spark, folder):
    return details.source_detail(
        views.run_headers(spark, folder), views.incidents(spark, folder), views.repair_attempts(spark, folder), views.price_obs(spark, folder), KEY, ORDER)


# --- provenance ------------------------------------------------------------------------------------------

REFS_SQL = "select 'price' as ref_kind, snapshot_id as ref_id, run_id from v_price_obs union all select 'change', cast(event_id as varchar), run_id from v_change"
PROVENANCE = cte("v_price_obs", "v_change", "v_run_header", "v_source", "v_provider", "v_incident", refs=REFS_SQL)


def provenance_rows(spark, folder):
    refs = views.price_obs(spark, folder).select(F.lit("price").alias("ref_kind"), F.col("snapshot_id").alias("ref_id"), "run_id").unionByName(
        views.changes(spark, folder).select(F.lit("change").alias("ref_kind"), F.col("event_id").cast("string").alias("ref_id"), "run_id"))
    return provenance.provenance(
        refs, views.run_headers(spark, folder), views.sources(spark, folder), views.providers(spark, folder), views.incidents(spark, folder))


@query(
    "e6_provenance_chain",
    PROVENANCE + "select ref_kind, ref_id, r.external_run_id, p.provider_slug, 'https://n' || s.provider_id || '.example.com/p/' || s.source_id as source_url"
    " from refs left join v_run_header r using (run_id) left join v_source s using (source_id) left join v_provider p on p.provider_id = s.provider_id",
)
def e6_provenance_chain(spark, folder):
    return provenance_rows(spark, folder).select("ref_kind", "ref_id", "external_run_id", "provider_slug", "source_url")


@query(
    "l5_validation_state",
    PROVENANCE + """select ref_kind, ref_id, case when r.run_id is null then 'unknown' when h.run_id is not null then 'quarantined' when r.status = 'succeeded' then 'validated'
  when r.status in ('partial','failed') then 'provisional' else 'unknown' end as validation from refs left join v_run_header r using (run_id)
  left join (select distinct run_id from v_incident where status in ('open','healing','needs_review')) h on h.run_id = r.run_id""",
)
def l5_validation_state(spark, folder):
    return provenance_rows(spark, folder).select("ref_kind", "ref_id", "validation")


@query(
    "e7_trusted_events",
    "select e.event_id, d.doc_id from (select event_id, case when event_type <> 'click' then user_id end as doc_id from events) e"
    " left join (select page_id as doc_id from pages where regexp_matches(url, '[?&]ref=')) d using (doc_id) where d.doc_id is null",
)
def e7_trusted_events(spark, folder):
    events = tables.load(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "click", F.col("user_id")).alias("snapshot_id"))
    snapshots = tables.load(spark, folder, "pages").select(
        F.col("page_id").alias("snapshot_id"), F.to_json(F.struct(F.col("url").alias("source_url"))).alias("raw"))
    kept = provenance.trusted_events(events, snapshots, provenance.inadmissible(F.col("raw"), "ref"))
    return kept.select("event_id", F.lit(None).cast("bigint").alias("doc_id"))


# --- comparison and facts --------------------------------------------------------------------------------


def wanted_entities(spark, folder):
    """The entities compared: every part of the widest size, in id order, plus ids nobody carries."""
    sizes = tables.load(spark, folder, "part").filter("p_size = 50").select(F.col("p_partkey").alias("entity_id"))
    missing = sizes.select((-F.col("entity_id") - 1).alias("entity_id"))
    return sizes.unionByName(missing).withColumn("position", F.col("entity_id"))


def _sql_text(column: str, kind: str) -> str:
    return {"num": f"cast({column} as varchar)", "text": column, "list": f"nullif(array_to_string({column}, ','), '')",
            "date": f"strftime({column}, '%Y-%m-%d')", "time": f"strftime({column}, '%Y-%m-%d %H:%M:%S')"}[kind]


_KINDS = ["num", "num", "num", "text", "text", "num", "num", "num", "num", "list", "list", "text", "date", "date", "date", "text", "time"]
_CELLS = ", ".join(
    f"('{field}', '{domain}', {_sql_text(column, kind)})" for (field, column, domain), kind in zip(explorer.COMPARED, _KINDS))


@query(
    "l1_compare",
    ENTRIES + f"select entity_id, field, domain, value, value is not null as known from (select e.*, f.* from entry e join part on p_partkey = entity_id and p_size = 50,"
    f" lateral (values {_CELLS}) f(field, domain, value))",
)
def l1_compare(spark, folder):
    rows = explorer.compare(entries(spark, folder), wanted_entities(spark, folder))
    return rows.select("entity_id", "field", "domain", "value", "known")


@query("e9_unresolved_ids", "select -p_partkey - 1 as entity_id from part where p_size = 50")
def e9_unresolved_ids(spark, folder):
    return explorer.unresolved(entries(spark, folder), wanted_entities(spark, folder)).select("entity_id")


_MONEY = "'$' || printf('%.2f', {0})"


def _modality_sql(field: str, column: str) -> list[str]:
    seen = f"coalesce({column}, cast([] as varchar[]))"
    rows = [f"('{field}', null, case when len({seen}) > 0 then 'observed' else 'unknown' end, nullif(array_to_string({seen}, ', '), ''))"]
    for m in ("text", "image", "audio", "video"):
        has = f"list_contains({seen}, '{m}')"
        rows.append(f"('{field}', '{m}', case when {has} then 'observed' when statement is not null and len({seen}) > 0 then 'unsupported' else 'unknown' end,"
                    f" case when {has} then 'supported' end)")
    return rows


def _fact_sql(field: str, value: str) -> str:
    return f"('{field}', null, case when {value} is not null then 'observed' else 'unknown' end, {value})"


def _flag_sql(column: str) -> str:
    return f"case when {column} then 'supported' when not {column} then 'not supported' end"


FACTS = ", ".join([
    _fact_sql("context_window", "cast(context_window as varchar)"), _fact_sql("max_output_tokens", "cast(max_output_tokens as varchar)"),
    _fact_sql("input_price", _MONEY.format("input_price")), _fact_sql("output_price", _MONEY.format("output_price")),
    _fact_sql("price", f"nullif(concat_ws(', ', {_MONEY.format('input_price')} || ' input', {_MONEY.format('output_price')} || ' output'), '')"),
    _fact_sql("vision", _flag_sql("supports_vision")), _fact_sql("tool_calling", _flag_sql("supports_tool_calling")),
    *_modality_sql("input_modality", "input_modalities"), *_modality_sql("output_modality", "output_modalities"),
    _fact_sql("lifecycle", "lifecycle_state"),
])


@query("l4_fact_lookup", ENTRIES + f"select entity_id, f.* from entry, lateral (values {FACTS}) f(field, modality, status, value)")
def l4_fact_lookup(spark, folder):
    return explorer.facts(entries(spark, folder))


@query(
    "l2_entity_detail",
    cte("v_price_obs", "v_lifecycle", "v_change", "v_capability") + f"""select entity_id, 'price' as item, snapshot_id as ref, cast(rn as int) as rn from (select *, row_number() over (partition by entity_id order by {NEWEST_SQL}) as rn from v_price_obs) where rn <= 100
union all select entity_id, 'lifecycle', snapshot_id, cast(rn as int) from (select *, row_number() over (partition by entity_id order by observed_at desc, run_id desc) as rn from v_lifecycle) where rn <= 100
union all select entity_id, 'change', cast(event_id as varchar), cast(rn as int) from (select *, row_number() over (partition by entity_id order by detected_at desc, event_id desc) as rn from v_change) where rn <= 50
union all select entity_id, 'capability', api_id, cast(rn as int) from (select *, row_number() over (partition by entity_id order by observed_at desc, api_id desc) as rn from v_capability) where rn <= 100
union all select entity_id, 'current', snapshot_id, cast(row_number() over (partition by entity_id order by mode, tier) as int) from (
  select *, row_number() over (partition by entity_id, mode, tier order by {NEWEST_SQL}) as rn from v_price_obs) where rn = 1
union all select entity_id, 'api_id', api_id, 1 from (select distinct entity_id, api_id from v_lifecycle)""",
)
def l2_entity_detail(spark, folder):
    return details.entity_detail(
        views.price_obs(spark, folder), views.lifecycle_obs(spark, folder), views.capabilities(spark, folder).withColumn("snapshot_id", F.col("api_id")),
        views.changes(spark, folder), KEY, ORDER)
