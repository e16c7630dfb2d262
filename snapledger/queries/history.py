"""Scans, current state and change detection over price, lifecycle and capability history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.operators import current, diff
from snapledger.operators.ordered import global_rank, latest, top_k
from snapledger.queries.registry import query
from snapledger.queries.sqlviews import cte
from snapledger.sources import tables, views

PREV_UNTIL, CURR_SINCE, CURR_UNTIL = "1998-01-01", "1998-01-01", "1999-07-01"
KEY, ORDER = views.PRICE_IDENTITY, views.PRICE_ORDER
NEWEST_SQL = "observed_at desc, run_id desc, line_no desc, supplier_id desc, input desc"


def stamp(column: str | Column, name: str | None = None) -> Column:
    """A time as text, so both engines print it the same way."""
    text = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return text.alias(name or column)


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def sql_stamp(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {name or column}"


def sql_day(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d') as {name or column}"


def _latest_sql(source: str, where: str = "true", partition: str = "entity_id, mode, tier", newest: str = NEWEST_SQL) -> str:
    return (
        f"select * exclude (rn) from (select *, row_number() over (partition by {partition} order by {newest}) as rn"
        f" from {source} where {where}) where rn = 1"
    )


PREV_SQL = _latest_sql("v_price_obs", f"observed_at < timestamp '{PREV_UNTIL}'")
CURR_SQL = _latest_sql(
    "v_price_obs", f"observed_at >= timestamp '{CURR_SINCE}' and observed_at < timestamp '{CURR_UNTIL}'"
)


def price_states(spark, folder):
    history = views.price_obs(spark, folder)
    return (
        current.as_of(history, KEY, ORDER, PREV_UNTIL),
        current.as_of(history, KEY, ORDER, CURR_UNTIL, CURR_SINCE),
    )


def price_pairs(spark, folder):
    """Both states from one pass, with only the compared columns."""
    names = [*KEY, *ORDER, "snapshot_id", "cached", "cache_write", "output", "pricing_unit", "source_url"]
    return current.as_of_pairs(views.price_obs(spark, folder).select(*names), KEY, ORDER, PREV_UNTIL, CURR_UNTIL)


PRICE_OUT = ["entity_id", "mode", "tier", "snapshot_id", "input", "cached", "cache_write", "output", "run_id"]
PRICE_OUT_SQL = ", ".join(PRICE_OUT)

# Change events between the two states, in SQL.
EVENTS_SQL = """
pairs as (select coalesce(p.entity_id, c.entity_id) as entity_id, coalesce(p.mode, c.mode) as mode,
    coalesce(p.tier, c.tier) as tier, p.snapshot_id as prev_snapshot_id, c.snapshot_id as curr_snapshot_id,
    p.input as p_input, c.input as c_input, p.cached as p_cached, c.cached as c_cached,
    p.cache_write as p_write, c.cache_write as c_write, p.output as p_output, c.output as c_output,
    p.pricing_unit as p_unit, c.pricing_unit as c_unit, p.source_url as p_url, c.source_url as c_url
  from prev p full outer join curr c on p.entity_id = c.entity_id and p.mode = c.mode and p.tier = c.tier),
presence as (select entity_id, bool_or(prev_snapshot_id is not null) as any_prev,
    bool_or(curr_snapshot_id is not null) as any_curr from pairs group by 1),
field_moves as (
  select entity_id, mode, tier, prev_snapshot_id, curr_snapshot_id, f.field_name, f.o as old_num, f.n as new_num
  from pairs, lateral (values ('inputPricePer1MTokens', p_input, c_input),
    ('cachedInputPricePer1MTokens', p_cached, c_cached), ('cacheWritePricePer1MTokens', p_write, c_write),
    ('outputPricePer1MTokens', p_output, c_output)) f(field_name, o, n)
  where prev_snapshot_id is not null and curr_snapshot_id is not null and f.o is distinct from f.n),
text_moves as (
  select entity_id, mode, tier, prev_snapshot_id, curr_snapshot_id, f.field_name, f.o as old_text, f.n as new_text
  from pairs, lateral (values ('pricingUnit', p_unit, c_unit), ('sourceUrl', p_url, c_url)) f(field_name, o, n)
  where prev_snapshot_id is not null and curr_snapshot_id is not null and f.o is distinct from f.n),
ends as (
  select x.*, case when prev_snapshot_id is null then 'model_added' else 'model_removed' end as change_type,
    case when prev_snapshot_id is null then not any_prev else not any_curr end as whole,
    row_number() over (partition by entity_id, prev_snapshot_id is null order by mode, tier) as rn
  from pairs x join presence using (entity_id)
  where prev_snapshot_id is null or curr_snapshot_id is null),
events as (
  select entity_id, mode, tier, prev_snapshot_id, curr_snapshot_id,
    case when old_num is null or new_num is null then 'metadata_changed' when new_num > old_num then 'price_increased'
      else 'price_decreased' end as change_type, field_name, old_num, new_num,
    cast(null as varchar) as old_text, cast(null as varchar) as new_text from field_moves
  union all
  select entity_id, mode, tier, prev_snapshot_id, curr_snapshot_id, 'metadata_changed', field_name, null, null, old_text, new_text
  from text_moves
  union all
  select entity_id, case when not whole then mode end, case when not whole then tier end, prev_snapshot_id, curr_snapshot_id,
    change_type, null, null, null, prev_snapshot_id, curr_snapshot_id
  from ends where not whole or rn = 1)
"""
DIFF_CTE = cte("v_price_obs", prev=PREV_SQL, curr=CURR_SQL).rstrip() + "," + EVENTS_SQL


@query(
    "flagship_price_movement",
    DIFF_CTE + "select change_type, coalesce(field_name, '') as field_name, count(*) as events,"
    " count(distinct entity_id) as entities, round(avg(new_num - old_num), 2) as mean_move from events group by 1, 2",
)
def flagship_price_movement(spark, folder):
    events = diff.diff_pairs(price_pairs(spark, folder))
    # Entity counts come from one extra grouping level, so no distinct set is held per group.
    per_entity = events.groupBy("change_type", F.coalesce("field_name", F.lit("")).alias("field_name"), "entity_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("new_num") - F.col("old_num")).alias("move"),
        F.count(F.col("new_num") - F.col("old_num")).alias("moved"),
    )
    return per_entity.groupBy("change_type", "field_name").agg(
        F.sum("n").alias("events"),
        F.count(F.lit(1)).alias("entities"),
        F.round(F.try_divide(F.sum("move"), F.sum("moved")), 2).alias("mean_move"),
    )


# --- scans -----------------------------------------------------------------------------------------------


@query(
    "a1_load_raw",
    "select doc_id, role, turn, len(text) as text_length from (select conv_id as doc_id, role, turn, text from conversations)",
)
def a1_load_raw(spark, folder):
    # The turns of a conversation arrive as one JSON record each and are parsed with a declared schema.
    raw = tables.load(spark, folder, "conversations").select(
        "conv_id", F.to_json(F.struct("role", "turn", "text")).alias("raw")
    )
    parsed = raw.select("conv_id", F.from_json("raw", "role STRING, turn BIGINT, text STRING").alias("r"))
    return parsed.select(
        F.col("conv_id").alias("doc_id"), "r.role", "r.turn", F.length("r.text").cast("bigint").alias("text_length")
    )


@query(
    "a2_scan_current",
    cte("v_price_obs", cur=_latest_sql("v_price_obs"))
    + f"select {PRICE_OUT_SQL} from cur where provider in ('Brand#1') and mode = 'a' and tier = 'f'",
)
def a2_scan_current(spark, folder):
    state = latest(views.price_obs(spark, folder), KEY, ORDER)
    return tables.scan_current(state, provider="Brand#1", mode="a", tier="f").select(*PRICE_OUT)


@query(
    "a3_scan_history",
    cte("v_price_obs")
    + f"select entity_id, mode, tier, snapshot_id, {sql_stamp('observed_at')}, rn from (select *,"
    f" cast(row_number() over (partition by entity_id, mode, tier order by {NEWEST_SQL}) as int) as rn from v_price_obs) where rn <= 3",
)
def a3_scan_history(spark, folder):
    newest = [F.col(c).desc() for c in ORDER]
    rows = tables.scan_history(views.price_obs(spark, folder), KEY, newest, 3)
    return rows.select(*KEY, "snapshot_id", stamp("observed_at"), "rn")


@query(
    "a4_scan_changes",
    cte("v_change")
    + "select event_id, entity_id, change_type, cast(row_number() over (order by detected_at desc, event_id desc) as bigint) as rank"
    " from v_change where change_type in ('price_increased','price_decreased') and detected_at >= timestamp '2024-01-10'"
    " order by detected_at desc, event_id desc limit 50",
)
def a4_scan_changes(spark, folder):
    order = [F.col("detected_at").desc(), F.col("event_id").desc()]
    rows = tables.scan_changes(
        views.changes(spark, folder),
        types=["price_increased", "price_decreased"],
        since="2024-01-10",
        order=order,
        limit=None,
    )
    return top_k(rows, order, 50).select("event_id", "entity_id", "change_type", "rank")


# --- current state ---------------------------------------------------------------------------------------


@query("g1_latest_price", cte("v_price_obs") + f"select {PRICE_OUT_SQL}, {sql_stamp('observed_at')} from ({_latest_sql('v_price_obs')})")
def g1_latest_price(spark, folder):
    return latest(views.price_obs(spark, folder), KEY, ORDER).select(*PRICE_OUT, stamp("observed_at"))


@query(
    "g1_latest_price_agg",
    cte("v_price_obs") + f"select entity_id, mode, tier, snapshot_id, input, output from ({_latest_sql('v_price_obs')})",
)
def g1_latest_price_agg(spark, folder):
    from snapledger.operators.ordered import latest_by_aggregate

    rows = views.price_obs(spark, folder).select(*KEY, *ORDER, "snapshot_id", "output")
    return latest_by_aggregate(rows, KEY, ORDER).select(*KEY, "snapshot_id", "input", "output")


COMPARABLE_SQL = "run_id in (select run_id from v_run_header where status in ('succeeded','partial'))"


@query(
    "g2_latest_comparable_price",
    cte("v_price_obs", "v_run_header") + f"select {PRICE_OUT_SQL} from ({_latest_sql('v_price_obs', COMPARABLE_SQL)})",
)
def g2_latest_comparable_price(spark, folder):
    rows = current.latest_comparable(
        views.price_obs(spark, folder), views.run_headers(spark, folder), KEY, ORDER
    )
    return rows.select(*PRICE_OUT)


LIFE_KEY, LIFE_ORDER = views.LIFECYCLE_IDENTITY, views.LIFECYCLE_ORDER
LIFE_NEWEST = "observed_at desc, run_id desc"


def _latest_life_sql(where: str = "true") -> str:
    return _latest_sql("v_lifecycle", where, "entity_id, api_id", LIFE_NEWEST)


@query(
    "g3_latest_lifecycle",
    cte("v_lifecycle", "v_run_header")
    + f"select entity_id, api_id, snapshot_id, state, {sql_day('deprecated_on')}, false as comparable from ({_latest_life_sql()})"
    f" union all select entity_id, api_id, snapshot_id, state, {sql_day('deprecated_on')}, true from ({_latest_life_sql(COMPARABLE_SQL)})",
)
def g3_latest_lifecycle(spark, folder):
    observations = views.lifecycle_obs(spark, folder)
    every = latest(observations, LIFE_KEY, LIFE_ORDER).withColumn("comparable", F.lit(False))
    usable = current.latest_comparable(observations, views.run_headers(spark, folder), LIFE_KEY, LIFE_ORDER)
    both = every.unionByName(usable.withColumn("comparable", F.lit(True)))
    return both.select("entity_id", "api_id", "snapshot_id", "state", day("deprecated_on"), "comparable")


@query(
    "g4_latest_capability",
    cte("v_capability")
    + "select provider, family, entity_id, context_window, supports_vision from (select *, row_number() over"
    " (partition by provider, family order by observed_at desc, entity_id desc) as rn from v_capability) where rn = 1",
)
def g4_latest_capability(spark, folder):
    rows = latest(views.capabilities(spark, folder), ["provider", "family"], ["observed_at", "entity_id"])
    return rows.select("provider", "family", "entity_id", "context_window", "supports_vision")


@query(
    "g11_primary_tier",
    cte("v_price_obs", cur=_latest_sql("v_price_obs"))
    + "select entity_id, mode, tier, snapshot_id from (select *, row_number() over (partition by entity_id order by"
    " case when mode = 'n' then 0 else 1 end, case tier when 'f' then 0 when 'x' then 1 else 50 end, mode, tier) as rn from cur) where rn = 1",
)
def g11_primary_tier(spark, folder):
    state = latest(views.price_obs(spark, folder), KEY, ORDER)
    rows = current.primary_tier(state, ["entity_id"], standard_mode="n", standard_tiers=["f", "x"])
    return rows.select("entity_id", "mode", "tier", "snapshot_id")


@query(
    "g12_capability_conflict",
    cte("v_capability")
    + "select provider, family, stage, conflicted, case when not conflicted then context_window end as context_window,"
    " case when not conflicted then supports_vision end as supports_vision from (select provider, family, stage,"
    " count(distinct (context_window, supports_vision, supports_tool_calling, list_sort(input_modalities))) > 1 as conflicted,"
    " arg_max(context_window, (observed_at, entity_id)) as context_window,"
    " arg_max(row(supports_vision), (observed_at, entity_id))[1] as supports_vision"
    " from v_capability group by 1, 2, 3)",
)
def g12_capability_conflict(spark, folder):
    values = ["context_window", "supports_vision", "supports_tool_calling", "input_modalities"]
    rows = current.resolve_capabilities(
        views.capabilities(spark, folder), ["provider", "family", "stage"], ["observed_at", "entity_id"], values
    )
    return rows.select("provider", "family", "stage", "conflicted", "context_window", "supports_vision")


OUTCOME_SQL = (
    "case when status in ('initiated','in_progress','awaiting_approval') then 'in_progress'"
    " when status in ('candidate_validated','approved') then 'recovered'"
    " when status in ('candidate_rejected','rejected') then 'rejected'"
    " when status = 'timed_out' then 'needs_review' else 'failed' end"
)


@query(
    "g13_furthest_repair",
    cte("v_repair")
    + "select incident_id, attempt_number, attempt_id, outcome from (select *, row_number() over (partition by incident_id,"
    " attempt_number order by case outcome when 'in_progress' then 0 when 'failed' then 1 when 'needs_review' then 2"
    " when 'rejected' then 3 else 4 end desc, started_at desc, attempt_id desc) as rn"
    f" from (select *, {OUTCOME_SQL} as outcome from v_repair)) where rn = 1",
)
def g13_furthest_repair(spark, folder):
    rows = current.furthest_repair(views.repair_attempts(spark, folder))
    return rows.select("incident_id", "attempt_number", "attempt_id", "outcome")


FOLD_SQL = f"""
select entity_id, arg_max(state, (observed_at, run_id)) filter (state is not null) as lifecycle_state,
  arg_max(deprecated_on, (observed_at, run_id)) filter (deprecated_on is not null) as deprecated_on,
  arg_max(row(retirement_date), (observed_at, run_id)) filter (exact or bound) as r,
  arg_max(row(case when bound then not_before_date end), (observed_at, run_id)) filter (exact or bound or cleared) as b,
  max(observed_at) as lifecycle_observed_at
from (select *, retirement_date is not null as exact,
  retirement_date is null and not_before_observation = 'date' and not_before_date is not null as bound,
  retirement_date is null and not_before_observation = 'explicitly_unannounced' as cleared from v_lifecycle)
group by 1"""


@query(
    "g15_lifecycle_fold",
    cte("v_lifecycle", folded=FOLD_SQL)
    + f"select entity_id, lifecycle_state, {sql_day('deprecated_on')}, {sql_day('r[1]', 'retirement_date')},"
    f" {sql_day('b[1]', 'retirement_not_before_date')}, {sql_stamp('lifecycle_observed_at')},"
    " coalesce(lifecycle_state, '') <> 'retired' as is_active from folded",
)
def g15_lifecycle_fold(spark, folder):
    rows = current.fold_lifecycle(views.lifecycle_obs(spark, folder), ["entity_id"], LIFE_ORDER)
    return rows.select(
        "entity_id", "lifecycle_state", day("deprecated_on"), day("retirement_date"),
        day("retirement_not_before_date"), stamp("lifecycle_observed_at"), "is_active",
    )


# --- change detection ------------------------------------------------------------------------------------

EVENT_OUT = ["entity_id", "mode", "tier", "change_type", "field_name", "old_num", "new_num", "old_text", "new_text"]


@query("f1_diff_prices", DIFF_CTE + f"select {', '.join(EVENT_OUT)} from events where change_type <> 'metadata_changed'")
def f1_diff_prices(spark, folder):
    events = diff.diff_prices(*price_states(spark, folder))
    return events.filter("change_type <> 'metadata_changed'").select(*EVENT_OUT)


@query("f2_metadata_changes", DIFF_CTE + f"select {', '.join(EVENT_OUT)} from events where change_type = 'metadata_changed'")
def f2_metadata_changes(spark, folder):
    events = diff.diff_pairs(price_pairs(spark, folder))
    return events.filter("change_type = 'metadata_changed'").select(*EVENT_OUT)


@query(
    "f3_collapse_whole_entities",
    DIFF_CTE + "select entity_id, change_type, mode is null as whole_entity, count(*) as events from events"
    " where change_type in ('model_added','model_removed') group by 1, 2, 3",
)
def f3_collapse_whole_entities(spark, folder):
    events = diff.diff_pairs(price_pairs(spark, folder)).filter(F.col("change_type").isin("model_added", "model_removed"))
    return events.groupBy("entity_id", "change_type", F.col("mode").isNull().alias("whole_entity")).agg(
        F.count(F.lit(1)).alias("events")
    )


@query(
    "f4_whole_entity_scope",
    DIFF_CTE + "select change_type, mode is null as no_mode, tier is null as no_tier, count(*) as events from events group by 1, 2, 3",
)
def f4_whole_entity_scope(spark, folder):
    events = diff.diff_pairs(price_pairs(spark, folder))
    return events.groupBy(
        "change_type", F.col("mode").isNull().alias("no_mode"), F.col("tier").isNull().alias("no_tier")
    ).agg(F.count(F.lit(1)).alias("events"))


CAPABILITY_STATES = cte(
    "v_capability",
    prev="select * exclude (rn) from (select *, row_number() over (partition by provider, family order by entity_id) as rn from v_capability) where rn = 1",
    curr="select * exclude (rn) from (select *, row_number() over (partition by provider, family order by entity_id desc) as rn from v_capability) where rn = 1",
)


def capability_states(spark, folder):
    rows = views.capabilities(spark, folder)
    identity = ["provider", "family"]
    first = rows.groupBy(*identity).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in identity]), "entity_id").alias("r"))
    return first.select(*identity, "r.*"), latest(rows, identity, ["entity_id"])


@query(
    "f5_diff_capabilities",
    CAPABILITY_STATES
    + """select provider, family, f.field_name, f.o as old_value, f.n as new_value
from prev p join curr c using (provider, family), lateral (values
  ('contextWindow', cast(p.context_window as varchar), cast(c.context_window as varchar)),
  ('maxOutputTokens', cast(p.max_output_tokens as varchar), cast(c.max_output_tokens as varchar)),
  ('supportsVision', cast(p.supports_vision as varchar), cast(c.supports_vision as varchar)),
  ('supportsToolCalling', cast(p.supports_tool_calling as varchar), cast(c.supports_tool_calling as varchar)),
  ('inputModalities', cast(to_json(p.input_modalities) as varchar), cast(to_json(c.input_modalities) as varchar)),
  ('outputModalities', cast(to_json(p.output_modalities) as varchar), cast(to_json(c.output_modalities) as varchar)),
  ('displayName', '"' || p.display_name || '"', '"' || c.display_name || '"'),
  ('modelStage', '"' || p.stage || '"', '"' || c.stage || '"')) f(field_name, o, n)
where f.o is distinct from f.n""",
)
def f5_diff_capabilities(spark, folder):
    prev, curr = capability_states(spark, folder)
    with_family = [df.withColumn("api_family", F.col("family")) for df in (prev, curr)]
    identity = ["provider", "api_family"]
    return diff.diff_capabilities(*with_family, identity).withColumnRenamed("api_family", "family")


LIFE_STATES = cte(
    "v_lifecycle",
    prev=_latest_life_sql("observed_at < timestamp '1998-01-01'"),
    curr=_latest_life_sql("observed_at >= timestamp '1998-01-01' and observed_at < timestamp '1999-07-01'"),
)


def lifecycle_states(spark, folder):
    rows = views.lifecycle_obs(spark, folder)
    return (
        current.as_of(rows, LIFE_KEY, LIFE_ORDER, "1998-01-01"),
        current.as_of(rows, LIFE_KEY, LIFE_ORDER, "1999-07-01", "1998-01-01"),
    )


@query(
    "f6_diff_lifecycle",
    LIFE_STATES
    + """select entity_id, api_id, f.field_name, f.o as old_value, f.n as new_value
from prev p join curr c using (entity_id, api_id), lateral (values
  ('lifecycleState', '"' || p.state || '"', '"' || c.state || '"', c.state is not null),
  ('deprecatedDate', '"' || p.deprecated_on || '"', '"' || c.deprecated_on || '"', c.deprecated_on is not null),
  ('retirementDate', '"' || p.retirement_date || '"', '"' || c.retirement_date || '"', c.retirement_date is not null),
  ('retirementNotBeforeDate', '"' || p.not_before_date || '"', '"' || c.not_before_date || '"',
    c.not_before_observation in ('date', 'explicitly_unannounced')),
  ('recommendedReplacement', '"' || p.replacement || '"', '"' || c.replacement || '"', c.replacement_observed)
  ) f(field_name, o, n, asserted)
where asserted and f.o is distinct from f.n""",
)
def f6_diff_lifecycle(spark, folder):
    return diff.diff_lifecycle(*lifecycle_states(spark, folder), LIFE_KEY)


@query(
    "f7_event_order",
    DIFF_CTE + "select entity_id, mode, tier, change_type, field_name, row_number() over (order by entity_id, mode nulls first,"
    " tier nulls first, case change_type when 'model_removed' then 0 when 'model_added' then 1 when 'price_decreased' then 2"
    " when 'price_increased' then 3 else 4 end, coalesce(field_name, '')) as rank from events",
)
def f7_event_order(spark, folder):
    events = diff.diff_pairs(price_pairs(spark, folder))
    named = ["entity_id", "mode", "tier", "change_type", "field_name"]
    return global_rank(events.select(*named), diff.event_order(KEY))


@query(
    "f8_identity_violations",
    cte("v_price_obs") + "select run_id, entity_id, mode, tier, count(*) as copies from v_price_obs group by 1, 2, 3, 4 having count(*) > 1",
)
def f8_identity_violations(spark, folder):
    return diff.identity_violations(views.price_obs(spark, folder), ["run_id", *KEY])


@query(
    "f9_price_history_changes",
    cte("v_price_obs", paired="""
select *, lag(snapshot_id) over w as p_id, lag(input) over w as p_input, lag(cached) over w as p_cached,
  lag(cache_write) over w as p_write, lag(output) over w as p_output, lag(pricing_unit) over w as p_unit, lag(source_url) over w as p_url
from v_price_obs window w as (partition by entity_id, mode, tier order by observed_at, run_id, line_no, supplier_id, input)""")
    + f"""select entity_id, mode, tier, {sql_stamp('observed_at')}, p_id as prev_snapshot_id, snapshot_id as curr_snapshot_id,
  f.field_name, case when f.kind = 'text' or f.o is null or f.n is null then 'metadata_changed'
    when f.n > f.o then 'price_increased' else 'price_decreased' end as change_type, f.o as old_num, f.n as new_num
from paired, lateral (values ('inputPricePer1MTokens', 'num', p_input, input, null, null),
  ('cachedInputPricePer1MTokens', 'num', p_cached, cached, null, null), ('cacheWritePricePer1MTokens', 'num', p_write, cache_write, null, null),
  ('outputPricePer1MTokens', 'num', p_output, output, null, null), ('pricingUnit', 'text', null, null, p_unit, pricing_unit),
  ('sourceUrl', 'text', null, null, p_url, source_url)) f(field_name, kind, o, n, ot, nt)
where p_id is not null and (f.o is distinct from f.n or f.ot is distinct from f.nt)""",
)
def f9_price_history_changes(spark, folder):
    lines = views.price_lines(spark, folder)
    rows = diff.price_history_changes(views.known_prices(spark, folder, lines), KEY, ORDER, derived=views.price_texts, sampled=lines)
    return rows.select(
        *KEY, stamp("observed_at"), "prev_snapshot_id", "curr_snapshot_id", "field_name", "change_type", "old_num", "new_num"
    )


# --- joins -----------------------------------------------------------------------------------------------


@query(
    "e1_snapshot_dimensions",
    cte("v_price_obs", "v_run_header", "v_source", "v_provider")
    + "select snapshot_id, entity_name, provider_slug, kind, status from v_price_obs o join v_run_header r using (run_id)"
    " join v_source s using (source_id) join v_provider p on s.provider_id = p.provider_id",
)
def e1_snapshot_dimensions(spark, folder):
    # No broadcast hints: the size of each dimension decides at run time.
    obs = views.price_obs(spark, folder).select("snapshot_id", "entity_name", "run_id")
    runs = views.run_headers(spark, folder).select("run_id", "source_id", "status")
    sources = views.sources(spark, folder).select("source_id", "provider_id", "kind")
    providers = views.providers(spark, folder).select("provider_id", "provider_slug")
    joined = obs.join(runs.join(sources.join(providers, "provider_id"), "source_id"), "run_id")
    return joined.select("snapshot_id", "entity_name", "provider_slug", "kind", "status")


@query(
    "e2_pair_price_states",
    cte("v_price_obs", prev=PREV_SQL, curr=CURR_SQL)
    + "select coalesce(p.entity_id, c.entity_id) as entity_id, coalesce(p.mode, c.mode) as mode, coalesce(p.tier, c.tier) as tier,"
    " p.snapshot_id as prev_snapshot_id, c.snapshot_id as curr_snapshot_id from prev p full outer join curr c"
    " on p.entity_id = c.entity_id and p.mode = c.mode and p.tier = c.tier",
)
def e2_pair_price_states(spark, folder):
    pairs = diff.pair_states(*price_states(spark, folder), KEY)
    return pairs.select(*KEY, F.col("p.snapshot_id").alias("prev_snapshot_id"), F.col("c.snapshot_id").alias("curr_snapshot_id"))


@query(
    "e3_pair_lifecycle_states",
    LIFE_STATES + "select entity_id, api_id, p.snapshot_id as prev_snapshot_id, c.snapshot_id as curr_snapshot_id"
    " from prev p join curr c using (entity_id, api_id)",
)
def e3_pair_lifecycle_states(spark, folder):
    pairs = diff.pair_states(*lifecycle_states(spark, folder), LIFE_KEY, "inner")
    return pairs.select(*LIFE_KEY, F.col("p.snapshot_id").alias("prev_snapshot_id"), F.col("c.snapshot_id").alias("curr_snapshot_id"))


@query(
    "e10_event_snapshot_ids",
    DIFF_CTE + "select entity_id, mode, tier, change_type, field_name, prev_snapshot_id, curr_snapshot_id from events",
)
def e10_event_snapshot_ids(spark, folder):
    events = diff.diff_prices(*price_states(spark, folder))
    return events.select(
        "entity_id", "mode", "tier", "change_type", "field_name", "prev_snapshot_id", "curr_snapshot_id"
    )


@query(
    "e11_run_external_id",
    cte("v_price_obs", "v_run_header")
    + "select snapshot_id, r.external_run_id from v_price_obs o left join v_run_header r using (run_id)",
)
def e11_run_external_id(spark, folder):
    obs = views.price_obs(spark, folder).select("snapshot_id", "run_id")
    runs = views.run_headers(spark, folder).select("run_id", "external_run_id")
    return obs.join(runs, "run_id", "left").select("snapshot_id", "external_run_id")
