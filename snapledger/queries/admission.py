"""Record checks, batch admission and idempotent writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.operators import contracts, gate
from snapledger.queries.history import KEY, sql_stamp, stamp
from snapledger.queries.registry import query
from snapledger.queries.scalars import sql_fixed
from snapledger.queries.sqlviews import cte
from snapledger.session import ensure_checkpoint_dir
from snapledger.sources import sinks, tables, views

# Each price check in SQL: (message, code, condition).
_URL = "(source_url is not null and not regexp_matches(source_url, '(?i)^https?://[^/?#\\s]+'))"
PRICE_CHECKS = [
    ("missing", "SCHEMA_VALIDATION_FAILURE",
     "provider is null or model_name is null or pricing_mode is null or context_tier is null or pricing_unit is null or source_url is null"),
    ("provider", "SCHEMA_VALIDATION_FAILURE",
     "not regexp_matches(provider, '^[\\p{L}\\p{N}][\\p{L}\\p{N} .&''()+_-]*$') or length(provider) not between 1 and 100"),
    ("model_name", "SCHEMA_VALIDATION_FAILURE",
     "not regexp_matches(model_name, '^[\\p{L}\\p{N}][\\p{L}\\p{N} ._:/+-]*$') or length(model_name) not between 1 and 200"),
    ("pricing_mode", "ILLEGAL_ENUM_VALUE", "not regexp_matches(pricing_mode, '^[a-z0-9][a-z0-9_-]*$')"),
    ("context_tier", "ILLEGAL_ENUM_VALUE", "not regexp_matches(context_tier, '^[a-z0-9][a-z0-9_-]*$')"),
    ("url", "SCHEMA_VALIDATION_FAILURE", _URL),
    ("price", "SCHEMA_VALIDATION_FAILURE", "least(coalesce(input_price,0), coalesce(cached_input_price,0), coalesce(cache_write_price,0), coalesce(output_price,0)) < 0"),
    ("no price", "SCHEMA_VALIDATION_FAILURE", "coalesce(input_price, cached_input_price, cache_write_price, output_price) is null"),
]
_BAD = " or ".join(f"coalesce({c}, false)" for _, _, c in PRICE_CHECKS)
_BAD_ENUM = " or ".join(f"coalesce({c}, false)" for _, k, c in PRICE_CHECKS if k == "ILLEGAL_ENUM_VALUE")
VALIDATED_SQL = f"select *, not ({_BAD}) as schema_ok, ({_BAD_ENUM}) as bad_enum from v_raw_price"
MARKED_SQL = """select *, schema_ok and rn > 1 as duplicate from (select *, case when schema_ok then row_number() over (partition by
  batch_id, schema_ok, provider, model_name, pricing_mode, context_tier order by position) end as rn from validated)"""


def validated_prices(spark, folder):
    return contracts.validate(views.raw_prices(spark, folder), contracts.price_contract())


def _checked(name: str, condition: str, check) -> None:
    @query(name, cte("v_raw_price") + f"select batch_id, position, coalesce({condition}, false) as broken from v_raw_price")
    def build(spark, folder):
        return views.raw_prices(spark, folder).select("batch_id", "position", check().broken.alias("broken"))


_checked("b1_identifier_shape", f"({PRICE_CHECKS[1][2]})",
         lambda: contracts.bad_shape("provider", contracts.PROVIDER_SHAPE, 100))
_checked("b1_slug_shape", f"({PRICE_CHECKS[3][2]})",
         lambda: contracts.bad_shape("pricing_mode", contracts.SLUG_SHAPE, 50, contracts.ENUM))
_checked("b2_http_url", _URL, lambda: contracts.bad_url("source_url"))
_checked("b3_price_range", "input_price < 0", lambda: contracts.bad_price("input_price"))
_checked("b4_any_price", "coalesce(input_price, output_price) is null", lambda: contracts.no_price(("input_price", "output_price")))
_checked("b5_required_fields", PRICE_CHECKS[0][2], lambda: contracts.missing(
    "provider", "model_name", "pricing_mode", "context_tier", "pricing_unit", "source_url"))
_checked("b6_enum_membership", "pricing_mode not in ('a', 'n')", lambda: contracts.not_in("pricing_mode", ("a", "n")))
_checked("b12_expected_provider", "provider is distinct from 'Brand-1'", lambda: contracts.differs("provider", "Brand-1"))


@query(
    "b7_unknown_keys",
    "select event_id, event_type in ('click', 'error') as broken from events",
)
def b7_unknown_keys(spark, folder):
    kind = F.col("event_type")
    raw = F.when(kind.isin("click", "error"), F.to_json(F.struct(F.col("value"), kind.alias("extra")))).otherwise(
        F.to_json(F.struct("value", "event_id")))
    events = tables.load(spark, folder, "events").withColumn("raw", raw)
    return events.select("event_id", contracts.unknown_keys("raw", ("value", "event_id")).broken.alias("broken"))


@query(
    "b8_english_date",
    "select o_orderkey, substr(o_orderpriority, 1, 1) in ('3', '4') as broken from orders",
)
def b8_english_date(spark, folder):
    pr = F.substring("o_orderpriority", 1, 1)
    shown = F.when(pr == "3", F.date_format("o_orderdate", "MMMM yyyy")).when(
        pr == "4", F.concat(F.lit("February 30, "), F.date_format("o_orderdate", "yyyy"))
    ).when(pr != "5", F.date_format("o_orderdate", "MMMM d, yyyy"))
    rows = tables.load(spark, folder, "orders").withColumn("t", shown)
    return rows.select("o_orderkey", contracts.bad_english_date("t").broken.alias("broken"))


@query(
    "b9_lifecycle_contradictions",
    cte("v_lifecycle") + """select snapshot_id, retirement_date is not null and nb is not null as both_dates,
  not_before_observation = 'date' and nb is null as undated, not replacement_observed and rp is not null as unseen
from (select *, case when replacement_observed then coalesce(not_before_date, deprecated_on) end as nb,
  coalesce(replacement, 'r') as rp from v_lifecycle)""",
)
def b9_lifecycle_contradictions(spark, folder):
    rows = views.lifecycle_obs(spark, folder).withColumns({
        "not_before_date": F.when(F.col("replacement_observed"), F.coalesce("not_before_date", "deprecated_on")),
        "replacement": F.coalesce("replacement", F.lit("r")),
    })
    both, undated, unseen = (c.broken for c in contracts.lifecycle_contradictions())
    return rows.select("snapshot_id", both.alias("both_dates"), undated.alias("undated"), unseen.alias("unseen"))


@query("b10_localized_page", "select page_id, regexp_matches(url, '[?&]ref=') as broken from pages")
def b10_localized_page(spark, folder):
    pages = tables.load(spark, folder, "pages")
    return pages.select("page_id", contracts.localized_page("url", "ref").broken.alias("broken"))


@query(
    "b11_duplicate_identity",
    cte("v_raw_price", validated=VALIDATED_SQL, marked=MARKED_SQL) + "select batch_id, position, schema_ok, duplicate from marked",
)
def b11_duplicate_identity(spark, folder):
    marked = contracts.mark_duplicates(validated_prices(spark, folder), contracts.price_contract())
    return marked.select("batch_id", "position", "schema_ok", "duplicate")


@query(
    "b13_text_quality",
    "select doc_id as id, length(t) not between 12 and 1000 or regexp_matches(text, '(?i)</?[a-z][\\s\\S]*>') as broken"
    " from (select doc_id, text, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as t from documents)"
    " union all select page_id, length(html) not between 12 and 1000 or regexp_matches(html, '(?i)</?[a-z][\\s\\S]*>') from pages",
)
def b13_text_quality(spark, folder):
    documents = tables.load(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    pages = tables.load(spark, folder, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("t"))
    return documents.unionByName(pages).select("id", contracts.bad_text("t", 12, 1000).broken.alias("broken"))


@query(
    "b14_issue_codes",
    cte("v_raw_price")
    + " union all ".join(
        f"select batch_id, position, '{code}' as code, '{message}' as fault from v_raw_price where coalesce({condition}, false)"
        for message, code, condition in PRICE_CHECKS),
)
def b14_issue_codes(spark, folder):
    # All faults of a record come from one pass over it.
    rows = contracts.issue_rows(views.raw_prices(spark, folder), contracts.price_contract(), ["batch_id", "position"])
    message = F.col("message")
    fault = (
        F.when(message.startswith("missing"), "missing").when(message.contains("http"), "url")
        .when(message == "no price", "no price").when(message.endswith("_price"), "price")
        .otherwise(F.regexp_replace(message, "^invalid ", ""))
    )
    return rows.select("batch_id", "position", "code", fault.alias("fault"))


@query(
    "b15_positive_values",
    cte("v_capability") + "select entity_id, coalesce(max_output_tokens <= 0, false) or coalesce(context_window - 1000 <= 0, false) as broken from v_capability",
)
def b15_positive_values(spark, folder):
    rows = views.capabilities(spark, folder).withColumn("context_window", F.col("context_window") - 1000)
    broken = contracts.not_positive("max_output_tokens").broken | contracts.not_positive("context_window").broken
    return rows.select("entity_id", broken.alias("broken"))


# --- batch admission -------------------------------------------------------------------------------------

# Limits of the price contract.
LIMITS = {"min_viable": 1, "min_expected": 2, "max_drop": 0.4, "max_spike": 3.0, "quarantine_ratio": 0.15}


def manifest(spark, folder):
    """Every run is announced, also one without records; failed runs carry the collector's error."""
    runs = gate.baselines(views.runs(spark, folder), F.to_date("started_at"))
    limits = {name: F.lit(value) for name, value in LIMITS.items()}
    return runs.select(
        F.col("run_id").alias("batch_id"), "source_id", "started_at",
        F.col("error_message").alias("collector_error"), F.col("lkg.count").alias("baseline_count"),
        F.col("lkg.run_id").alias("baseline_run"),
    ).withColumns(limits)


def decisions(spark, folder):
    evidence = gate.batch_evidence(validated_prices(spark, folder), contracts.price_contract())
    return gate.decide(manifest(spark, folder), evidence)


EVIDENCE_SQL = """select batch_id, count(*) as seen, count(*) filter (schema_ok and not duplicate) as valid,
  count(*) filter (duplicate) as dups, bool_or(bad_enum) as any_enum,
  bool_and(coalesce(input_price, cached_input_price, cache_write_price, output_price) is null) filter (schema_ok and not duplicate) as all_null,
  bool_or(least(coalesce(input_price,0), coalesce(cached_input_price,0), coalesce(cache_write_price,0), coalesce(output_price,0)) < 0) filter (schema_ok and not duplicate) as any_neg
  from marked group by 1"""
MANIFEST_SQL = """select run_id as batch_id, source_id, started_at, error_message,
  last_value(case when status = 'succeeded' then records_accepted end ignore nulls) over w as base_count,
  last_value(case when status = 'succeeded' then run_id end ignore nulls) over w as base_run
  from v_run window w as (partition by source_id order by started_at, run_id rows between unbounded preceding and 1 preceding)"""
DECISION_SQL = """select *, case when refused then 'quarantined' when invalid > 0 then 'degraded' else 'healthy' end as status,
  case when collapsed then 'collapse' when spiked then 'spike' when compared then 'within_tolerance' end as drift_type,
  list_sort(list_distinct(list_filter([case when crashed then 'COLLECTOR_EXECUTION_FAILURE' end, case when empty then 'ZERO_RECORDS' end,
    case when below or collapsed then 'RECORD_COUNT_COLLAPSE' end, case when spiked then 'RECORD_COUNT_SPIKE' end,
    case when f and invalid - dups > 0 then 'SCHEMA_VALIDATION_FAILURE' end, case when f and any_enum then 'ILLEGAL_ENUM_VALUE' end,
    case when f and dups > 0 then 'DUPLICATE_IDENTIFIERS' end, case when f and valid > 0 and all_null then 'ALL_PRICES_NULL' end,
    case when f and valid > 0 and any_neg then 'SEMANTIC_INVARIANT_VIOLATION' end], lambda x: x is not null))) as codes
from (select *, crashed or empty or budget or below or collapsed or spiked or (f and valid > 0 and (all_null or any_neg)) as refused from (
  select *, compared and not collapsed and valid > 10 and valid / base_count >= 3.0 as spiked from (
  select *, f and invalid > 0 and invalid / seen >= 0.15 as budget, f and valid < 1 as below,
    compared and base_count >= 2 and (base_count - valid) / base_count >= 0.4 as collapsed from (
  select *, not crashed and seen = 0 as empty, not crashed and seen > 0 as f, not crashed and seen > 0 and coalesce(base_count > 0, false) as compared from (
  select m.batch_id, m.source_id, m.started_at, m.error_message, m.base_count, m.base_run, m.error_message is not null as crashed,
    case when m.error_message is null then coalesce(seen, 0) else 0 end as seen,
    case when m.error_message is null then coalesce(valid, 0) else 0 end as valid,
    case when m.error_message is null then coalesce(seen - valid, 0) else 0 end as invalid,
    case when m.error_message is null then coalesce(dups, 0) else 0 end as dups,
    coalesce(any_enum, false) as any_enum, coalesce(all_null, false) as all_null, coalesce(any_neg, false) as any_neg
  from manifest m left join evidence e using (batch_id))))))"""
GATE = cte("v_raw_price", "v_run", validated=VALIDATED_SQL, marked=MARKED_SQL, evidence=EVIDENCE_SQL,
           manifest=MANIFEST_SQL, decision=DECISION_SQL)


@query("d1_batch_counts", GATE + "select batch_id, seen as records_seen, valid as records_valid, seen - valid as records_invalid,"
       " dups as duplicates from evidence")
def d1_batch_counts(spark, folder):
    rows = gate.batch_evidence(validated_prices(spark, folder), contracts.price_contract())
    return rows.select("batch_id", "records_seen", "records_valid", "records_invalid", "duplicates")


def _gate_query(name: str, spark_columns: list[str], sql_columns: str) -> None:
    @query(name, GATE + f"select batch_id, {sql_columns} from decision")
    def build(spark, folder):
        return decisions(spark, folder).select("batch_id", *spark_columns)


_gate_query("d2_failure_budget", ["invalid_ratio", "over_budget"],
            "case when seen > 0 then invalid / seen else 0.0::double end as invalid_ratio, budget as over_budget")
_gate_query("d3_empty_batches", ["records_seen", "refused"], "seen as records_seen, refused")
_gate_query("d4_minimum_records", ["records_valid", "below_minimum"], "valid as records_valid, below as below_minimum")
_gate_query("d5_count_collapse", ["baseline_count", "collapsed"], "base_count as baseline_count, collapsed")
_gate_query("d6_count_spike", ["records_valid", "spiked"], "valid as records_valid, spiked")


@query("d7_drift", GATE + "select batch_id, drift_type, round(case when compared then (valid - base_count) / base_count * 100 end, 6) as drift_percent from decision")
def d7_drift(spark, folder):
    return decisions(spark, folder).select("batch_id", "drift_type", F.round("drift_percent", 6).alias("drift_percent"))


# The price contract rejects such records one by one, so a batch of its valid ones cannot break these invariants. A contract
# without the record checks lets them through, as a user's own contract may.
FIRSTS = cte("v_raw_price", firsts="select * from v_raw_price qualify row_number() over"
             " (partition by batch_id, provider, model_name, pricing_mode, context_tier order by position) = 1")


def _invariant_broken(raw: DataFrame, code: str) -> DataFrame:
    price = contracts.price_contract()
    loose = contracts.Contract("loose", price.key, (), price.invariants, price.limits)
    rows = gate.batch_evidence(contracts.validate(raw, loose), loose)
    return rows.select("batch_id", F.array_contains("record_codes", code).alias("broken"))


@query("d8_all_prices_null", FIRSTS + "select batch_id, bool_and(context_tier = 'o') as broken from firsts group by 1")
def d8_all_prices_null(spark, folder):
    unpriced = F.col("context_tier") == "o"
    prices = {c: F.when(~unpriced, F.coalesce(c, F.lit(1.0))) for c in contracts.PRICES}
    return _invariant_broken(views.raw_prices(spark, folder).withColumns(prices), contracts.NULL_PRICES)


@query("d9_negative_price", FIRSTS + "select batch_id, coalesce(bool_or(input_price < 0), false) as broken from firsts group by 1")
def d9_negative_price(spark, folder):
    return _invariant_broken(views.raw_prices(spark, folder), contracts.SEMANTIC)


def _deprecations(spark, folder):
    """Deprecation tables: one batch per customer, one record per order."""
    orders = tables.load(spark, folder, "orders")
    status = F.col("o_orderstatus")
    state = F.when(status == "F", "Active").when(status == "P", "Deprecated").otherwise("Retired")
    pr = F.substring("o_orderpriority", 1, 1)
    return orders.select(
        F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("position"),
        F.concat(F.lit("claude-"), F.col("o_orderkey")).alias("api_model_name"),
        F.when(F.col("o_totalprice") > 490000, "Unknown").otherwise(state).alias("current_state"),
        F.when(pr == "1", F.date_format("o_orderdate", "MMMM d, yyyy")).alias("deprecated_date"),
        F.when(pr == "2", F.concat(F.lit("Not sooner than "), F.date_format("o_orderdate", "MMMM d, yyyy")))
        .alias("tentative_retirement_date"),
        F.lit("https://docs.example.com/p").alias("product_page_url"),
    )


@query(
    "d10_no_active_record",
    """select o_custkey as batch_id, count(*) as records_seen, count(*) filter (ok) as records_valid,
  count(*) filter (ok) > 0 and not coalesce(bool_or(o_orderstatus = 'F') filter (ok), false) as broken
from (select *, o_totalprice <= 490000 as ok from orders) group by 1""",
)
def d10_no_active_record(spark, folder):
    contract = contracts.deprecation_contract()
    rows = gate.batch_evidence(contracts.validate(_deprecations(spark, folder), contract), contract)
    return rows.select("batch_id", "records_seen", "records_valid", F.col("invariant_broken").alias("broken"))


@query(
    "d11_vanished_fields",
    """select source || lang as batch_id, count(*) as records_seen,
  bool_and(n_chars <= 3000) as no_limits, bool_and(lang = 'es') as no_modalities from documents group by 1""",
)
def d11_vanished_fields(spark, folder):
    documents = tables.load(spark, folder, "documents")
    raw = documents.select(
        F.concat("source", "lang").alias("batch_id"), F.col("doc_id").alias("position"),
        F.concat(F.lit("m-"), F.col("doc_id")).alias("model_id"),
        F.lit("https://docs.example.com/m").alias("source_url"),
        F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("string").alias("capability_statement"),
        F.when(F.col("n_chars") > 3000, F.concat("n_chars", F.lit(" tokens"))).otherwise("varies").alias("context_window_raw"),
        F.when(F.col("lang") != "es", F.array(F.lit("Text"))).alias("input_modalities"),
    )
    contract = contracts.catalog_contract(needs_modalities=True)
    rows = gate.batch_evidence(contracts.validate(raw, contract), contract)
    has = lambda code: F.array_contains("record_codes", code)
    return rows.select(
        "batch_id", "records_seen", has(contracts.TOKEN_LIMITS).alias("no_limits"), has(contracts.SEMANTIC).alias("no_modalities")
    )


_gate_query("d12_collector_error", ["records_seen", "severity", "summary"], """seen as records_seen,
  case when len(list_intersect(codes, ['COLLECTOR_EXECUTION_FAILURE','ZERO_RECORDS','RECORD_COUNT_COLLAPSE'])) > 0 then 'critical'
    when len(list_intersect(codes, ['SCHEMA_VALIDATION_FAILURE','ILLEGAL_ENUM_VALUE','ALL_PRICES_NULL','SEMANTIC_INVARIANT_VIOLATION','DUPLICATE_IDENTIFIERS'])) > 0 then 'warning' else 'info' end as severity,
  case when crashed then 'Collector execution failed: ' || error_message when seen = 0 then 'Collector output contains zero records'
    when status = 'healthy' then 'Evaluated ' || seen || ' records: 100% valid. Source healthy.'
    when status = 'degraded' then 'Evaluated ' || seen || ' records: ' || valid || ' valid, ' || invalid || ' rejected (' || printf('%.1f', """ + sql_fixed("(invalid / seen * 100)", 1) + """) || '% error rate). Source degraded within tolerance.'
    else 'Quarantined: ' || invalid || '/' || seen || ' invalid records. Anomaly triggers: [' || coalesce(nullif(array_to_string(codes, ', '), ''), 'VALIDATION_FAILURE') || '].' end as summary""")


@query("d13_last_known_good", GATE + "select batch_id, base_run as baseline_run, base_count as baseline_count from manifest")
def d13_last_known_good(spark, folder):
    return manifest(spark, folder).select("batch_id", "baseline_run", "baseline_count")


_gate_query("d14_status", ["status"], "status")


@query("d15_reason_codes", GATE + "select batch_id, array_to_string(codes, ',') as reason_codes from decision")
def d15_reason_codes(spark, folder):
    return decisions(spark, folder).select("batch_id", F.array_join("reason_codes", ",").alias("reason_codes"))


@query(
    "d16_severity",
    GATE + """select severity, count(*) as batches from (select case
  when len(list_intersect(codes, ['COLLECTOR_EXECUTION_FAILURE','ZERO_RECORDS','RECORD_COUNT_COLLAPSE'])) > 0 then 'critical'
  when len(list_intersect(codes, ['SCHEMA_VALIDATION_FAILURE','ILLEGAL_ENUM_VALUE','ALL_PRICES_NULL','SEMANTIC_INVARIANT_VIOLATION','DUPLICATE_IDENTIFIERS'])) > 0
  then 'warning' else 'info' end as severity from decision) group by 1""",
)
def d16_severity(spark, folder):
    return decisions(spark, folder).groupBy("severity").agg(F.count(F.lit(1)).alias("batches"))


@query(
    "d17_admit_split",
    GATE + "select batch_id, position, 'admitted' as outcome from marked where schema_ok and not duplicate and batch_id in (select batch_id from decision where not refused)"
    " union all select batch_id, position, 'quarantined' from marked where batch_id in (select batch_id from decision where refused)",
)
def d17_admit_split(spark, folder):
    ensure_checkpoint_dir(spark)
    contract = contracts.price_contract()
    # Checked once; what decisions and duplicates need is kept, so the records are read and matched a single time.
    slim = ["batch_id", "position", *contract.key, *contracts.PRICES, "schema_ok", "enum_fault"]
    validated = validated_prices(spark, folder).select(*slim).checkpoint()
    decided = gate.decide(manifest(spark, folder), gate.batch_evidence(validated, contract)).select("batch_id", "refused")
    judged = contracts.mark_duplicates(validated, contract).join(decided, "batch_id")
    outcome = F.when(F.col("refused"), "quarantined").when(F.col("accepted"), "admitted")
    return judged.select("batch_id", "position", outcome.alias("outcome")).filter(F.col("outcome").isNotNull())


@query(
    "d18_incident_resolution",
    cte("v_incident", "v_run_header", newest="""select source_id, arg_max(incident_id, (created_at, run_id)) as incident_id, max(created_at) as created_at
  from v_incident where status in ('open','healing','needs_review') group by 1""")
    + f"""select n.source_id, incident_id, arg_min(r.run_id, (r.started_at, r.run_id)) as resolved_by, {sql_stamp('min(r.started_at)', 'resolved_at')}
from newest n join v_run_header r on r.source_id = n.source_id and r.started_at >= n.created_at and r.status in ('succeeded','partial') group by 1, 2""",
)
def d18_incident_resolution(spark, folder):
    admitted = views.run_headers(spark, folder).filter(F.col("status").isin("succeeded", "partial"))
    rows = gate.resolve_incidents(views.incidents(spark, folder), admitted)
    return rows.select("source_id", "incident_id", "resolved_by", stamp("resolved_at"))


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, nexts in gate.TRANSITIONS.items() for b in {*nexts, a})


@query(
    "d19_illegal_transitions",
    cte("v_run_header", h="""select *, lag(state) over (partition by source_id order by started_at, run_id) as before from (
  select run_id, source_id, started_at, case status when 'succeeded' then 'healthy' when 'partial' then 'degraded' when 'failed' then 'quarantined' else 'healing' end as state from v_run_header)""")
    + f"select run_id, source_id, before, state from h where before is not null and (before, state) not in (values {_ALLOWED})",
)
def d19_illegal_transitions(spark, folder):
    status = F.col("status")
    state = F.when(status == "succeeded", "healthy").when(status == "partial", "degraded").when(status == "failed", "quarantined").otherwise("healing")
    history = views.run_headers(spark, folder).select("run_id", "source_id", F.col("started_at").alias("at"), state.alias("state"))
    rows = gate.illegal_transitions(history, F.to_date("at"))
    return rows.select("run_id", "source_id", "before", "state")


@query(
    "e12_source_contract",
    cte("v_source")
    + """select source_id, category, coalesce(c.domain, 'none') as authority_domain, c.ratio as quarantine_ratio from (
  select source_id, p as provider, case kind when 'pricing' then 'pricing' when 'models' then case when is_active then 'models'
    when p in ('anthropic','gemini') then 'lifecycle' else 'models' end else 'other' end as category, is_active
  from (select *, (['openai','anthropic','gemini','xai'])[provider_id % 4 + 1] as p from v_source)) s
left join (values ('pricing', 'pricing', 0.15::double), ('lifecycle', 'lifecycle', 0.0::double), ('models', 'catalog', 0.15::double)) c(cat, domain, ratio)
  on c.cat = s.category and (s.category in ('pricing', 'lifecycle') or s.is_active)""",
)
def e12_source_contract(spark, folder):
    names = F.array(*[F.lit(p) for p in ("openai", "anthropic", "gemini", "xai")])
    sources = views.sources(spark, folder)
    named = sources.select(
        "source_id", "kind", F.element_at(names, F.pmod("provider_id", F.lit(4)) + 1).alias("provider"), F.col("is_active").alias("is_catalog")
    )
    categorized = named.withColumn("category", contracts.source_category(F.col("kind"), F.col("provider"), F.col("is_catalog")))
    rows = contracts.attach_contract(categorized)
    return rows.select(
        "source_id", "category", F.coalesce("authority_domain", F.lit("none")).alias("authority_domain"), "quarantine_ratio"
    )


@query(
    "e14_recovery_run",
    cte("v_incident", "v_run", newest="""select source_id, arg_max(incident_id, (resolved_at, run_id)) as incident_id, arg_max(run_id, (resolved_at, run_id)) as bad_run,
  max(resolved_at) as resolved_at from v_incident where status = 'resolved' and resolved_at is not null group by 1""")
    + f"""select n.source_id, n.incident_id, {sql_stamp('n.resolved_at', 'resolved_at')}, arg_min(r.run_id, (r.started_at, r.run_id)) as recovery_run,
  {sql_stamp('min(r.started_at)', 'recovered_at')} from newest n left join v_run r on r.source_id = n.source_id and r.started_at >= n.resolved_at
  and r.run_id <> n.bad_run and r.status in ('succeeded','partial') and r.records_accepted > 0 group by n.source_id, n.incident_id, n.resolved_at""",
)
def e14_recovery_run(spark, folder):
    rows = gate.recovery_runs(views.incidents(spark, folder), views.runs(spark, folder))
    return rows.select("source_id", "incident_id", stamp("resolved_at"), "recovery_run", stamp("recovered_at"))


# --- writes ----------------------------------------------------------------------------------------------


@query(
    "a5_new_snapshots",
    cte("v_price_obs")
    + """select run_id, entity_id, mode, tier, min(snapshot_id) as snapshot_id from v_price_obs n
where not exists (select 1 from v_price_obs e where e.observed_at < timestamp '1998-01-01' and e.run_id = n.run_id
  and e.entity_id = n.entity_id and e.mode = n.mode and e.tier = n.tier) group by 1, 2, 3, 4""",
)
def a5_new_snapshots(spark, folder):
    obs = views.price_obs(spark, folder).select("run_id", *KEY, "snapshot_id", "observed_at")
    stored = obs.filter(F.col("observed_at") < F.lit("1998-01-01").cast("timestamp"))
    rows = sinks.new_snapshots(obs, stored, ["run_id", *KEY], ["snapshot_id"])
    return rows.select("run_id", *KEY, "snapshot_id")


@query(
    "a6_collapse_changes",
    cte("v_change") + "select distinct event_id, change_type, field_name, entity_id, new_text from v_change",
)
def a6_collapse_changes(spark, folder):
    # The stored events arrive twice, as from a replayed run; identical repeats must collapse.
    events = views.changes(spark, folder).select("event_id", "change_type", "field_name", "entity_id", "new_text")
    return sinks.collapse_changes(events.unionByName(events), ["event_id", "change_type", "field_name"])


@query(
    "a7_upsert_dimensions",
    cte("v_price_obs")
    + f"select entity_id, {sql_stamp('min(observed_at)', 'first_seen_at')}, {sql_stamp('max(observed_at)', 'last_seen_at')},"
    " arg_max(source_url, (observed_at, source_url)) as source_url from v_price_obs group by 1",
)
def a7_upsert_dimensions(spark, folder):
    obs = views.price_obs(spark, folder)
    cut = F.lit("1998-01-01").cast("timestamp")

    def sighted(rows):
        return rows.groupBy("entity_id").agg(
            F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"),
            F.max_by("source_url", F.struct("observed_at", "source_url")).alias("source_url"),
        )

    stored, incoming = sighted(obs.filter(F.col("observed_at") < cut)), sighted(obs.filter(F.col("observed_at") >= cut))
    rows = sinks.merge_dimension(stored, incoming, ["entity_id"], ["source_url"])
    return rows.select("entity_id", stamp("first_seen_at"), stamp("last_seen_at"), "source_url")


def delivered(spark, rows, path):
    """Rows as a delivery brings them: files, which an append reads twice without making them anew."""
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def sighted_keys(obs):
    """What two deliveries bring of every key, from one pass: the first has the rows before 1998, the second all rows."""
    early = F.col("observed_at") < F.lit("1998-01-01").cast("timestamp")
    seen = obs.groupBy("run_id", *KEY).agg(
        F.min("snapshot_id").alias("snapshot_id"), F.min(F.when(early, F.col("snapshot_id"))).alias("first"), F.min("observed_at").alias("observed_at"))
    # The text of the first delivery is stored where it is another one.
    return seen.select("run_id", *KEY, "snapshot_id", F.col("first").isNotNull().alias("early"),
                       F.nullif("first", F.col("snapshot_id")).alias("first"), "observed_at")


def two_deliveries(seen):
    """A run's rows lie in several months here, so the second delivery names the month its run was first stored in."""
    stored_in = F.lit("1997-12-01").cast("timestamp")
    first = seen.filter("early").select("run_id", *KEY, F.coalesce("first", "snapshot_id").alias("snapshot_id"), stored_in.alias("observed_at"))
    # A key with a missing part is never found again.
    found = F.col("early") & F.col("run_id").isNotNull()
    for name in KEY:
        found = found & F.col(name).isNotNull()
    return first, seen.select("run_id", *KEY, "snapshot_id", F.when(found, stored_in).otherwise(F.col("observed_at")).alias("observed_at"))


@query(
    "a5_append_ledger",
    cte("v_price_obs")
    + """select cast(run_id as varchar) as run_id, cast(entity_id as varchar) as entity_id, mode, tier,
  coalesce(min(snapshot_id) filter (observed_at < timestamp '1998-01-01'), min(snapshot_id)) as snapshot_id from v_price_obs group by 1, 2, 3, 4""",
)
def a5_append_ledger(spark, folder):
    """Two deliveries into a written ledger, the second with all of the first once more, and its repetition."""
    root = f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    obs = views.price_obs(spark, folder).drop("input", "cached", "cache_write", "output")
    first, later = two_deliveries(delivered(spark, sighted_keys(obs), f"{root}/delivery"))
    for rows in (first, later, later):
        sinks.append_snapshots(rows, root, "fact_price", ["snapshot_id"])
    return sinks.read_ledger(spark, root, "fact_price").select("run_id", *KEY, "snapshot_id")


@query(
    "a7_register_sources",
    """select cast(c_custkey as varchar) as source_id, cast(c_nationkey as varchar) as provider_id, lower(c_mktsegment) as kind, c_name as label,
  case when c_custkey % 3 = 0 then c_custkey % 2 = 0 else true end as is_active, n_name as provider_name
from customer join nation on c_nationkey = n_nationkey""",
)
def a7_register_sources(spark, folder):
    """Providers and sources announced twice: what the second announcement leaves out stays, what it says replaces."""
    root = f"{ensure_checkpoint_dir(spark)}/sources-{uuid.uuid4().hex}"
    customers, nations = tables.load(spark, folder, "customer"), tables.load(spark, folder, "nation")
    named = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    key = [F.col("c_custkey").cast("string").alias("source_id"), F.col("c_nationkey").cast("string").alias("provider_id")]
    sinks.register_sources(named.select(*key, F.lower("c_mktsegment").alias("kind"), F.lit("old").alias("label"), F.col("n_name").alias("name")), root)
    stated = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 2 == 0)
    sinks.register_sources(named.select(*key, F.col("c_name").alias("label"), stated.alias("is_active")), root)
    providers = sinks.read_dimension(spark, root, "dim_provider").select("provider_id", F.col("name").alias("provider_name"))
    return sinks.read_dimension(spark, root, "dim_source").join(providers, "provider_id").select(
        "source_id", "provider_id", "kind", "label", "is_active", "provider_name")


@query(
    "a8_quarantine_rows",
    GATE + "select 'incident-' || batch_id as incident_id, batch_id, position, not schema_ok as has_issue from validated"
    " where batch_id in (select batch_id from decision where refused)",
)
def a8_quarantine_rows(spark, folder):
    rows = gate.quarantined(validated_prices(spark, folder), decisions(spark, folder))
    return rows.select(
        F.concat(F.lit("incident-"), F.col("batch_id").cast("string")).alias("incident_id"), "batch_id", "position",
        (F.size("issues") > 0).alias("has_issue"),
    )


@query(
    "a9_run_log",
    cte("v_raw_price", validated=VALIDATED_SQL, marked=MARKED_SQL)
    + "select *, case when records_rejected > 0 then 'partial' else 'succeeded' end as status from (select batch_id, count(*) as records_seen,"
    " count(*) filter (schema_ok and not duplicate) as records_accepted, count(*) filter (not schema_ok or duplicate) as records_rejected from marked group by 1)",
)
def a9_run_log(spark, folder):
    marked = contracts.mark_duplicates(validated_prices(spark, folder), contracts.price_contract())
    return sinks.run_log(marked, F.col("accepted"), "batch_id")


@query(
    "a10_skip_replayed",
    cte("v_run_header")
    + "select run_id, source_id from v_run_header n where started_at >= timestamp '1998-01-01' and not exists (select 1 from v_run_header d"
    " where d.started_at < timestamp '1999-01-01' and d.status in ('succeeded','partial') and d.source_id = n.source_id and d.external_run_id = n.external_run_id)",
)
def a10_skip_replayed(spark, folder):
    runs = views.run_headers(spark, folder)
    at = F.col("started_at")
    incoming = runs.filter(at >= F.lit("1998-01-01").cast("timestamp"))
    log = runs.filter(at < F.lit("1999-01-01").cast("timestamp"))
    return sinks.skip_replayed(incoming, log).select("run_id", "source_id")


@query(
    "a11_close_abandoned",
    cte("v_run_header", n="select *, lead(started_at) over (partition by source_id order by started_at, run_id) as nxt from v_run_header")
    + f"select run_id, case when status = 'running' and nxt is not null then 'failed' else status end as status,"
    f" {sql_stamp('case when status = $$running$$ and nxt is not null then nxt else completed_at end', 'completed_at')},"
    f" case when status = 'running' and nxt is not null then '{sinks.ABANDONED}' else error_message end as error_message from n",
)
def a11_close_abandoned(spark, folder):
    rows = sinks.close_abandoned(views.run_headers(spark, folder), F.to_date("started_at"))
    return rows.select("run_id", "status", stamp("completed_at"), "error_message")
