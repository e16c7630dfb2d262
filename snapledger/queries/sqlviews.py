"""The observation views again, as DuckDB SQL for the checks."""

from __future__ import annotations

_SNAPSHOT_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey, cast(round(l_extendedprice*100) as bigint))"
)

VIEWS = {
    "v_price_obs": f"""
select {_SNAPSHOT_ID} as snapshot_id, p_brand as provider, l_partkey as entity_id, p_name as entity_name,
  lower(l_returnflag) as mode, lower(l_linestatus) as tier, l_extendedprice as input,
  nullif(l_discount, 0) as cached, nullif(l_tax, 0) as cache_write, l_quantity as output,
  case when l_linenumber = 6 then 'EUR' when l_linenumber < 6 then 'USD' end as currency,
  case when l_linenumber = 7 then 'tokens' else 'USD per 1M tokens' end as pricing_unit,
  'https://prices.example.com/s' || l_suppkey as source_url,
  l_shipdate as observed_at, l_orderkey as run_id, l_linenumber as line_no, l_suppkey as supplier_id
from lineitem join part on l_partkey = p_partkey""",
    "v_run_header": """
select *, case when status <> 'running' then started_at + to_minutes(cast(floor(o_totalprice / 1000) as int)) end as completed_at,
  case when status = 'failed' then 'fetch failed token=k' || run_id || ' <b>page</b>  gone' end as error_message
from (select o_orderkey as run_id, o_custkey as source_id, o_totalprice,
  case when o_orderstatus = 'F' then 'succeeded' when o_orderstatus = 'P' then 'partial'
       when o_orderpriority = '1-URGENT' then 'running' else 'failed' end as status,
  'x' || strftime(o_orderdate, '%Y-%m') as external_run_id,
  lower(substr(o_orderpriority, 3, 20)) as triggered_by, o_orderdate as started_at from orders)""",
    "v_run": """
select h.run_id, h.source_id, h.status, h.external_run_id, h.triggered_by, h.started_at, h.completed_at, h.error_message,
  coalesce(c.seen, 0) as records_seen, coalesce(c.rejected, 0) as records_rejected,
  coalesce(c.seen, 0) - coalesce(c.rejected, 0) as records_accepted
from v_run_header h left join (
  select l_orderkey as run_id, count(*) as seen, count(*) filter (l_discount = 0) as rejected
  from lineitem group by 1) c using (run_id)""",
    "v_provider": "select n_nationkey as provider_id, lower(n_name) as provider_slug, n_name as provider_name from nation",
    "v_source": """
select c_custkey as source_id, c_nationkey as provider_id,
  case when c_mktsegment in ('AUTOMOBILE','HOUSEHOLD') then 'pricing'
       when c_mktsegment in ('BUILDING','FURNITURE') then 'models' else 'other' end as kind,
  'c_' || c_custkey as collector_id,
  'https://u:p@n' || c_nationkey || '.example.com/p/' || c_custkey || '?token=abc#top' as source_url,
  c_name as label, c_acctbal > 0 as is_active, c_acctbal as balance
from customer""",
    "v_incident": """
select *, case when status = 'resolved' then created_at + to_hours(cast(floor(o_totalprice / 10000) as int)) end as resolved_at
from (select 'i' || o_orderkey as incident_id, o_custkey as source_id, o_orderkey as run_id,
  case substr(o_orderpriority, 1, 1) when '1' then 'open' when '2' then 'healing' when '3' then 'needs_review'
    when '4' then 'resolved' else 'dismissed' end as status,
  case when o_orderstatus = 'O' then 'critical' else 'warning' end as severity,
  case when o_orderstatus = 'O' then 'ZERO_RECORDS' else 'SCHEMA_VALIDATION_FAILURE' end as reason_code,
  case when o_totalprice > 250000 then 1 else 0 end as healing_attempt_count,
  o_orderdate as created_at, o_totalprice
from orders where o_orderstatus <> 'F')""",
    "v_repair": f"""
select {_SNAPSHOT_ID} as attempt_id, 'i' || l_orderkey as incident_id,
  case when l_linenumber <= 3 then 1 else 2 end as attempt_number,
  case l_returnflag || l_linestatus when 'AF' then 'initiated' when 'AO' then 'awaiting_approval'
    when 'NF' then 'approved' when 'NO' then 'candidate_rejected' when 'RF' then 'timed_out' else 'failed' end as status,
  l_shipdate as started_at
from lineitem""",
    "v_capability": """
select d.doc_id as entity_id, d.source as provider, d.source || '-' || d.doc_id as api_id,
  'Model ' || d.doc_id as display_name, d.lang as family,
  case when n_chars > 2000 then 'ga' when n_chars > 500 then 'preview' end as stage,
  n_chars as context_window, nullif(n_chars // 100, 0) as max_output_tokens,
  quality = 1 as supports_vision, toxic = 1 as supports_tool_calling,
  case lang when 'en' then ['text','image'] when 'de' then ['text','audio','video'] when 'fr' then ['text']
    else cast([] as varchar[]) end as input_modalities,
  case when quality is not null then ['text'] else cast([] as varchar[]) end as output_modalities,
  case when n_chars > 1000 then 'The page lists every supported type.' end as statement,
  case when toxic = 1 then 'deprecated' when quality = 0 then 'retired' when quality = 1 then 'active' end as lifecycle_state,
  timestamp '2024-01-01' + to_minutes(cast(n_chars as int)) as observed_at
from documents d left join labels l on d.doc_id = l.doc_id""",
    "v_lifecycle": """
select 's' || o_orderkey as snapshot_id, o_orderkey as run_id, o_custkey as entity_id, 'api-' || o_custkey as api_id,
  case when pr <> '5' then case o_orderstatus when 'F' then 'active' when 'P' then 'deprecated' else 'retired' end end as state,
  case when o_totalprice > 200000 then cast(o_orderdate as date) + 30 end as deprecated_on,
  case when pr = '1' then cast(o_orderdate as date) + 90 end as retirement_date,
  case when pr = '2' then cast(o_orderdate as date) + 60 end as not_before_date,
  case pr when '2' then 'date' when '3' then 'explicitly_unannounced' when '4' then 'imprecise_date' else 'unobserved' end as not_before_observation,
  case when o_totalprice > 300000 then 'next-' || (o_custkey + 1) end as replacement,
  o_totalprice > 100000 as replacement_observed,
  'https://docs.example.com/' || o_custkey as source_url, o_orderdate as observed_at
from (select *, substr(o_orderpriority, 1, 1) as pr from orders)""",
    "v_change": """
select event_id, ts as detected_at,
  (['claude','google','openai','grok'])[user_id % 4 + 1] as provider, user_id as entity_id,
  'model-' || user_id || case when k >= 70 then '-pro' when k >= 50 then '-mini' else '' end as model_name,
  change_type, field_name,
  case when event_type in ('purchase','error') then value end as old_num,
  case when event_type in ('purchase','error') then cast(k as double) end as new_num,
  case when event_type in ('click','view') then 'v-old' end as old_text,
  case when field_name in ('deprecatedDate','retirementDate','retirementNotBeforeDate') then strftime(ts, '%Y-%m-%d')
    when field_name = 'recommendedReplacement' then 'next-' || k
    when field_name = 'lifecycleState' then case when k >= 90 then 'retired' else 'legacy' end
    when event_type = 'view' then 'v' || k end as new_text,
  event_id % 1000 as run_id
from (select *, case event_type when 'purchase' then 'price_decreased' when 'error' then 'price_increased'
    when 'signup' then case when k < 70 then 'model_added' else 'model_removed' end
    when 'click' then 'lifecycle_changed'
    else case when k < 50 then 'metadata_changed' else 'capability_changed' end end as change_type,
  case when event_type in ('purchase','error')
      then case when k < 50 then 'inputPricePer1MTokens' else 'outputPricePer1MTokens' end
    when event_type = 'click' then case when k < 20 then 'deprecatedDate' when k < 40 then 'retirementDate'
      when k < 60 then 'retirementNotBeforeDate' when k < 80 then 'recommendedReplacement' else 'lifecycleState' end
    when event_type = 'view' then case when k < 50 then 'sourceUrl' else 'contextWindow' end end as field_name
  from (select *, cast(props->>'k' as int) as k from events))""",
    "v_raw_price": """
select l_orderkey as batch_id,
  cast(l_linenumber as bigint) * 1000000000000 + l_suppkey * 100000000 + cast(round(l_extendedprice*100) as bigint) as position,
  case when p_size >= 49 then p_brand else replace(p_brand, '#', '-') end as provider,
  case when p_size = 48 then p_name || '!' else p_name end as model_name,
  case when p_size = 47 then l_returnflag else lower(l_returnflag) end as pricing_mode,
  lower(l_linestatus) as context_tier,
  case when p_size = 46 then -l_extendedprice when p_size = 45 then null else l_extendedprice end as input_price,
  nullif(l_discount, 0) as cached_input_price, nullif(l_tax, 0) as cache_write_price,
  case when p_size <> 45 then l_quantity end as output_price,
  case when p_size <> 44 then 'USD per 1M tokens' end as pricing_unit,
  case when p_size = 43 then 'ftp://h.example.com/' || l_suppkey when p_size = 42 then 'not a url'
    else 'https://h.example.com/' || l_suppkey end as source_url
from lineitem join part on l_partkey = p_partkey""",
    "v_name": f"""
select {_SNAPSHOT_ID} as row_id, (['anthropic','gemini','openai','xai'])[l_linenumber % 4 + 1] as provider,
  ' models/' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '__'
  || case when p_type = 'PROMO' then 'Preview' else p_type end
  || case when l_returnflag = 'A' then strftime(l_shipdate, '-%Y%m%d') when l_returnflag = 'N' then strftime(l_shipdate, '-%Y-%m-%d')
    when l_linestatus = 'F' then '-001' else strftime(l_shipdate, ' %m%d') end as name
from lineitem join part on l_partkey = p_partkey""",
}

_NEEDS = {"v_run": ["v_run_header"]}


def cte(*names: str, **extra: str) -> str:
    """A WITH clause with the named views, their dependencies, and extra named subqueries after them."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    parts = [f"{name} as ({VIEWS[name]})" for name in ordered]
    parts += [f"{name} as ({text})" for name, text in extra.items()]
    return "with " + ",\n".join(parts) + "\n"
