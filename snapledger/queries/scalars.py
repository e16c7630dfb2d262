"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.functions import labels, lineage, text, values
from snapledger.operators import current
from snapledger.queries.history import day, sql_day, sql_stamp, stamp
from snapledger.queries.registry import query
from snapledger.queries.sqlviews import cte
from snapledger.sources import tables, views

NOW = "2024-02-01 00:00:00"


def lit_ts(value: str):
    return F.lit(value).cast("timestamp")


def md5_of(column):
    return F.md5(column)


def sql_case(column: str, table: dict[str, str], otherwise: str) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    return f"case {column} {arms} else {otherwise} end"


# --- names and URLs --------------------------------------------------------------------------------------


@query(
    "c1_source_defaults",
    cte("v_raw_price")
    + "select batch_id, position, coalesce(source_url, 'x') as source_url, case when u in ('per_1m_tokens') or u is null"
    " then 'USD per 1M tokens' else u end as pricing_unit from (select *, case when context_tier = 'f' then 'per_1m_tokens'"
    " else pricing_unit end as u from v_raw_price)",
)
def c1_source_defaults(spark, folder):
    raw = views.raw_prices(spark, folder).withColumn(
        "pricing_unit", F.when(F.col("context_tier") == "f", "per_1m_tokens").otherwise(F.col("pricing_unit"))
    )
    return text.with_source_defaults(raw, "x").select("batch_id", "position", "source_url", "pricing_unit")


@query("c2_drop_parenthetical", "select p_partkey, p_name as name from part")
def c2_drop_parenthetical(spark, folder):
    part = tables.load(spark, folder, "part")
    noted = F.concat("p_name", F.lit("  ("), "p_type", F.lit(") "))
    return part.select("p_partkey", text.drop_trailing_parenthetical(noted).alias("name"))


TOKEN_TEXT_SQL = (
    "select event_id, case event_type when 'view' then chr(8203) || k || ',000 tokens' when 'click' then value || 'K'"
    " when 'purchase' then 'approx ' || k || 'k' when 'error' then k || 'M tokens' || chr(57487) else cast(value as varchar) end as t"
    " from (select *, cast(props->>'k' as int) as k from events)"
)


def token_texts(spark, folder):
    events = tables.load(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    kind = F.col("event_type")
    value = F.col("value").cast("string")
    shown = (
        F.when(kind == "view", F.concat(F.lit("​"), "k", F.lit(",000 tokens")))
        .when(kind == "click", F.concat(value, F.lit("K")))
        .when(kind == "purchase", F.concat(F.lit("approx "), "k", F.lit("k")))
        .when(kind == "error", F.concat("k", F.lit("M tokens")))
        .otherwise(value)
    )
    return events.select("event_id", shown.alias("t"))


@query(
    "c3_token_count",
    f"""select event_id, cast(case when v = floor(v) and v > 0 and v <= 9007199254740991 then v end as bigint) as tokens from (
  select event_id, coalesce(try_cast(nullif(regexp_extract(c, '(?i)^(\\d+)\\s*(?:tokens?)?$', 1), '') as double),
    try_cast(nullif(regexp_extract(c, '(?i)^(\\d+(?:\\.\\d+)?)\\s*([km])\\s*(?:tokens?)?$', 1), '') as double)
    * case lower(regexp_extract(c, '(?i)^(\\d+(?:\\.\\d+)?)\\s*([km])\\s*(?:tokens?)?$', 2)) when 'k' then 1000 when 'm' then 1000000 end) as v
  from (select event_id, replace(trim(regexp_replace(t, '[\\x{{200B}}-\\x{{200F}}\\x{{E000}}-\\x{{F8FF}}]', '', 'g')), ',', '') as c from ({TOKEN_TEXT_SQL})))""",
)
def c3_token_count(spark, folder):
    return token_texts(spark, folder).select("event_id", values.token_count(F.col("t")).alias("tokens"))


@query(
    "c4_strip_non_textual",
    "select doc_id, md5(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as stripped from documents",
)
def c4_strip_non_textual(spark, folder):
    # Zero-width, bidi and private-use marks are put into every text; stripping must give it back whole.
    documents = tables.load(spark, folder, "documents").select("doc_id", "text")
    marked = F.concat(F.lit("﻿"), F.regexp_replace("text", "e", "e​"), F.lit("‮\U000f0001"))
    return documents.select("doc_id", md5_of(text.strip_non_textual(marked)).alias("stripped"))


@query(
    "c5_modalities",
    """select doc_id, array_to_string(m, ',') as modalities from (select doc_id, case lang when 'en' then ['image','text']
  when 'de' then ['audio','text'] when 'fr' then ['text','video','image'] else cast([] as varchar[]) end as m from documents)""",
)
def c5_modalities(spark, folder):
    documents = tables.load(spark, folder, "documents")
    lang = F.col("lang")
    published = (
        F.when(lang == "en", "Vision, text;IMAGE").when(lang == "de", "voice speech\ttext")
        .when(lang == "fr", "text;video smell image").otherwise("braille")
    )
    return documents.select("doc_id", F.array_join(text.modalities_from_text(published), ",").alias("modalities"))


DATE_TEXT_SQL = """select o_orderkey, o_orderstatus, case substr(o_orderpriority, 1, 1)
  when '1' then strftime(o_orderdate, '%B %-d, %Y') when '2' then 'Not sooner than ' || strftime(o_orderdate, '%B %-d, %Y')
  when '3' then strftime(o_orderdate, '%B %Y') when '4' then 'February 30, ' || strftime(o_orderdate, '%Y')
  else 'No shutdown date announced' end as t from orders"""
SQL_DATE = (
    "case when regexp_matches({0}, '^(January|February|March|April|May|June|July|August|September|October|November|December)"
    " ([1-9]|[12]\\d|3[01]), (\\d{{4}})$') then cast(try_strptime({0}, '%B %d, %Y') as date) end"
)
SQL_MONTH = (
    "regexp_matches({0}, '^(January|February|March|April|May|June|July|August|September|October|November|December) (\\d{{4}})$')"
)


def date_texts(spark, folder):
    orders = tables.load(spark, folder, "orders")
    pr = F.substring("o_orderpriority", 1, 1)
    full = F.date_format("o_orderdate", "MMMM d, yyyy")
    shown = (
        F.when(pr == "1", full).when(pr == "2", F.concat(F.lit("Not sooner than "), full))
        .when(pr == "3", F.date_format("o_orderdate", "MMMM yyyy"))
        .when(pr == "4", F.concat(F.lit("February 30, "), F.date_format("o_orderdate", "yyyy")))
        .otherwise("No shutdown date announced")
    )
    return orders.select("o_orderkey", "o_orderstatus", shown.alias("t"))


@query("c6_english_date", f"select o_orderkey, strftime({SQL_DATE.format('t')}, '%Y-%m-%d') as iso from ({DATE_TEXT_SQL})")
def c6_english_date(spark, folder):
    return date_texts(spark, folder).select("o_orderkey", F.date_format(values.english_date(F.col("t")), "yyyy-MM-dd").alias("iso"))


@query(
    "c7_retirement_text",
    "select o_orderkey, strftime(case when not starts_with(t, 'Not sooner than ') then " + SQL_DATE.format("t")
    + " end, '%Y-%m-%d') as exact, strftime(case when starts_with(t, 'Not sooner than ') then "
    + SQL_DATE.format("substr(t, 17)") + f" end, '%Y-%m-%d') as not_before from ({DATE_TEXT_SQL})",
)
def c7_retirement_text(spark, folder):
    exact, lower = values.retirement_dates(F.col("t"))
    return date_texts(spark, folder).select(
        "o_orderkey", F.date_format(exact, "yyyy-MM-dd").alias("exact"), F.date_format(lower, "yyyy-MM-dd").alias("not_before")
    )


@query(
    "c8_shutdown_state",
    f"""select o_orderkey, case when o_orderstatus = 'O' then 'retired' when {SQL_DATE.format('t')} is not null or {SQL_MONTH.format('t')}
  then 'deprecated' end as state, case when {SQL_DATE.format('t')} is not null then 'date' when {SQL_MONTH.format('t')} then 'imprecise_date'
  when t = 'No shutdown date announced' then 'explicitly_unannounced' else 'unobserved' end as observation from ({DATE_TEXT_SQL})""",
)
def c8_shutdown_state(spark, folder):
    shown = F.col("t")
    return date_texts(spark, folder).select(
        "o_orderkey",
        values.shutdown_state(F.col("o_orderstatus") == "O", shown).alias("state"),
        values.shutdown_observation(shown).alias("observation"),
    )


@query(
    "c9_capability_flags",
    cte("v_capability")
    + "select entity_id, coalesce(supports_vision, case when list_contains(input_modalities, 'image') then true end) as vision,"
    " case when len(input_modalities) > 0 then list_contains(input_modalities, 'image') end as listed from v_capability",
)
def c9_capability_flags(spark, folder):
    rows = views.capabilities(spark, folder)
    inputs = F.col("input_modalities")
    return rows.select(
        "entity_id",
        values.observed_flag(F.col("supports_vision"), F.array_contains(inputs, "image")).alias("vision"),
        values.exhaustive_flag(inputs, "image").alias("listed"),
    )


FAMILY_IDS = (
    "gpt-5-mini", "gpt-4o-preview", "o3", "dall-e-3", "whisper-1", "unknown",
    "big-opus", "a-sonnet-x", "haiku", "grok-build-beta", "grok-4-exp", "gpt-image",
)


def _family_sql() -> str:
    arms = []
    for name, test, word, family in values.FAMILY_RULES:
        hit = f"starts_with(a, '{word}')" if test == "prefix" else f"contains(a, '{word}')"
        arms.append(f"when provider = '{name}' and {hit} then '{family}'")
    arms += [f"when provider = '{n}' then '{f}'" for n, f in values.DEFAULT_FAMILY.items()]
    stages = []
    for name, pattern, otherwise in values.STAGE_RULES:
        inner = f"'{otherwise}'" if pattern is None else f"case when regexp_matches(a, '{pattern}') then 'preview' else '{otherwise}' end"
        stages.append(f"when provider = '{name}' then {inner}")
    ids = ", ".join(f"'{i}'" for i in FAMILY_IDS)
    return (
        f"select event_id, case {' '.join(arms)} end as family, case {' '.join(stages)} end as stage from (select event_id,"
        f" (['openai','anthropic','gemini','xai'])[user_id % 4 + 1] as provider, ([{ids}])[cast(props->>'k' as int) % 12 + 1] as a from events)"
    )


@query("c10_family_stage", _family_sql())
def c10_family_stage(spark, folder):
    events = tables.load(spark, folder, "events")
    names = F.array(*[F.lit(p) for p in ("openai", "anthropic", "gemini", "xai")])
    ids = F.array(*[F.lit(i) for i in FAMILY_IDS])
    shaped = events.select(
        "event_id",
        F.element_at(names, F.pmod("user_id", F.lit(4)).cast("int") + 1).alias("provider"),
        F.element_at(ids, F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(12)) + 1).alias("api_id"),
    )
    provider, api_id = F.col("provider"), F.col("api_id")
    return shaped.select(
        "event_id",
        values.family_of(provider, api_id, F.lit(None).cast("string")).alias("family"),
        values.stage_of(provider, api_id).alias("stage"),
    )


def sql_key(column: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(lower(trim({column})), '^models/', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    )


SQL_FAMILY_KEY = """case provider when 'anthropic' then regexp_replace(k, '-\\d{8}$', '')
  when 'gemini' then case when regexp_matches(k, '(^|-)(preview|exp|experimental)(-|$)') then k else regexp_replace(k, '-\\d{3}$', '') end
  when 'openai' then regexp_replace(regexp_replace(k, '-\\d{4}-\\d{2}-\\d{2}$', ''), '-\\d{8}$', '')
  when 'xai' then regexp_replace(regexp_replace(k, '-\\d{4}$', ''), '-\\d{8}$', '') else k end"""


@query("c11_identity_key", cte("v_name") + f"select row_id, {sql_key('name')} as key from v_name")
def c11_identity_key(spark, folder):
    return views.names(spark, folder).select("row_id", text.identity_key(F.col("name")).alias("key"))


@query("c11_identity_key_unicode", f"select conv_id, turn, md5({sql_key('text')}) as key from conversations")
def c11_identity_key_unicode(spark, folder):
    rows = tables.load(spark, folder, "conversations")
    return rows.select("conv_id", "turn", F.md5(text.identity_key(F.col("text"))).alias("key"))


@query("c12_family_key", cte("v_name") + f"select row_id, {SQL_FAMILY_KEY} as family_key from (select *, {sql_key('name')} as k from v_name)")
def c12_family_key(spark, folder):
    rows = views.names(spark, folder).withColumn("key", text.key_from_ascii(F.col("name")))
    return rows.select("row_id", text.family_key(F.col("key"), F.col("provider")).alias("family_key"))


@query(
    "c13_provider_alias",
    cte("v_change") + f"select event_id, {sql_case('provider', text.PROVIDER_ALIASES, 'provider')} as provider from v_change",
)
def c13_provider_alias(spark, folder):
    shouted = F.concat(F.lit(" "), F.upper("provider"))
    return views.changes(spark, folder).select("event_id", text.provider_slug(shouted).alias("provider"))


@query(
    "c14_canonical_key",
    cte("v_capability")
    + "select entity_id, case when stage is not null then lower(provider) || ':' || lower(api_id) else 'id:' || entity_id end as model_key from v_capability",
)
def c14_canonical_key(spark, folder):
    api_id = F.when(F.col("stage").isNotNull(), F.upper("api_id")).otherwise(" ")
    rows = views.capabilities(spark, folder)
    return rows.select("entity_id", text.canonical_key(F.col("provider"), api_id, F.col("entity_id")).alias("model_key"))


@query(
    "c15_composite_identity",
    cte("v_price_obs") + "select provider, lower(entity_name) as name, mode, tier, count(*) as observations from v_price_obs group by 1, 2, 3, 4",
)
def c15_composite_identity(spark, folder):
    # A struct is the key; no string encoding is needed to keep its parts apart.
    key = F.struct("provider", F.lower("entity_name").alias("name"), "mode", "tier").alias("identity")
    counted = views.price_obs(spark, folder).groupBy(key).agg(F.count(F.lit(1)).alias("observations"))
    return counted.select("identity.*", "observations")


@query(
    "c16_last_path_segment",
    "select page_id, nullif(regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '([^/]+)/*$', 1), '') as slug from pages",
)
def c16_last_path_segment(spark, folder):
    return tables.load(spark, folder, "pages").select("page_id", text.last_path_segment(F.col("url")).alias("slug"))


@query(
    "c17_safe_url",
    cte("v_source")
    + "select source_id as id, 'https://n' || provider_id || '.example.com/p/' || source_id as safe from v_source"
    " union all select page_id, regexp_extract(url, '^[^?#]+', 0) from pages",
)
def c17_safe_url(spark, folder):
    sources = views.sources(spark, folder).select(F.col("source_id").alias("id"), "source_url")
    pages = tables.load(spark, folder, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source_url"))
    return sources.unionByName(pages).select("id", text.safe_url(F.col("source_url")).alias("safe"))


def sql_redact(column: str) -> str:
    for pattern in text.SECRETS:
        column = f"regexp_replace({column}, '{pattern}', '[redacted]', 'g')"
    return column


def sql_clean(column: str, limit: int) -> str:
    plain = f"trim(regexp_replace(regexp_replace({sql_redact(column)}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
    return (
        f"(select case when x = '' then null when length(x) <= {limit} then x else rtrim(x[1:{limit - 1}]) || '…' end from (select {plain} as x))"
    )


@query(
    "c18_clean_text",
    cte("v_run_header") + f"select run_id as id, {sql_clean('error_message', 240)} as cleaned from v_run_header"
    f" union all select page_id, {sql_clean('html', 120)} from pages",
)
def c18_clean_text(spark, folder):
    runs = views.run_headers(spark, folder).select(F.col("run_id").alias("id"), text.clean_text(F.col("error_message")).alias("cleaned"))
    pages = tables.load(spark, folder, "pages").select(F.col("page_id").alias("id"), text.clean_text(F.col("html"), 120).alias("cleaned"))
    return runs.unionByName(pages)


def raw_price_json(spark, folder):
    obs = views.price_obs(spark, folder)
    return obs.withColumn("raw", F.to_json(F.struct(
        F.col("entity_name").alias("Model Name"),
        F.col("mode").alias("mode"),
        F.col("cached").alias("cachedInput"),
        F.col("input").alias("Input-Price"),
        F.col("currency").alias("currency"),
    )))


LINEAGE_SQL = """select snapshot_id, f.normalized_field, f.normalized_value, f.raw_field, f.raw_value,
  case when f.raw_field is null then 'derived' else 'mapped' end as derivation
from v_price_obs, lateral (values
  ('modelName', entity_name, 'Model Name', entity_name), ('pricingMode', mode, 'mode', mode),
  ('contextTier', tier, null, null),
  ('cachedInputPricePer1MTokens', cast(cached as varchar), case when cached is not null then 'cachedInput' end, cast(cached as varchar)),
  ('currency', currency, case when currency is not null then 'currency' end, currency),
  ('pricingUnit', pricing_unit, null, null)
) f(normalized_field, normalized_value, raw_field, raw_value)"""


@query("c19_alias_lookup", cte("v_price_obs") + LINEAGE_SQL)
def c19_alias_lookup(spark, folder):
    wanted = {
        "modelName": F.col("entity_name"), "pricingMode": F.col("mode"), "contextTier": F.col("tier"),
        "cachedInputPricePer1MTokens": F.col("cached"), "currency": F.col("currency"), "pricingUnit": F.col("pricing_unit"),
    }
    return lineage.lineage(raw_price_json(spark, folder), ["snapshot_id"], "raw", wanted)


LIFE_LINEAGE_SQL = f"""select snapshot_id, f.normalized_field, f.normalized_value, f.raw_field, f.raw_value,
  case when f.raw_field is null then 'derived' else 'mapped' end as derivation
from (select *, strftime(deprecated_on, '%Y-%m-%d') as d from v_lifecycle), lateral (values
  ('apiModelId', api_id, 'Model-ID', api_id),
  ('lifecycleState', state, case when state is not null then 'currentState' end, state),
  ('deprecatedOn', d, case when d is not null then 'deprecated' end, d),
  ('recommendedReplacement', replacement, null, null),
  ('sourceUrl', source_url, 'url', source_url)
) f(normalized_field, normalized_value, raw_field, raw_value)"""


@query("l7_raw_to_normalized", cte("v_lifecycle") + LIFE_LINEAGE_SQL)
def l7_raw_to_normalized(spark, folder):
    rows = views.lifecycle_obs(spark, folder).withColumn("raw", F.to_json(F.array(F.struct(
        F.col("api_id").alias("Model-ID"), F.col("state").alias("currentState"),
        F.col("deprecated_on").alias("deprecated"), F.col("source_url").alias("url"),
    ))))
    wanted = {
        "apiModelId": F.col("api_id"), "lifecycleState": F.col("state"), "deprecatedOn": F.col("deprecated_on"),
        "recommendedReplacement": F.col("replacement"), "sourceUrl": text.safe_url(F.col("source_url")),
    }
    return lineage.lineage(rows, ["snapshot_id"], "raw", wanted, lineage.LIFECYCLE_ALIASES)


# --- hashes and numbers ----------------------------------------------------------------------------------


def _sql_dec(column: str) -> str:
    return f"coalesce(cast(cast({column} as decimal(20,8)) as varchar), '')"


@query(
    "c20_content_hash",
    cte("v_price_obs", "v_lifecycle")
    + "select snapshot_id, md5(" + " || '|' || ".join([*[_sql_dec(c) for c in ("input", "cached", "cache_write", "output")],
                                                       "coalesce(currency, '')", "pricing_unit"])
    + ") as content_hash from v_price_obs union all select snapshot_id, md5(coalesce(state, '') || '|' ||"
    " coalesce(cast(deprecated_on - date '1970-01-01' as varchar), '') || '|' || coalesce(cast(retirement_date - date '1970-01-01' as varchar), '')"
    " || '|' || coalesce(cast(not_before_date - date '1970-01-01' as varchar), '') || '|' || not_before_observation || '|' ||"
    " case when replacement_observed then 'observed' else 'unobserved' end || '|' || coalesce(replacement, '')) from v_lifecycle",
)
def c20_content_hash(spark, folder):
    prices = [F.col(c) for c in ("input", "cached", "cache_write", "output")]
    hashed = views.price_obs(spark, folder).select(
        "snapshot_id", values.price_hash(prices, F.col("currency"), F.col("pricing_unit")).alias("content_hash")
    )
    life = [F.col(c) for c in ("state", "deprecated_on", "retirement_date", "not_before_date", "not_before_observation",
                               "replacement_observed", "replacement")]
    return hashed.unionByName(
        views.lifecycle_obs(spark, folder).select("snapshot_id", values.lifecycle_hash(*life).alias("content_hash"))
    )


@query(
    "c20_capability_hash",
    cte("v_capability")
    + "select entity_id, md5(coalesce(display_name, '') || '|' || coalesce(family, '') || '|' || coalesce(stage, '') || '|' ||"
    " coalesce(cast(context_window as varchar), '') || '|' || coalesce(cast(max_output_tokens as varchar), '') || '|' ||"
    " coalesce(cast(supports_vision as varchar), 'unknown') || '|' || coalesce(cast(supports_tool_calling as varchar), 'unknown') || '|' ||"
    " array_to_string(list_sort(input_modalities), ',') || '|' || array_to_string(list_sort(output_modalities), ',')) as content_hash from v_capability",
)
def c20_capability_hash(spark, folder):
    def cols(*names):
        return [F.col(n) for n in names]

    return views.capabilities(spark, folder).select("entity_id", values.capability_hash(
        cols("display_name", "family", "stage"), cols("context_window", "max_output_tokens"),
        cols("supports_vision", "supports_tool_calling"), cols("input_modalities", "output_modalities"),
    ).alias("content_hash"))


def sql_round_cost(expression: str) -> str:
    return f"floor(({expression} + 2.220446049250313e-16) * 1000000 + 0.5) / 1000000"


@query("c21_cost", cte("v_price_obs") + f"select snapshot_id, {sql_round_cost('(1234567 / 1000000.0::double) * input')} as cost from v_price_obs")
def c21_cost(spark, folder):
    cost = values.round_cost(F.lit(1234567) / F.lit(1_000_000) * F.col("input"))
    return views.price_obs(spark, folder).select("snapshot_id", cost.alias("cost"))


def sql_fixed(x: str, digits: int) -> str:
    """Half up on the exact binary value: printf is exact but rounds exact ties to even, so those are caught."""
    scale = 10 ** digits
    tie = f"(abs({x}) * {scale} - floor(abs({x}) * {scale}) = 0.5 and {x} * 1024 = floor({x} * 1024))"
    size = f"case when {tie} then (floor(abs({x}) * {scale}) + 1) / {scale} else cast(printf('%.{digits}f', abs({x})) as double) end"
    return f"(case when {x} < 0 then -1.0::double else 1.0::double end * {size})"


SQL_ABS = sql_fixed("(new_num - old_num)", 6)
SQL_PCT = sql_fixed("((new_num - old_num) / nullif(old_num, 0) * 100)", 2)


@query("c22_price_delta", cte("v_change") + f"select event_id, {SQL_ABS} as absolute_change, {SQL_PCT} as percent_change from v_change where old_num is not null")
def c22_price_delta(spark, folder):
    absolute, percent = values.price_delta(F.col("old_num"), F.col("new_num"))
    rows = views.changes(spark, folder).filter("old_num is not null")
    return rows.select("event_id", absolute.alias("absolute_change"), percent.alias("percent_change"))


SQL_NUM = "regexp_replace(regexp_replace(printf('%.8f', {0}), '0+$', ''), '\\.$', '')"


def sql_price_text(column: str) -> str:
    small = f"regexp_replace(printf('%.4f', round({column}, 4)), '0{{1,2}}$', '')"
    return f"'$' || case when {column} < 1 then {small} else format('{{:,.2f}}', {column}) end"


@query(
    "c23_formats",
    cte("v_price_obs")
    + f"select snapshot_id, '$' || printf('%.2f', input) as money, {sql_price_text('cached')} as cached_text,"
    f" {sql_price_text('output')} as output_text, format('{{:,}}', cast(run_id as bigint)) as run_text from v_price_obs",
)
def c23_formats(spark, folder):
    return views.price_obs(spark, folder).select(
        "snapshot_id",
        values.money(F.col("input")).alias("money"),
        values.price_text(F.col("cached")).alias("cached_text"),
        values.price_text(F.col("output")).alias("output_text"),
        values.count_text(F.col("run_id")).alias("run_text"),
    )


def _sql_class(position: int, default: str) -> str:
    arms = []
    for rule in labels.CLASSES:
        fields = "" if rule[1] is None else " and field_name in (" + ", ".join(f"'{f}'" for f in rule[1]) + ")"
        arms.append(f"when change_type = '{rule[0]}'{fields} then '{rule[position]}'")
    return f"case {' '.join(arms)} else '{default}' end"


SQL_FLAGSHIP = "(" + " or ".join(f"contains(lower(model_name), '{w}')" for w in labels.FLAGSHIP_WORDS) + ")"
SQL_SCORE = f"""case when kind = 'model_added' then case when {SQL_FLAGSHIP} then 95 else 85 end
  when kind = 'lifecycle_transition' then 90
  when kind in ('retirement_scheduled','retirement_not_before_scheduled') then case when {SQL_FLAGSHIP} then 88 else 80 end
  when kind = 'deprecation_scheduled' then case when {SQL_FLAGSHIP} then 85 else 75 end
  when kind = 'replacement_recommended' then 82
  when abs(percent_change) >= 50 then 92 when abs(percent_change) >= 20 then 82 when abs(percent_change) >= 10 then 70
  when percent_change is not null then 55 when category = 'pricing' then 65 when kind = 'model_removed' then 75 else 50 end"""
PROVIDER_NAMES = {"anthropic": "Anthropic", "google": "Google", "openai": "OpenAI", "xai": "xAI"}

# Classified evidence in SQL; the temporal queries build on it too.
EVIDENCE_SQL = f"""select *, {SQL_SCORE} as significance,
  {sql_case('provider', PROVIDER_NAMES, 'provider')} as provider_name from (
  select event_id, detected_at, entity_id, model_name, change_type, field_name, old_num, new_num, old_text, new_text, run_id,
    {sql_case('provider', text.PROVIDER_ALIASES, 'provider')} as provider,
    {_sql_class(2, 'metadata_changed')} as kind, {_sql_class(3, 'metadata')} as category,
    case when {_sql_class(3, 'metadata')} = 'pricing' then {SQL_ABS} end as absolute_change,
    case when {_sql_class(3, 'metadata')} = 'pricing' then {SQL_PCT} end as percent_change from v_change)"""
EVIDENCE = cte("v_change", evidence=EVIDENCE_SQL)


def evidence(spark, folder):
    from snapledger.operators.temporal import build_evidence

    return build_evidence(views.changes(spark, folder))


@query("c24_classification", EVIDENCE + "select event_id, kind, category from evidence")
def c24_classification(spark, folder):
    return evidence(spark, folder).select("event_id", "kind", "category")


@query("c25_significance", EVIDENCE + "select event_id, cast(significance as int) as significance from evidence")
def c25_significance(spark, folder):
    return evidence(spark, folder).select("event_id", "significance")


_P, _O, _N = SQL_NUM.format("abs(percent_change)"), SQL_NUM.format("old_num"), SQL_NUM.format("new_num")
SENTENCE_SQL = f"""case when kind = 'model_added' then model_name || ' was added to ' || provider_name || '''s catalog.'
  when kind = 'model_removed' then model_name || ' was removed from ' || provider_name || '''s catalog.'
  when kind = 'price_decreased' then model_name || ' ' || field_name || ' reduced from $' || {_O} || ' to $' || {_N} || ' / 1M tokens'
    || case when percent_change is not null then ' (' || {_P} || '% reduction)' else '' end || '.'
  when kind = 'price_increased' then model_name || ' ' || field_name || ' increased from $' || {_O} || ' to $' || {_N} || ' / 1M tokens'
    || case when percent_change is not null then ' (' || {_P} || '% increase)' else '' end || '.'
  when kind = 'lifecycle_transition' then model_name || ' transitioned lifecycle state from ' || old_text || ' to ' || new_text || '.'
  when kind = 'deprecation_scheduled' then model_name || ' scheduled for deprecation effective ' || new_text || '.'
  when kind = 'retirement_scheduled' then model_name || ' scheduled for retirement on ' || new_text || '.'
  when kind = 'retirement_not_before_scheduled' then model_name || ' shutdown scheduled not sooner than ' || new_text || '.'
  when kind = 'replacement_recommended' then model_name || ' recommended replacement designated as ' || new_text || '.'
  else model_name || ' ' || field_name || ' updated from ' || old_text || ' to ' || new_text || '.' end"""


@query("c26_sentences", EVIDENCE + f"select event_id, {SENTENCE_SQL} as summary from evidence")
def c26_sentences(spark, folder):
    return evidence(spark, folder).select("event_id", "summary")


SQL_PCT_LABEL = (
    "case when percent_change > 0 then '+' when percent_change < 0 then '−' else '' end || printf('%.1f', " + sql_fixed("abs(percent_change)", 1) + ") || '%'"
)
SQL_TIER = "case when significance >= 75 then 'high' when significance >= 40 then 'medium' else 'low' end"
SQL_DIRECTION = "case kind when 'price_increased' then 'increase' when 'price_decreased' then 'decrease' else 'none' end"


@query(
    "c27_labels",
    EVIDENCE + f"select event_id, {sql_case('kind', labels.TONES, 'null')} as tone, {SQL_TIER} as tier, {SQL_DIRECTION} as direction,"
    f" {SQL_PCT_LABEL} as delta, {sql_case('kind', labels.TYPE_LABELS, 'kind')} as type_label,"
    f" {sql_case('category', labels.CATEGORY_LABELS, 'category')} as category_label from evidence",
)
def c27_labels(spark, folder):
    kind = F.col("kind")
    return evidence(spark, folder).select(
        "event_id",
        labels.tone(kind).alias("tone"),
        labels.tier_of_score(F.col("significance")).alias("tier"),
        labels.direction(kind).alias("direction"),
        labels.percent_label(F.col("percent_change")).alias("delta"),
        labels.lookup(kind, labels.TYPE_LABELS, kind).alias("type_label"),
        labels.lookup(F.col("category"), labels.CATEGORY_LABELS, F.col("category")).alias("category_label"),
    )


SQL_AUTHORITY = "case when category in ('catalog','lifecycle','deprecations','retirements') then 'authoritative' else 'verified_scrape' end"


@query(
    "c28_authority",
    EVIDENCE + f"select event_id, authority, case when authority = 'authoritative' then 1.0::double else 0.95::double end as confidence,"
    " case authority when 'authoritative' then 'official' else 'verified' end as trust"
    f" from (select event_id, {SQL_AUTHORITY} as authority from evidence)",
)
def c28_authority(spark, folder):
    rows = evidence(spark, folder)
    return rows.select("event_id", "authority", "confidence", labels.trust(F.col("authority")).alias("trust"))


@query("c29_trim_to_null", "select o_orderkey, nullif(trim(case when o_orderstatus = 'F' then '  ' else ' ' || o_orderpriority || ' ' end), '') as label from orders")
def c29_trim_to_null(spark, folder):
    orders = tables.load(spark, folder, "orders")
    padded = F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return orders.select("o_orderkey", text.trim_to_null(padded).alias("label"))


@query(
    "c30_tier_rank",
    """select p_partkey, case when k > 0 then k - 1 when is_long then 100 else 50 end as tier_rank, is_long
  from (select p_partkey, coalesce(list_position(['default','short','base','standard'], lower(t)), 0) as k,
    regexp_matches(t, '(?i)long|extended|large|\\b>\\s*\\d') as is_long
    from (select p_partkey, case when p_type = 'PROMO' then 'ctx> 200k' when p_type = 'SMALL' then 'ctx > 9' else p_type end as t from part))""",
)
def c30_tier_rank(spark, folder):
    tier = F.when(F.col("p_type") == "PROMO", "ctx> 200k").when(F.col("p_type") == "SMALL", "ctx > 9").otherwise(F.col("p_type"))
    return tables.load(spark, folder, "part").select(
        "p_partkey", current.tier_rank(tier).alias("tier_rank"), current.is_long_tier(tier).alias("is_long")
    )


@query(
    "c31_age_minutes",
    f"select event_id, greatest(cast(floor((epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 60000000.0) as bigint), 0) as age_minutes from events",
)
def c31_age_minutes(spark, folder):
    return tables.load(spark, folder, "events").select("event_id", values.age_minutes(F.col("ts"), lit_ts(NOW)).alias("age_minutes"))


@query(
    "c32_quantity",
    """select event_id, cast(floor(v * case u when 'k' then 1000 when 'm' then 1000000 when 'B' then 1000000000 else 1 end + 0.5) as bigint) as quantity
from (select event_id, value as v, case event_type when 'view' then 'k' when 'click' then 'm' when 'error' then 'B' end as u from events)""",
)
def c32_quantity(spark, folder):
    kind = F.col("event_type")
    unit = F.when(kind == "view", "k").when(kind == "click", "m").when(kind == "error", "B")
    digits = F.concat(F.lit(" "), F.col("value").cast("string"))
    return tables.load(spark, folder, "events").select("event_id", values.quantity(digits, unit).alias("quantity"))


@query(
    "c33_capability_statement",
    cte("v_capability") + "select entity_id, statement from v_capability",
)
def c33_capability_statement(spark, folder):
    padded = F.concat(F.lit("  "), "statement", F.lit(" "))
    raw = F.to_json(F.struct("entity_id", padded.alias("capability_statement")))
    return views.capabilities(spark, folder).select("entity_id", text.capability_statement(raw).alias("statement"))


@query(
    "c34_enumerated_ids",
    """select p_partkey, case when p_size >= 25 then 'm-' || p_partkey || ';n.' || p_size else '' end as ids from part""",
)
def c34_enumerated_ids(spark, folder):
    size = F.col("p_size")
    listed = (
        F.when(size >= 25, F.concat(F.lit("m-"), "p_partkey", F.lit(", n."), "p_size"))
        .when(size >= 20, F.concat(F.lit("m-"), "p_partkey", F.lit(" m-"), "p_partkey"))
        .when(size >= 10, F.concat(F.lit("m-"), "p_partkey", F.lit(" and")))
        .otherwise(F.concat(F.lit("m-"), "p_partkey"))
    )
    ids = F.coalesce(F.array_join(text.enumerated_ids(listed), ";"), F.lit(""))
    return tables.load(spark, folder, "part").select("p_partkey", ids.alias("ids"))


@query(
    "c35_dashboard_mapping",
    cte("v_change")
    + f"select event_id, {sql_case('change_type', labels.DASHBOARD_TYPES, chr(39) + 'schema_update' + chr(39))} as dashboard_type,"
    " case when change_type in ('model_removed','price_increased') then 'warning' else 'info' end as severity from v_change",
)
def c35_dashboard_mapping(spark, folder):
    kind = F.col("change_type")
    return views.changes(spark, folder).select(
        "event_id", labels.dashboard_type(kind).alias("dashboard_type"), labels.dashboard_severity(kind).alias("severity")
    )


@query(
    "c36_schedule",
    cte("v_source", "v_run_header", last="select source_id, max(started_at) as last_start from v_run_header group by 1")
    + """select source_id, strftime(last_start + to_minutes(cast(cadence as int)), '%Y-%m-%d %H:%M:%S') as next_expected,
  case when not is_active then 'disabled' when last_start is null then 'never_run'
    when timestamp '2001-06-01' >= last_start + to_minutes(cast(cadence as int)) then 'cadence_elapsed' else 'not_due' end as reason
from (select s.source_id, is_active, last_start, case when kind = 'pricing' then 360 else 720 end as cadence
  from v_source s left join last using (source_id))""",
)
def c36_schedule(spark, folder):
    runs = views.run_headers(spark, folder).groupBy("source_id").agg(F.max("started_at").alias("last_start"))
    rows = views.sources(spark, folder).join(runs, "source_id", "left")
    cadence = F.when(F.col("kind") == "pricing", values.CADENCE_MINUTES["pricing"]).otherwise(values.CADENCE_MINUTES["models"])
    last = F.col("last_start")
    return rows.select(
        "source_id",
        stamp(values.next_run(last, cadence), "next_expected"),
        values.due_reason(F.col("is_active"), last, cadence, lit_ts("2001-06-01")).alias("reason"),
    )
