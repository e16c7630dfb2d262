"""Contracts: what a source's records must look like, as column expressions.

A contract is data: record checks (a Column that is true when broken), batch invariants (an aggregate over
the valid records), the identity key and the batch limits. Users extend it with their own expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.functions import text, values

SCHEMA, ENUM, DUPLICATE = "SCHEMA_VALIDATION_FAILURE", "ILLEGAL_ENUM_VALUE", "DUPLICATE_IDENTIFIERS"
SEMANTIC, NULL_PRICES, TOKEN_LIMITS = (
    "SEMANTIC_INVARIANT_VIOLATION", "ALL_PRICES_NULL", "CAPABILITY_TOKEN_LIMITS_MISSING")

# Identifier shapes.
PROVIDER_SHAPE = r"^[\p{L}\p{N}][\p{L}\p{N} .&'()+_-]*\z"
NAME_SHAPE = r"^[\p{L}\p{N}][\p{L}\p{N} ._:/+-]*\z"
SLUG_SHAPE = r"^[a-z0-9][a-z0-9_-]*\z"
COLLECTOR_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9_-]*\z"
HYPHEN_ID_SHAPE = r"^claude-[a-z0-9]+(?:-[a-z0-9]+)*\z"
DOTTED_ID_SHAPE = r"^[a-z0-9]+(?:[.-][a-z0-9]+)*\z"
ANY_SHAPE = r"[\s\S]"
MARKUP = r"(?i)</?[a-z][\s\S]*>"
# Published lifecycle words.
STATE_NAMES = ("Active", "Legacy", "Deprecated", "Retired")


@dataclass(frozen=True)
class Check:
    message: str
    broken: Column
    code: str = SCHEMA


@dataclass(frozen=True)
class Invariant:
    """``broken`` gets a function that limits a condition to valid records and returns an aggregate."""

    code: str
    message: str
    inputs: Sequence[str]
    broken: Callable[[Callable[[Column], Column]], Column]


@dataclass(frozen=True)
class Limits:
    min_viable: int = 1
    min_expected: int = 1
    max_drop: float = 0.35
    max_spike: float = 3.0
    quarantine_ratio: float = 0.1
    max_staleness_minutes: int = 1440


@dataclass(frozen=True)
class Contract:
    name: str
    key: Sequence[str]
    checks: Sequence[Check]
    invariants: Sequence[Invariant] = ()
    limits: Limits = field(default_factory=Limits)
    authoritative: bool = False
    # Shorter conditions that together say the same as all checks, for deciding without explaining.
    quick: Sequence[Column] = ()


def _any(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def missing(*columns: str) -> Check:
    return Check(f"missing {'/'.join(columns)}", _any(F.col(c).isNull() for c in columns))


def bad_shape(column: str, shape: str, limit: int, code: str = SCHEMA) -> Check:
    """Length first, which is counted without a pattern; a shape that any text has is not matched at all."""
    value = F.col(column)
    fits = F.char_length(value).between(1, limit)
    return Check(f"invalid {column}", _true(~(fits if shape == ANY_SHAPE else fits & value.rlike("^" + shape.removeprefix("^")))), code)


def not_trimmed(column: str) -> Check:
    # Only the ends are looked at: what trimming takes away begins with the first character or ends with one of the last two, as the
    # pattern also matches before a final line end that is no space itself.
    ends = F.concat(F.substring(column, 1, 1), F.substring(column, -2, 2))
    return Check(f"untrimmed {column}", _true(ends != text.trim_text(ends)))


def bad_url(column: str) -> Check:
    return Check(f"{column} is not http(s)", F.col(column).isNotNull() & ~text.is_http_url(F.col(column)))


def bad_price(column: str) -> Check:
    value = F.col(column)
    broken = F.isnan(value) | (value < 0) | (value == float("inf"))
    return Check(f"invalid {column}", _true(broken))


def any_bad_price(columns: Sequence[str]) -> Column:
    """The price checks of several columns at once: NaN sorts above infinity, and NULLs are skipped."""
    prices = [F.col(c) for c in columns]
    return _true((F.least(*prices) < 0) | (F.greatest(*prices) >= float("inf")))


def no_price(columns: Sequence[str]) -> Check:
    return Check("no price", F.coalesce(*[F.col(c) for c in columns]).isNull())


def not_in(column: str, allowed: Sequence[str]) -> Check:
    return Check(f"illegal {column}", _true(~F.col(column).isin(list(allowed))), ENUM)


def unknown_keys(raw: str, allowed: Sequence[str]) -> Check:
    keys = F.json_object_keys(F.col(raw))
    return Check("unknown key", _true(F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) > 0))


def bad_english_date(column: str, also: Sequence[Callable[[Column], Column]] = ()) -> Check:
    value = F.col(column)
    accepted = values.english_date(value).isNotNull()
    for alternative in also:
        accepted = accepted | alternative(value)
    return Check(f"invalid {column}", value.isNotNull() & ~_true(accepted))


def localized_page(column: str, parameter: str = "hl") -> Check:
    return Check("localized rendering", text.query_parameter(F.col(column), parameter).isNotNull())


def differs(column: str, expected: str) -> Check:
    return Check(f"unexpected {column}", ~F.col(column).eqNullSafe(F.lit(expected)))


def bad_text(column: str, shortest: int, longest: int) -> Check:
    size = F.char_length(text.trim_text(F.col(column)))
    return Check(f"unusable {column}", _true(~size.between(shortest, longest) | F.col(column).rlike(MARKUP)))


def not_positive(column: str) -> Check:
    return Check(f"{column} is not positive", _true(F.col(column) <= 0))


def lifecycle_contradictions() -> list[Check]:
    """Cross-field rules of a normalized lifecycle record."""
    both = F.col("retirement_date").isNotNull() & F.col("not_before_date").isNotNull()
    undated = (F.col("not_before_observation") == "date") & F.col("not_before_date").isNull()
    unseen = ~F.col("replacement_observed") & F.col("replacement").isNotNull()
    return [
        Check("exact and not-before date", both),
        Check("date observation without date", _true(undated)),
        Check("unobserved replacement with value", _true(unseen)),
    ]


PRICES = ("input_price", "cached_input_price", "cache_write_price", "output_price")


def price_contract(provider: str | None = None, limits: Limits | None = None) -> Contract:
    checks = [
        missing("provider", "model_name", "pricing_mode", "context_tier", "pricing_unit", "source_url"),
        bad_shape("provider", PROVIDER_SHAPE, 100),
        not_trimmed("provider"),
        bad_shape("model_name", NAME_SHAPE, 200),
        bad_shape("pricing_mode", SLUG_SHAPE, 50, ENUM),
        bad_shape("context_tier", SLUG_SHAPE, 50, ENUM),
        bad_shape("pricing_unit", ANY_SHAPE, 100),
        bad_url("source_url"),
        no_price(PRICES),
    ]
    if provider is not None:
        checks.append(differs("provider", provider))
    quick = [*[c.broken for c in checks], any_bad_price(PRICES)]
    checks += [bad_price(c) for c in PRICES]
    none_priced = F.coalesce(*[F.col(c) for c in PRICES]).isNull()
    any_negative = F.least(*[F.coalesce(F.col(c), F.lit(0.0)) for c in PRICES]) < 0
    return Contract(
        "price", ("provider", "model_name", "pricing_mode", "context_tier"), checks,
        (
            Invariant(NULL_PRICES, "all prices null", PRICES, lambda valid: F.bool_and(valid(none_priced))),
            Invariant(SEMANTIC, "negative price", PRICES, lambda valid: F.bool_or(valid(any_negative))),
        ),
        limits or Limits(1, 2, 0.4, 3.0, 0.15), quick=tuple(quick),
    )


def deprecation_contract() -> Contract:
    """Deprecation table with a published state per API name."""
    return Contract(
        "deprecation", ("api_model_name",),
        [
            missing("product_page_url", "api_model_name", "current_state"),
            bad_url("product_page_url"),
            bad_shape("api_model_name", NAME_SHAPE, 200),
            bad_shape("api_model_name", HYPHEN_ID_SHAPE, 200),
            not_in("current_state", STATE_NAMES),
            bad_english_date("deprecated_date"),
            bad_english_date("tentative_retirement_date",
                             [lambda v: values.retirement_dates(v)[1].isNotNull()]),
        ],
        (Invariant(SEMANTIC, "no active record", ("current_state",),
                   lambda valid: ~F.bool_or(valid(F.col("current_state") == "Active"))),),
        Limits(2, 2, 0.35, 3.0, 0.0), True,
    )


def shutdown_contract() -> Contract:
    """Shutdown table with announced dates in words."""
    loose = [values.is_month_only]
    return Contract(
        "shutdown", ("model_id",),
        [
            missing("model_id", "model_group", "model_stage", "is_shutdown"),
            bad_shape("model_id", DOTTED_ID_SHAPE, 200),
            bad_text("model_group", 1, 200),
            not_in("model_stage", ("stable", "preview")),
            bad_english_date("release_date_raw", loose),
            bad_english_date("shutdown_not_before_date_raw", [*loose, lambda v: v == values.UNANNOUNCED]),
            bad_shape("recommended_replacement", DOTTED_ID_SHAPE, 200),
            bad_url("product_page_url"),
        ],
        (), Limits(2, 2, 0.35, 3.0, 0.0), True,
    )


def catalog_contract(key: str = "model_id", locale_parameter: str | None = None, needs_output_limit: bool = False,
                     needs_modalities: bool = False, allowed_keys: Sequence[str] | None = None, enumerated: bool = False) -> Contract:
    """Model catalog. A field every record of the page publishes must not vanish from a whole batch.

    ``enumerated``: the key may list several ids, to be expanded after the gate.
    """
    shape = bad_shape(key, NAME_SHAPE, 200)
    if enumerated:
        shape = replace(shape, broken=shape.broken & text.enumerated_ids(F.col(key)).isNull())
    checks = [
        missing(key), shape, bad_url("source_url"),
        bad_shape("display_name", ANY_SHAPE, 200), bad_shape("capability_statement", ANY_SHAPE, 1000),
    ]
    if locale_parameter:
        checks.append(localized_page("source_url", locale_parameter))
    if allowed_keys is not None:
        checks.append(unknown_keys("raw", allowed_keys))

    def vanished(code: str, column: str, parsed: Column) -> Invariant:
        return Invariant(code, f"no {column}", (column,), lambda valid: F.bool_and(valid(parsed)))

    invariants = []
    if needs_output_limit or needs_modalities:
        invariants.append(vanished(TOKEN_LIMITS, "context_window_raw",
                                   values.token_count(F.col("context_window_raw")).isNull()))
    if needs_output_limit:
        invariants.append(vanished(TOKEN_LIMITS, "max_output_tokens_raw",
                                   values.token_count(F.col("max_output_tokens_raw")).isNull()))
    if needs_modalities:
        invariants.append(vanished(SEMANTIC, "input_modalities", F.size(text.modality_list(F.col("input_modalities"))) <= 0))
    return Contract("catalog", (key,), checks, tuple(invariants), Limits(1, 1, 0.4, 3.0, 0.15), True)


def quote_contract() -> Contract:
    """Short quotations: readable length and no markup."""
    return Contract(
        "quote", ("quote_text",),
        [missing("quote_text", "author"), bad_text("quote_text", 12, 1000), bad_text("author", 3, 120)],
    )


# The registered contracts. category, domain, providers, authoritative, limits.
CONTRACT_ROWS = (
    ("pricing", "pricing", ("openai", "anthropic", "gemini", "xai"), False, Limits(1, 2, 0.4, 3.0, 0.15)),
    ("lifecycle", "lifecycle", ("anthropic", "gemini"), True, Limits(2, 2, 0.35, 3.0, 0.0)),
    ("models", "catalog", ("openai", "anthropic", "gemini", "xai"), True, Limits(1, 1, 0.4, 3.0, 0.15)),
)


def contract_table(spark: SparkSession) -> DataFrame:
    """``dim_contract``: one row per governed (category, provider). Ten rows, fixed."""
    rows = [
        (category, provider, domain, authoritative, x.min_viable, x.min_expected, x.max_drop, x.max_spike,
         x.quarantine_ratio, x.max_staleness_minutes)
        for category, domain, providers, authoritative, x in CONTRACT_ROWS
        for provider in providers
    ]
    return spark.createDataFrame(
        rows,
        "category string, provider string, authority_domain string, is_authoritative boolean, min_viable int,"
        " min_expected int, max_drop double, max_spike double, quarantine_ratio double, max_staleness_minutes int",
    )


def source_category(kind: Column, provider: Column, is_catalog: Column) -> Column:
    """What a source is an authority on. Lifecycle and catalog pages share a kind; the collector tells them apart."""
    return (
        F.when(kind == "pricing", "pricing")
        .when(kind == "models", F.when(_true(is_catalog), "models")
              .when(provider.isin("anthropic", "gemini"), "lifecycle").otherwise("models"))
        .otherwise("other")
    )


def attach_contract(sources: DataFrame) -> DataFrame:
    """Sources (with ``category``, ``provider``, ``is_catalog``) and the contract that governs them, if any."""
    table = contract_table(sources.sparkSession)
    governed = F.col("category").isin("pricing", "lifecycle") | _true(F.col("is_catalog"))
    keyed = sources.withColumn("_category", F.when(governed, F.col("category")))
    offered = table.withColumnRenamed("category", "_category")
    joined = keyed.join(offered, ["_category", "provider"], "left")
    return joined.drop("_category")


def issues(contract: Contract) -> Column:
    """Every broken check of a record as array of (code, message)."""
    found = [
        F.when(c.broken, F.struct(F.lit(c.code).alias("code"), F.lit(c.message).alias("message"))) for c in contract.checks
    ]
    return F.filter(F.array(*found), lambda i: i.isNotNull())


def issue_rows(records: DataFrame, contract: Contract, keys: Sequence[str]) -> DataFrame:
    """One row per (record, broken check), found in one pass over the records."""
    found = [F.when(c.broken, F.struct(F.lit(c.code).alias("code"), F.lit(c.message).alias("message"))) for c in contract.checks]
    rows = records.select(*keys, F.explode(F.array(*found)).alias("i")).filter(F.col("i").isNotNull())
    return rows.select(*keys, "i.code", "i.message")


def validate(records: DataFrame, contract: Contract) -> DataFrame:
    """Adds ``schema_ok``, ``enum_fault`` and the full list of ``issues``.

    The two flags are plain conditions that stop at the first broken check. The list costs more and is
    pruned from every plan that only asks for the flags.
    """
    flags = F.struct(
        (~_any(contract.quick or [c.broken for c in contract.checks])).alias("schema_ok"),
        _any(c.broken for c in contract.checks if c.code == ENUM).alias("enum_fault"),
    )
    # Generated, so that a filter on a flag reads it instead of repeating every check.
    return records.select("*", F.inline(F.array(flags))).withColumn("issues", issues(contract))


def first_valid(validated: DataFrame, contract: Contract, batch: str = "batch_id", position: str = "position") -> DataFrame:
    """The valid records: of several with one identity in a batch, the first by position."""
    keys = [batch, *contract.key]
    rest = [c for c in validated.columns if c not in (*keys, "schema_ok", "enum_fault", "issues")]
    return (
        validated.filter("schema_ok").groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), position).alias("_row")).select(*keys, "_row.*")
    )


def mark_duplicates(validated: DataFrame, contract: Contract, batch: str = "batch_id", position: str = "position") -> DataFrame:
    """Adds ``duplicate`` to valid records that repeat an identity, and ``accepted`` for the rest."""
    keys = [batch, *contract.key]
    firsts = validated.filter("schema_ok").groupBy(*keys).agg(F.min(position).alias("_first"))
    repeated = F.col("schema_ok") & (F.col(position) > F.col("_first"))
    return (
        validated.join(firsts, keys, "left")
        .withColumn("duplicate", _true(repeated))
        .withColumn("accepted", F.col("schema_ok") & ~F.col("duplicate"))
        .drop("_first")
    )
