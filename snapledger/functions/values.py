"""Numbers, dates, hashes and three-state flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.functions.text import strip_non_textual

# Magnitude suffixes, and the largest integer a double holds exactly.
MAGNITUDES = {"k": 1_000, "m": 1_000_000, "b": 1_000_000_000}
MAX_SAFE_INTEGER = 9007199254740991

# Month names as sources write them, and the two phrases of a retirement notice.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
FULL_DATE = rf"^({MONTHS}) ([1-9]|[12]\d|3[01]), (\d{{4}})$"
MONTH_ONLY = rf"^({MONTHS}) (\d{{4}})$"
NOT_BEFORE = "Not sooner than "
UNANNOUNCED = "No shutdown date announced"


def _magnitude(unit: Column, names: Sequence[str]) -> Column:
    result = None
    for name in names:
        test = F.lower(unit) == name
        result = F.when(test, MAGNITUDES[name]) if result is None else result.when(test, MAGNITUDES[name])
    return result.otherwise(1)


def _positive_integer(value: Column) -> Column:
    whole = (value == F.floor(value)) & (value > 0) & (value <= MAX_SAFE_INTEGER)
    return F.when(whole, value.cast("bigint"))


def token_count(text: Column) -> Column:
    """A definite published token count: ``128,000``, ``128k tokens``, ``1.5M``; anything vaguer is NULL."""
    clean = F.regexp_replace(strip_non_textual(text), ",", "")
    digits = F.regexp_extract(clean, r"(?i)^(\d+)\s*(?:tokens?)?$", 1)
    short = r"(?i)^(\d+(?:\.\d+)?)\s*([km])\s*(?:tokens?)?$"
    amount, unit = F.regexp_extract(clean, short, 1), F.regexp_extract(clean, short, 2)
    plain = F.nullif(digits, F.lit("")).try_cast("double")
    scaled = F.nullif(amount, F.lit("")).try_cast("double") * _magnitude(unit, ("k", "m"))
    return _positive_integer(F.coalesce(plain, scaled))


def quantity(digits: Column, unit: Column) -> Column:
    """A quantity split into digits and an optional k/m/b suffix, rounded to a whole number."""
    base = F.regexp_replace(digits, r"[,_\s]", "").try_cast("double")
    return F.floor(base * F.when(unit.isNull() | (unit == ""), 1).otherwise(_magnitude(unit, ("k", "m", "b"))) + 0.5)


def english_date(text: Column) -> Column:
    """``August 5, 2025`` as a date; NULL unless complete and a real calendar day."""
    return F.when(text.rlike(FULL_DATE), F.try_to_date(text, "MMMM d, yyyy"))


def is_month_only(text: Column) -> Column:
    return F.coalesce(text.rlike(MONTH_ONLY), F.lit(False))


def retirement_dates(text: Column) -> tuple[Column, Column]:
    """(exact date, lower bound) of a retirement notice; at most one is set."""
    bounded = F.coalesce(text.startswith(NOT_BEFORE), F.lit(False))
    lower = english_date(F.substr(text, F.lit(len(NOT_BEFORE) + 1)))
    return F.when(~bounded, english_date(text)), F.when(bounded, lower)


def shutdown_state(is_shutdown: Column, shutdown_text: Column) -> Column:
    """Lifecycle state a shutdown table implies; NULL where it implies none."""
    announced = english_date(shutdown_text).isNotNull() | is_month_only(shutdown_text)
    return F.when(is_shutdown, "retired").when(announced, "deprecated")


def shutdown_observation(shutdown_text: Column) -> Column:
    """What kind of statement about the shutdown date was observed."""
    return (
        F.when(english_date(shutdown_text).isNotNull(), "date")
        .when(is_month_only(shutdown_text), "imprecise_date")
        .when(shutdown_text == UNANNOUNCED, "explicitly_unannounced")
        .otherwise("unobserved")
    )


def observed_flag(explicit: Column, evidence: Column) -> Column:
    """Explicit flag if published, true on positive evidence, otherwise unknown. Never false by absence."""
    return F.coalesce(explicit, F.when(evidence, True))


def exhaustive_flag(published: Column, wanted: str) -> Column:
    """For a source whose published list is complete: in the list or not; unknown if it published none."""
    return F.when(F.size(published) > 0, F.array_contains(published, wanted))


def any_matches(values: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(values, lambda v: v.rlike(pattern)), F.lit(False))


# Fixed values: (provider, test, text, family), first match wins within a provider.
FAMILY_RULES = (
    ("openai", "prefix", "gpt-5", "GPT-5"),
    ("openai", "prefix", "gpt-4", "GPT-4"),
    ("openai", "prefix", "o1", "o-series"),
    ("openai", "prefix", "o3", "o-series"),
    ("openai", "prefix", "o4", "o-series"),
    ("openai", "prefix", "dall-e", "Image"),
    ("openai", "prefix", "gpt-image", "Image"),
    ("openai", "prefix", "whisper", "Audio"),
    ("openai", "prefix", "tts", "Audio"),
    ("anthropic", "contains", "opus", "Claude Opus"),
    ("anthropic", "contains", "sonnet", "Claude Sonnet"),
    ("anthropic", "contains", "haiku", "Claude Haiku"),
    ("anthropic", "contains", "fable", "Claude Fable"),
    ("anthropic", "contains", "mythos", "Claude Mythos"),
    ("xai", "prefix", "grok-build", "Grok Build"),
    ("xai", "prefix", "grok-imagine", "Grok Imagine"),
)
# Family of a provider when no rule matches; NULL if not listed.
DEFAULT_FAMILY = {"gemini": "Gemini", "xai": "Grok"}
# Fixed values: (provider, pattern of a preview id, stage otherwise).
STAGE_RULES = (
    ("openai", "(?i)preview", "ga"),
    ("anthropic", None, "ga"),
    ("gemini", "(?i)preview|exp|experimental", "stable"),
    ("xai", "(?i)preview|beta|exp|experimental", "ga"),
)


def family_of(provider: Column, api_id: Column, published: Column, rules=FAMILY_RULES, defaults=None) -> Column:
    """Published family if any, else derived from the id by the provider's rules."""
    lowered, derived = F.lower(api_id), None
    for name, test, text, family in rules:
        hit = (provider == name) & (lowered.startswith(text) if test == "prefix" else lowered.contains(text))
        derived = F.when(hit, family) if derived is None else derived.when(hit, family)
    for name, family in (DEFAULT_FAMILY if defaults is None else defaults).items():
        derived = derived.when(provider == name, family)
    return F.coalesce(F.nullif(published, F.lit("")), derived)


def stage_of(provider: Column, api_id: Column, rules=STAGE_RULES) -> Column:
    stage = None
    for name, pattern, otherwise in rules:
        value = F.lit(otherwise) if pattern is None else F.when(api_id.rlike(pattern), "preview").otherwise(otherwise)
        stage = F.when(provider == name, value) if stage is None else stage.when(provider == name, value)
    return stage


def age_minutes(at: Column, now: Column) -> Column:
    """Whole minutes since ``at``, never negative; NULL if never observed."""
    elapsed = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.when(at.isNotNull(), F.greatest(F.floor(elapsed / 60_000_000), F.lit(0)))


def next_run(last_start: Column, cadence_minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", cadence_minutes.cast("int"), last_start)


def due_reason(enabled: Column, last_start: Column, cadence_minutes: Column, now: Column, forced: bool = False) -> Column:
    """Why a source is or is not due. Attempts pace it, not successes."""
    if forced:
        return F.when(~enabled, "disabled").otherwise("forced")
    elapsed = now.cast("timestamp") >= next_run(last_start, cadence_minutes)
    return (
        F.when(~enabled, "disabled").when(last_start.isNull(), "never_run")
        .when(elapsed, "cadence_elapsed").otherwise("not_due")
    )


# Minutes between collections by source category.
CADENCE_MINUTES = {"pricing": 360, "lifecycle": 720, "models": 720}

EPSILON = 2.220446049250313e-16


def round_cost(value: Column) -> Column:
    """Six decimals, half up on the binary double."""
    return F.floor((value + F.lit(EPSILON)) * 1_000_000 + 0.5) / 1_000_000


def to_fixed(value: Column, digits: int) -> Column:
    """``value`` rounded half up on its exact binary value.

    ``round`` works on the shortest decimal text, so 1.65 would become 1.7 although the double is below
    1.65. The scaled product is split into its rounded value and its rounding error; the error decides an
    apparent tie. The steps run over one-element arrays, so that each operand is evaluated once instead of
    being repeated in the expression tree.
    """
    scale = float(10 ** digits)

    def parts(size: Column) -> Column:
        split = size * 134217729.0
        return F.struct(size.alias("size"), (split - (split - size)).alias("high"), (size * scale).alias("product"))

    def rounded(p: Column) -> Column:
        error = (p["high"] * scale - p["product"]) + (p["size"] - p["high"]) * scale
        whole = F.floor(p["product"])
        rest = p["product"] - whole
        up = (rest > 0.5) | ((rest == 0.5) & (error >= 0))
        return (whole + F.when(up, 1).otherwise(0)) / scale

    size = F.get(F.transform(F.transform(F.array(F.abs(value)), parts), rounded), F.lit(0))
    return F.signum(value) * size


def price_delta(old: Column, new: Column) -> tuple[Column, Column]:
    """(absolute change, percent change); percent is NULL when the old price is zero."""
    return to_fixed(new - old, 6), to_fixed((new - old) / F.nullif(old, F.lit(0.0)) * 100, 2)


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", to_fixed(value, 2)))


def price_text(value: Column) -> Column:
    """Display price: two decimals, or up to four below one dollar."""
    small = F.call_function("format_number", F.round(value, 4), F.lit("#,##0.00##"))
    return F.concat(F.lit("$"), F.when(value < 1, small).otherwise(F.format_number(value, 2)))


def count_text(value: Column) -> Column:
    return F.format_number(value, 0)


def _joined_hash(parts: Sequence[Column]) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def price_hash(prices: Sequence[Column], currency: Column, unit: Column) -> Column:
    """Fingerprint of the priced values; equal hashes mean the price did not move."""
    return _joined_hash([*[p.cast("decimal(20,8)") for p in prices], currency, unit])


def lifecycle_hash(state, deprecated_on, retirement, not_before, observation, replacement_observed, replacement) -> Column:
    days = [F.unix_date(d) for d in (deprecated_on, retirement, not_before)]
    observed = F.when(replacement_observed, "observed").otherwise("unobserved")
    return _joined_hash([state, *days, observation, observed, replacement])


def capability_hash(texts: Sequence[Column], counts: Sequence[Column], flags: Sequence[Column], lists: Sequence[Column]) -> Column:
    """Flags hash as text with ``unknown`` for NULL; list elements are sorted."""
    shown = [F.coalesce(f.cast("string"), F.lit("unknown")) for f in flags]
    joined = [F.array_join(F.array_sort(values), ",") for values in lists]
    return _joined_hash([*texts, *counts, *shown, *joined])
