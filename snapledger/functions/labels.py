"""Classification, scores, labels and sentences of change events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.functions.values import price_text, to_fixed

# Fixed values: (stored type, field spellings or None, published type, category), first match wins.
CLASSES = (
    ("price_increased", None, "price_increased", "pricing"),
    ("price_decreased", None, "price_decreased", "pricing"),
    ("model_added", None, "model_added", "catalog"),
    ("model_removed", None, "model_removed", "catalog"),
    ("lifecycle_changed", ("deprecatedDate", "deprecated_on"), "deprecation_scheduled", "deprecations"),
    ("lifecycle_changed", ("retirementDate", "retirement_date"), "retirement_scheduled", "retirements"),
    ("lifecycle_changed", ("retirementNotBeforeDate", "retirement_not_before_date"),
     "retirement_not_before_scheduled", "retirements"),
    ("lifecycle_changed", ("recommendedReplacement", "recommended_replacement"),
     "replacement_recommended", "replacements"),
    ("lifecycle_changed", None, "lifecycle_transition", "lifecycle"),
    ("capability_changed", None, "metadata_changed", "catalog"),
    ("metadata_changed", None, "metadata_changed", "metadata"),
)
CATEGORIES = ("pricing", "lifecycle", "catalog", "deprecations", "retirements", "replacements", "metadata")
FLAGSHIP_WORDS = ("sonnet", "opus", "gpt-4", "pro", "grok-2")
AUTHORITATIVE_CATEGORIES = ("catalog", "lifecycle", "deprecations", "retirements")

# Display text per category and type, and the tone of each type.
CATEGORY_LABELS = {
    "pricing": "Pricing", "lifecycle": "Lifecycle", "catalog": "Catalog", "deprecations": "Deprecation",
    "retirements": "Retirement", "replacements": "Replacement", "metadata": "Metadata",
}
TYPE_LABELS = {
    "price_increased": "Price increase", "price_decreased": "Price decrease", "model_added": "Model added",
    "model_removed": "Model removed", "lifecycle_transition": "Lifecycle transition",
    "deprecation_scheduled": "Deprecation scheduled", "retirement_scheduled": "Retirement scheduled",
    "retirement_not_before_scheduled": "Retirement window announced",
    "replacement_recommended": "Replacement recommended", "metadata_changed": "Metadata changed",
}
TONES = {
    "price_increased": "negative", "price_decreased": "positive", "model_added": "positive",
    "model_removed": "negative", "lifecycle_transition": "warning", "deprecation_scheduled": "warning",
    "retirement_scheduled": "negative", "retirement_not_before_scheduled": "warning",
    "replacement_recommended": "info", "metadata_changed": "neutral",
}
DOMAINS = {
    "price_increased": "pricing", "price_decreased": "pricing", "lifecycle_changed": "lifecycle",
    "capability_changed": "capability", "model_added": "other", "model_removed": "other",
    "metadata_changed": "other",
}
DASHBOARD_TYPES = {
    "model_added": "model_launch", "model_removed": "model_removal", "price_increased": "price_change",
    "price_decreased": "price_change", "lifecycle_changed": "deprecation",
    "capability_changed": "capability_change",
}
TRUST = {"authoritative": "official", "verified_scrape": "verified", "inferred": "inferred"}


def lookup(column: Column, table: dict[str, str], otherwise: Column | str | None = None) -> Column:
    result = None
    for key, value in table.items():
        result = F.when(column == key, value) if result is None else result.when(column == key, value)
    return result if otherwise is None else result.otherwise(otherwise)


def _class(raw_type: Column, field: Column, position: int, default: str) -> Column:
    result = None
    for rule in CLASSES:
        hit = raw_type == rule[0]
        if rule[1] is not None:
            hit = hit & F.coalesce(field.isin(*rule[1]), F.lit(False))
        result = F.when(hit, rule[position]) if result is None else result.when(hit, rule[position])
    return result.otherwise(default)


def published_type(raw_type: Column, field: Column) -> Column:
    return _class(raw_type, field, 2, "metadata_changed")


def category(raw_type: Column, field: Column) -> Column:
    return _class(raw_type, field, 3, "metadata")


def is_flagship(name: Column, words: Sequence[str] = FLAGSHIP_WORDS) -> Column:
    lowered = F.lower(name)
    hit = lowered.contains(words[0])
    for word in words[1:]:
        hit = hit | lowered.contains(word)
    return hit


# The scores below, by kind of event and size of a price move.
def significance(kind: Column, group: Column, percent: Column, name: Column) -> Column:
    """0 to 100: by type and flagship name, or by the size of a price move."""
    flagship, size = is_flagship(name), F.abs(percent)
    scheduled = kind.isin("retirement_scheduled", "retirement_not_before_scheduled")
    return (
        F.when(kind == "model_added", F.when(flagship, 95).otherwise(85))
        .when(kind == "lifecycle_transition", 90)
        .when(scheduled, F.when(flagship, 88).otherwise(80))
        .when(kind == "deprecation_scheduled", F.when(flagship, 85).otherwise(75))
        .when(kind == "replacement_recommended", 82)
        .when(size >= 50, 92).when(size >= 20, 82).when(size >= 10, 70).when(size.isNotNull(), 55)
        .when(group == "pricing", 65)
        .when(kind == "model_removed", 75)
        .otherwise(50)
    )


def plain_number(value: Column) -> Column:
    """A number without trailing zeros, with all decimals a stored price can have."""
    text = F.call_function("format_number", value, F.lit("0.########"))
    return F.when(value.isNotNull(), text)


# The wording of the sentences below.
def sentence(kind, name, provider_name, field, old_text, new_text, old_num, new_num, percent) -> Column:
    """One sentence restating an event from its own values."""
    size = plain_number(F.abs(percent))
    old_value = F.coalesce(plain_number(old_num), old_text, F.lit("null"))
    new_value = F.coalesce(plain_number(new_num), new_text, F.lit("null"))

    def moved(verb: str, noun: str) -> Column:
        part = F.when(percent.isNotNull(), F.concat(F.lit(" ("), size, F.lit(f"% {noun})"))).otherwise("")
        return F.concat(name, F.lit(" "), field, F.lit(f" {verb} from $"), plain_number(old_num), F.lit(" to $"),
                        plain_number(new_num), F.lit(" / 1M tokens"), part, F.lit("."))

    priced = old_num.isNotNull() & new_num.isNotNull()
    end = F.lit(".")
    return (
        F.when(kind == "model_added", F.concat(name, F.lit(" was added to "), provider_name, F.lit("'s catalog.")))
        .when(kind == "model_removed", F.concat(name, F.lit(" was removed from "), provider_name, F.lit("'s catalog.")))
        .when((kind == "price_decreased") & priced, moved("reduced", "reduction"))
        .when((kind == "price_increased") & priced, moved("increased", "increase"))
        .when(kind == "lifecycle_transition",
              F.concat(name, F.lit(" transitioned lifecycle state from "), old_value, F.lit(" to "), new_value, end))
        .when(kind == "deprecation_scheduled", F.concat(name, F.lit(" scheduled for deprecation effective "), new_value, end))
        .when(kind == "retirement_scheduled", F.concat(name, F.lit(" scheduled for retirement on "), new_value, end))
        .when(kind == "retirement_not_before_scheduled",
              F.concat(name, F.lit(" shutdown scheduled not sooner than "), new_value, end))
        .when(kind == "replacement_recommended",
              F.concat(name, F.lit(" recommended replacement designated as "), new_value, end))
        .when((kind == "metadata_changed") & field.isNotNull(),
              F.concat(name, F.lit(" "), field, F.lit(" updated from "), old_value, F.lit(" to "), new_value, end))
        .otherwise(F.concat(name, F.lit(" updated in "), provider_name, end))
    )


def impact_reason(kind, field, new_text, percent) -> Column:
    size = plain_number(F.abs(percent))
    moved = percent.isNotNull() & (percent != 0)
    return (
        F.when(kind == "model_added", "New model release introduced to provider catalog")
        .when((kind == "price_decreased") & moved, F.concat(F.lit("Major price reduction of "), size, F.lit("% on "), field))
        .when((kind == "price_increased") & moved,
              F.concat(F.lit("Price increase of "), plain_number(percent), F.lit("% on "), field))
        .when((kind == "lifecycle_transition") & (new_text == "retired"), "Model lifecycle officially shut down / retired")
        .when(kind.isin("retirement_scheduled", "retirement_not_before_scheduled"),
              F.concat(F.lit("Retirement date scheduled for "), new_text))
        .when(kind == "deprecation_scheduled", F.concat(F.lit("Deprecation announced with effective date "), new_text))
        .when(kind == "replacement_recommended", F.concat(F.lit("Migration path designated to "), new_text))
        .otherwise("Significant operational update observed")
    )


def tone(kind: Column) -> Column:
    return lookup(kind, TONES, "neutral")


def tier_of_score(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 40, "medium").otherwise("low")


def direction(kind: Column) -> Column:
    return F.when(kind == "price_increased", "increase").when(kind == "price_decreased", "decrease").otherwise("none")


def percent_label(percent: Column) -> Column:
    sign = F.when(percent > 0, "+").when(percent < 0, "−").otherwise("")
    return F.when(percent.isNotNull(), F.concat(sign, F.format_string("%.1f", to_fixed(F.abs(percent), 1)), F.lit("%")))


# State words shown with a capital letter.
STATE_WORDS = ("active", "legacy", "deprecated", "retired", "preview")


def value_text(text: Column, number: Column) -> Column:
    """One side of a before/after pair as display text."""
    trimmed = F.trim(text)
    shown = F.when(F.lower(trimmed).isin(*STATE_WORDS), F.concat(F.upper(F.substring(trimmed, 1, 1)), F.substr(trimmed, F.lit(2))))
    return F.coalesce(price_text(number), shown, F.nullif(trimmed, F.lit("")))


def three_state_label(flag: Column) -> Column:
    return F.when(flag, "Supported").when(~flag, "Not supported").otherwise("Unknown")


def authority(group: Column) -> Column:
    return F.when(group.isin(*AUTHORITATIVE_CATEGORIES), "authoritative").otherwise("verified_scrape")


def confidence(level: Column) -> Column:
    return F.when(level == "authoritative", 1.0).otherwise(0.95)


def trust(level: Column) -> Column:
    return lookup(level, TRUST, "unverified")


def dashboard_type(raw_type: Column) -> Column:
    return lookup(raw_type, DASHBOARD_TYPES, "schema_update")


def dashboard_severity(raw_type: Column) -> Column:
    return F.when(raw_type.isin("model_removed", "price_increased"), "warning").otherwise("info")


def evidence_domain(raw_type: Column) -> Column:
    return lookup(raw_type, DOMAINS, "other")
