"""Text and URL functions. All are built-in expressions except the folding of non-ASCII names."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code points that carry no readable text (zero-width and bidi marks, private use areas).
NON_TEXTUAL = (
    r"[\x{200B}-\x{200F}\x{2028}\x{2029}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}"
    r"\x{E000}-\x{F8FF}\x{FEFF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
)
HTTP_URL = r"(?i)^https?://([^\s/?#@]*@)?[^\s/?#@:]+(:\d*)?([/?#][\s\S]*)?\z"
_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"

REDACTED = "[redacted]"
# Shapes of credentials, applied in this order.
SECRETS = (
    r"(?i)\b(api[_-]?key|apikey|secret|token|password|passwd|authorization|auth|bearer|access[_-]?key"
    r"|service[_-]?role|anon[_-]?key)\b\s*[:=]\s*\S+",
    r"(?i)\bBearer\s+[A-Za-z0-9._\-]{8,}",
    r"\beyJ[A-Za-z0-9._-]{10,}",
    r"\b[A-Fa-f0-9]{32,}\b",
    r"\bsk-[A-Za-z0-9_-]{8,}\b",
)

# Accepted modality spellings.
MODALITIES = {
    "text": "text", "image": "image", "vision": "image", "audio": "audio", "voice": "audio",
    "speech": "audio", "video": "video",
}

# Provider spellings folded to one slug.
PROVIDER_ALIASES = {
    "claude": "anthropic", "anthropic": "anthropic", "gemini": "google", "google": "google",
    "openai": "openai", "gpt": "openai", "chatgpt": "openai", "xai": "xai", "grok": "xai",
}


def _mapped(column: Column, mapping: dict[str, str]) -> Column:
    result = None
    for key, value in mapping.items():
        test = column == key
        result = F.when(test, value) if result is None else result.when(test, value)
    return result


def trim_text(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def trim_to_null(text: Column) -> Column:
    return F.nullif(trim_text(text), F.lit(""))


def strip_non_textual(text: Column) -> Column:
    """Text without invisible characters, trimmed."""
    return trim_text(F.regexp_replace(text, NON_TEXTUAL, ""))


def drop_trailing_parenthetical(name: Column) -> Column:
    return trim_text(F.regexp_replace(name, r"\s+\([^)]*\)\s*$", ""))


def modality_list(values: Column) -> Column:
    """Known modalities of an array, first-seen order, aliases folded, unknown dropped."""
    known = F.transform(values, lambda v: _mapped(F.lower(strip_non_textual(v)), MODALITIES))
    return F.coalesce(F.array_distinct(F.filter(known, lambda v: v.isNotNull())), F.array().cast("array<string>"))


def modalities_from_text(text: Column) -> Column:
    return modality_list(F.split(text, r"[,;\s]+"))


def provider_slug(provider: Column) -> Column:
    clean = F.lower(trim_text(provider))
    return F.coalesce(_mapped(clean, PROVIDER_ALIASES), clean)


def key_from_ascii(name: Column) -> Column:
    """Comparison key of a published name: lower case, ``models/`` dropped, runs of other characters to ``-``."""
    lowered = F.regexp_replace(F.lower(trim_text(name)), "^models/", "")
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.arrow_udf(StringType())
def _compatibility_form(values: pa.Array) -> pa.Array:
    # Not pyarrow.compute.utf8_normalize: its NFKC leaves accents decomposed.
    folded = [None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()]
    return pa.array(folded, pa.string())


def identity_key(name: Column) -> Column:
    """:func:`key_from_ascii` after Unicode compatibility folding.

    Spark has no such function, so names with a non-ASCII character take a vectorised Python step. Plain
    names travel past it as NULL and keep the JVM value.
    """
    foreign = name.rlike(r"[^\x00-\x7F]")
    return key_from_ascii(F.coalesce(_compatibility_form(F.when(foreign, name)), name))


def family_key(key: Column, provider: Column) -> Column:
    """Identity key without its date or revision suffix, by the provider's own naming."""
    named_variant = key.rlike("(^|-)(preview|exp|experimental)(-|$)")
    dated = F.regexp_replace(key, r"-\d{8}$", "")
    return (
        F.when(provider == "anthropic", dated)
        .when(provider == "gemini", F.when(named_variant, key).otherwise(F.regexp_replace(key, r"-\d{3}$", "")))
        .when(provider == "openai", F.regexp_replace(F.regexp_replace(key, r"-\d{4}-\d{2}-\d{2}$", ""), r"-\d{8}$", ""))
        .when(provider == "xai", F.regexp_replace(F.regexp_replace(key, r"-\d{4}$", ""), r"-\d{8}$", ""))
        .otherwise(key)
    )


def canonical_key(provider: Column, api_id: Column, entity_id: Column) -> Column:
    """``provider:api_id`` in lower case, or ``id:<entity>`` when no API id is published."""
    published = trim_to_null(api_id).isNotNull()
    return F.when(
        published, F.concat_ws(":", F.lower(trim_text(provider)), F.lower(trim_text(api_id)))
    ).otherwise(F.concat(F.lit("id:"), F.lower(trim_text(entity_id.cast("string")))))


def is_http_url(url: Column) -> Column:
    """True only for an http or https URL with a host."""
    return F.coalesce(url.rlike(HTTP_URL), F.lit(False))


def last_path_segment(url: Column) -> Column:
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def query_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def safe_url(url: Column) -> Column:
    """http(s) URL without credentials, query and fragment; anything else is NULL."""
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    protocol = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    bare = F.when(protocol == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    return F.when(is_http_url(url), F.concat(protocol, F.lit("://"), bare, path))


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, REDACTED.replace("[", r"\[").replace("]", r"\]"))
    return text


def clean_text(text: Column, limit: int = 240) -> Column:
    """Publishable text: secrets and markup out, whitespace collapsed, at most ``limit`` characters."""
    plain = F.regexp_replace(redact(text), "<[^>]*>", " ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(plain, 1, limit - 1)), F.lit("…"))
    return F.when(plain == "", None).when(F.char_length(plain) <= limit, plain).otherwise(cut)


def enumerated_ids(value: Column) -> Column:
    """The ids a text enumerates, or NULL unless it is two or more distinct, id-shaped tokens."""
    tokens = F.filter(F.split(F.trim(value), r"[\s,]+"), lambda t: t != "")
    shaped = F.forall(tokens, lambda t: t.rlike(r"^[a-z0-9]+([.\-_][a-z0-9]+)+$"))
    distinct = F.size(F.array_distinct(tokens)) == F.size(tokens)
    return F.when((F.size(tokens) >= 2) & shaped & distinct, tokens)


def capability_statement(raw: Column) -> Column:
    """The sentence with which a source enumerates what it supports, if its raw record carries one."""
    return trim_to_null(F.get_json_object(raw, "$.capability_statement"))


def with_source_defaults(df: DataFrame, default_url: str, default_unit: str = "USD per 1M tokens",
                         unit_aliases: Sequence[str] = ("per_1m_tokens",)) -> DataFrame:
    """Raw price records with the collector's source URL and unit filled in and unit spellings repaired."""
    unit = F.coalesce("pricing_unit", F.lit(default_unit))
    repaired = F.when(unit.isin(list(unit_aliases)), default_unit).otherwise(unit)
    return df.withColumns({"source_url": F.coalesce("source_url", F.lit(default_url)), "pricing_unit": repaired})
