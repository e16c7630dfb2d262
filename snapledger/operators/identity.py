"""Which canonical entity a published identifier means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions import text
from snapledger.session import ensure_checkpoint_dir


def _fixed(rows: DataFrame) -> DataFrame:
    """Rows several later steps read, computed once and kept on shared storage."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    exact = text.identity_key(F.col(name))
    keyed = rows.withColumn("exact_key", exact)
    return keyed.withColumn("family_key", text.family_key(F.col("exact_key"), F.col("provider")))


def resolve_identities(incoming: DataFrame, entities: DataFrame, aliases: DataFrame, on_ambiguity: str = "flag") -> DataFrame:
    """Plan for every incoming (provider, api_id): alias, exact, unique_family, new or ambiguous.

    Alias and exact matches are settled for the whole batch first and use up their entities; a family
    match counts only if exactly one unused entity and one unsettled id share the family. Uniqueness is a
    count per key, so every step is an aggregate and an equi-join. ``on_ambiguity``: ``flag`` keeps the
    verdict, ``create`` turns it into new, ``fail`` fails the job.
    """
    ids = _keyed(incoming.select("provider", "api_id").distinct(), "api_id")
    known = _fixed(_keyed(entities.select("provider", "entity_id", "name"), "name"))
    alias_keys = (
        _keyed(aliases.select("provider", "alias", "entity_id", "last_seen_at"), "alias")
        .join(known.select("provider", "entity_id"), ["provider", "entity_id"], "left_semi")
        .groupBy("provider", "exact_key")
        .agg(F.max_by("entity_id", F.struct("last_seen_at", "entity_id")).alias("alias_entity"))
    )
    by_exact = known.groupBy("provider", "exact_key").agg(
        F.count(F.lit(1)).alias("exact_n"), F.min("entity_id").alias("exact_entity"))
    staged = ids.join(alias_keys, ["provider", "exact_key"], "left").join(by_exact, ["provider", "exact_key"], "left")
    settled_entity = F.coalesce("alias_entity", F.when(F.col("exact_n") == 1, F.col("exact_entity")))
    staged = staged.withColumn("settled", settled_entity).withColumn(
        "how", F.when(F.col("alias_entity").isNotNull(), "alias").when(F.col("settled").isNotNull(), "exact"))
    staged = _fixed(staged.select("provider", "api_id", "exact_key", "family_key", "settled", "how"))

    used = staged.filter(F.col("settled").isNotNull()).select("provider", F.col("settled").alias("entity_id")).distinct()
    free = known.join(used, ["provider", "entity_id"], "left_anti")
    families = free.groupBy("provider", "family_key").agg(
        F.count(F.lit(1)).alias("family_n"), F.min("entity_id").alias("family_entity"))
    free_exact = free.groupBy("provider", "exact_key").agg(F.count(F.lit(1)).alias("free_exact_n"))

    open_ids = staged.filter(F.col("settled").isNull()).select("provider", "api_id", "exact_key", "family_key")
    claims = open_ids.groupBy("provider", "family_key").agg(F.count(F.lit(1)).alias("claim_n"))
    judged = (
        open_ids.join(claims, ["provider", "family_key"])
        .join(families, ["provider", "family_key"], "left")
        .join(free_exact, ["provider", "exact_key"], "left")
    )
    unique = (F.col("family_n") == 1) & (F.col("claim_n") == 1)
    contested = F.coalesce(F.col("family_n") > 0, F.lit(False)) | F.coalesce(F.col("free_exact_n") > 0, F.lit(False))
    verdict = F.when(unique, "unique_family").when(contested, "ambiguous").otherwise("new")
    if on_ambiguity == "create":
        verdict = F.when(unique, "unique_family").otherwise("new")
    elif on_ambiguity == "fail":
        stop = F.raise_error(F.concat(F.lit("ambiguous identity: "), F.col("api_id"))).cast("string")
        verdict = F.when(unique, "unique_family").when(contested, stop).otherwise("new")
    late = judged.select("provider", "api_id", F.when(unique, F.col("family_entity")).alias("entity_id"), verdict.alias("reason"))
    early = staged.filter(F.col("settled").isNotNull()).select(
        "provider", "api_id", F.col("settled").alias("entity_id"), F.col("how").alias("reason"))
    return early.unionByName(late)


def expand_enumerated(records: DataFrame, column: str = "api_id") -> DataFrame:
    """One row per id where a page lists several ids in one field; other rows unchanged."""
    ids = F.coalesce(text.enumerated_ids(F.col(column)), F.array(F.col(column)))
    return records.withColumn(column, F.explode(ids))


def resolve_duplicates(records: DataFrame, fingerprint: Column, slug: Column, key: str = "api_id", position: str = "position") -> DataFrame:
    """At most one record per id. Adds ``outcome``: accepted, repeated or conflict.

    Identical evidence keeps the last record. Otherwise the one record whose page is named after the id
    wins; if there is no such single page, all of them are conflicts.
    """
    marked = records.withColumns({"_fp": fingerprint, "_own": F.coalesce(slug == F.col(key), F.lit(False))})
    groups = marked.groupBy(key).agg(
        (F.min("_fp") == F.max("_fp")).alias("_same"),
        F.max(position).alias("_last"),
        F.count_if("_own").alias("_owners"),
    )
    joined = marked.join(groups, key)
    keep = F.when(F.col("_same"), F.col(position) == F.col("_last")).otherwise((F.col("_owners") == 1) & F.col("_own"))
    outcome = F.when(keep, "accepted").when(F.col("_same"), "repeated").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("_fp", "_own", "_same", "_last", "_owners")


def resolve_names(questions: DataFrame, entities: DataFrame, names: Sequence[str]) -> DataFrame:
    """Entity each asked name means: an exact key, else keys that continue it after a ``-``.

    Each key is stored with every prefix that ends before a ``-``, so the prefix tier is an equi-join too.
    Per key only the smallest and largest entity are kept: equal means one entity, different means the
    name is ambiguous, and no list of matches is ever built.
    """
    keys = entities.select(
        "entity_id", F.explode(F.array_distinct(F.array_compact(F.array(*[text.key_from_ascii(F.col(n)) for n in names])))).alias("key"))
    parts = F.split("key", "-")
    lengths = F.sequence(F.lit(1), F.size(parts) - 1)
    prefixes = F.when(F.size(parts) > 1, F.transform(lengths, lambda n: F.array_join(F.slice(parts, 1, n), "-")))

    def spanned(rows: DataFrame, label: str) -> DataFrame:
        return rows.groupBy("key").agg(F.min("entity_id").alias(f"{label}_low"), F.max("entity_id").alias(f"{label}_high"))

    exact = spanned(keys, "exact")
    prefix = spanned(keys.select("entity_id", F.explode(prefixes).alias("key")), "prefix")
    asked = questions.withColumn("key", text.key_from_ascii(F.col("name")))
    joined = asked.join(exact, "key", "left").join(prefix, "key", "left")
    tier = F.when(F.col("exact_low").isNotNull(), "exact").when(F.col("prefix_low").isNotNull(), "prefix")
    low = F.when(tier == "exact", F.col("exact_low")).otherwise(F.col("prefix_low"))
    high = F.when(tier == "exact", F.col("exact_high")).otherwise(F.col("prefix_high"))
    blank = F.col("key") == ""
    status = (
        F.when(tier.isNull() | blank, "unresolved").when(low == high, "resolved").otherwise("ambiguous")
    )
    return joined.withColumns({
        "status": status, "matched": F.when(~blank, tier), "entity_id": F.when((low == high) & ~blank, low),
    }).drop("key", "exact_low", "exact_high", "prefix_low", "prefix_high")
