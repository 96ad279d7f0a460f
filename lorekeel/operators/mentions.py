"""Mentions of entities in documents: joins, counts and audits over provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeel.functions.columns import budget_tokens, micros, nocase

KEY = ("entity_id", "document_id", "mention_text")


def dedup(provenance: DataFrame) -> DataFrame:
    """One row for each (entity, document, mention), the first detected; ties go to the smallest source, then snippet.

    Rows without entity are no evidence and are dropped.
    """
    rest = [c for c in ("detected_at", "source", "context_snippet", "run_id") if c in provenance.columns]
    first = F.min(F.struct(F.coalesce("detected_at", F.lit("9999-01-01").cast("timestamp")).alias("_t"), *rest)).alias("f")
    return provenance.where("entity_id is not null").groupBy(*KEY).agg(first).select(*KEY, *[F.col(f"f.{c}") for c in rest])


def save(new: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of a batch that the table does not hold yet, each key once."""
    return dedup(new).join(held.select(*KEY), list(KEY), "left_anti")


def with_entities(provenance: DataFrame, entities: DataFrame, document_id: str) -> DataFrame:
    """The mentions of one document with their entities, in order of detection."""
    e = entities.select("entity_id", "canonical_name", "entity_type")
    return provenance.where(F.col("document_id") == document_id).join(e, "entity_id").orderBy("detected_at", "prov_id")


def counts(entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """(entity_id, mentions) for all entities, zero included."""
    n = provenance.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    return entities.select("entity_id").join(n, "entity_id", "left").select("entity_id", F.coalesce("mentions", F.lit(0)).alias("mentions"))


def _pairs_of_document(provenance: DataFrame) -> DataFrame:
    return provenance.where("entity_id is not null and document_id is not null").select("document_id", "entity_id").distinct()


def co_mentioned(provenance: DataFrame, entities: DataFrame, entity_id: str, since: Column | None = None) -> DataFrame:
    """Entities that share documents with one entity, with the number of documents; ``since`` bounds the anchor's mentions only."""
    anchor = provenance.where(F.col("entity_id") == entity_id)
    if since is not None:
        anchor = anchor.where(F.col("detected_at") >= since)
    docs = anchor.select("document_id").distinct()
    other = _pairs_of_document(provenance).where(F.col("entity_id") != entity_id).join(docs, "document_id", "left_semi")
    n = other.groupBy("entity_id").agg(F.count(F.lit(1)).alias("documents"))
    return n.join(entities.select("entity_id", "canonical_name"), "entity_id")


def co_mention_pairs(provenance: DataFrame, least: int = 2) -> DataFrame:
    """(entity_a, entity_b, documents): pairs that share at least ``least`` documents.

    The size of the join is the sum of squares of entities per document, which the length of a text bounds.
    """
    p = _pairs_of_document(provenance)
    a, b = p.toDF("document_id", "entity_a"), p.toDF("document_id", "entity_b")
    n = a.join(b, "document_id").where("entity_a < entity_b").groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("documents"))
    return n.where(F.col("documents") >= least)


# ---------------------------------------------------------------- audits
def thin(entities: DataFrame, provenance: DataFrame, least: int) -> DataFrame:
    """Entities with fewer than ``least`` distinct (document, mention), none included, whatever their status."""
    n = provenance.where("entity_id is not null").select("entity_id", "document_id", "mention_text").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    rows = entities.select("entity_id", "canonical_name").join(n, "entity_id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    return rows.where(F.col("mentions") < least)


def short_snippets(provenance: DataFrame, entities: DataFrame, tokens: int) -> DataFrame:
    """Mentions whose snippet has fewer than ``tokens`` tokens, a token being four characters."""
    p = provenance.where(F.length("context_snippet") <= 4 * (tokens - 1)).withColumn("tokens", budget_tokens(F.col("context_snippet")))
    return p.join(entities.select("entity_id", "canonical_name"), "entity_id")


def narrow_spread(entities: DataFrame, provenance: DataFrame, days: float) -> DataFrame:
    """Entities mentioned more than once, all within ``days``; mentions without time do not count."""
    t = provenance.where("entity_id is not null and detected_at is not null").groupBy("entity_id")
    span = t.agg(F.count(F.lit(1)).alias("mentions"), (F.max(micros("detected_at")) - F.min(micros("detected_at"))).alias("span_us"))
    rows = span.where((F.col("mentions") > 1) & (F.col("span_us") < int(days * 86_400_000_000)))
    return rows.join(entities.select("entity_id", "canonical_name"), "entity_id")


def findings(entities: DataFrame, provenance: DataFrame, least: int, tokens: int, days: float) -> DataFrame:
    """All audits in long form: (finding_type, entity_id, canonical_name, detail_key, detail_value)."""

    def long(rows: DataFrame, kind: str, key: str, value: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("finding_type"), "entity_id", "canonical_name", F.lit(key).alias("detail_key"), value.cast("string").alias("detail_value"))

    return (
        long(thin(entities, provenance, least), "thin_mentions", "mentions", F.col("mentions"))
        .unionByName(long(short_snippets(provenance, entities, tokens), "short_snippet", "tokens", F.col("tokens")))
        .unionByName(long(narrow_spread(entities, provenance, days), "narrow_spread", "span_us", F.col("span_us")))
    )


# ---------------------------------------------------------------- aliases on several entities
def collisions(aliases: DataFrame, entities: DataFrame, active_only: bool = False) -> DataFrame:
    """(alias, entity_id, canonical_name, entity_type) of aliases that several entities have, compared without case."""
    e = entities.where("status = 'active'") if active_only else entities
    rows = aliases.where("alias is not null").select("entity_id", nocase("alias").alias("alias")).distinct().join(e.select("entity_id", "canonical_name", "entity_type"), "entity_id")
    many = rows.groupBy(F.col("alias").alias("_a")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(many, F.col("alias") == F.col("_a"), "left_semi")


def scored_collisions(aliases: DataFrame, entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """(alias, members, mentions, same_type, merge_target): the target is the member mentioned most, then by name, then id."""
    rows = collisions(aliases, entities).join(counts(entities, provenance), "entity_id")
    best = F.min(F.struct((-F.col("mentions")).alias("m"), "canonical_name", "entity_id")).alias("b")
    out = rows.groupBy("alias").agg(F.count(F.lit(1)).alias("members"), F.sum("mentions").alias("mentions"), (F.min("entity_type") == F.max("entity_type")).alias("same_type"), best)
    return out.select("alias", "members", "mentions", "same_type", F.col("b.entity_id").alias("merge_target"))


def proposed_merges(aliases: DataFrame, entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """(old_id, new_id): members of collisions within one type and the target they would be merged into."""
    scored = scored_collisions(aliases, entities, provenance).where("same_type").select(F.col("alias").alias("_a"), "merge_target")
    rows = collisions(aliases, entities).join(scored, F.col("alias") == F.col("_a"))
    return rows.where("entity_id != merge_target").groupBy(F.col("entity_id").alias("old_id")).agg(F.min("merge_target").alias("new_id"))
