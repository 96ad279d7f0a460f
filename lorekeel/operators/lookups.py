"""Lookups of entities, relationships and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeel.functions.columns import nocase, unset_or


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with ``aliases``, a sorted array; empty where there are none."""
    a = aliases.where("alias is not null").groupBy(F.col("entity_id").alias("alias_of")).agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    return entities.join(a, F.col("entity_id") == F.col("alias_of"), "left").drop("alias_of").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def by_ids(rows: DataFrame, ids: Sequence[str] | DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows whose id is in a set; ids that are not there are dropped without error."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), F.col(column) == F.col("_id"), "left_semi")
    return rows.where(F.col(column).isin(list(ids)))


def by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(nocase("canonical_name") == name.lower())


def by_alias(entities: DataFrame, aliases: DataFrame, alias: str) -> DataFrame:
    """Entities with an alias, without case; an entity is given once for each alias row that matches."""
    hit = aliases.where(nocase("alias") == alias.lower()).select(F.col("entity_id").alias("_e"), "alias")
    return hit.join(entities, F.col("_e") == F.col("entity_id")).drop("_e")


def exists(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``wanted`` (canonical_name, entity_type) the rows that some entity has, names without case."""
    e = entities.select(nocase("canonical_name").alias("_n"), F.col("entity_type").alias("_t"))
    return wanted.join(e, (nocase("canonical_name") == F.col("_n")) & (F.col("entity_type") == F.col("_t")), "left_semi")


def external_ids(aliases: DataFrame, prefix: str) -> DataFrame:
    """Distinct external ids kept as aliases with a prefix, e.g. ``ticker:``."""
    return aliases.where(nocase("alias").startswith(prefix.lower())).select(F.expr(f"substring(alias, {len(prefix) + 1})").alias("external_id")).distinct()


def name_type_pairs(entities: DataFrame) -> DataFrame:
    return entities.select(nocase("canonical_name").alias("name"), "entity_type").distinct()


def by_type(entities: DataFrame, entity_type: str, subtype: str | None = None) -> DataFrame:
    c = F.col("entity_type") == entity_type
    return entities.where(c if subtype is None else c & (F.col("subtype") == subtype))


def by_status(entities: DataFrame, status: str) -> DataFrame:
    return entities.where(F.col("status") == status)


def name_prefix(entities: DataFrame, prefix: str) -> DataFrame:
    """Names that begin with a prefix, without case; % and _ are plain characters."""
    return entities.where(nocase("canonical_name").startswith(prefix.lower()))


def since(rows: DataFrame, column: str, moment: str, tie: str) -> DataFrame:
    """Rows at or after a moment, the newest first."""
    return rows.where(F.col(column) >= F.lit(moment).cast("timestamp")).orderBy(F.desc(column), tie)


def listed(entities: DataFrame, q: str | None = None, entity_type: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The listing of the REST interface: a name prefix goes before a type, a type before a status; else active ones."""
    rows = name_prefix(entities, q) if q else by_type(entities, entity_type) if entity_type else by_status(entities, status or "active")
    return rows.orderBy("canonical_name", "entity_id").offset(offset).limit(limit)


def export_slice(entities: DataFrame, entity_type: str | None = None, subtype: str | None = None, moment: str | None = None) -> DataFrame:
    """What an export takes: type and subtype, else since a moment, else the active ones."""
    if entity_type:
        return by_type(entities, entity_type, subtype)
    return since(entities, "created_at", moment, "entity_id") if moment else by_status(entities, "active")


# ---------------------------------------------------------------- relationships
def relationships_for(relationships: DataFrame, entity_id: str) -> DataFrame:
    """Rows with the entity as source, then as target; a self-loop comes twice."""
    return relationships.where(F.col("source_id") == entity_id).unionByName(relationships.where(F.col("target_id") == entity_id))


def relationships_between(relationships: DataFrame, source: str, target: str) -> DataFrame:
    return relationships.where((F.col("source_id") == source) & (F.col("target_id") == target))


def as_of(relationships: DataFrame, moment: Column) -> DataFrame:
    """Relationships that hold at a moment, both bounds included and unset bounds open."""
    return relationships.where(unset_or("valid_from", F.col("valid_from") <= moment) & unset_or("valid_until", F.col("valid_until") >= moment))


def min_confidence(relationships: DataFrame, least: float) -> DataFrame:
    """NULL confidence is below any bound."""
    return relationships.where(F.col("confidence") >= least)


def active(relationships: DataFrame, now: Column) -> DataFrame:
    """Not ended: valid_until is unset or after ``now``; valid_from does not count."""
    return relationships.where(unset_or("valid_until", F.col("valid_until") > now))


def listed_relationships(relationships: DataFrame, entity_id: str | None = None, source: str | None = None, target: str | None = None, relation_type: str | None = None, least: float | None = None) -> DataFrame:
    """The listing of the REST interface: entity before both ends before source before target, then label and confidence."""
    if entity_id:
        rows = relationships_for(relationships, entity_id)
    elif source and target:
        rows = relationships_between(relationships, source, target)
    elif source or target:
        rows = relationships.where(F.col("source_id") == source) if source else relationships.where(F.col("target_id") == target)
    else:
        rows = relationships
    if relation_type:
        rows = rows.where(F.col("relation_type") == relation_type)
    return rows if least is None else min_confidence(rows, least)


def touching(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct relationships with an end in a set of entities."""
    ids = entities.select(F.col("entity_id").alias("_id")).distinct()
    ends = [relationships.join(ids, F.col(c) == F.col("_id"), "left_semi") for c in ("source_id", "target_id")]
    return ends[0].unionByName(ends[1]).distinct()


def named(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with the names and types of both ends; rows with an end that is no entity are dropped."""
    e = entities.select("entity_id", "canonical_name", "entity_type")
    s = e.toDF("source_id", "source_name", "source_type")
    t = e.toDF("target_id", "target_name", "target_type")
    return relationships.join(s, "source_id").join(t, "target_id")
