"""Results of chunks, runs and imports put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.functions.columns import nocase


def proposals(rows: DataFrame) -> DataFrame:
    """New entities proposed by the chunks of a document, one for each name (without case) and type: the one with the
    longest description, then of the first chunk. A name proposed with several types is left out.

    ``rows``: document_id, chunk_index, canonical_name, entity_type, description.
    """
    r = rows.where("canonical_name is not null and entity_type is not null").withColumn("name", nocase("canonical_name"))
    rest = ("canonical_name", "description", "chunk_index")
    best = F.min(F.struct((-F.length(F.coalesce("description", F.lit("")))).alias("_n"), F.col("chunk_index").alias("_c"), *rest)).alias("b")
    one = r.groupBy("document_id", "name", "entity_type").agg(best)
    clash = conflicts(rows).select(F.col("document_id").alias("_d"), F.col("name").alias("_n"))
    return one.join(clash, (F.col("document_id") == F.col("_d")) & (F.col("name") == F.col("_n")), "left_anti").select("document_id", "entity_type", *[F.col(f"b.{c}") for c in rest])


def conflicts(rows: DataFrame) -> DataFrame:
    """(document_id, name, types): names proposed with several types, the types in order."""
    r = rows.where("canonical_name is not null and entity_type is not null").select("document_id", nocase("canonical_name").alias("name"), "entity_type").distinct()
    return r.groupBy("document_id", "name").agg(F.sort_array(F.collect_set("entity_type")).alias("t")).where("size(t) > 1").select("document_id", "name", F.array_join("t", ",").alias("types"))


def relationships(rows: DataFrame) -> DataFrame:
    """Relationships found in the chunks of a document, one for each (source, target, label), whatever its period: the one
    with the longest snippet, then of the first chunk."""
    best = F.min(F.struct((-F.length(F.coalesce("snippet", F.lit("")))).alias("_n"), F.col("chunk_index").alias("_c"), "snippet", "chunk_index")).alias("b")
    return rows.groupBy("document_id", "source_id", "target_id", "relation_type").agg(best).select("document_id", "source_id", "target_id", "relation_type", "b.snippet", "b.chunk_index")


def united_aliases(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order, with the aliases of all rows in order of first sight.

    Each alias of a key is one row before they come together, so what is collected is a set of aliases, not the rows of a key.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(order, "canonical_name")).alias("f"))
    each = rows.select(key, order, F.posexplode("aliases").alias("_at", "alias")).groupBy(key, "alias").agg(F.min(F.struct(order, "_at")).alias("seen"))
    lists = each.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("seen", "alias"))).alias("l"))
    both = first.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left")
    return both.select(key, "f.canonical_name", F.coalesce(F.col("l.alias"), F.array().cast("array<string>")).alias("aliases"))


def seed_import(seed: DataFrame, held: DataFrame, order: str = "seed_id") -> DataFrame:
    """Seed records that are new: no entity has their name (without case) and type, and no earlier seed row has."""
    rest = [c for c in seed.columns if c != order]
    first = seed.groupBy(nocase("canonical_name").alias("_n"), F.col("entity_type").alias("_t")).agg(F.min(F.struct(order, *rest)).alias("f"))
    e = held.select(nocase("canonical_name").alias("_hn"), F.col("entity_type").alias("_ht"))
    return first.join(e, (F.col("_n") == F.col("_hn")) & (F.col("_t") == F.col("_ht")), "left_anti").select("f.*")


def external_import(rows: DataFrame, held: DataFrame, held_ids: DataFrame) -> DataFrame:
    """Records of an outside source that are new: neither their external id nor their name and type is held. Twins within
    the batch are both taken."""
    e = held.select(nocase("canonical_name").alias("_hn"), F.col("entity_type").alias("_ht"))
    out = rows.join(held_ids.select(F.col("external_id").alias("_x")), F.col("external_id") == F.col("_x"), "left_anti")
    return out.join(e, (nocase("canonical_name") == F.col("_hn")) & (F.col("entity_type") == F.col("_ht")), "left_anti")


# ---------------------------------------------------------------- runs
def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").limit(n)


def touched(provenance: DataFrame, run_id: str) -> DataFrame:
    return provenance.where((F.col("run_id") == run_id) & F.col("entity_id").isNotNull()).select("entity_id").distinct()


def edge_keys(relationships_: DataFrame, run_id: str) -> DataFrame:
    return relationships_.where(F.col("run_id") == run_id).select("source_id", "target_id", "relation_type").distinct()


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Rows of two sets with the side they are on: base, head or both. One full join."""
    on = base.columns
    b, h = base.distinct().withColumn("_b", F.lit(1)), head.distinct().withColumn("_h", F.lit(1))
    side = F.when(F.col("_h").isNull(), "base").when(F.col("_b").isNull(), "head").otherwise("both")
    return b.join(h, on, "full").select(*on, side.alias("side"))


def run_stats(provenance: DataFrame, relationships_: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, documents, mentions, entities, relationships) as the tables have them, zero included."""
    p = provenance.where("run_id is not null").groupBy("run_id").agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("mentions"), F.countDistinct("entity_id").alias("entities"))
    r = relationships_.where("run_id is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("relationships"))
    rows = runs.select("run_id").join(p, "run_id", "left").join(r, "run_id", "left")
    return rows.na.fill(0, ["documents", "mentions", "entities", "relationships"])


def failed_documents(provenance: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, document_id) of documents that failed runs had in hand."""
    bad = runs.where("status = 'failed'").select("run_id")
    return provenance.join(bad, "run_id", "left_semi").select("run_id", "document_id").distinct()


def precision_recall(found: DataFrame, expected: DataFrame, *key: str) -> DataFrame:
    """One row: true positives, false ones, misses, precision, recall, F1 of two sets over a key; 0 where undefined."""
    f, e = found.select(*key).distinct().withColumn("_f", F.lit(1)), expected.select(*key).distinct().withColumn("_e", F.lit(1))
    rows = f.join(e, list(key), "full")
    n = lambda c: F.count(F.when(c, 1))
    one = rows.agg(n(F.col("_f").isNotNull() & F.col("_e").isNotNull()).alias("tp"), n(F.col("_e").isNull()).alias("fp"), n(F.col("_f").isNull()).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


# ---------------------------------------------------------------- snapshots of quality
def quality_snapshot(entities: DataFrame, relationships_: DataFrame, provenance: DataFrame, collided: DataFrame) -> DataFrame:
    """One row: totals, mentions for each entity, aliases on several entities and the worst of them."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sizes = collided.groupBy("alias").agg(F.count(F.lit(1)).alias("members"))
    worst = sizes.agg(F.count(F.lit(1)).alias("alias_collisions"), F.min(F.struct((-F.col("members")).alias("m"), "alias")).alias("w"))
    rows = n(entities, "entities").crossJoin(n(relationships_, "relationships")).crossJoin(n(provenance, "mentions")).crossJoin(worst)
    return rows.select("entities", "relationships", "mentions", "alias_collisions", F.col("w.alias").alias("worst_alias"), (-F.col("w.m")).alias("worst_members"), F.round(F.when(F.col("entities") > 0, F.col("mentions") / F.col("entities")).otherwise(0.0), 6).alias("density"))


def compare_snapshots(old: DataFrame, new: DataFrame, most_drop: float, most_collisions: int) -> DataFrame:
    """One row for each total: old, new, drop in percent, and whether it is within bounds; both bounds may be reached."""
    o, k = old.select([F.col(c).alias(f"o_{c}") for c in old.columns]), new
    both = o.crossJoin(k)
    drop = lambda a, b: F.when(a > 0, (a - b) * 100.0 / a).otherwise(0.0)
    rows = [F.struct(F.lit(c).alias("total"), F.col(f"o_{c}").cast("long").alias("old"), F.col(c).cast("long").alias("new"), F.round(drop(F.col(f"o_{c}"), F.col(c)), 6).alias("drop"), (drop(F.col(f"o_{c}"), F.col(c)) <= most_drop).alias("ok")) for c in ("entities", "relationships", "mentions")]
    c = "alias_collisions"
    rows.append(F.struct(F.lit(c).alias("total"), F.col(f"o_{c}").cast("long").alias("old"), F.col(c).cast("long").alias("new"), F.round(drop(F.col(f"o_{c}"), F.col(c)), 6).alias("drop"), (F.col(c) - F.col(f"o_{c}") <= most_collisions).alias("ok")))
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quality_profile(entities: DataFrame, relationships_: DataFrame, provenance: DataFrame, collided: DataFrame, top: int = 10) -> DataFrame:
    """(section, key, detail, value): the snapshot in long form.

    Sections: total (entities, relationships, mentions, alias_collisions), type, subtype (detail; '' where there is none),
    collision (the ``top`` aliases on most entities, ties by alias; detail: their types, value: their entities).
    """
    n = lambda df, key: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total").alias("section"), F.lit(key).alias("key"), F.lit("").alias("detail"), "value")
    kinds = entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("value")).select(F.lit("type"), F.col("entity_type"), F.lit(""), "value")
    subs = entities.groupBy("entity_type", F.coalesce("subtype", F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("subtype"), F.col("entity_type"), F.col("s"), "value")
    one = collided.select("alias", "entity_id").join(entities.select("entity_id", "entity_type"), "entity_id").groupBy("alias").agg(F.countDistinct("entity_id").alias("value"), F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("t"))
    worst = one.orderBy(F.desc("value"), "alias").limit(top).select(F.lit("collision"), F.col("alias"), F.col("t"), "value")
    totals = n(entities, "entities").unionAll(n(relationships_, "relationships")).unionAll(n(provenance, "mentions")).unionAll(n(one, "alias_collisions"))
    return totals.unionAll(kinds).unionAll(subs).unionAll(worst)


def profile_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, key, detail, before, after, delta) of two profiles, without their collisions; what one of them lacks is 0."""
    on = ["section", "key", "detail"]
    o, k = (p.where("section != 'collision'").select(*on, F.col("value").alias(c)) for p, c in ((old, "before"), (new, "after")))
    return o.join(k, on, "full").na.fill(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def breaches(old: DataFrame, new: DataFrame, most_drop: float = 10.0, most_collisions: int = 0) -> DataFrame:
    """(rule, before, after, amount) of the bounds that a new profile breaks: entities fallen by more than ``most_drop`` percent, alias
    collisions grown by more than ``most_collisions``. Reaching a bound breaks none; from 0 nothing falls."""
    c = profile_changes(old, new).where("section = 'total'")
    fall = c.where("key = 'entities' and before > 0").withColumn("amount", F.round(-F.col("delta") * 100.0 / F.col("before"), 6)).where(F.col("amount") > most_drop).select(F.lit("entity drop").alias("rule"), "before", "after", "amount")
    more = c.where("key = 'alias_collisions'").where(F.col("delta") > most_collisions).select(F.lit("alias collisions").alias("rule"), "before", "after", F.col("delta").cast("double").alias("amount"))
    return fall.unionAll(more)


def named_diff(sides: DataFrame, entities: DataFrame, sample: int = 15) -> DataFrame:
    """(side, n, names): of a diff of entities (entity_id, side) the size of each side, and the names of its first ``sample`` ids; ids
    without a record have no name. Only the first ids of each task travel."""
    n = sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    few = None
    for side in ("base", "head", "both"):
        one = sides.where(F.col("side") == side).orderBy("entity_id").limit(sample)
        few = one if few is None else few.unionByName(one)
    named = few.join(entities.select("entity_id", "canonical_name"), "entity_id")
    names = named.groupBy("side").agg(F.array_sort(F.collect_list(F.struct("entity_id", "canonical_name"))).alias("l"))
    return n.join(names, "side", "left").select("side", "n", F.coalesce(F.array_join(F.col("l.canonical_name"), ", "), F.lit("")).alias("names"))


def article_scores(found: DataFrame, expected: DataFrame, article: str, *key: str) -> DataFrame:
    """(article, tp, fp, fn, precision, recall) for each article of either set."""
    on = [article, *key]
    f, e = found.select(*on).distinct().withColumn("_f", F.lit(1)), expected.select(*on).distinct().withColumn("_e", F.lit(1))
    n = lambda c: F.count(F.when(c, 1))
    one = f.join(e, on, "full").groupBy(article).agg(n(F.col("_f").isNotNull() & F.col("_e").isNotNull()).alias("tp"), n(F.col("_e").isNull()).alias("fp"), n(F.col("_f").isNull()).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return one.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def run_totals(results: DataFrame) -> DataFrame:
    """One row for a run from the results of its documents (status: done, skipped or failed; mentions, proposals, relationships): how many of
    each status, and the sums over those that were not skipped; 0 for an empty run."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    total = lambda c: F.coalesce(F.sum(F.when(F.col("status") != "skipped", F.col(c))), F.lit(0)).cast("long").alias(c)
    return results.agg(n("done"), n("skipped"), n("failed"), total("mentions"), total("proposals"), total("relationships"))
