"""Further queries of the catalogue: the ledger of runs, records that are kept, snapshots of quality, neighbourhoods, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeel.functions import columns as c
from lorekeel.operators import articles, budget, extraction, graph, ledger, mentions, merging, reports
from lorekeel.plans.catalogue import _COLLIDED, _LOG, _PROPOSED, _TS, _WALK, HOT, RUN_A, RUN_B, _now, _proposed, _Tables, query
from lorekeel.sources import readers

_OVER = "(finished_at IS NOT NULL AND status IN ('completed', 'failed'))"


@query(f"""SELECT run_id, CASE WHEN {_OVER} THEN status ELSE 'running' END AS status, epoch_us(started_at) AS started_us, CASE WHEN {_OVER} THEN epoch_us(finished_at) END AS finished_us,
CASE WHEN {_OVER} THEN document_count ELSE 0 END AS document_count, CASE WHEN {_OVER} THEN entity_count ELSE 0 END AS entity_count FROM ingestion_runs""")
def run_ledger(spark, d):
    """Runs as the log of their beginnings and ends has them."""
    r = _Tables(spark, d).ingestion_runs
    now = ledger.runs_now(ledger.started(r).unionByName(ledger.finished(r)))
    return now.select("run_id", "status", c.micros("started_at").alias("started_us"), c.micros("finished_at").alias("finished_us"), "document_count", "entity_count")


@query(f"SELECT run_id, status, epoch_us(started_at) AS started_us, document_count FROM ingestion_runs WHERE run_id = '{RUN_A}'")
def run_by_id(spark, d):
    r = _Tables(spark, d).ingestion_runs
    return r.where(F.col("run_id") == RUN_A).select("run_id", "status", c.micros("started_at").alias("started_us"), "document_count")


@query("""WITH n AS (SELECT run_id, count(*) AS mentions, count(DISTINCT entity_id) AS entities FROM provenance WHERE run_id IS NOT NULL GROUP BY 1)
SELECT r.run_id, r.status, CASE WHEN r.status = 'completed' THEN n.mentions ELSE n.mentions // 2 END AS mentions, CASE WHEN r.status = 'completed' THEN n.entities ELSE 0 END AS entities
FROM ingestion_runs r LEFT JOIN n USING (run_id) WHERE n.run_id IS NOT NULL OR r.run_id IS NOT NULL""")
def run_metrics(spark, d):
    """Metrics saved half-way through each run, and again by those that completed."""
    t = _Tables(spark, d)
    n = t.provenance.where("run_id is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("entity_id").alias("entities"))
    half = n.select("run_id", F.expr("mentions div 2").alias("mentions"), F.lit(0).cast("long").alias("entities"))
    done = n.join(t.ingestion_runs.where("status = 'completed'").select("run_id"), "run_id", "left_semi")
    return ledger.metrics_of(t.ingestion_runs, ledger.replaced(half, done, ["run_id"])).select("run_id", "status", "mentions", "entities")


@query("""SELECT p.run_id, p.document_id, max(epoch_us(p.detected_at)) AS failed_us, r.error_message FROM provenance p JOIN ingestion_runs r USING (run_id) WHERE r.status = 'failed' GROUP BY p.run_id, p.document_id, r.error_message""")
def article_failures(spark, d):
    """The ledger of failures: each document of a failed run once, with its last failure."""
    t = _Tables(spark, d)
    bad = t.ingestion_runs.where("status = 'failed'").select("run_id", "error_message")
    events = t.provenance.join(bad, "run_id").select("run_id", "document_id", F.col("detected_at").alias("failed_at"), "error_message")
    held = ledger.latest(events, ("run_id", "document_id"), ("failed_at",))
    return held.select("run_id", "document_id", c.micros("failed_at").alias("failed_us"), "error_message")


@query("""WITH touched AS (SELECT entity_id, canonical_name, status FROM entities WHERE status = 'merged' OR entity_type = 'person')
SELECT entity_id, alias FROM entity_aliases WHERE entity_id NOT IN (SELECT entity_id FROM touched)
UNION ALL SELECT DISTINCT entity_id, alias FROM (SELECT entity_id, unnest([lower(canonical_name), canonical_name]) AS alias FROM touched WHERE status <> 'merged')""")
def alias_sync(spark, d):
    """Persons get their names as aliases anew, merged entities lose theirs."""
    t = _Tables(spark, d)
    e = t.entities.where("status = 'merged' or entity_type = 'person'")
    new = e.select("entity_id", F.when(F.col("status") == "merged", F.array().cast("array<string>")).otherwise(F.array(F.lower("canonical_name"), "canonical_name")).alias("aliases"))
    return ledger.synced_aliases(t.entity_aliases, new)


@query(f"""SELECT (SELECT max(snapshot_id) FROM entity_snapshots) + row_number() OVER (ORDER BY entity_id) AS history_id, 'update' AS operation, entity_id, canonical_name, epoch_us({_TS}) AS changed_us
FROM entities WHERE updated_at IS NOT NULL""")
def history_append(spark, d):
    """The entities that were updated, written to the log after its last revision."""
    t = _Tables(spark, d)
    log = graph.revisions(t.entity_snapshots)
    new = ledger.appended(log, t.entities.where("updated_at is not null"), "update", _now(), ["entity_id"])
    return new.select("history_id", "operation", "entity_id", "canonical_name", c.micros("changed_at").alias("changed_us"))


@query(f"""WITH s AS (SELECT * FROM entity_snapshots QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_id DESC) = 1)
SELECT e.entity_id, e.canonical_name, epoch_us(e.created_at) AS created_us, epoch_us(e.updated_at) AS updated_us FROM entities e WHERE e.entity_id NOT IN (SELECT entity_id FROM s)
UNION ALL SELECT s.entity_id, s.canonical_name, epoch_us(coalesce(e.created_at, s.created_at, {_TS})), CASE WHEN e.entity_id IS NOT NULL THEN epoch_us({_TS}) ELSE epoch_us(s.updated_at) END
FROM s LEFT JOIN entities e USING (entity_id)""")
def entity_upsert(spark, d):
    """The last dump of every entity written over the table."""
    t = _Tables(spark, d)
    last = t.entity_snapshots.dropDuplicates(["snapshot_id"]).withColumnRenamed("snapshot_id", "history_id").withColumnRenamed("snapshot_at", "changed_at")
    new = graph.state_at(last, F.lit("9999-01-01").cast("timestamp")).drop("history_id", "changed_at")
    return graph.upsert(t.entities, new.select(t.entities.columns), _now()).select("entity_id", "canonical_name", c.micros("created_at").alias("created_us"), c.micros("updated_at").alias("updated_us"))


_MERGED = f"""(SELECT document_id, entity_type, canonical_name, description, chunk_index FROM {_PROPOSED} r
WHERE (document_id, lower(canonical_name)) NOT IN (SELECT (document_id, lower(canonical_name)) FROM {_PROPOSED} GROUP BY document_id, lower(canonical_name) HAVING count(DISTINCT entity_type) > 1)
QUALIFY row_number() OVER (PARTITION BY document_id, lower(canonical_name), entity_type ORDER BY length(description) DESC, chunk_index, canonical_name, description) = 1)"""
_NEW_ID = "md5(document_id || chr(1) || lower(canonical_name) || chr(1) || entity_type)"


def _persisted(t):
    rows = _proposed(t).withColumn("source", F.lit("model")).withColumn("context_snippet", F.col("description"))
    held = t.provenance.select("entity_id", "document_id", "source", "mention_text", "context_snippet", "detected_at", "run_id")
    return extraction.persisted_proposals(rows, held, "run-1", _now())


@query(f"SELECT {_NEW_ID} AS entity_id, canonical_name, entity_type, description, 'active' AS status FROM {_MERGED}")
def persist_proposals(spark, d):
    """Proposals of all documents as entities."""
    return _persisted(_Tables(spark, d))[0].select("entity_id", "canonical_name", "entity_type", "description", "status")


@query(f"SELECT {_NEW_ID} AS entity_id, document_id, canonical_name AS mention_text, 'model' AS source, 'run-1' AS run_id FROM {_MERGED}")
def persist_proposal_mentions(spark, d):
    return _persisted(_Tables(spark, d))[1].select("entity_id", "document_id", "mention_text", "source", "run_id")


@query("""WITH best AS (SELECT * FROM relationships QUALIFY row_number() OVER (PARTITION BY coalesce(document_id, ''), source_id, target_id, relation_type
ORDER BY length(description) DESC, length(description) % 3, description, valid_from NULLS FIRST, valid_until NULLS FIRST) = 1)
SELECT DISTINCT source_id, target_id, relation_type, coalesce(epoch_us(valid_from), -1) AS from_us FROM best b WHERE NOT coalesce(valid_until < valid_from, false)
AND NOT EXISTS (SELECT 1 FROM relationships q WHERE q.confidence >= 0.9 AND q.source_id = b.source_id AND q.target_id = b.target_id AND q.relation_type = b.relation_type AND q.valid_from IS NOT DISTINCT FROM b.valid_from)""")
def persist_relationships(spark, d):
    """All relationships as if chunks of their documents had given them, saved beside the sure ones."""
    r = _Tables(spark, d).relationships
    rows = r.select(F.coalesce("document_id", F.lit("")).alias("document_id"), "source_id", "target_id", "relation_type", F.col("description").alias("snippet"), (F.length("description") % 3).alias("chunk_index"), "valid_from", "valid_until")
    new = extraction.persisted_relationships(rows, r.where("confidence >= 0.9"), "run-1", _now())
    return new.select("source_id", "target_id", "relation_type", F.coalesce(c.micros("valid_from"), F.lit(-1)).alias("from_us"))


# ---------------------------------------------------------------- quality
def _profile_sql(where: str, collided: str) -> str:
    one = f"(SELECT c.alias, count(DISTINCT c.entity_id) AS value, string_agg(DISTINCT e.entity_type, ',' ORDER BY e.entity_type) AS detail FROM {collided} c JOIN entities e USING (entity_id) WHERE {where} GROUP BY 1)"
    return f"""(SELECT 'total' AS section, 'entities' AS key, '' AS detail, count(*) AS value FROM entities WHERE {where}
UNION ALL SELECT 'total', 'relationships', '', count(*) FROM relationships UNION ALL SELECT 'total', 'mentions', '', count(*) FROM provenance UNION ALL SELECT 'total', 'alias_collisions', '', count(*) FROM {one}
UNION ALL SELECT 'type', entity_type, '', count(*) FROM entities WHERE {where} GROUP BY 2 UNION ALL SELECT 'subtype', entity_type, coalesce(subtype, ''), count(*) FROM entities WHERE {where} GROUP BY 2, 3
UNION ALL SELECT * FROM (SELECT 'collision', alias, detail, value FROM {one} ORDER BY value DESC, alias LIMIT 10))"""


_ALL, _ACTIVE = _profile_sql("true", f"(SELECT * FROM {_COLLIDED} WHERE false)"), _profile_sql("status = 'active'", _COLLIDED)


def _profiles(t):
    collided = mentions.collisions(t.entity_aliases, t.entities)
    return merging.quality_profile(t.entities, t.relationships, t.provenance, collided.limit(0)), merging.quality_profile(t.entities.where("status = 'active'"), t.relationships, t.provenance, collided)


@query(f"SELECT * FROM {_profile_sql('true', _COLLIDED)}")
def quality_profile(spark, d):
    """Totals, counts by type and subtype, and the aliases that most entities share."""
    t = _Tables(spark, d)
    return merging.quality_profile(t.entities, t.relationships, t.provenance, mentions.collisions(t.entity_aliases, t.entities))


@query(f"""SELECT section, key, detail, coalesce(a.value, 0) AS before, coalesce(b.value, 0) AS after, coalesce(b.value, 0) - coalesce(a.value, 0) AS delta
FROM (SELECT * FROM {_ALL} WHERE section <> 'collision') a FULL JOIN (SELECT * FROM {_ACTIVE} WHERE section <> 'collision') b USING (section, key, detail)""")
def profile_changes(spark, d):
    """What changes when only active entities are kept."""
    return merging.profile_changes(*_profiles(_Tables(spark, d)))


@query(f"""WITH c AS (SELECT key, a.value AS before, b.value AS after FROM (SELECT * FROM {_ALL} WHERE section = 'total') a JOIN (SELECT * FROM {_ACTIVE} WHERE section = 'total') b USING (section, key, detail))
SELECT 'entity drop' AS rule, before, after, round((before - after) * 100.0 / before, 6) AS amount FROM c WHERE key = 'entities' AND before > 0 AND round((before - after) * 100.0 / before, 6) > 1.0
UNION ALL SELECT 'alias collisions', before, after, CAST(after - before AS DOUBLE) FROM c WHERE key = 'alias_collisions' AND after - before > 0""")
def profile_breaches(spark, d):
    """The bounds broken by it."""
    return merging.breaches(*_profiles(_Tables(spark, d)), 1.0, 0)


# ---------------------------------------------------------------- neighbourhoods
_MET = f"""(SELECT * FROM relationships WHERE confidence >= 0.5 AND (source_id IN (SELECT entity_id FROM near WHERE depth < 2) OR target_id IN (SELECT entity_id FROM near WHERE depth < 2))
QUALIFY row_number() OVER (PARTITION BY source_id, target_id, relation_type, valid_from ORDER BY coalesce(discovered_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), discovered_at NULLS FIRST, description NULLS FIRST, document_id NULLS FIRST) = 1)"""


def _around(spark, d):
    t = _Tables(spark, d)
    return graph.subgraph(t.entities, t.entity_aliases, t.relationships, HOT, 2, 0.5)


@query(f"""{_WALK} SELECT row_number() OVER (ORDER BY entity_id <> '{HOT}', canonical_name, entity_id)::INTEGER AS position, entity_id, canonical_name, depth,
coalesce((SELECT string_agg(DISTINCT alias, '|' ORDER BY alias) FROM entity_aliases a WHERE a.entity_id = e.entity_id), '') AS aliases FROM entities e JOIN near USING (entity_id)""")
def subgraph_entities(spark, d):
    """The entities around one, it first, then by name."""
    return _around(spark, d)[0].select("position", "entity_id", "canonical_name", "depth", F.array_join("aliases", "|").alias("aliases"))


@query(f"""{_WALK} SELECT row_number() OVER (ORDER BY source_id, target_id, relation_type, valid_from NULLS FIRST)::INTEGER AS position, source_id, target_id, relation_type, coalesce(epoch_us(valid_from), -1) AS from_us, document_id FROM {_MET}""")
def subgraph_edges(spark, d):
    return _around(spark, d)[1].select("position", "source_id", "target_id", "relation_type", F.coalesce(c.micros("valid_from"), F.lit(-1)).alias("from_us"), "document_id")


@query(f"{_WALK} SELECT DISTINCT document_id FROM {_MET} WHERE document_id IS NOT NULL")
def subgraph_documents(spark, d):
    """The documents that the edges around one come from."""
    return _around(spark, d)[2]


@query("""SELECT e.entity_id, (SELECT count(*) FROM relationships r WHERE r.source_id = e.entity_id OR r.target_id = e.entity_id) AS relationships, (SELECT count(*) FROM provenance p WHERE p.entity_id = e.entity_id) AS mentions FROM entities e""")
def entity_detail_counts(spark, d):
    t = _Tables(spark, d)
    return graph.detail_counts(t.entities, t.relationships, t.provenance)


# ---------------------------------------------------------------- runs and imports side by side
_SIDES = f"""(SELECT coalesce(b.entity_id, h.entity_id) AS entity_id, CASE WHEN h.entity_id IS NULL THEN 'base' WHEN b.entity_id IS NULL THEN 'head' ELSE 'both' END AS side
FROM (SELECT DISTINCT entity_id FROM provenance WHERE run_id = '{RUN_A}' AND entity_id IS NOT NULL) b FULL JOIN (SELECT DISTINCT entity_id FROM provenance WHERE run_id = '{RUN_B}' AND entity_id IS NOT NULL) h ON b.entity_id = h.entity_id)"""


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY entity_id) AS k FROM {_SIDES})
SELECT side, count(*) AS n, coalesce(string_agg(canonical_name, ', ' ORDER BY entity_id) FILTER (k <= 15 AND canonical_name IS NOT NULL), '') AS names FROM s LEFT JOIN entities USING (entity_id) GROUP BY 1""")
def run_diff_named(spark, d):
    """Entities of two runs side by side, with the names of the first of each side."""
    t = _Tables(spark, d)
    return merging.named_diff(merging.diff(merging.touched(t.provenance, RUN_A), merging.touched(t.provenance, RUN_B)), t.entities)


@query("""WITH s AS (SELECT DISTINCT lower(canonical_name) AS name, entity_type FROM entity_snapshots), m AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE lower(e.canonical_name) = s.name AND e.entity_type = s.entity_type))
SELECT a.entity_type, a.seen, coalesce(b.created, 0) AS created, a.seen - coalesce(b.created, 0) AS skipped FROM (SELECT entity_type, count(*) AS seen FROM entity_snapshots GROUP BY 1) a LEFT JOIN (SELECT entity_type, count(*) AS created FROM m GROUP BY 1) b USING (entity_type)""")
def import_counters(spark, d):
    """Records seen, created and skipped by an import of all dumps, by type."""
    t = _Tables(spark, d)
    seed = t.entity_snapshots.select(F.col("snapshot_id").alias("seed_id"), "canonical_name", "entity_type", "description")
    return ledger.import_counters(seed, merging.seed_import(seed, t.entities), "entity_type")


@query("""WITH f AS (SELECT DISTINCT p.document_id, p.entity_id FROM provenance p JOIN entities e USING (entity_id) WHERE lower(mention_text) = lower(canonical_name)),
x AS (SELECT DISTINCT p.document_id, p.entity_id FROM provenance p JOIN entities e USING (entity_id) WHERE detected_at IS NOT NULL),
s AS (SELECT coalesce(f.document_id, x.document_id) AS document_id, count(*) FILTER (f.entity_id IS NOT NULL AND x.entity_id IS NOT NULL) AS tp, count(*) FILTER (x.entity_id IS NULL) AS fp, count(*) FILTER (f.entity_id IS NULL) AS fn
FROM f FULL JOIN x ON f.document_id = x.document_id AND f.entity_id = x.entity_id GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM s""")
def article_scores(spark, d):
    """Precision and recall of each document, for the mentions found by the canonical name alone."""
    t = _Tables(spark, d)
    p = t.provenance.where("document_id is not null").join(t.entities.select("entity_id", "canonical_name"), "entity_id")
    return merging.article_scores(p.where("lower(mention_text) = lower(canonical_name)"), p.where("detected_at is not null"), "document_id", "entity_id")


# ---------------------------------------------------------------- questions and reports
@query("""WITH m AS (SELECT document_id, entity_id, prov_id % 50 AS s, -(prov_id % 50 + length(mention_text)) AS e FROM provenance WHERE entity_id IS NOT NULL AND mention_text IS NOT NULL),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY document_id, entity_id ORDER BY s, e) = 1)
SELECT document_id AS chunk_id, entity_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY s, e, entity_id) AS INTEGER) AS pos FROM f""")
def candidate_order(spark, d):
    """The entities of each document in the order of first sight."""
    p = _Tables(spark, d).provenance.where("entity_id is not null and mention_text is not null")
    start = F.col("prov_id") % 50
    return budget.candidate_order(p.select(F.col("document_id").alias("chunk_id"), start.alias("span_start"), (start + F.length("mention_text")).alias("span_end"), F.array("entity_id").alias("candidate_ids")))


@query("""WITH f AS (SELECT document_id, entity_id, prov_id, mention_text FROM provenance WHERE entity_id IS NOT NULL AND mention_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, entity_id ORDER BY prov_id, mention_text) = 1)
SELECT document_id AS chunk_id, 'PREVIOUSLY RESOLVED ENTITIES:' || chr(10) || string_agg('- ' || mention_text || ' (id=' || entity_id || ')', chr(10) ORDER BY prov_id, entity_id) AS block FROM f GROUP BY 1""")
def resolved_header(spark, d):
    """The part of a question that lists what was resolved before."""
    p = _Tables(spark, d).provenance.where("entity_id is not null and mention_text is not null")
    return budget.seen_lines(p.select(F.col("document_id").alias("chunk_id"), F.col("prov_id").alias("pos"), F.col("mention_text").alias("surface_form"), "entity_id"))


@query(f"""WITH m AS (SELECT DISTINCT alias, canonical_name, entity_type, substr(entity_id, 1, 8) AS id FROM {_COLLIDED})
SELECT alias, alias || ': ' || count(*) || ' entities: ' || string_agg(canonical_name || ' (' || entity_type || ', ' || id || ')', '; ' ORDER BY canonical_name, entity_type, id) AS line FROM m GROUP BY alias""")
def report_collisions(spark, d):
    t = _Tables(spark, d)
    return reports.collision_report(mentions.collisions(t.entity_aliases, t.entities))


@query("""SELECT * FROM (SELECT 0 AS line_no, 'entities: ' || (SELECT count(*) FROM entities) AS line UNION ALL SELECT 1, 'mentions: ' || (SELECT count(*) FROM provenance) UNION ALL SELECT 2, 'relationships: ' || (SELECT count(*) FROM relationships))""")
def report_health(spark, d):
    t = _Tables(spark, d)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return reports.health_report(n(t.entities, "entities").crossJoin(n(t.provenance, "mentions")).crossJoin(n(t.relationships, "relationships")))


@query(f"""WITH r AS (SELECT *, (SELECT count(DISTINCT entity_id) FROM provenance p WHERE p.run_id = i.run_id) AS entities FROM ingestion_runs i WHERE run_id = '{RUN_A}'), l AS (
SELECT unnest([CASE WHEN status = 'failed' THEN 'THIS RUN FAILED' END, 'run: ' || run_id, 'status: ' || status, 'started: ' || strftime(started_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), 'finished: ' || strftime(finished_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'),
'documents processed: ' || document_count, 'mentions saved: ' || entity_count, 'relationships saved: ' || relationship_count, 'distinct entities: ' || entities, 'error: ' || error_message]) AS line, unnest(range(10)) AS k FROM r)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS line_no, line FROM l WHERE line IS NOT NULL""")
def report_run(spark, d):
    t = _Tables(spark, d)
    return reports.run_report(t.ingestion_runs, RUN_A, merging.run_stats(t.provenance, t.relationships, t.ingestion_runs))


@query(f"SELECT CASE side WHEN 'base' THEN 0 WHEN 'head' THEN 1 ELSE 2 END AS line_no, CASE side WHEN 'both' THEN 'entities, in both: ' ELSE 'entities, only in ' || side || ': ' END || count(*) AS line FROM {_SIDES} GROUP BY side")
def report_diff(spark, d):
    p = _Tables(spark, d).provenance
    sides = merging.diff(merging.touched(p, RUN_A), merging.touched(p, RUN_B)).groupBy("side").agg(F.count(F.lit(1)).alias("n")).withColumn("names", F.lit(""))
    return reports.diff_report(sides, "entities")


# ---------------------------------------------------------------- imports from outside
_LANDED = "(SELECT entity_id, canonical_name AS label, nullif(subtype, '') AS exchange, CASE WHEN length(canonical_name) % 2 = 0 THEN upper(substr(entity_id, 1, 4)) END AS ticker, CASE WHEN length(canonical_name) % 3 = 0 THEN status END AS country, description FROM entities WHERE entity_type = 'organization')"


@query(f"""SELECT 'Q' || entity_id AS external_id, label AS canonical_name, label || ' is a publicly listed company' || coalesce(', headquartered in ' || country, '') ||
CASE WHEN exchange IS NOT NULL AND ticker IS NOT NULL THEN ', listed on ' || exchange || ' under ticker ' || ticker WHEN exchange IS NOT NULL THEN ', listed on ' || exchange WHEN ticker IS NOT NULL THEN ', trading under ticker ' || ticker ELSE '' END || '.' ||
coalesce(' ' || nullif(description, ''), '') AS description, 'wikidata:Q' || entity_id || coalesce('|ticker:' || ticker, '') AS aliases FROM {_LANDED}""")
def company_import(spark, d):
    """Organizations as if a knowledge base had answered: one landed answer for each, read, mapped and described."""
    e = _Tables(spark, d).entities.where("entity_type = 'organization'")
    text = lambda x: F.struct(x.cast("string").alias("value"))
    some = lambda cond, x: F.when(cond, text(x))
    n = F.length("canonical_name")
    row = F.struct(text(F.concat(F.lit("http://example.org/entity/Q"), "entity_id")).alias("item"), text(F.col("canonical_name")).alias("itemLabel"), text(F.col("description")).alias("description"), text(F.col("subtype")).alias("exchangeLabel"), some(n % 2 == 0, F.upper(F.substring("entity_id", 1, 4))).alias("ticker"), some(n % 3 == 0, F.col("status")).alias("countryLabel"))
    landed = e.select(F.to_json(F.struct(F.struct(F.array(row).alias("bindings")).alias("results"))).alias("body"))
    return readers.imported(landed, "company").select("external_id", "canonical_name", "description", F.array_join("aliases", "|").alias("aliases"))


# ---------------------------------------------------------------- whole tables where the catalogue shows a part
@query("SELECT document_id FROM articles WHERE replace(document_id, '-', '') NOT IN (SELECT replace(document_id, '-', '') FROM provenance WHERE document_id IS NOT NULL)")
def unprocessed_documents_all(spark, d):
    """Articles that no mention comes from."""
    t = _Tables(spark, d)
    return articles.unprocessed(t.articles, t.provenance).select("document_id")


@query(f"""SELECT DISTINCT entity_id, document_id, mention_text FROM provenance p WHERE entity_id IS NOT NULL AND (run_id <> '{RUN_A}' OR run_id IS NULL)
AND NOT EXISTS (SELECT 1 FROM provenance q WHERE q.run_id = '{RUN_A}' AND q.entity_id = p.entity_id AND q.document_id = p.document_id AND q.mention_text = p.mention_text)""")
def provenance_save_all(spark, d):
    """The mentions of all other runs saved to a table that holds those of one."""
    p = _Tables(spark, d).provenance
    first = F.col("run_id").eqNullSafe(F.lit(RUN_A))
    return mentions.save(p.where(~first), p.where(first)).select("entity_id", "document_id", "mention_text")


@query("""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text, length(text) // 2 AS s FROM documents WHERE length(text) >= 2),
b AS (SELECT *, s + 1 AS e, greatest(0, s - 100) AS a0, least(length(text), s + 101) AS b0 FROM t),
l AS (SELECT *, strpos(substr(text, a0 + 1), ' ') + a0 - 1 AS sp, strpos(reverse(substr(text, e + 1, b0 - e)), ' ') AS back FROM b),
k AS (SELECT *, CASE WHEN a0 > 0 AND sp >= a0 AND sp < s THEN sp + 1 ELSE a0 END AS a1, CASE WHEN b0 < length(text) AND back > 0 THEN b0 - back ELSE b0 END AS b1 FROM l)
SELECT document_id, md5((CASE WHEN a1 > 0 THEN '...' ELSE '' END) || substr(text, a1 + 1, b1 - a1) || (CASE WHEN b1 < length(text) THEN '...' ELSE '' END)) AS snippet FROM k""")
def context_snippet_all(spark, d):
    """The text around the middle character of every document."""
    t = _Tables(spark, d).documents.select(F.col("doc_id").cast("string").alias("document_id"), "text", F.expr("length(text) div 2").cast("int").alias("s")).where("length(text) >= 2")
    return t.select("document_id", F.md5(c.snippet(F.col("text"), F.col("s"), F.col("s") + 1)).alias("snippet"))


@query(f"""WITH p AS (SELECT document_id, count(*) AS mentions, count(*) FILTER (entity_id IS NULL) AS proposals FROM provenance WHERE document_id IS NOT NULL GROUP BY 1),
r AS (SELECT document_id, count(*) AS relationships FROM relationships GROUP BY 1),
f AS (SELECT DISTINCT document_id FROM provenance JOIN ingestion_runs USING (run_id) WHERE status = 'failed'),
x AS (SELECT p.*, coalesce(relationships, 0) AS relationships, CASE WHEN p.document_id IN (SELECT document_id FROM f) THEN 'failed' WHEN mentions = 1 THEN 'skipped' ELSE 'done' END AS status FROM p LEFT JOIN r USING (document_id))
SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
CAST(coalesce(sum(mentions) FILTER (status <> 'skipped'), 0) AS BIGINT) AS mentions, CAST(coalesce(sum(proposals) FILTER (status <> 'skipped'), 0) AS BIGINT) AS proposals, CAST(coalesce(sum(relationships) FILTER (status <> 'skipped'), 0) AS BIGINT) AS relationships FROM x""")
def run_totals(spark, d):
    """All documents as the results of one run: those of failed runs failed, those with a single mention were skipped."""
    t = _Tables(spark, d)
    p = t.provenance.where("document_id is not null")
    n = p.groupBy("document_id").agg(F.count(F.lit(1)).alias("mentions"), F.count(F.when(F.col("entity_id").isNull(), 1)).alias("proposals"))
    r = t.relationships.groupBy("document_id").agg(F.count(F.lit(1)).alias("relationships"))
    bad = p.join(t.ingestion_runs.where("status = 'failed'").select("run_id"), "run_id", "left_semi").select("document_id", F.lit(True).alias("bad")).distinct()
    rows = n.join(r, "document_id", "left").join(bad, "document_id", "left").na.fill(0, ["relationships"])
    return merging.run_totals(rows.withColumn("status", F.when(F.col("bad"), "failed").when(F.col("mentions") == 1, "skipped").otherwise("done")))
