"""The catalogue of named queries and the SQL each is checked against.

Every query runs over whole tables. Constants are shared with the SQL; results name instants in
microseconds, so that no time zone enters a comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeel import schemas
from lorekeel.functions import columns as c
from lorekeel.operators import articles as ar
from lorekeel.operators import budget, detection, graph, lookups, mentions, merging, segments, versions
from lorekeel.plans import pipeline
from lorekeel.sources import readers
from lorekeel.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


@query(r"""
WITH held AS (
  SELECT entity_id, coalesce(updated_at, created_at) AS t,
    row(nullif(trim(regexp_replace(canonical_name, '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(subtype, '\s+', ' ', 'g')), ''),
        nullif(trim(regexp_replace(description, '\s+', ' ', 'g')), ''), valid_from, valid_until,
        nullif(trim(regexp_replace(status, '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(merged_into, '\s+', ' ', 'g')), ''))::VARCHAR AS p
  FROM entity_snapshots
  QUALIFY row_number() OVER (PARTITION BY entity_id, coalesce(updated_at, created_at) ORDER BY snapshot_at DESC, snapshot_id DESC) = 1
), starts AS (
  SELECT entity_id, t FROM held WINDOW w AS (PARTITION BY entity_id ORDER BY t)
  QUALIFY p IS DISTINCT FROM lag(p) OVER w OR row_number() OVER w = 1
)
SELECT entity_id, epoch_us(t) AS start_us, coalesce(lead(epoch_us(t)) OVER (PARTITION BY entity_id ORDER BY t), -1) AS end_us FROM starts
""")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of every entity and their periods."""
    return versions.version_history(read_table(spark, sf_dir, "entity_snapshots"))


# ---------------------------------------------------------------- constants
HOT = "f9552fe4633f0e4c7ab97553b210d05b"
SECOND = "7266f9118d694ab198855072bdbbe14b"
RUN_A, RUN_B = "8f34f0acc9e553f0ee20216ea691268f", "9b47aaa24b326497c79e002c79009961"
NOW = "2024-05-03 00:00:00"
SHOWN = sorted([HOT, SECOND, "69d2765e91d6d288d05b8a381162ef36", "2b8782c67e4ba49443cf7125bc3c2a83", "ae23d7fcefecec98550e60623e5ba19b", "9c2ac292aaf975009d7558b79e6a2957", "5a3921550816c6905094e953d46f2f05", "4ed8c361411b6a318278c8767764f97d"])
_IDS = ", ".join(f"'{x}'" for x in SHOWN)
_TS = f"TIMESTAMPTZ '{NOW}+00'"
_RULES = ", ".join(f"('{a}','{b}','{l}')" for a, b, l in schemas.RULE_ROWS)
_E = "entity_id, canonical_name, entity_type, status"


def _now():
    return F.lit(NOW).cast("timestamp")


class _Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(*self._at, name)


def _brief(df: DataFrame) -> DataFrame:
    return df.select("entity_id", "canonical_name", "entity_type", "status")


# ---------------------------------------------------------------- entities
@query(f"SELECT {_E} FROM entities WHERE entity_id = '{HOT}'")
def entity_by_id(spark, d):
    return _brief(lookups.by_ids(_Tables(spark, d).entities, [HOT]))


@query(f"SELECT {_E} FROM entities WHERE entity_id IN ({_IDS})")
def entities_by_ids(spark, d):
    return _brief(lookups.by_ids(_Tables(spark, d).entities, SHOWN))


@query("""SELECT e.entity_id, coalesce(string_agg(a.alias, '|' ORDER BY a.alias), '') AS aliases, count(a.alias) AS n
FROM entities e LEFT JOIN entity_aliases a USING (entity_id) GROUP BY 1""")
def entity_with_aliases(spark, d):
    t = _Tables(spark, d)
    return lookups.with_aliases(t.entities, t.entity_aliases).select("entity_id", F.array_join("aliases", "|").alias("aliases"), F.size("aliases").cast("long").alias("n"))


@query(f"SELECT {_E} FROM entities WHERE lower(canonical_name) = lower('ZACHARY tesovoham')")
def entity_by_name_nocase(spark, d):
    return _brief(lookups.by_name(_Tables(spark, d).entities, "ZACHARY tesovoham"))


@query(f"""SELECT e.entity_id, a.alias, e.canonical_name FROM entities e JOIN entity_aliases a USING (entity_id)
WHERE lower(a.alias) IN (SELECT min(lower(alias)) FROM entity_aliases WHERE entity_id = '{HOT}')""")
def entity_by_alias_nocase(spark, d):
    t = _Tables(spark, d)
    one = t.entity_aliases.where(F.col("entity_id") == HOT).agg(F.min(F.lower("alias")).alias("_alias"))
    held = t.entity_aliases.join(F.broadcast(one), F.lower("alias") == F.col("_alias"), "left_semi")
    return held.join(t.entities.select("entity_id", "canonical_name"), "entity_id").select("entity_id", "alias", "canonical_name")


@query("SELECT DISTINCT e.canonical_name, e.entity_type FROM entities e JOIN entity_aliases a ON lower(a.alias) = lower(e.canonical_name)")
def entities_named_like_an_alias(spark, d):
    """Existence by name and type: of all aliases, as they would be imported, the names that are held already."""
    t = _Tables(spark, d)
    wanted = t.entities.select("canonical_name", "entity_type").distinct()
    held = t.entity_aliases.select(F.lower("alias").alias("_name"))
    return wanted.join(held, F.lower("canonical_name") == F.col("_name"), "left_semi")


@query("SELECT DISTINCT substr(alias, 8) AS external_id FROM entity_aliases WHERE lower(alias) LIKE 'ticker:%'")
def external_id_prefix_extract(spark, d):
    return lookups.external_ids(_Tables(spark, d).entity_aliases, "ticker:")


@query("SELECT DISTINCT lower(canonical_name) AS name, entity_type FROM entities")
def name_type_pairs(spark, d):
    return lookups.name_type_pairs(_Tables(spark, d).entities)


@query(f"SELECT {_E} FROM entities WHERE entity_type = 'organization' AND subtype = 'central_bank'")
def entities_by_type_subtype(spark, d):
    return _brief(lookups.by_type(_Tables(spark, d).entities, "organization", "central_bank"))


@query(f"SELECT {_E} FROM entities WHERE status = 'merged'")
def entities_by_status(spark, d):
    return _brief(lookups.by_status(_Tables(spark, d).entities, "merged"))


@query(f"SELECT {_E} FROM entities WHERE starts_with(lower(canonical_name), 'klo')")
def entities_name_prefix(spark, d):
    return _brief(lookups.name_prefix(_Tables(spark, d).entities, "KLO"))


@query("SELECT entity_id, epoch_us(created_at) AS created_us FROM entities WHERE created_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00'")
def entities_since(spark, d):
    return lookups.since(_Tables(spark, d).entities, "created_at", "2024-06-01 00:00:00", "entity_id").select("entity_id", c.micros("created_at").alias("created_us"))


@query(f"SELECT {_E} FROM entities WHERE status = 'active' ORDER BY canonical_name, entity_id LIMIT 20 OFFSET 10")
def entities_listing(spark, d):
    return _brief(lookups.listed(_Tables(spark, d).entities, limit=20, offset=10))


@query(f"SELECT {_E} FROM entities WHERE entity_type = 'person' AND subtype = 'politician'")
def export_slice(spark, d):
    return _brief(lookups.export_slice(_Tables(spark, d).entities, "person", "politician", "2024-06-01"))


# ---------------------------------------------------------------- provenance
@query(f"SELECT prov_id, document_id, mention_text FROM provenance WHERE entity_id = '{SECOND}'")
def provenance_for_entity(spark, d):
    return _Tables(spark, d).provenance.where(F.col("entity_id") == SECOND).select("prov_id", "document_id", "mention_text")


@query("""SELECT entity_id, document_id, mention_text, min(coalesce(epoch_us(detected_at), -1)) FILTER (detected_at IS NOT NULL) AS first_us
FROM provenance WHERE entity_id IS NOT NULL GROUP BY 1, 2, 3""")
def provenance_dedup(spark, d):
    return mentions.dedup(_Tables(spark, d).provenance).select("entity_id", "document_id", "mention_text", c.micros("detected_at").alias("first_us"))


@query(f"""SELECT DISTINCT entity_id, document_id, mention_text FROM provenance p WHERE entity_id IS NOT NULL AND run_id = '{RUN_B}'
AND NOT EXISTS (SELECT 1 FROM provenance q WHERE q.run_id = '{RUN_A}' AND q.entity_id = p.entity_id AND q.document_id = p.document_id AND q.mention_text = p.mention_text)""")
def provenance_save(spark, d):
    p = _Tables(spark, d).provenance
    return mentions.save(p.where(F.col("run_id") == RUN_B), p.where(F.col("run_id") == RUN_A)).select("entity_id", "document_id", "mention_text")


@query("SELECT DISTINCT a.document_id FROM articles a WHERE replace(a.document_id, '-', '') IN (SELECT replace(document_id, '-', '') FROM provenance)")
def documents_with_provenance(spark, d):
    t = _Tables(spark, d)
    return ar.by_document(t.articles, t.provenance.select("document_id")).select("document_id")


@query(f"SELECT prov_id, mention_text, epoch_us(detected_at) AS detected_us FROM provenance WHERE entity_id = '{HOT}' AND detected_at >= TIMESTAMPTZ '2024-05-01 00:00:00+00'")
def recent_mentions(spark, d):
    p = _Tables(spark, d).provenance.where(F.col("entity_id") == HOT)
    return lookups.since(p, "detected_at", "2024-05-01 00:00:00", "prov_id").select("prov_id", "mention_text", c.micros("detected_at").alias("detected_us"))


_DOC = "(SELECT document_id FROM provenance WHERE document_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"SELECT p.prov_id, p.entity_id, e.canonical_name, p.mention_text FROM provenance p JOIN entities e USING (entity_id) WHERE p.document_id = {_DOC}")
def mentions_with_entities(spark, d):
    t = _Tables(spark, d)
    top = t.provenance.where("document_id is not null").groupBy("document_id").count().orderBy(F.desc("count"), "document_id").limit(1).select("document_id")
    rows = t.provenance.join(F.broadcast(top), "document_id", "left_semi")
    return rows.join(t.entities.select("entity_id", "canonical_name"), "entity_id").select("prov_id", "entity_id", "canonical_name", "mention_text")


@query("SELECT e.entity_id, count(p.entity_id) AS mentions FROM entities e LEFT JOIN provenance p USING (entity_id) GROUP BY 1")
def mention_counts(spark, d):
    t = _Tables(spark, d)
    return mentions.counts(t.entities, t.provenance)


@query(f"""SELECT p2.entity_id, e.canonical_name, count(DISTINCT p2.document_id) AS documents
FROM provenance p1 JOIN provenance p2 USING (document_id) JOIN entities e ON e.entity_id = p2.entity_id
WHERE p1.entity_id = '{HOT}' AND p2.entity_id <> '{HOT}' AND p1.detected_at >= TIMESTAMPTZ '2024-05-01 00:00:00+00' GROUP BY 1, 2""")
def co_mentioned(spark, d):
    t = _Tables(spark, d)
    return mentions.co_mentioned(t.provenance, t.entities, HOT, F.lit("2024-05-01 00:00:00").cast("timestamp")).select("entity_id", "canonical_name", "documents")


@query("""WITH p AS (SELECT DISTINCT document_id, entity_id FROM provenance WHERE entity_id IS NOT NULL AND document_id IS NOT NULL)
SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, count(*) AS documents FROM p a JOIN p b USING (document_id) WHERE a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_mention_pairs(spark, d):
    return mentions.co_mention_pairs(_Tables(spark, d).provenance)


# ---------------------------------------------------------------- audits
_THIN = """SELECT e.entity_id, e.canonical_name, coalesce(n, 0) AS mentions FROM entities e LEFT JOIN
(SELECT entity_id, count(*) AS n FROM (SELECT DISTINCT entity_id, document_id, mention_text FROM provenance) GROUP BY 1) USING (entity_id) WHERE coalesce(n, 0) < 3"""
_SHORT = "SELECT p.prov_id, p.entity_id, e.canonical_name, CAST(ceil(length(context_snippet) / 4.0) AS INTEGER) AS tokens FROM provenance p JOIN entities e USING (entity_id) WHERE length(context_snippet) <= 44"
_NARROW = """SELECT entity_id, canonical_name, mentions, span_us FROM (SELECT entity_id, count(*) AS mentions, max(epoch_us(detected_at)) - min(epoch_us(detected_at)) AS span_us
FROM provenance WHERE detected_at IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1) JOIN entities USING (entity_id) WHERE mentions > 1 AND span_us < 86400000000"""


@query(_THIN)
def audit_thin_mentions(spark, d):
    t = _Tables(spark, d)
    return mentions.thin(t.entities, t.provenance, 3)


@query(_SHORT)
def audit_short_snippets(spark, d):
    t = _Tables(spark, d)
    return mentions.short_snippets(t.provenance, t.entities, 12).select("prov_id", "entity_id", "canonical_name", "tokens")


@query(_NARROW)
def audit_narrow_spread(spark, d):
    t = _Tables(spark, d)
    return mentions.narrow_spread(t.entities, t.provenance, 1).select("entity_id", "canonical_name", "mentions", "span_us")


@query(f"""SELECT 'thin_mentions' AS finding_type, entity_id, canonical_name, 'mentions' AS detail_key, CAST(mentions AS VARCHAR) AS detail_value FROM ({_THIN})
UNION ALL SELECT 'short_snippet', entity_id, canonical_name, 'tokens', CAST(tokens AS VARCHAR) FROM ({_SHORT})
UNION ALL SELECT 'narrow_spread', entity_id, canonical_name, 'span_us', CAST(span_us AS VARCHAR) FROM ({_NARROW})""")
def audit_findings_long(spark, d):
    t = _Tables(spark, d)
    return mentions.findings(t.entities, t.provenance, 3, 12, 1)


_COLLIDED = """(SELECT DISTINCT lower(a.alias) AS alias, e.entity_id, e.canonical_name, e.entity_type FROM entity_aliases a JOIN entities e USING (entity_id)
WHERE lower(a.alias) IN (SELECT lower(alias) FROM entity_aliases JOIN entities USING (entity_id) GROUP BY 1 HAVING count(DISTINCT entity_id) > 1))"""


@query(f"SELECT * FROM {_COLLIDED}")
def alias_collisions(spark, d):
    t = _Tables(spark, d)
    return mentions.collisions(t.entity_aliases, t.entities)


_SCORED = f"""(WITH m AS (SELECT c.*, (SELECT count(*) FROM provenance p WHERE p.entity_id = c.entity_id) AS n FROM {_COLLIDED} c)
SELECT alias, count(*) AS members, CAST(sum(n) AS BIGINT) AS mentions, count(DISTINCT entity_type) = 1 AS same_type,
first(entity_id ORDER BY n DESC, canonical_name, entity_id) AS merge_target FROM m GROUP BY alias)"""


@query(f"SELECT * FROM {_SCORED}")
def score_alias_collisions(spark, d):
    t = _Tables(spark, d)
    return mentions.scored_collisions(t.entity_aliases, t.entities, t.provenance)


@query(f"SELECT c.entity_id AS old_id, min(s.merge_target) AS new_id FROM {_COLLIDED} c JOIN {_SCORED} s USING (alias) WHERE s.same_type AND c.entity_id <> s.merge_target GROUP BY 1")
def proposed_merges(spark, d):
    t = _Tables(spark, d)
    return mentions.proposed_merges(t.entity_aliases, t.entities, t.provenance)


# ---------------------------------------------------------------- relationships
_R = "source_id, target_id, relation_type, document_id"


def _edge(df):
    return df.select("source_id", "target_id", "relation_type", "document_id")


@query(f"SELECT {_R} FROM relationships WHERE source_id = '{HOT}' UNION ALL SELECT {_R} FROM relationships WHERE target_id = '{HOT}'")
def relationships_for_entity(spark, d):
    return _edge(lookups.relationships_for(_Tables(spark, d).relationships, HOT))


_PAIR = "(SELECT min(target_id) FROM relationships WHERE source_id = '" + HOT + "')"


@query(f"SELECT {_R} FROM relationships WHERE source_id = '{HOT}' AND target_id = {_PAIR}")
def relationships_between(spark, d):
    r = _Tables(spark, d).relationships
    target = r.where(F.col("source_id") == HOT).agg(F.min("target_id").alias("target_id"))
    return _edge(r.where(F.col("source_id") == HOT).join(F.broadcast(target), "target_id", "left_semi"))


@query(f"SELECT {_R}, qualifier_id FROM relationships WHERE qualifier_id IN (SELECT entity_id FROM entities WHERE entity_type = 'person')")
def relationships_by_qualifier(spark, d):
    t = _Tables(spark, d)
    return lookups.by_ids(t.relationships, lookups.by_type(t.entities, "person").select("entity_id"), "qualifier_id").select("source_id", "target_id", "relation_type", "document_id", "qualifier_id")


@query(f"SELECT {_R} FROM relationships WHERE relation_kind_id IS NULL")
def relationships_by_kind(spark, d):
    return _edge(_Tables(spark, d).relationships.where("relation_kind_id is null"))


@query(f"SELECT {_R} FROM relationships WHERE relation_type = 'owns'")
def relationships_by_type(spark, d):
    return _edge(lookups.listed_relationships(_Tables(spark, d).relationships, relation_type="owns"))


@query(f"SELECT {_R} FROM relationships WHERE document_id IN (SELECT document_id FROM provenance WHERE run_id = '{RUN_A}')")
def relationships_by_document(spark, d):
    t = _Tables(spark, d)
    return _edge(lookups.by_ids(t.relationships, t.provenance.where(F.col("run_id") == RUN_A).select("document_id"), "document_id"))


@query(f"SELECT {_R}, coalesce(epoch_us(valid_from), -1) AS from_us FROM relationships WHERE (valid_from IS NULL OR valid_from <= {_TS}) AND (valid_until IS NULL OR valid_until >= {_TS})")
def relationships_as_of(spark, d):
    return lookups.as_of(_Tables(spark, d).relationships, _now()).select("source_id", "target_id", "relation_type", "document_id", F.coalesce(c.micros("valid_from"), F.lit(-1)).alias("from_us"))


@query(f"SELECT {_R}, confidence FROM relationships WHERE confidence >= 0.9")
def relationships_min_confidence(spark, d):
    return lookups.min_confidence(_Tables(spark, d).relationships, 0.9).select("source_id", "target_id", "relation_type", "document_id", "confidence")


@query(f"SELECT {_R} FROM relationships WHERE valid_until IS NULL OR valid_until > {_TS}")
def active_relationships(spark, d):
    return _edge(lookups.active(_Tables(spark, d).relationships, _now()))


@query("SELECT DISTINCT source_id, target_id, relation_type, coalesce(epoch_us(valid_from), -1) AS from_us FROM relationships")
def relationship_dedup(spark, d):
    return graph.dedup_edges(_Tables(spark, d).relationships).select("source_id", "target_id", "relation_type", F.coalesce(c.micros("valid_from"), F.lit(-1)).alias("from_us"))


@query(f"""SELECT DISTINCT source_id, target_id, relation_type, coalesce(epoch_us(valid_from), -1) AS from_us FROM relationships r WHERE confidence >= 0.5
AND NOT coalesce(valid_until < valid_from, false) AND NOT EXISTS (SELECT 1 FROM relationships q WHERE (q.confidence < 0.5 OR q.confidence IS NULL) AND q.source_id = r.source_id AND q.target_id = r.target_id
AND q.relation_type = r.relation_type AND q.valid_from IS NOT DISTINCT FROM r.valid_from)""")
def relationship_save(spark, d):
    r = _Tables(spark, d).relationships
    return graph.save_edges(r.where("confidence >= 0.5"), r.where("confidence < 0.5 or confidence is null")).select("source_id", "target_id", "relation_type", F.coalesce(c.micros("valid_from"), F.lit(-1)).alias("from_us"))


@query("SELECT source_id, target_id, relation_type, epoch_us(valid_from) AS from_us, epoch_us(valid_until) AS until_us FROM relationships WHERE valid_until < valid_from")
def temporal_violations(spark, d):
    return _Tables(spark, d).relationships.where(graph.temporal_violation()).select("source_id", "target_id", "relation_type", c.micros("valid_from").alias("from_us"), c.micros("valid_until").alias("until_us"))


@query(f"""WITH rules(s, t, l) AS (VALUES {_RULES})
SELECT r.source_id, r.target_id, r.relation_type, a.entity_type AS source_type, b.entity_type AS target_type,
CASE WHEN EXISTS (SELECT 1 FROM rules WHERE s = a.entity_type AND t = b.entity_type) THEN 'label' ELSE 'pair' END AS problem
FROM relationships r JOIN entities a ON a.entity_id = r.source_id JOIN entities b ON b.entity_id = r.target_id
WHERE NOT EXISTS (SELECT 1 FROM rules WHERE s = a.entity_type AND t = b.entity_type AND l = r.relation_type)""")
def audit_relationship_constraints(spark, d):
    t = _Tables(spark, d)
    rules = spark.createDataFrame(schemas.RULE_ROWS, "source_type string, target_type string, label string")
    return graph.checked(t.relationships, t.entities, rules).select("source_id", "target_id", "relation_type", "source_type", "target_type", "problem")


@query(f"""SELECT DISTINCT {_R}, coalesce(epoch_us(valid_from), -1) AS from_us, confidence FROM relationships
WHERE source_id IN (SELECT entity_id FROM entities WHERE entity_type = 'place') OR target_id IN (SELECT entity_id FROM entities WHERE entity_type = 'place')""")
def export_relationships(spark, d):
    t = _Tables(spark, d)
    return lookups.touching(t.relationships, lookups.by_type(t.entities, "place")).select("source_id", "target_id", "relation_type", "document_id", F.coalesce(c.micros("valid_from"), F.lit(-1)).alias("from_us"), "confidence").distinct()


_BOTH = "(SELECT source_id AS a, target_id AS b FROM relationships WHERE confidence >= 0.5 UNION ALL SELECT target_id, source_id FROM relationships WHERE confidence >= 0.5)"
_WALK = f"""WITH RECURSIVE walk(entity_id, depth) AS (SELECT '{HOT}', 0 UNION SELECT b, depth + 1 FROM walk JOIN {_BOTH} ON a = entity_id WHERE depth < 2),
near AS (SELECT entity_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1)"""


@query(f"{_WALK} SELECT * FROM near")
def k_hop_nodes(spark, d):
    return graph.k_hop(_Tables(spark, d).relationships, HOT, 2, 0.5)[0]


@query(f"""{_WALK} SELECT DISTINCT source_id, target_id, relation_type, coalesce(epoch_us(valid_from), -1) AS from_us FROM relationships
WHERE confidence >= 0.5 AND (source_id IN (SELECT entity_id FROM near WHERE depth < 2) OR target_id IN (SELECT entity_id FROM near WHERE depth < 2))""")
def k_hop_edges(spark, d):
    return graph.k_hop(_Tables(spark, d).relationships, HOT, 2, 0.5)[1].select("source_id", "target_id", "relation_type", F.coalesce(c.micros("valid_from"), F.lit(-1)).alias("from_us"))


# ---------------------------------------------------------------- history
_LOG = """(SELECT s.*, snapshot_id AS history_id, CASE WHEN row_number() OVER w = 1 THEN 'create'
WHEN status = 'merged' AND lag(status) OVER w IS DISTINCT FROM 'merged' THEN 'merge' ELSE 'update' END AS operation
FROM (SELECT DISTINCT * FROM entity_snapshots) s WINDOW w AS (PARTITION BY entity_id ORDER BY snapshot_id))"""


@query(f"SELECT history_id, operation, epoch_us(snapshot_at) AS changed_us, canonical_name, status FROM {_LOG} WHERE entity_id = '{HOT}'")
def entity_history(spark, d):
    log = graph.revisions(_Tables(spark, d).entity_snapshots.where(F.col("entity_id") == HOT))
    return log.select("history_id", "operation", c.micros("changed_at").alias("changed_us"), "canonical_name", "status")


@query(f"SELECT entity_id, max(history_id) AS history_id, max_by(canonical_name, history_id) AS canonical_name, max_by(operation, history_id) AS operation FROM {_LOG} WHERE snapshot_at <= {_TS} GROUP BY 1")
def entity_as_of(spark, d):
    log = graph.revisions(_Tables(spark, d).entity_snapshots)
    return graph.state_at(log, _now()).select("entity_id", "history_id", "canonical_name", "operation")


@query(f"""SELECT (SELECT max(snapshot_id) FROM entity_snapshots) + 1 AS history_id, 'revert' AS operation, entity_id, canonical_name, status FROM {_LOG}
WHERE entity_id = '{HOT}' AND history_id = (SELECT min(snapshot_id) FROM entity_snapshots WHERE entity_id = '{HOT}')""")
def revert_entity(spark, d):
    log = graph.revisions(_Tables(spark, d).entity_snapshots)
    first = log.where(F.col("entity_id") == HOT).agg(F.min("history_id").alias("history_id"))
    return graph.revert(log, HOT, first, _now()).select("history_id", "operation", "entity_id", "canonical_name", "status")


@query(f"SELECT source_id, target_id, relation_type, epoch_us(discovered_at) AS changed_us, 'create' AS operation FROM relationships WHERE source_id = '{SECOND}' OR target_id = '{SECOND}'")
def relationship_history(spark, d):
    """Every relationship row is a revision that created it."""
    r = _Tables(spark, d).relationships
    return r.where((F.col("source_id") == SECOND) | (F.col("target_id") == SECOND)).select("source_id", "target_id", "relation_type", c.micros("discovered_at").alias("changed_us"), F.lit("create").alias("operation"))


@query(f"""SELECT e.entity_id, epoch_us(coalesce(e.created_at, min(s.snapshot_at))) AS created_us, epoch_us(coalesce(e.updated_at, max(s.snapshot_at))) AS updated_us
FROM entities e LEFT JOIN entity_snapshots s USING (entity_id) GROUP BY e.entity_id, e.created_at, e.updated_at""")
def backfill_entity_timestamps(spark, d):
    t = _Tables(spark, d)
    s = t.entity_snapshots.groupBy("entity_id").agg(F.min("snapshot_at").alias("lo"), F.max("snapshot_at").alias("hi"))
    return t.entities.join(s, "entity_id", "left").select("entity_id", c.micros(F.coalesce("created_at", "lo")).alias("created_us"), c.micros(F.coalesce("updated_at", "hi")).alias("updated_us"))


_CLOSED = """closed AS (WITH RECURSIVE m AS (SELECT entity_id AS old_id, merged_into AS new_id FROM entities WHERE merged_into IS NOT NULL AND merged_into <> entity_id),
go(old_id, new_id, n) AS (SELECT old_id, new_id, 1 FROM m UNION ALL SELECT g.old_id, m.new_id, n + 1 FROM go g JOIN m ON g.new_id = m.old_id WHERE n < 60)
SELECT old_id, new_id FROM go WHERE new_id NOT IN (SELECT old_id FROM m))"""


def _merges(t):
    return graph.closed_merges(t.entities.where("merged_into is not null").select(F.col("entity_id").alias("old_id"), F.col("merged_into").alias("new_id")))


@query(f"WITH {_CLOSED} SELECT DISTINCT coalesce(new_id, entity_id) AS entity_id, document_id, mention_text FROM provenance LEFT JOIN closed ON old_id = entity_id WHERE entity_id IS NOT NULL")
def merge_redirect_provenance(spark, d):
    t = _Tables(spark, d)
    return graph.redirect_provenance(t.provenance, _merges(t)).select("entity_id", "document_id", "mention_text")


@query(f"""WITH {_CLOSED} SELECT DISTINCT coalesce(a.new_id, source_id) AS source_id, coalesce(b.new_id, target_id) AS target_id, relation_type, coalesce(epoch_us(valid_from), -1) AS from_us
FROM relationships LEFT JOIN closed a ON a.old_id = source_id LEFT JOIN closed b ON b.old_id = target_id""")
def merge_redirect_relationships(spark, d):
    t = _Tables(spark, d)
    return graph.redirect_relationships(t.relationships, _merges(t)).select("source_id", "target_id", "relation_type", F.coalesce(c.micros("valid_from"), F.lit(-1)).alias("from_us"))


# ---------------------------------------------------------------- counts
@query("SELECT entity_type, count(*) AS entities FROM entities GROUP BY 1")
def count_entities_by_type(spark, d):
    return _Tables(spark, d).entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"))


@query("SELECT entity_type, coalesce(subtype, '') AS subtype, count(*) AS entities FROM entities GROUP BY 1, 2")
def count_by_type_subtype(spark, d):
    return _Tables(spark, d).entities.groupBy("entity_type", F.coalesce("subtype", F.lit("")).alias("subtype")).agg(F.count(F.lit(1)).alias("entities"))


_COUNTED = ("articles", "entities", "entity_aliases", "provenance", "relationships", "ingestion_runs")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS table_rows FROM {n}" for n in _COUNTED))
def table_counts(spark, d):
    out = None
    for n in _COUNTED:
        one = read_table(spark, d, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("table_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT source, count(*) AS articles FROM articles GROUP BY 1")
def articles_by_source(spark, d):
    return ar.by_source(_Tables(spark, d).articles)


@query(f"SELECT source, max(epoch_us(scraped_at)) AS last_us, round(({int(1714694400000000)} - max(epoch_us(scraped_at))) / 3.6e9, 2) AS hours_ago FROM articles GROUP BY 1")
def last_seen_per_source(spark, d):
    return ar.last_seen(_Tables(spark, d).articles, _now())


@query("SELECT epoch_us(scraped_at) AS batch_us, count(*) AS articles, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM articles GROUP BY scraped_at ORDER BY scraped_at DESC LIMIT 5")
def recent_batches(spark, d):
    return ar.recent_batches(_Tables(spark, d).articles)


@query("""SELECT count(*) AS articles, count(*) FILTER (trim(coalesce(body, '')) = '') AS empty_body, count(*) FILTER (trim(coalesce(title, '')) = '') AS empty_title,
count(*) FILTER (published IS NULL) AS missing_published, count(*) FILTER (length(coalesce(body, '')) < 50) AS short_body,
(SELECT count(*) FROM (SELECT document_id FROM articles GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids,
(SELECT count(*) FROM (SELECT url FROM articles GROUP BY 1 HAVING count(*) > 1)) AS repeated_urls FROM articles""")
def data_quality(spark, d):
    return ar.quality(_Tables(spark, d).articles)


@query("""SELECT CAST(CAST(g AS DATE) AS VARCHAR) AS day, (SELECT count(*) FROM articles WHERE CAST(scraped_at AT TIME ZONE 'UTC' AS DATE) = CAST(g AS DATE)) AS articles,
(SELECT count(*) FROM articles WHERE CAST(scraped_at AT TIME ZONE 'UTC' AS DATE) = CAST(g AS DATE)) = 0 AND CAST(g AS DATE) < DATE '2024-05-06' AS gap
FROM generate_series(DATE '2024-04-29', DATE '2024-05-06', INTERVAL 1 DAY) t(g)""")
def daily_coverage_gaps(spark, d):
    return ar.daily_coverage(_Tables(spark, d).articles, "2024-05-06")


# ---------------------------------------------------------------- articles
_HASH = r"sha256(trim(regexp_replace(lower(body), '[\s\p{Z}]+', ' ', 'g')))"


@query(f"SELECT {_HASH} AS content_hash, count(*) AS copies, min(document_id) AS first_document_id FROM articles WHERE body IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup(spark, d):
    return ar.content_duplicates(_Tables(spark, d).articles)


_BATCH = "TIMESTAMPTZ '2024-04-30 04:00:00+00'"


@query(f"""WITH a AS (SELECT document_id, url, scraped_at, CASE WHEN trim(coalesce(body, '')) <> '' THEN {_HASH} END AS h FROM articles),
b AS (SELECT * FROM a WHERE scraped_at >= {_BATCH} QUALIFY row_number() OVER (PARTITION BY coalesce(h, document_id) ORDER BY document_id) = 1),
n AS (SELECT * FROM b WHERE (h IS NULL OR h NOT IN (SELECT h FROM a WHERE scraped_at < {_BATCH} AND h IS NOT NULL)) QUALIFY row_number() OVER (PARTITION BY url ORDER BY document_id) = 1)
SELECT document_id, url FROM n WHERE url NOT IN (SELECT url FROM a WHERE scraped_at < {_BATCH})""")
def article_save(spark, d):
    a = _Tables(spark, d).articles
    at = F.lit("2024-04-30 04:00:00").cast("timestamp")
    return ar.save(a.where(F.col("scraped_at") >= at), a.where(F.col("scraped_at") < at)).select("document_id", "url")


@query("SELECT document_id, source, epoch_us(scraped_at) AS scraped_us FROM articles WHERE source = 'harborwire' ORDER BY scraped_at DESC, document_id LIMIT 10 OFFSET 5")
def articles_page(spark, d):
    return ar.page(_Tables(spark, d).articles, "harborwire", 10, 5).select("document_id", "source", c.micros("scraped_at").alias("scraped_us"))


@query("""SELECT url, CAST(min(CAST(published AT TIME ZONE 'UTC' AS DATE)) AS VARCHAR) AS day FROM articles
WHERE CAST(published AT TIME ZONE 'UTC' AS DATE) BETWEEN DATE '2024-04-01' AND DATE '2024-04-30' GROUP BY url""")
def backfill_day_range(spark, d):
    return ar.backfill(_Tables(spark, d).articles, "2024-04-01", "2024-04-30").select("url", F.col("day").cast("string").alias("day"))


@query("SELECT document_id FROM articles WHERE replace(document_id, '-', '') NOT IN (SELECT replace(document_id, '-', '') FROM provenance WHERE run_id < '8')")
def unprocessed_documents(spark, d):
    t = _Tables(spark, d)
    return ar.unprocessed(t.articles, t.provenance.where("run_id < '8'")).select("document_id")


_FAILED = "(SELECT DISTINCT run_id, document_id FROM provenance WHERE run_id IN (SELECT run_id FROM ingestion_runs WHERE status = 'failed'))"


@query(f"SELECT * FROM {_FAILED}")
def failed_documents(spark, d):
    t = _Tables(spark, d)
    return merging.failed_documents(t.provenance, t.ingestion_runs)


@query(f"SELECT document_id, source FROM articles WHERE replace(document_id, '-', '') IN (SELECT replace(document_id, '-', '') FROM {_FAILED})")
def resume_failed_documents(spark, d):
    t = _Tables(spark, d)
    return ar.by_document(t.articles, merging.failed_documents(t.provenance, t.ingestion_runs).select("document_id")).select("document_id", "source")


# ---------------------------------------------------------------- runs
@query("SELECT run_id, status, epoch_us(started_at) AS started_us FROM ingestion_runs ORDER BY started_at DESC, run_id LIMIT 10")
def recent_runs(spark, d):
    return merging.recent_runs(_Tables(spark, d).ingestion_runs).select("run_id", "status", c.micros("started_at").alias("started_us"))


@query(f"SELECT DISTINCT entity_id FROM provenance WHERE run_id = '{RUN_A}' AND entity_id IS NOT NULL")
def entities_touched_by_run(spark, d):
    return merging.touched(_Tables(spark, d).provenance, RUN_A)


def _diff_sql(cols: str, table: str, cond: str = "TRUE") -> str:
    side = lambda r: f"(SELECT DISTINCT {cols} FROM {table} WHERE run_id = '{r}' AND {cond})"
    return f"""SELECT *, 'base' AS side FROM ({side(RUN_A)} EXCEPT {side(RUN_B)}) UNION ALL SELECT *, 'head' FROM ({side(RUN_B)} EXCEPT {side(RUN_A)})
UNION ALL SELECT *, 'both' FROM ({side(RUN_A)} INTERSECT {side(RUN_B)})"""


@query(_diff_sql("entity_id", "provenance", "entity_id IS NOT NULL"))
def run_diff_entities(spark, d):
    p = _Tables(spark, d).provenance
    return merging.diff(merging.touched(p, RUN_A), merging.touched(p, RUN_B))


@query(_diff_sql("source_id, target_id, relation_type", "relationships"))
def run_diff_relationships(spark, d):
    r = _Tables(spark, d).relationships
    return merging.diff(merging.edge_keys(r, RUN_A), merging.edge_keys(r, RUN_B))


@query("""SELECT run_id, coalesce(documents, 0) AS documents, coalesce(mentions, 0) AS mentions, coalesce(entities, 0) AS entities, coalesce(relationships, 0) AS relationships FROM ingestion_runs
LEFT JOIN (SELECT run_id, count(DISTINCT document_id) AS documents, count(*) AS mentions, count(DISTINCT entity_id) AS entities FROM provenance GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS relationships FROM relationships GROUP BY 1) USING (run_id)""")
def run_stats(spark, d):
    t = _Tables(spark, d)
    return merging.run_stats(t.provenance, t.relationships, t.ingestion_runs)


# ---------------------------------------------------------------- quality over time
_SNAP = f"""(SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relationships) AS relationships, (SELECT count(*) FROM provenance) AS mentions,
(SELECT count(DISTINCT alias) FROM {_COLLIDED}) AS alias_collisions,
(SELECT alias FROM {_COLLIDED} GROUP BY alias ORDER BY count(*) DESC, alias LIMIT 1) AS worst_alias, (SELECT count(*) FROM {_COLLIDED} GROUP BY alias ORDER BY count(*) DESC, alias LIMIT 1) AS worst_members,
round((SELECT count(*) FROM provenance) / (SELECT count(*) FROM entities), 6) AS density)"""


@query(f"SELECT * FROM {_SNAP}")
def quality_snapshot(spark, d):
    t = _Tables(spark, d)
    return merging.quality_snapshot(t.entities, t.relationships, t.provenance, mentions.collisions(t.entity_aliases, t.entities))


@query(f"""WITH n AS (SELECT * FROM {_SNAP}), o AS (SELECT (SELECT count(*) FROM entities WHERE created_at < TIMESTAMPTZ '2024-06-01 00:00:00+00') AS entities,
(SELECT count(*) FROM relationships WHERE discovered_at < TIMESTAMPTZ '2024-05-02 00:00:00+00') AS relationships, (SELECT count(*) FROM provenance WHERE detected_at < TIMESTAMPTZ '2024-05-02 00:00:00+00') AS mentions, 0 AS alias_collisions),
v AS (SELECT unnest(['entities', 'relationships', 'mentions', 'alias_collisions']) AS total, unnest([o.entities, o.relationships, o.mentions, o.alias_collisions]) AS old, unnest([n.entities, n.relationships, n.mentions, n.alias_collisions]) AS new FROM o, n)
SELECT total, old, new, round(CASE WHEN old > 0 THEN (old - new) * 100.0 / old ELSE 0 END, 6) AS drop, CASE WHEN total = 'alias_collisions' THEN new - old <= 5 ELSE (CASE WHEN old > 0 THEN (old - new) * 100.0 / old ELSE 0 END) <= 10 END AS ok FROM v""")
def snapshot_compare(spark, d):
    t = _Tables(spark, d)
    new = merging.quality_snapshot(t.entities, t.relationships, t.provenance, mentions.collisions(t.entity_aliases, t.entities))
    before = lambda m: F.lit(m).cast("timestamp")
    none = mentions.collisions(t.entity_aliases, t.entities).limit(0)
    old = merging.quality_snapshot(t.entities.where(F.col("created_at") < before("2024-06-01")), t.relationships.where(F.col("discovered_at") < before("2024-05-02")), t.provenance.where(F.col("detected_at") < before("2024-05-02")), none)
    keep = ["entities", "relationships", "mentions", "alias_collisions"]
    return merging.compare_snapshots(old.select(keep), new.select(keep), 10, 5)


@query("""SELECT count(*) FILTER (e.hit AND e.want) AS tp, count(*) FILTER (e.hit AND NOT e.want) AS fp, count(*) FILTER (NOT e.hit AND e.want) AS fn,
round(count(*) FILTER (e.hit AND e.want) / greatest(count(*) FILTER (e.hit), 1), 6) AS precision, round(count(*) FILTER (e.hit AND e.want) / greatest(count(*) FILTER (e.want), 1), 6) AS recall,
round(2 * count(*) FILTER (e.hit AND e.want) / greatest(count(*) FILTER (e.hit) + count(*) FILTER (e.want), 1), 6) AS f1
FROM (SELECT entity_id, document_id, bool_or(lower(mention_text) = lower(canonical_name)) AS hit, bool_or(detected_at IS NOT NULL) AS want
      FROM provenance JOIN entities USING (entity_id) GROUP BY 1, 2) e""")
def precision_recall(spark, d):
    """Mentions found by the canonical name alone, against all dated mentions."""
    t = _Tables(spark, d)
    p = t.provenance.join(t.entities.select("entity_id", "canonical_name"), "entity_id")
    return merging.precision_recall(p.where("lower(mention_text) = lower(canonical_name)"), p.where("detected_at is not null"), "entity_id", "document_id")


@query("""SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM provenance) AS mentions, (SELECT count(*) FROM relationships) AS relationships, (SELECT count(*) FROM articles) AS articles,
(SELECT run_id FROM ingestion_runs ORDER BY started_at DESC, run_id LIMIT 1) AS latest_run, (SELECT status FROM ingestion_runs ORDER BY started_at DESC, run_id LIMIT 1) AS latest_status""")
def health_summary(spark, d):
    t = _Tables(spark, d)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = n(t.entities, "entities").crossJoin(n(t.provenance, "mentions")).crossJoin(n(t.relationships, "relationships")).crossJoin(n(t.articles, "articles"))
    last = merging.recent_runs(t.ingestion_runs, 1).select(F.col("run_id").alias("latest_run"), F.col("status").alias("latest_status"))
    return one.crossJoin(last)


# ---------------------------------------------------------------- merging results
_PROPOSED = """(SELECT replace(p.document_id, '-', '') AS document_id, CAST(p.prov_id % 5 AS INTEGER) AS chunk_index, p.mention_text AS canonical_name,
coalesce(CASE WHEN p.prov_id % 7 > 0 THEN e.entity_type END, 'topic') AS entity_type, p.context_snippet AS description, p.prov_id FROM provenance p LEFT JOIN entities e USING (entity_id))"""


def _proposed(t):
    """Mentions as the proposals of five chunks for each document."""
    p = t.provenance.join(t.entities.select("entity_id", "entity_type"), "entity_id", "left")
    return p.select(c.hex_id("document_id").alias("document_id"), (F.col("prov_id") % 5).cast("int").alias("chunk_index"), F.col("mention_text").alias("canonical_name"), F.coalesce(F.when(F.col("prov_id") % 7 > 0, F.col("entity_type")), F.lit("topic")).alias("entity_type"), F.col("context_snippet").alias("description"))


@query(f"""SELECT document_id, entity_type, canonical_name, description, chunk_index FROM {_PROPOSED} r
WHERE (document_id, lower(canonical_name)) NOT IN (SELECT (document_id, lower(canonical_name)) FROM {_PROPOSED} GROUP BY document_id, lower(canonical_name) HAVING count(DISTINCT entity_type) > 1)
QUALIFY row_number() OVER (PARTITION BY document_id, lower(canonical_name), entity_type ORDER BY length(description) DESC, chunk_index, canonical_name, description) = 1""")
def merge_proposals(spark, d):
    return merging.proposals(_proposed(_Tables(spark, d)))


@query(f"SELECT document_id, lower(canonical_name) AS name, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types FROM {_PROPOSED} GROUP BY 1, 2 HAVING count(DISTINCT entity_type) > 1")
def proposal_conflicts(spark, d):
    return merging.conflicts(_proposed(_Tables(spark, d)))


@query("""SELECT coalesce(document_id, '') AS document_id, source_id, target_id, relation_type, description AS snippet, CAST(length(description) % 3 AS INTEGER) AS chunk_index FROM relationships
QUALIFY row_number() OVER (PARTITION BY document_id, source_id, target_id, relation_type ORDER BY length(description) DESC, length(description) % 3, description) = 1""")
def merge_relationships(spark, d):
    r = _Tables(spark, d).relationships.select(F.coalesce("document_id", F.lit("")).alias("document_id"), "source_id", "target_id", "relation_type", F.col("description").alias("snippet"), (F.length("description") % 3).alias("chunk_index"))
    return merging.relationships(r)


@query("""WITH x AS (SELECT s.entity_id, s.snapshot_id, s.canonical_name, a.alias FROM (SELECT DISTINCT * FROM entity_snapshots) s LEFT JOIN entity_aliases a USING (entity_id))
SELECT entity_id, first(canonical_name ORDER BY snapshot_id) AS canonical_name, coalesce(string_agg(DISTINCT alias, '|' ORDER BY alias), '') AS aliases FROM x GROUP BY 1""")
def dedupe_union_aliases(spark, d):
    """Records of one id from several dumps: the first stays, and the aliases are united."""
    t = _Tables(spark, d)
    rows = lookups.with_aliases(t.entity_snapshots.dropDuplicates(["snapshot_id"]), t.entity_aliases)
    return merging.united_aliases(rows, "entity_id", "snapshot_id").select("entity_id", "canonical_name", F.array_join(F.array_sort("aliases"), "|").alias("aliases"))


@query("""SELECT min(snapshot_id) AS seed_id, lower(canonical_name) AS name, entity_type FROM entity_snapshots s
WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE lower(e.canonical_name) = lower(s.canonical_name) AND e.entity_type = s.entity_type) GROUP BY 2, 3""")
def seed_import_dedup(spark, d):
    t = _Tables(spark, d)
    seed = t.entity_snapshots.select(F.col("snapshot_id").alias("seed_id"), "canonical_name", "entity_type", "description")
    return merging.seed_import(seed, t.entities).select("seed_id", F.lower("canonical_name").alias("name"), "entity_type")


@query("""SELECT snapshot_id, entity_id FROM (SELECT DISTINCT * FROM entity_snapshots) s WHERE entity_id NOT IN (SELECT entity_id FROM entities WHERE status = 'active')
AND NOT EXISTS (SELECT 1 FROM entities e WHERE lower(e.canonical_name) = lower(s.canonical_name) AND e.entity_type = s.entity_type)""")
def external_import_dedup(spark, d):
    t = _Tables(spark, d)
    rows = t.entity_snapshots.dropDuplicates(["snapshot_id"]).withColumn("external_id", F.col("entity_id"))
    held = lookups.by_status(t.entities, "active").select(F.col("entity_id").alias("external_id"))
    return merging.external_import(rows, t.entities, held).select("snapshot_id", "entity_id")


# ---------------------------------------------------------------- cookbook
@query(f"""SELECT p.entity_id, e.canonical_name, count(DISTINCT p.document_id) AS documents, count(*) AS mentions FROM provenance p JOIN entities e USING (entity_id)
WHERE e.status = 'active' AND p.detected_at >= {_TS} - INTERVAL 7 DAY GROUP BY 1, 2 ORDER BY documents DESC, mentions DESC, p.entity_id LIMIT 20""")
def cookbook_most_mentioned(spark, d):
    t = _Tables(spark, d)
    p = t.provenance.where(F.col("detected_at") >= _now() - F.expr("INTERVAL 7 DAYS")).groupBy("entity_id").agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("mentions"))
    rows = p.join(lookups.by_status(t.entities, "active").select("entity_id", "canonical_name"), "entity_id")
    return rows.select("entity_id", "canonical_name", "documents", "mentions").orderBy(F.desc("documents"), F.desc("mentions"), "entity_id").limit(20)


@query("""SELECT p.entity_id, e.canonical_name, count(*) AS mentions FROM provenance p JOIN entities e USING (entity_id) WHERE e.entity_type = 'person' GROUP BY 1, 2 ORDER BY mentions DESC, p.entity_id LIMIT 25""")
def cookbook_most_mentioned_by_type(spark, d):
    t = _Tables(spark, d)
    n = mentions.counts(lookups.by_type(t.entities, "person"), t.provenance).where("mentions > 0").join(t.entities.select("entity_id", "canonical_name"), "entity_id")
    return n.select("entity_id", "canonical_name", "mentions").orderBy(F.desc("mentions"), "entity_id").limit(25)


@query("SELECT relation_type, count(*) AS edges, round(avg(confidence), 6) AS mean_confidence FROM relationships GROUP BY 1")
def cookbook_relation_types(spark, d):
    return graph.histogram(_Tables(spark, d).relationships)


@query("""WITH p AS (SELECT DISTINCT document_id, entity_id FROM provenance WHERE entity_id IS NOT NULL AND document_id IS NOT NULL)
SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, count(*) AS documents FROM p a JOIN p b USING (document_id) WHERE a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY documents DESC, 1, 2 LIMIT 20""")
def cookbook_co_mentions(spark, d):
    return mentions.co_mention_pairs(_Tables(spark, d).provenance).orderBy(F.desc("documents"), "entity_a", "entity_b").limit(20)


@query(f"SELECT alias, count(*) AS members, string_agg(canonical_name, ' | ' ORDER BY canonical_name) AS names FROM {_COLLIDED} GROUP BY 1")
def cookbook_alias_collisions(spark, d):
    t = _Tables(spark, d)
    return mentions.collisions(t.entity_aliases, t.entities).groupBy("alias").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.sort_array(F.collect_list("canonical_name")), " | ").alias("names"))


@query("SELECT r.source_id, a.canonical_name AS source_name, r.relation_type, b.canonical_name AS target_name, r.confidence FROM relationships r JOIN entities a ON a.entity_id = r.source_id JOIN entities b ON b.entity_id = r.target_id WHERE r.confidence >= 0.8")
def cookbook_high_confidence(spark, d):
    t = _Tables(spark, d)
    return lookups.named(lookups.min_confidence(t.relationships, 0.8), t.entities).select("source_id", "source_name", "relation_type", "target_name", "confidence")


@query("SELECT entity_id, canonical_name, merged_into, epoch_us(updated_at) AS updated_us FROM entities WHERE status = 'merged' AND merged_into IS NOT NULL")
def cookbook_merge_history(spark, d):
    return lookups.by_status(_Tables(spark, d).entities, "merged").where("merged_into is not null").select("entity_id", "canonical_name", "merged_into", c.micros("updated_at").alias("updated_us"))


@query(f"SELECT prov_id, document_id, source, epoch_us(detected_at) AS detected_us FROM provenance WHERE entity_id = '{HOT}' AND detected_at IS NOT NULL")
def cookbook_timeline(spark, d):
    p = _Tables(spark, d).provenance
    return p.where((F.col("entity_id") == HOT) & F.col("detected_at").isNotNull()).orderBy("detected_at", "prov_id").select("prov_id", "document_id", "source", c.micros("detected_at").alias("detected_us"))


@query(f"SELECT e.entity_id, e.canonical_name, count(*) AS mentions FROM provenance p JOIN entities e USING (entity_id) WHERE p.run_id = '{RUN_A}' GROUP BY 1, 2")
def cookbook_entities_of_run(spark, d):
    t = _Tables(spark, d)
    n = t.provenance.where(F.col("run_id") == RUN_A).groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    return n.join(t.entities.select("entity_id", "canonical_name"), "entity_id").select("entity_id", "canonical_name", "mentions")


@query("""SELECT run_id, status, document_count, CAST(coalesce(n, 0) AS BIGINT) AS mentions, round(epoch_us(finished_at) / 1e6 - epoch_us(started_at) / 1e6, 3) AS seconds
FROM ingestion_runs LEFT JOIN (SELECT run_id, count(*) AS n FROM provenance GROUP BY 1) USING (run_id)""")
def cookbook_run_scorecard(spark, d):
    t = _Tables(spark, d)
    n = t.provenance.groupBy("run_id").agg(F.count(F.lit(1)).alias("mentions"))
    seconds = F.round(c.micros("finished_at") / 1e6 - c.micros("started_at") / 1e6, 3)
    return t.ingestion_runs.join(n, "run_id", "left").select("run_id", "status", "document_count", F.coalesce("mentions", F.lit(0)).alias("mentions"), seconds.alias("seconds"))


# ---------------------------------------------------------------- dictionary and mentions in text
_DICT = "(SELECT DISTINCT lower(n) AS alias, entity_id FROM (SELECT entity_id, canonical_name AS n FROM entities UNION ALL SELECT entity_id, alias FROM entity_aliases WHERE entity_id IN (SELECT entity_id FROM entities)) WHERE n <> '')"
_FOUND = rf"""(WITH a AS MATERIALIZED (SELECT DISTINCT alias, regexp_extract(alias, '[\p{{L}}\p{{N}}]+') AS word FROM {_DICT}),
w AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents),
m AS MATERIALIZED (SELECT d.doc_id, lower(d.text) AS low, a.alias FROM w JOIN a USING (word) JOIN documents d USING (doc_id) WHERE a.word <> '' AND contains(lower(d.text), a.alias))
SELECT CAST(doc_id AS VARCHAR) AS document_id, alias FROM m
WHERE regexp_matches(low, (CASE WHEN regexp_matches(alias, '^[\p{{L}}\p{{N}}]') THEN '(^|[^\p{{L}}\p{{N}}])' ELSE '' END) || regexp_escape(alias) || (CASE WHEN regexp_matches(alias, '[\p{{L}}\p{{N}}]$') THEN '($|[^\p{{L}}\p{{N}}])' ELSE '' END)))"""
_MEANT = f"(SELECT alias, count(DISTINCT entity_id) AS n, min(entity_id) AS entity_id FROM {_DICT} GROUP BY 1)"


def _docs(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("document_id"), "text", "doc_type")


def _dictionary(t):
    return detection.dictionary(t.entities, t.entity_aliases)


@query(f"SELECT * FROM {_DICT}")
def alias_dictionary(spark, d):
    return _dictionary(_Tables(spark, d))


@query(f"SELECT * FROM {_FOUND}")
def detect_mentions(spark, d):
    t = _Tables(spark, d)
    return detection.detect(_docs(t), _dictionary(t)).select("document_id", "alias").distinct()


_SPANS = rf"""(WITH a AS MATERIALIZED (SELECT DISTINCT alias, regexp_extract(alias, '[\p{{L}}\p{{N}}]+') AS word FROM {_DICT}),
w AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM documents),
m AS MATERIALIZED (SELECT d.doc_id, d.text, lower(d.text) AS low, a.alias FROM w JOIN a USING (word) JOIN documents d USING (doc_id) WHERE a.word <> '' AND contains(lower(d.text), a.alias)),
o AS (SELECT *, unnest(list_filter(range(1, length(low) - length(alias) + 2), lambda i: substr(low, i, length(alias)) = alias)) AS i FROM m)
SELECT CAST(doc_id AS VARCHAR) AS document_id, alias, text, CAST(i - 1 AS INTEGER) AS span_start, CAST(i - 1 + length(alias) AS INTEGER) AS span_end FROM o
WHERE (i = 1 OR NOT regexp_matches(substr(low, i - 1, 1), '[\p{{L}}\p{{N}}]') OR NOT regexp_matches(alias, '^[\p{{L}}\p{{N}}]'))
AND (i + length(alias) > length(low) OR NOT regexp_matches(substr(low, i + length(alias), 1), '[\p{{L}}\p{{N}}]') OR NOT regexp_matches(alias, '[\p{{L}}\p{{N}}]$')))"""


@query(f"SELECT document_id, alias, span_start, span_end FROM {_SPANS}")
def detect_mention_spans(spark, d):
    """Every occurrence with its place."""
    t = _Tables(spark, d)
    return detection.detect(_docs(t), _dictionary(t))


@query(f"SELECT f.document_id, f.alias, m.entity_id FROM {_FOUND} f JOIN {_MEANT} m USING (alias) WHERE m.n = 1")
def resolve_unambiguous(spark, d):
    t = _Tables(spark, d)
    return detection.resolved(detection.detect(_docs(t), _dictionary(t)), _dictionary(t)).select("document_id", "alias", "entity_id").distinct()


@query(f"SELECT f.document_id, f.alias, CAST(m.n AS INTEGER) AS candidates FROM {_FOUND} f JOIN {_MEANT} m USING (alias) WHERE m.n > 1")
def unresolved_mentions(spark, d):
    t = _Tables(spark, d)
    return detection.unresolved(detection.detect(_docs(t), _dictionary(t)), _dictionary(t)).select("document_id", "alias", "candidates").distinct()


@query(f"SELECT DISTINCT f.document_id, x.entity_id FROM {_FOUND} f JOIN {_DICT} x USING (alias)")
def document_prescan(spark, d):
    t = _Tables(spark, d)
    return detection.prescan(detection.detect(_docs(t), _dictionary(t)), _dictionary(t))


@query(f"""WITH f AS (SELECT s.*, m.entity_id FROM {_SPANS} s JOIN {_MEANT} m USING (alias) WHERE m.n = 1),
b AS (SELECT *, span_start AS s, span_end AS e, greatest(0, span_start - 100) AS a0, least(length(text), span_end + 100) AS b0 FROM f),
l AS (SELECT *, strpos(substr(text, a0 + 1), ' ') + a0 - 1 AS sp, strpos(reverse(substr(text, e + 1, b0 - e)), ' ') AS back FROM b),
k AS (SELECT *, CASE WHEN a0 > 0 AND sp >= a0 AND sp < s THEN sp + 1 ELSE a0 END AS a1, CASE WHEN b0 < length(text) AND back > 0 THEN b0 - back ELSE b0 END AS b1 FROM l)
SELECT document_id, alias, span_start, span_end, entity_id, (CASE WHEN a1 > 0 THEN '...' ELSE '' END) || substr(text, a1 + 1, b1 - a1) || (CASE WHEN b1 < length(text) THEN '...' ELSE '' END) AS context_snippet FROM k""")
def mention_snippets(spark, d):
    """Resolved occurrences with the text around them."""
    t = _Tables(spark, d)
    found = detection.resolved(detection.detect_with_snippets(_docs(t), _dictionary(t)), _dictionary(t))
    return found.select("document_id", "alias", "span_start", "span_end", "entity_id", "context_snippet")


@query("""WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text, strpos(text, 'percent') - 1 AS s FROM documents WHERE contains(text, 'percent')),
b AS (SELECT *, s + 7 AS e, greatest(0, s - 100) AS a0, least(length(text), s + 107) AS b0 FROM h),
l AS (SELECT *, strpos(substr(text, a0 + 1), ' ') + a0 - 1 AS sp, strpos(reverse(substr(text, e + 1, b0 - e)), ' ') AS back FROM b),
k AS (SELECT *, CASE WHEN a0 > 0 AND sp >= a0 AND sp < s THEN sp + 1 ELSE a0 END AS a1, CASE WHEN b0 < length(text) AND back > 0 THEN b0 - back ELSE b0 END AS b1 FROM l)
SELECT document_id, md5((CASE WHEN a1 > 0 THEN '...' ELSE '' END) || substr(text, a1 + 1, b1 - a1) || (CASE WHEN b1 < length(text) THEN '...' ELSE '' END)) AS snippet FROM k""")
def context_snippet(spark, d):
    """The text around the first 'percent' of each document."""
    h = _docs(_Tables(spark, d)).withColumn("s", F.instr("text", "percent") - 1).where("s >= 0")
    return h.select("document_id", F.md5(c.snippet(F.col("text"), F.col("s"), F.col("s") + 7)).alias("snippet"))


_FORMS = f"(SELECT entity_id, lower(canonical_name) AS form FROM entities WHERE entity_id IN ({_IDS}) UNION SELECT entity_id, lower(alias) FROM entity_aliases WHERE entity_id IN ({_IDS}))"
_MATCHES = f"""(SELECT doc_id, entity_id, CAST(sum(CASE WHEN form <> '' AND contains(low, form) THEN len(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, length(form)) = form)) ELSE 0 END) AS BIGINT) AS matches
FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE doc_type = 'news'), {_FORMS} GROUP BY 1, 2)"""


def _shown(t):
    e = lookups.with_aliases(lookups.by_ids(t.entities, SHOWN), t.entity_aliases)
    ids = sorted(SHOWN)
    chunks = t.documents.where("doc_type = 'news'").select(F.col("doc_id").alias("chunk_id"), "text", F.array(*[F.lit(i) for i in ids]).alias("candidate_ids"))
    return chunks, e


@query(f"SELECT doc_id AS chunk_id, entity_id, matches FROM {_MATCHES}")
def alias_match_counts(spark, d):
    return budget.alias_matches(*_shown(_Tables(spark, d)))


_BLOCK = """'[' || CAST({r} AS VARCHAR) || '] entity_id=' || entity_id || chr(10) || '    name: ' || canonical_name || chr(10) || '    type: ' || entity_type || (CASE WHEN coalesce(subtype, '') <> '' THEN ' / ' || subtype ELSE '' END)
|| (CASE WHEN names <> '' THEN chr(10) || '    aliases: ' || names ELSE '' END) || chr(10) || '    description: ' || coalesce(description, '') || chr(10) || chr(10)"""
_FITTED = f"""fit AS (WITH e AS (SELECT entity_id, canonical_name, entity_type, subtype, description, coalesce((SELECT string_agg(alias, ', ' ORDER BY alias) FROM entity_aliases a WHERE a.entity_id = x.entity_id), '') AS names,
row_number() OVER (ORDER BY entity_id) AS g FROM entities x WHERE entity_id IN ({_IDS})),
r AS (SELECT m.doc_id, 700 - CAST(ceil(length(d.text) / 4.0) AS INTEGER) AS room, e.*, row_number() OVER (PARTITION BY m.doc_id ORDER BY matches DESC, g) AS k FROM {_MATCHES} m JOIN documents d USING (doc_id) JOIN e USING (entity_id)),
s AS (SELECT *, 20 + sum(length({_BLOCK.format(r="g")})) OVER (PARTITION BY doc_id) AS whole, 20 + sum(length({_BLOCK.format(r="k")})) OVER (PARTITION BY doc_id ORDER BY k) AS part FROM r)
SELECT doc_id AS chunk_id, entity_id, CAST(CASE WHEN ceil(whole / 4.0) <= room THEN g ELSE k END AS INTEGER) AS rank, canonical_name, entity_type, subtype, description, names FROM s WHERE room > 0 AND (ceil(whole / 4.0) <= room OR ceil(part / 4.0) <= room))"""


@query(f"WITH {_FITTED} SELECT chunk_id, entity_id, rank FROM fit")
def fit_candidates(spark, d):
    return budget.fitted(*_shown(_Tables(spark, d)), 700)


@query(f"WITH {_FITTED} SELECT chunk_id, md5('CANDIDATE ENTITIES:' || chr(10) || string_agg({_BLOCK.format(r='rank')}, '' ORDER BY rank)) AS block FROM fit GROUP BY 1")
def kg_context_block(spark, d):
    chunks, e = _shown(_Tables(spark, d))
    return budget.context_block(budget.fitted(chunks, e, 700), e).select("chunk_id", F.md5("block").alias("block"))


def _prescanned(t):
    """All documents with the entities that any occurrence in them could mean, and all entities."""
    ids = detection.prescan(detection.detect(_docs(t), _dictionary(t)), _dictionary(t)).groupBy("document_id").agg(F.sort_array(F.collect_list("entity_id")).alias("candidate_ids"))
    return _docs(t).join(ids, "document_id").select(F.col("document_id").cast("long").alias("chunk_id"), "text", "candidate_ids"), lookups.with_aliases(t.entities, t.entity_aliases)


@query()
def alias_match_counts_all(spark, d):
    """As alias_match_counts, over all documents with the candidates that occur in them; checked against brute force in the tests."""
    return budget.alias_matches(*_prescanned(_Tables(spark, d)))


@query()
def fit_candidates_all(spark, d):
    return budget.fitted(*_prescanned(_Tables(spark, d)), 700)


@query()
def kg_context_block_all(spark, d):
    chunks, e = _prescanned(_Tables(spark, d))
    return budget.context_block(budget.fitted(chunks, e, 700), e).select("chunk_id", F.md5("block").alias("block"))


# ---------------------------------------------------------------- segments
_Z = r"[\s\p{Z}\x{0B}\x{85}]"
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_Z}+|{_Z}+$', '', 'g')"


def _segment_sql(kind: str, name: str, line: str, pre: str = "SELECT *, NULL AS extra FROM l0", keep: str = "FALSE") -> str:
    return rf"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text FROM documents WHERE doc_type = '{kind}' AND NOT regexp_full_match(text, '{_Z}*')),
l0 AS (SELECT document_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS pos FROM d),
l1 AS ({pre}), l2 AS (SELECT document_id, pos, {name} AS name, {line} AS line FROM l1),
l3 AS (SELECT *, count(name) OVER (PARTITION BY document_id ORDER BY pos) AS ord FROM l2),
s AS (SELECT document_id, ord, max(name) AS section_name, {_strip("coalesce(string_agg(line, chr(10) ORDER BY pos), '')")} AS text FROM l3 WHERE ord > 0 GROUP BY 1, 2),
u AS (SELECT * FROM s WHERE text <> '' OR {keep} UNION ALL SELECT document_id, 0, NULL, {_strip("text")} FROM d WHERE document_id NOT IN (SELECT document_id FROM l3 WHERE ord > 0))
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS INTEGER) AS chunk_index, section_name, md5(text) AS text FROM u"""


def _chunks(df):
    return df.select("document_id", "chunk_index", "section_name", F.md5("text").alias("text"))


_ATX = r"^(#{1,6})[\s\p{Z}]+(.+?)[\s\p{Z}]*#*[\s\p{Z}]*$"
_SET = r"^[\s\p{Z}]*(={3,}|-{3,})[\s\p{Z}]*$"


@query(_segment_sql("research", f"CASE WHEN atx THEN regexp_extract(line, '{_ATX}', 2) WHEN under THEN {_strip('line')} END", "CASE WHEN NOT atx AND NOT under AND NOT coalesce(lag(under) OVER (PARTITION BY document_id ORDER BY pos), false) THEN line END",
f"""SELECT *, regexp_matches(line, '{_ATX}') AS atx, coalesce(regexp_matches(lead(line) OVER (PARTITION BY document_id ORDER BY pos), '{_SET}'), false) AND NOT regexp_full_match(line, '{_Z}*') AND NOT regexp_matches(line, '{_ATX}') AND NOT regexp_matches(line, '{_SET}') AS under FROM l0"""))
def segment_research(spark, d):
    return _chunks(segments.research(_docs(_Tables(spark, d)).where("doc_type = 'research'")))


_ITEM = r"^[\s\p{Z}]*[Ii][Tt][Ee][Mm][\s\p{Z}]+(\d+[A-Za-z]?)\.?[\s\p{Z}]*(.*?)[\s\p{Z}]*$"


@query(_segment_sql("filing", f"CASE WHEN head THEN 'Item ' || upper(regexp_extract(line, '{_ITEM}', 1)) || (CASE WHEN regexp_extract(line, '{_ITEM}', 2) <> '' THEN '. ' || regexp_extract(line, '{_ITEM}', 2) ELSE '' END) END", "CASE WHEN NOT head THEN line END",
f"SELECT *, regexp_matches(line, '{_ITEM}') AND length({_strip('line')}) <= 200 AND starts_with(lower({_strip('line')}), 'item ') AS head FROM l0"))
def segment_filing(spark, d):
    return _chunks(segments.filings(_docs(_Tables(spark, d)).where("doc_type = 'filing'")))


_W = r"\p{L}\p{M}\p{N}\p{Pc}\x{200C}\x{200D}"
_SPK = rf"^([A-Z][{_W}.''-]*(?:[\s\p{{Z}}]+[A-Z][{_W}.''-]*){{0,4}}(?:[\s\p{{Z}}]*-[\s\p{{Z}}]*[A-Z][{_W}\s\p{{Z}}.,&''-]*?)?)[\s\p{{Z}}]*:[\s\p{{Z}}]*(.*)$"
_SPEAKER_NAME = f"regexp_extract(line, '{_SPK}', 1)"
_DIV = "lower(" + _strip("line") + ") IN (" + ", ".join(f"'{x}'" for x in segments.DIVIDERS) + ")"


@query(_segment_sql("transcript", f"CASE WHEN div THEN 'Q&A' WHEN lab THEN {_strip(_SPEAKER_NAME)} END",
f"CASE WHEN NOT div AND NOT coalesce(last_value(CASE WHEN div OR lab THEN div END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos), false) THEN CASE WHEN lab THEN nullif(regexp_extract(line, '{_SPK}', 2), '') ELSE line END END",
f"SELECT *, {_DIV} AS div, NOT ({_DIV}) AND regexp_matches(line, '{_SPK}') AS lab FROM l0", "section_name = 'Q&A'"))
def segment_transcript(spark, d):
    return _chunks(segments.transcripts(_docs(_Tables(spark, d)).where("doc_type = 'transcript'")))


@query()
def sub_chunk_paragraphs(spark, d):
    """Sections of texts of every kind in pieces of at most 60 words; a fold, checked against brute force in the tests."""
    return segments.expanded(pipeline.chunks(_docs(_Tables(spark, d))), 60, 0.0)


@query(rf"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS piece, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pos FROM documents),
w AS (SELECT *, string_split(regexp_replace({_strip("piece")}, '{_Z}+', ' ', 'g'), ' ') AS words FROM p),
b AS (SELECT *, lag(words) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM w)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS piece, md5(CASE WHEN prev IS NULL THEN piece ELSE array_to_string(prev[greatest(1, len(prev) - 8):], ' ') || chr(10) || chr(10) || piece END) AS text FROM b""")
def chunk_overlap(spark, d):
    """Paragraphs that begin with the last nine words of the one before."""
    t = _Tables(spark, d).documents
    rows = t.select("doc_id", F.posexplode(segments.overlapped(F.split("text", "\n\n", -1), 60)).alias("piece", "text"))
    return rows.select("doc_id", "piece", F.md5("text").alias("text"))


@query(rf"""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS budget_tokens, CAST(CASE WHEN regexp_full_match(text, '{_Z}*') THEN 0 ELSE len(string_split(regexp_replace({_strip("text")}, '{_Z}+', ' ', 'g'), ' ')) END AS INTEGER) AS word_tokens FROM documents""")
def token_estimates(spark, d):
    return _Tables(spark, d).documents.select("doc_id", c.budget_tokens(F.col("text")).alias("budget_tokens"), c.word_tokens(F.col("text")).alias("word_tokens"))


@query("""WITH p AS (SELECT doc_id, text, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pos FROM documents),
s AS (SELECT *, sum(length(part) + CASE WHEN pos > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS chars FROM p)
SELECT doc_id, md5(coalesce(string_agg(part, chr(10) || chr(10) ORDER BY pos) FILTER (chars <= 800), substr(first(text), 1, 800))) AS text FROM s GROUP BY doc_id""")
def truncate_paragraphs(spark, d):
    return _Tables(spark, d).documents.select("doc_id", F.md5(segments.truncated(F.col("text"), 200)).alias("text"))


@query(f"""WITH r AS (SELECT p.document_id, CAST(p.prov_id % 4 AS INTEGER) AS chunk_index, p.entity_id, CAST(p.prov_id AS INTEGER) AS span_start, p.mention_text AS surface_form FROM provenance p WHERE entity_id IS NOT NULL),
f AS (SELECT document_id, entity_id, chunk_index AS seen_in, surface_form FROM r QUALIFY row_number() OVER (PARTITION BY document_id, entity_id ORDER BY chunk_index, span_start, surface_form) = 1)
SELECT h.document_id, h.chunk_index, f.entity_id, f.surface_form FROM (SELECT DISTINCT document_id, chunk_index FROM r) h JOIN f ON f.document_id = h.document_id AND f.seen_in < h.chunk_index""")
def running_entities(spark, d):
    """Mentions as those of four chunks for each document, and what each chunk knows from earlier ones."""
    p = _Tables(spark, d).provenance.where("entity_id is not null")
    return detection.running(p.select("document_id", (F.col("prov_id") % 4).cast("int").alias("chunk_index"), "entity_id", F.col("prov_id").cast("int").alias("span_start"), F.col("mention_text").alias("surface_form")))


# ---------------------------------------------------------------- values in responses
_DATES = "(SELECT entity_id, CASE length(canonical_name) % 4 WHEN 0 THEN strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') WHEN 1 THEN strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') WHEN 2 THEN strftime(created_at AT TIME ZONE 'UTC', '%Y') ELSE canonical_name END AS x FROM entities)"


@query(rf"""SELECT entity_id, epoch_us(CASE WHEN regexp_full_match(x, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN strptime(x, '%Y-%m-%d') WHEN regexp_full_match(x, '\d{{4}}-\d{{1,2}}') THEN strptime(x || '-01', '%Y-%m-%d')
WHEN regexp_full_match(x, '\d{{4}}') THEN strptime(x || '-01-01', '%Y-%m-%d') END) AS at_us FROM {_DATES}""")
def partial_date_parse(spark, d):
    e = _Tables(spark, d).entities
    k = F.length("canonical_name") % 4
    x = F.when(k == 0, F.date_format("created_at", "yyyy-MM-dd")).when(k == 1, F.date_format("created_at", "yyyy-MM")).when(k == 2, F.date_format("created_at", "yyyy")).otherwise(F.col("canonical_name"))
    return e.select("entity_id", c.micros(c.partial_date(x)).alias("at_us"))


@query("SELECT source_id, target_id, relation_type, CASE WHEN confidence IS NOT NULL THEN greatest(0.0, least(1.0, confidence * 3 - 1)) END AS confidence FROM relationships")
def confidence_clamp(spark, d):
    return _Tables(spark, d).relationships.select("source_id", "target_id", "relation_type", c.clamp(F.col("confidence") * 3 - 1).alias("confidence"))


@query("""SELECT document_id, round(CASE WHEN count(*) FILTER (run_id IS NULL) > 0 OR count(*) = 0 THEN 1.0 ELSE count(*) FILTER (entity_id IS NULL) / count(*) END, 6) AS ambiguity FROM provenance GROUP BY 1""")
def ambiguity_score(spark, d):
    """Mentions as one response for each document: unresolved ones are new, and one without a run spoils it."""
    g = _Tables(spark, d).provenance.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("entity_id").isNull(), 1)).alias("new"), F.count(F.when(F.col("run_id").isNull(), 1)).alias("bad"))
    return g.select("document_id", F.round(c.ambiguity(F.col("n"), F.col("new"), F.col("bad") == 0), 6).alias("ambiguity"))


# ---------------------------------------------------------------- sources and runs
@query(r"""WITH l AS (SELECT document_id, trim(unnest(string_split(regexp_replace(body, '[<>&]', ' ', 'g'), chr(10)))) AS line, generate_subscripts(string_split(regexp_replace(body, '[<>&]', ' ', 'g'), chr(10)), 1) AS pos FROM articles)
SELECT document_id, md5(coalesce(string_agg(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), chr(10) || chr(10) ORDER BY pos) FILTER (NOT regexp_full_match(line, '[\s\p{Z}]*')), '')) AS text FROM l GROUP BY 1""")
def html_article_text(spark, d):
    """Bodies as pages with one paragraph for each line, and their text back again."""
    a = _Tables(spark, d).articles
    body = F.regexp_replace(F.regexp_replace("body", "[<>&]", " "), "\n", "</p>\n<p class='x'>")
    pages = a.select("document_id", F.concat(F.lit("<html><nav><p>Menu</p></nav><article><p>"), body, F.lit("</p></article><article><p>Other</p></article></html>")).alias("html"))
    return readers.article_texts(pages, "document_id").select("document_id", F.md5("text").alias("text"))


@query()
def ingest_mentions(spark, d):
    """A whole run over all documents: chunks, dictionary, resolution, snippets, and the rows that are new."""
    t = _Tables(spark, d)
    docs = t.documents.select(F.col("doc_id").cast("string").alias("document_id"), "text", "doc_type", "source")
    return pipeline.ingest(docs, t.entities, t.entity_aliases, t.provenance, "run-1", NOW).provenance


def _register() -> None:
    from lorekeel.plans import records  # noqa: F401  (its queries add themselves)


def queries() -> dict[str, Query]:
    _register()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(_SQL)
