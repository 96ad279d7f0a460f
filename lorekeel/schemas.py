"""Tables of the knowledge graph: columns, enumerations, rules."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _table(spec: dict[str, T.DataType], required: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in spec.items()])


ENTITY = _table(
    {"entity_id": _S, "canonical_name": _S, "entity_type": _S, "subtype": _S, "description": _S, "valid_from": _TS, "valid_until": _TS, "status": _S, "merged_into": _S, "created_at": _TS, "updated_at": _TS},
    ("entity_id", "canonical_name", "entity_type", "status"),
)
ALIAS = _table({"entity_id": _S, "alias": _S}, ("entity_id", "alias"))
PROVENANCE = _table({"entity_id": _S, "document_id": _S, "source": _S, "mention_text": _S, "context_snippet": _S, "detected_at": _TS, "run_id": _S}, ("document_id", "mention_text"))
RELATIONSHIP = _table(
    {"source_id": _S, "target_id": _S, "relation_type": _S, "description": _S, "qualifier_id": _S, "relation_kind_id": _S, "valid_from": _TS, "valid_until": _TS, "document_id": _S, "discovered_at": _TS, "run_id": _S, "confidence": _D},
    ("source_id", "target_id", "relation_type"),
)
RUN = _table({"run_id": _S, "started_at": _TS, "finished_at": _TS, "status": _S, "document_count": _L, "entity_count": _L, "relationship_count": _L, "error_message": _S}, ("run_id",))
RUN_METRICS = _table({"run_id": _S, "chunks": _L, "mentions": _L, "resolved": _L, "proposals": _L, "relationships": _L, "provider_name": _S, "model_name": _S, "wall_clock_seconds": _D, "input_tokens": _L, "output_tokens": _L}, ("run_id",))
ARTICLE_FAILURE = _table({"run_id": _S, "document_id": _S, "error_message": _S, "failed_at": _TS}, ("run_id", "document_id"))
ARTICLE = _table({"url": _S, "title": _S, "body": _S, "source": _S, "published": _TS, "scraped_at": _TS, "document_id": _S, "content_hash": _S}, ("url", "document_id"))
CHUNK = _table({"document_id": _S, "chunk_index": T.IntegerType(), "section_name": _S, "text": _S}, ("document_id", "chunk_index"))
MENTION = T.StructType([T.StructField("document_id", _S), T.StructField("surface_form", _S), T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()), T.StructField("candidate_ids", T.ArrayType(_S))])

# Fixed values.
ENTITY_TYPES = ("person", "organization", "place", "topic", "product", "legislation", "asset", "metric", "role", "relation_kind")
ENTITY_STATUSES = ("active", "merged", "deprecated")
RUN_STATUSES = ("running", "completed", "failed")
DOCUMENT_TYPES = ("news", "research", "transcript", "filing")

# Which labels are usual between two types of entities.
RELATION_RULES: dict[tuple[str, str], tuple[str, ...]] = {
    ("asset", "organization"): ("issued_by", "managed_by", "listed_on", "component_of"),
    ("asset", "asset"): ("tracks", "derived_from", "component_of"),
    ("organization", "organization"): ("acquired", "merged_with", "spun_off", "competes_with", "supplies", "partners_with", "invests_in", "subsidiary_of", "parent_of", "listed_on", "ipo_on", "delisted_from", "managed_by", "member_of"),
    ("organization", "legislation"): ("enforces", "sponsored_by"),
    ("organization", "topic"): ("hosts", "classified_as"),
    ("organization", "metric"): ("sets",),
    ("organization", "place"): ("headquartered_in", "located_in"),
    ("organization", "product"): ("approved", "grounded"),
    ("organization", "asset"): ("covers",),
    ("person", "organization"): ("works_at", "employed_by", "leads", "appointed_at", "departed_from", "founded"),
    ("person", "asset"): ("covers",),
    ("legislation", "organization"): ("targets", "applies_to", "sponsored_by"),
    ("legislation", "place"): ("targets", "applies_to"),
    ("metric", "organization"): ("issued_by", "set_by"),
    ("metric", "place"): ("measures",),
    ("product", "organization"): ("manufactured_by",),
    ("product", "product"): ("competes_with", "runs_on"),
    ("topic", "metric"): ("triggers",),
    ("topic", "topic"): ("affects",),
    ("topic", "asset"): ("affects",),
    ("place", "place"): ("member_of",),
    ("place", "organization"): ("member_of",),
    ("asset", "topic"): ("belongs_to",),
}
RULE_ROWS = [(s, t, label) for (s, t), labels in RELATION_RULES.items() for label in labels]
