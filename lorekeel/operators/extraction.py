"""Stages that ask a model: discovery without candidates, relationships between what was resolved, and what is kept of both.

A stage is a pass over chunks in Arrow batches; the provider is made once in each task. A chunk whose answers break the rules
has an error and spoils no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeel.operators import budget, graph, mentions, merging, responses

DISCOVER = "Name the entities of the text that stand for themselves, each with type, description and a short passage. Answer with JSON."
RELATE = "Name the relationships the text states between the listed entities. Answer with JSON."
_NEW = [(n, pa.string()) for n in ("surface_form", "context_snippet", "canonical_name", "entity_type", "subtype", "description")] + [("aliases", pa.list_(pa.string()))]
_EDGE = [(n, pa.string()) for n in ("source_id", "target_id", "relation_type", "qualifier_id", "valid_from", "valid_until")] + [("confidence", pa.float64()), ("context_snippet", pa.string())]
NEW = "array<struct<surface_form: string, context_snippet: string, canonical_name: string, entity_type: string, subtype: string, description: string, aliases: array<string>>>"
EDGE = "array<struct<source_id: string, target_id: string, relation_type: string, qualifier_id: string, valid_from: string, valid_until: string, confidence: double, context_snippet: string>>"
_USED = "error string, input_tokens long, output_tokens long"


def _stage(rows: DataFrame, columns: list[str], field: str, kind: list, schema: str, make: Callable[[], responses.Provider], ask: Callable) -> DataFrame:
    """One answer for each row: (chunk_id, field, error, input_tokens, output_tokens)."""
    names = ["chunk_id", field, "error", "input_tokens", "output_tokens"]
    types = [pa.string(), pa.list_(pa.struct(kind)), pa.string(), pa.int64(), pa.int64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for batch in it:
            out: list[tuple] = []
            for key, *given in zip(*(batch.column(c).to_pylist() for c in ["chunk_id", *columns]), strict=True):
                try:
                    found, used = ask(provider, *given)
                    out.append((key, found, None, used.input_tokens, used.output_tokens))
                except (responses.ResponseError, responses.ProviderError) as e:
                    out.append((key, [], str(e), 0, 0))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    src = rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), *columns)
    return src.mapInArrow(run, f"chunk_id string, {field} {schema}, {_USED}")


def discover(chunks: DataFrame, make: Callable[[], responses.Provider], attempts: int = 2) -> DataFrame:
    """(chunk_id, proposals, error, input_tokens, output_tokens): the entities a model finds in chunks (chunk_id, text) without candidates.

    The text is cut to what the window of the provider leaves, four characters to a token; a NULL text is asked as ''. With no
    candidates every resolved mention is unknown, so an answer that has one is not accepted.
    """

    def ask(provider: responses.Provider, text: str | None):
        room = 4 * budget.flexible(provider.context_window, len(DISCOVER) // 4)
        (_, new), used = responses.ask(provider, budget.first_question("", (text or "")[:room]), lambda t: responses.check_entities(t, ()), attempts, DISCOVER)
        return new, used

    return _stage(chunks, ["text"], "proposals", _NEW, NEW, make, ask)


def relate(chunks: DataFrame, make: Callable[[], responses.Provider], attempts: int = 2) -> DataFrame:
    """(chunk_id, relationships, error, input_tokens, output_tokens): what a model says links the entities of chunks.

    ``chunks``: chunk_id, text, known (array of entity_id, name, surface_form), new (array of canonical_name, entity_type, subtype,
    entity_id): resolved mentions, and proposals with the ids they were given. A chunk with no resolved mention is not asked. Ends
    are taken by id or, without case, by name; dates that are none are NULL.
    """

    def ask(provider: responses.Provider, text: str | None, known: list | None, new: list | None):
        known, new = known or [], new or []
        if not known:
            return [], responses.Usage()
        names = {k["name"]: k["entity_id"] for k in known if k["name"]} | {k["canonical_name"]: k["entity_id"] for k in new if k["entity_id"]}
        ids = {k["entity_id"] for k in known} | {k["entity_id"] for k in new if k["entity_id"]}
        room = 4 * budget.flexible(provider.context_window, len(RELATE) // 4)
        question = budget.second_question(budget.listed_entities([(k["surface_form"], k["entity_id"]) for k in known], [(k["canonical_name"], k["entity_type"], k["subtype"]) for k in new]), (text or "")[:room])
        return responses.ask(provider, question, lambda t: responses.check_relationships(t, ids, names), attempts, RELATE)

    return _stage(chunks, ["text", "known", "new"], "relationships", _EDGE, EDGE, make, ask)


# ---------------------------------------------------------------- what is kept
def entity_of_proposal(document: Column, name: Column, kind: Column) -> Column:
    """The id of the entity made from a proposal: the same for the same document, name (without case) and type, so that a repeated
    run makes no second one."""
    return F.md5(F.concat_ws("\u0001", document, F.lower(name), kind))


def persisted_proposals(rows: DataFrame, held: DataFrame, run_id: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entities, provenance) made from proposals (document_id, chunk_index, canonical_name, entity_type, description, source, context_snippet).

    The proposals of a document are merged first; each makes one active entity and one mention of its own name. Mentions that
    the table holds already are left out.
    """
    one = merging.proposals(rows)
    key = (F.col("document_id"), F.col("canonical_name"), F.col("entity_type"))
    one = one.withColumn("entity_id", entity_of_proposal(*key))
    none = lambda t: F.lit(None).cast(t)
    entities = one.select("entity_id", "canonical_name", "entity_type", none("string").alias("subtype"), "description", none("timestamp").alias("valid_from"), none("timestamp").alias("valid_until"), F.lit("active").alias("status"), none("string").alias("merged_into"), now.alias("created_at"), none("timestamp").alias("updated_at"))
    first = rows.groupBy("document_id", "chunk_index", "canonical_name", "entity_type").agg(F.min(F.struct("source", "context_snippet")).alias("f")).select("document_id", "chunk_index", "canonical_name", "entity_type", "f.source", "f.context_snippet")
    said = one.join(first, ["document_id", "chunk_index", "canonical_name", "entity_type"])
    new = said.select("entity_id", "document_id", "source", F.col("canonical_name").alias("mention_text"), "context_snippet", now.alias("detected_at"), F.lit(run_id).alias("run_id"))
    return entities, mentions.save(new, held)


def persisted_relationships(rows: DataFrame, held: DataFrame, run_id: str, now: Column) -> DataFrame:
    """The edges made from relationships of chunks (document_id, chunk_index, source_id, target_id, relation_type, snippet, and what else an
    edge has), those of a document merged first; the description is the passage. Edges that the table holds are left out."""
    best = merging.relationships(rows)
    rest = [c for c in ("qualifier_id", "relation_kind_id", "valid_from", "valid_until", "confidence") if c in rows.columns]
    key = ["document_id", "source_id", "target_id", "relation_type", "chunk_index"]
    more = rows.groupBy(*key, "snippet").agg(F.min(F.struct(*rest)).alias("m")) if rest else None
    if more is not None:
        cond = [best[k].eqNullSafe(more[k]) for k in (*key, "snippet")]
        best = best.join(more, cond, "left").select(*[best[c] for c in best.columns], *[F.col(f"m.{c}").alias(c) for c in rest])
    edges = best.select(*[c for c in best.columns if c not in ("snippet", "chunk_index")], F.col("snippet").alias("description"), now.alias("discovered_at"), F.lit(run_id).alias("run_id"))
    return graph.save_edges(edges, held)
