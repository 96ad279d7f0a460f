"""Ingestion: articles to mentions, as one plan over all documents of a run.

Articles not yet processed -> chunks -> dictionary mentions -> resolved mentions with snippets -> provenance rows that the
table does not hold yet. A model stage may be put between for what the dictionary leaves open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.functions.columns import hex_id
from lorekeel.operators import articles as ar
from lorekeel.operators import budget, detection, graph, mentions, responses, segments
from lorekeel.session import persist_table

SEGMENTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"news": segments.news, "research": segments.research, "filing": segments.filings, "transcript": segments.transcripts}
SYSTEM = "Link the marked mentions to the listed candidates, or describe the entity if none fits. Answer with JSON."


@dataclass(frozen=True)
class Result:
    """What one run adds, and what it saw."""

    provenance: DataFrame
    unresolved: DataFrame
    stats: DataFrame


def chunks(documents: DataFrame, most_words: int | None = None) -> DataFrame:
    """Chunks of documents (document_id, text, doc_type), each by the segmenter of its kind; unknown kinds are news."""
    kind = F.when(F.col("doc_type").isin(*SEGMENTERS), F.col("doc_type")).otherwise("news")
    d = documents.withColumn("_k", kind)
    out = None
    for name, cut in SEGMENTERS.items():
        one = cut(d.where(F.col("_k") == name).select("document_id", "text"))
        out = one if out is None else out.unionByName(one)
    return segments.expanded(out, most_words) if most_words else out


def ingest(documents: DataFrame, entities: DataFrame, aliases: DataFrame, held: DataFrame, run_id: str, detected_at: str, reprocess: bool = False) -> Result:
    """Mentions of active entities in documents (document_id, text, doc_type, source)."""
    docs = documents.withColumn("document_id", hex_id(F.col("document_id").cast("string")))
    if not reprocess:
        docs = persist_table(ar.unprocessed(docs, held), "unprocessed")  # each segmenter reads it
    # Cut once: words, texts and snippets all read the pieces.
    pieces = persist_table(chunks(docs.select("document_id", "text", "doc_type")).select("document_id", "chunk_index", "text"), "pieces")
    key = F.concat_ws("#", "document_id", F.col("chunk_index").cast("string"))
    texts = pieces.where("text != ''").select(key.alias("document_id"), "text")
    known = persist_table(detection.dictionary(entities.where("status = 'active'"), aliases), "dictionary")
    found = persist_table(detection.detect_with_snippets(texts, known), "occurrences")
    sure = detection.resolved(found, known)
    doc = F.substring_index("document_id", "#", 1)
    source = docs.select(F.col("document_id").alias("_d"), "source")
    rows = sure.select("entity_id", doc.alias("document_id"), F.col("alias").alias("mention_text"), "context_snippet")
    rows = rows.join(source, F.col("document_id") == F.col("_d")).drop("_d").withColumn("detected_at", F.lit(detected_at).cast("timestamp")).withColumn("run_id", F.lit(run_id))
    new = persist_table(mentions.save(rows, held), "new-mentions")
    open_ = detection.unresolved(found, known).select(doc.alias("document_id"), "alias", "span_start", "candidate_ids")
    seen = docs.agg(F.count(F.lit(1)).alias("documents")).crossJoin(new.agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("entity_id").alias("entities")))
    return Result(new, open_, seen.withColumn("run_id", F.lit(run_id)))


def ask_model(chunk_rows: DataFrame, make: Callable[[], responses.Provider], attempts: int = 2) -> DataFrame:
    """(chunk_id, resolved, proposals, error): the answers of a provider made in each task, checked; a chunk that fails has an
    error and spoils no other. ``chunk_rows``: chunk_id, text, candidate_ids, block (see the budget module), and if there is one,
    before: what was resolved in earlier chunks, as lines. A chunk with no candidates has nothing to be resolved and is not asked."""
    if "before" not in chunk_rows.columns:
        chunk_rows = chunk_rows.withColumn("before", F.lit(None).cast("string"))
    item = "struct<surface_form: string, context_snippet: string, entity_id: string>"
    new = "struct<surface_form: string, context_snippet: string, canonical_name: string, entity_type: string, subtype: string, description: string, aliases: array<string>>"
    schema = f"chunk_id string, resolved array<{item}>, proposals array<{new}>, error string, input_tokens long, output_tokens long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for batch in it:
            rows = []
            for k, text, ids, block, before in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "text", "candidate_ids", "block", "before")), strict=True):
                if not ids:
                    rows.append({"chunk_id": k, "resolved": [], "proposals": [], "error": None, "input_tokens": 0, "output_tokens": 0})
                    continue
                try:
                    question = budget.first_question("\n\n".join(x for x in (block, before) if x), text or "")
                    (resolved, proposals), used = responses.ask(provider, question, lambda t, ids=ids: responses.check_entities(t, ids), attempts, SYSTEM)
                    rows.append({"chunk_id": k, "resolved": resolved, "proposals": proposals, "error": None, "input_tokens": used.input_tokens, "output_tokens": used.output_tokens})
                except (responses.ResponseError, responses.ProviderError) as e:
                    rows.append({"chunk_id": k, "resolved": [], "proposals": [], "error": str(e), "input_tokens": 0, "output_tokens": 0})
            strings = lambda names: pa.list_(pa.struct([(n, pa.list_(pa.string()) if n == "aliases" else pa.string()) for n in names]))
            types = [pa.string(), strings(["surface_form", "context_snippet", "entity_id"]), strings(["surface_form", "context_snippet", "canonical_name", "entity_type", "subtype", "description", "aliases"]), pa.string(), pa.int64(), pa.int64()]
            names = ["chunk_id", "resolved", "proposals", "error", "input_tokens", "output_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return chunk_rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text", "candidate_ids", "block", "before").mapInArrow(run, schema)


def model_input(chunk_rows: DataFrame, entities: DataFrame, tokens: int) -> DataFrame:
    """Chunks (chunk_id, text, candidate_ids) with the block of candidates that fits the budget."""
    blocks = budget.context_block(budget.fitted(chunk_rows, entities, tokens), entities)
    return chunk_rows.join(blocks, "chunk_id", "left").withColumn("text", segments.truncated(F.col("text"), tokens))


def apply_merges(entities: DataFrame, provenance: DataFrame, relationships: DataFrame, mapping: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after merging entities, chains of merges followed to their end."""
    m = graph.closed_merges(mapping)
    return graph.merged_entities(entities, m, F.lit(now).cast("timestamp")), graph.redirect_provenance(provenance, m), graph.redirect_relationships(relationships, m)
