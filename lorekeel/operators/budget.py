"""Prompts of a bounded size: which candidates of a chunk are shown, and how."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeel.functions.columns import budget_tokens, overlapping_count
from lorekeel.operators import detection

HEADROOM = 800
HEADER = "CANDIDATE ENTITIES:\n"


def flexible(window: int, system_tokens: int, headroom: int = HEADROOM) -> int:
    """Tokens left for candidates and text."""
    return max(0, window - system_tokens - headroom)


def alias_matches(chunks: DataFrame, entities: DataFrame, most: int = detection.AUTOMATON_ALIASES) -> DataFrame:
    """(chunk_id, entity_id, matches): how often name and aliases occur in the text, without case, overlaps included.

    ``chunks`` (chunk_id, text, candidate_ids) name their candidates; ``entities`` have aliases. Each distinct form counts. Up to
    ``most`` forms go to the tasks as an automaton that reads each text once; more are joined to the texts.
    """
    form = F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), lambda x: F.lower(x)))
    held = entities.select("entity_id", F.explode(form).alias("form")).where("form is not null and form != ''").distinct()
    rows = held.limit(most + 1).collect()
    return _counted(chunks, entities, [(r[0], r[1]) for r in rows]) if len(rows) <= most else alias_matches_by_join(chunks, entities)


def _counted(chunks: DataFrame, entities: DataFrame, held: list[tuple[str, str]]) -> DataFrame:
    source = chunks.select("chunk_id", F.lower("text").alias("low"), "candidate_ids")
    known = {k for k, _ in held}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = detection.Automaton([f for _, f in held])
        forms: dict[str, list[str]] = {}
        for k, f in held:
            forms.setdefault(k, []).append(f)
        for batch in it:
            at, ids, n = [], [], []
            for i, (low, candidates) in enumerate(zip(batch.column("low").to_pylist(), batch.column("candidate_ids").to_pylist(), strict=True)):
                seen = machine.counts(low or "")
                for k in candidates or ():
                    if k in known:
                        at.append(i)
                        ids.append(k)
                        n.append(sum(seen.get(f, 0) for f in forms[k]))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(at, pa.int64())), pa.array(ids, pa.string()), pa.array(n, pa.int64())], ["chunk_id", "entity_id", "matches"])

    return source.mapInArrow(run, f"chunk_id {source.schema['chunk_id'].dataType.simpleString()}, entity_id string, matches long")


def alias_matches_by_join(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """The same counts by joins, for any number of forms."""
    pair = chunks.select("chunk_id", F.lower("text").alias("_low"), F.explode("candidate_ids").alias("entity_id")).join(entities.select("entity_id", "canonical_name", "aliases"), "entity_id")
    forms = F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), F.lower))
    one = pair.select("chunk_id", "entity_id", "_low", F.explode(forms).alias("_form"))
    return one.groupBy("chunk_id", "entity_id").agg(F.sum(overlapping_count(F.col("_low"), F.col("_form"))).alias("matches"))


def entity_block(rank: Column) -> Column:
    """The lines that show one candidate; ``rank`` counts from 1."""
    label = F.concat("entity_type", F.when(F.coalesce("subtype", F.lit("")) != "", F.concat(F.lit(" / "), "subtype")).otherwise(""))
    names = F.array_join("aliases", ", ")
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] entity_id="), "entity_id", F.lit("\n    name: "), "canonical_name", F.lit("\n    type: "), label,
        F.when(names != "", F.concat(F.lit("\n    aliases: "), names)).otherwise(""), F.lit("\n    description: "), F.coalesce("description", F.lit("")), F.lit("\n\n"),
    )


def fitted(chunks: DataFrame, entities: DataFrame, tokens: int) -> DataFrame:
    """(chunk_id, entity_id, rank) of the candidates that are shown with each chunk.

    The text goes first; the rest of the budget goes to candidates. If all fit, they stay in their order; else they are
    ranked by matches, and taken until the first that does not fit. A chunk that fills the budget shows none.
    """
    c = chunks.withColumn("_left", F.lit(tokens) - budget_tokens(F.col("text")))
    order = c.select("chunk_id", "_left", F.posexplode("candidate_ids").alias("_pos", "entity_id"))
    rows = order.join(entities, "entity_id").join(alias_matches(chunks, entities), ["chunk_id", "entity_id"]).where("_left > 0")
    given, ranked = Window.partitionBy("chunk_id").orderBy("_pos"), Window.partitionBy("chunk_id").orderBy(F.desc("matches"), "_pos")
    rows = rows.withColumn("_g", F.row_number().over(given)).withColumn("_r", F.row_number().over(ranked))
    whole = Window.partitionBy("chunk_id")
    rows = rows.withColumn("_all", F.sum(F.length(entity_block(F.col("_g")))).over(whole) + len(HEADER))
    rows = rows.withColumn("_sum", F.sum(F.length(entity_block(F.col("_r")))).over(ranked.rowsBetween(Window.unboundedPreceding, 0)) + len(HEADER))
    fits = lambda c: F.ceil(c / 4) <= F.col("_left")
    # Sums only grow, so what fits is a prefix.
    out = rows.where(fits(F.col("_all")) | fits(F.col("_sum")))
    return out.select("chunk_id", "entity_id", F.when(fits(F.col("_all")), F.col("_g")).otherwise(F.col("_r")).alias("rank"))


def context_block(chosen: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, block): the candidates of each chunk as the prompt shows them."""
    rows = chosen.join(entities, "entity_id").select("chunk_id", "rank", entity_block(F.col("rank")).alias("b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), "")
    return rows.groupBy("chunk_id").agg(F.concat(F.lit(HEADER), text).alias("block"))


# ---------------------------------------------------------------- questions
# The headings of the parts of a question.
SEEN, LISTED, TEXT, UNHELD = "PREVIOUSLY RESOLVED ENTITIES:", "ENTITIES IN THIS TEXT:", "TEXT:", "NEW — not yet in KG"


def _once(pairs: list[tuple[str, str]]) -> list[str]:
    """A line for each (form, id), the first form of an id."""
    forms: dict[str, str] = {}
    for form, key in pairs:
        forms.setdefault(key, form)
    return [f"- {form} (id={key})" for key, form in forms.items()]


def first_question(block: str, text: str, before: list[tuple[str, str]] | None = None) -> str:
    """Which entities does a text name: the candidates, those resolved in earlier chunks as (form, id), the text; empty parts are left out."""
    parts = [block] if block else []
    if before:
        parts.append("\n".join([SEEN, *_once(before)]))
    return "\n\n".join([*parts, f"{TEXT}\n{text}"])


def listed_entities(resolved: list[tuple[str, str]], new: list[tuple[str, str, str | None]] | None = None) -> str:
    """The entities of a text: resolved ones as (form, id), each id once, then proposals as (name, type, subtype); '' for none."""
    if not resolved and not new:
        return ""
    kinds = [f"- {name} ({' / '.join(x for x in (kind, sub) if x)}, {UNHELD})" for name, kind, sub in new or ()]
    return "\n".join([LISTED, "", *_once(resolved), *kinds])


def second_question(block: str, text: str) -> str:
    """Which relationships does a text state: the entities, the text."""
    return "\n\n".join([*([block] if block else []), f"{TEXT}\n{text}"])


def seen_lines(resolved: DataFrame) -> DataFrame:
    """(chunk_id, block): the entities resolved before a chunk, as the question shows them, in the order of ``pos``.

    ``resolved``: chunk_id, pos, surface_form, entity_id; an id counts at its first place.
    """
    first = resolved.groupBy("chunk_id", "entity_id").agg(F.min(F.struct("pos", "surface_form")).alias("f"))
    line = F.concat(F.lit("- "), F.col("f.surface_form"), F.lit(" (id="), F.col("entity_id"), F.lit(")"))
    rows = first.select("chunk_id", F.col("f.pos").alias("pos"), line.alias("line")).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return rows.select("chunk_id", F.concat(F.lit(SEEN + "\n"), F.array_join(F.col("l.line"), "\n")).alias("block"))


def candidate_order(found: DataFrame) -> DataFrame:
    """(chunk_id, entity_id, pos): the candidates of a chunk in the order of first sight, from 1.

    ``found``: chunk_id, span_start, span_end, candidate_ids. Occurrences go by their start, the longer first; within one, its list.
    """
    each = found.select("chunk_id", "span_start", (-F.col("span_end")).alias("_e"), F.posexplode("candidate_ids").alias("_i", "entity_id"))
    first = each.groupBy("chunk_id", "entity_id").agg(F.min(F.struct("span_start", "_e", "_i")).alias("f"))
    w = Window.partitionBy("chunk_id").orderBy("f", "entity_id")
    return first.select("chunk_id", "entity_id", F.row_number().over(w).alias("pos"))
