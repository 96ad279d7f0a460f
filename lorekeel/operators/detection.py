"""Dictionary matching: aliases of entities in text, resolved where one entity is meant.

The dictionary is matched by one of two plans, which agree. The automaton plan reads every text once and shuffles none; its
dictionary goes to every task, so it is used up to a checked size only. The relational plan explodes the distinct words of a
text, joins them with the rarest words of the aliases, and brings all aliases that meet a text to it at once, so a text is
shuffled once however many aliases it meets; it never leaves the JVM and has no bound on the dictionary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel import schemas
from lorekeel.functions.columns import snippet

AUTOMATON_ALIASES = 200_000


def dictionary(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, entity_id): lower-cased names and aliases that are not empty, each pair once."""
    names = entities.select("entity_id", F.col("canonical_name").alias("alias"))
    both = names.unionByName(aliases.join(entities.select("entity_id"), "entity_id", "left_semi").select("entity_id", "alias"))
    return both.select(F.lower("alias").alias("alias"), "entity_id").where("alias is not null and alias != ''").distinct()


def candidates(d: DataFrame) -> DataFrame:
    """(alias, candidate_ids, candidates) of a dictionary."""
    return d.groupBy("alias").agg(F.sort_array(F.collect_set("entity_id")).alias("candidate_ids")).withColumn("candidates", F.size("candidate_ids"))


_TOKEN = r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"


def detect(documents: DataFrame, d: DataFrame, most: int = AUTOMATON_ALIASES) -> DataFrame:
    """(document_id, alias, span_start, span_end): every occurrence of an alias, without case, that no letter or digit touches.

    Overlapping occurrences all count. Offsets are characters of the lower-cased text from 0, the end excluded. Blank aliases
    and NULL texts have none. Up to ``most`` aliases go to the tasks as an automaton, more are joined.
    """
    d = d.where("trim(alias) != ''")
    known = [r[0] for r in d.select("alias").distinct().limit(most + 1).collect()]
    text = documents.where("text is not null and document_id is not null").select(F.col("document_id").cast("string").alias("document_id"), F.lower("text").alias("text"))
    return _by_automaton(text, known) if len(known) <= most else detect_by_join(documents, d)


def detect_by_join(documents: DataFrame, d: DataFrame) -> DataFrame:
    """The same occurrences by joins, for dictionaries of any size.

    A document is looked up by its distinct words and symbols, an alias by the one of it that fewest aliases have; the aliases
    that meet a document there are compared with its text, in the row of the text.
    """
    text = documents.where("text is not null and document_id is not null").select("document_id", F.lower("text").alias("low"))
    words = text.select("document_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(_TOKEN), F.lit(1)))).alias("word"))
    of_alias = d.where("trim(alias) != ''").select("alias").distinct().select("alias", F.explode(F.array_distinct(F.regexp_extract_all("alias", F.lit(_TOKEN), F.lit(1)))).alias("word"))
    common = of_alias.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keyed = of_alias.join(common, "word").groupBy("alias").agg(F.min(F.struct("n", "word")).alias("k")).select("alias", F.col("k.word").alias("word"))
    met = words.join(keyed, "word").groupBy("document_id").agg(F.collect_set("alias").alias("aliases"))
    here = text.join(met, "document_id").select("document_id", "low", F.explode("aliases").alias("alias")).where(F.contains("low", "alias"))
    # The text parted before every occurrence: each part but the first begins one, and the lengths give the places.
    quoted = F.concat(F.lit(r"(?=\Q"), F.col("alias"), F.lit(r"\E)"))
    sizes = F.transform(F.split("low", quoted, -1), lambda x: F.length(x))
    # A first part that is itself an occurrence has no place before it: split does not part a text at its beginning.
    first = F.when(F.startswith("low", "alias"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    later = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"] + x)).alias("all")), lambda a: a["all"])
    at = here.select("document_id", "low", "alias", F.explode(F.array_distinct(F.concat(first, later))).alias("span_start"))
    at = at.withColumn("span_end", (F.col("span_start") + F.length("alias")).cast("int"))
    inside = lambda c: c.rlike(r"^[\p{L}\p{N}]")
    left = (F.col("span_start") == 0) | ~inside(F.expr("substring(low, span_start, 1)")) | ~inside(F.expr("substring(alias, 1, 1)"))
    right = (F.col("span_end") >= F.length("low")) | ~inside(F.expr("substring(low, span_end + 1, 1)")) | ~inside(F.expr("substring(alias, -1, 1)"))
    return at.where(left & right).select("document_id", "alias", "span_start", "span_end")


class Automaton:
    """Aho-Corasick over lower-cased aliases; only whole aliases are reported."""

    def __init__(self, aliases: list[str]) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for a in aliases:
            self.machine.add_word(a, a)
        if aliases:
            self.machine.make_automaton()
        self.empty = not aliases

    def counts(self, low: str) -> dict[str, int]:
        """How often each alias stands in a lower-cased text, overlaps included, whatever touches it."""
        return {} if self.empty else Counter(a for _, a in self.machine.iter(low))

    def spans(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Occurrences that no letter or digit touches: a place is a boundary unless both sides are letters or digits."""
        if self.empty:
            return
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)  # offsets stay those of the text
        for last, a in self.machine.iter(low):
            s, e = last - len(a) + 1, last + 1
            if (s == 0 or not (low[s - 1].isalnum() and low[s].isalnum())) and (e == len(low) or not (low[e - 1].isalnum() and low[e].isalnum())):
                yield a, s, e


def detect_by_automaton(documents: DataFrame, d: DataFrame, most: int = AUTOMATON_ALIASES) -> DataFrame:
    """The same occurrences by an automaton in every task; a dictionary above ``most`` aliases is refused."""
    known = [r[0] for r in d.select("alias").distinct().limit(most + 1).collect()]
    if len(known) > most:
        raise ValueError(f"more than {most} aliases: use detect()")
    return _by_automaton(documents.select(F.col("document_id").cast("string").alias("document_id"), "text"), known)


def _by_automaton(texts: DataFrame, known: list[str]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(known)
        for batch in it:
            out: list[tuple] = []
            for doc, text in zip(batch.column("document_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out += [(doc, a, s, e) for a, s, e in machine.spans(text or "")]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["document_id", "alias", "span_start", "span_end"])

    return texts.mapInArrow(run, "document_id string, alias string, span_start int, span_end int")


def snippet_of(text: str, start: int, end: int, window: int) -> str:
    """The text around [start, end) as ``functions.columns.snippet`` has it."""
    a, b = max(0, start - window), min(len(text), end + window)
    blank, last = text.find(" ", a, start), text.rfind(" ", end, b)
    left = blank + 1 if a > 0 and blank >= 0 else a
    right = last if b < len(text) and last >= 0 else b
    return ("..." if left > 0 else "") + text[left:right] + ("..." if right < len(text) else "")


def detect_with_snippets(documents: DataFrame, d: DataFrame, window: int = 100, most: int = AUTOMATON_ALIASES) -> DataFrame:
    """Occurrences as ``detect`` finds them, with the text around each; up to ``most`` aliases no text is shuffled for it."""
    d = d.where("trim(alias) != ''")
    known = [r[0] for r in d.select("alias").distinct().limit(most + 1).collect()]
    if len(known) > most:
        return with_snippets(detect_by_join(documents, d), documents, window)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(known)
        for batch in it:
            out: list[tuple] = []
            for doc, low, text in zip(*(batch.column(c).to_pylist() for c in ("document_id", "low", "text")), strict=True):
                out += [(doc, a, s, e, snippet_of(text, s, e, window)) for a, s, e in machine.spans(low)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["document_id", "alias", "span_start", "span_end", "context_snippet"])

    src = documents.where("text is not null and document_id is not null").select(F.col("document_id").cast("string").alias("document_id"), F.lower("text").alias("low"), "text")
    return src.mapInArrow(run, "document_id string, alias string, span_start int, span_end int, context_snippet string")


def no_mentions(documents: DataFrame) -> DataFrame:
    """The detector that finds nothing."""
    return documents.sparkSession.createDataFrame([], schemas.MENTION)


def with_candidates(found: DataFrame, d: DataFrame) -> DataFrame:
    return found.join(candidates(d), "alias")


def resolved(found: DataFrame, d: DataFrame) -> DataFrame:
    """Occurrences that mean one entity."""
    return with_candidates(found, d).where("candidates = 1").withColumn("entity_id", F.element_at("candidate_ids", 1))


def unresolved(found: DataFrame, d: DataFrame) -> DataFrame:
    """Occurrences that could mean several."""
    return with_candidates(found, d).where("candidates > 1")


def with_snippets(found: DataFrame, documents: DataFrame, window: int = 100) -> DataFrame:
    """Occurrences with the text around them."""
    t = documents.select(F.col("document_id").alias("_d"), F.col("text").alias("_t"))
    return found.join(t, F.col("document_id") == F.col("_d")).withColumn("context_snippet", snippet(F.col("_t"), F.col("span_start"), F.col("span_end"), window)).drop("_d", "_t")


def prescan(found: DataFrame, d: DataFrame) -> DataFrame:
    """(document_id, entity_id): every entity that any occurrence in a document could mean, for all its chunks."""
    return found.select("document_id", "alias").distinct().join(d, "alias").select("document_id", "entity_id").distinct()


def running(resolved_: DataFrame, chunks: str = "chunk_index") -> DataFrame:
    """(document_id, chunk, entity_id, surface_form): the entities resolved in earlier chunks of a document, each with the
    form in which it was first met."""
    first = resolved_.groupBy("document_id", "entity_id").agg(F.min(F.struct(chunks, "span_start", "surface_form")).alias("f")).select("document_id", "entity_id", F.col(f"f.{chunks}").alias("seen_in"), "f.surface_form")
    here = resolved_.select("document_id", chunks).distinct()
    return here.join(first, "document_id").where(F.col("seen_in") < F.col(chunks)).select("document_id", chunks, "entity_id", "surface_form")


def hits(found: DataFrame) -> DataFrame:
    return found.groupBy("document_id", "alias").agg(F.count(F.lit(1)).alias("hits"))

