"""Documents into chunks: by headings, items, speakers and paragraphs.

All segmenters are one shape: lines are told apart as headings or text, a running count of headings
numbers the sections of a document, and the text lines of a section are joined. A window over a document
holds the lines of one document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeel.functions.columns import word_tokens

# What tells a heading of each kind of document.
ATX = r"(?U)^(#{1,6})\s+(.+?)\s*#*\s*$"
SETEXT = r"(?U)^\s*(=|-)\1{2,}\s*$"
ITEM = r"(?Ui)^\s*ITEM\s+(\d+[A-Za-z]?)\.?\s*(.*?)\s*$"
DIVIDERS = ("q&a", "qa", "questions and answers", "question and answer session", "question-and-answer session")
LONGEST_HEADING = 200
# A speaker's label is what stands before the first colon of a line: one to five capitalized words, and after a dash, if there is
# one, where they are from.
_CAPITALIZED = r"[A-Z][\w.'-]*"
LABEL = rf"(?U)^{_CAPITALIZED}(\s+{_CAPITALIZED}){{0,4}}(\s*-\s*[A-Z][\w\s.,&'-]*)?\s*$"
OVERLAP = 0.15

BLANK = r"(?U)^\s*$"
_TRIM = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def _lines(documents: DataFrame) -> DataFrame:
    """(document_id, pos, line) of documents (document_id, text) that are not blank."""
    d = documents.where(~F.col("text").rlike(BLANK)).select("document_id", "text")
    return d.select("document_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line"))


def _joined(lines: DataFrame, *by: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy(*by).agg(stripped(text).alias("text"))


def _whole(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents in which no heading was found, as one chunk each."""
    rest = documents.where(~F.col("text").rlike(BLANK)).join(found.select(F.col("document_id").alias("_d")).distinct(), F.col("document_id") == F.col("_d"), "left_anti")
    return rest.select("document_id", F.lit(None).cast("string").alias("section_name"), stripped(F.col("text")).alias("text"), F.lit(0).alias("ord"))


def _numbered(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("ord")
    return rows.select("document_id", (F.row_number().over(w) - 1).cast("int").alias("chunk_index"), "section_name", "text")


def _sections(lines: DataFrame, documents: DataFrame, keep_empty: Column | None = None) -> DataFrame:
    """Sections of lines (document_id, pos, line, name): ``name`` is set where a section starts, and ``line`` is NULL
    where the line itself is no text of it. Text before the first heading is dropped."""
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("ord", F.count("name").over(w)).where("ord > 0")
    body = _joined(rows, "document_id", "ord")
    names = rows.where("name is not null").select("document_id", "ord", F.col("name").alias("section_name"))
    out = names.join(body, ["document_id", "ord"])
    full = F.col("text") != ""
    out = out.where(full if keep_empty is None else full | keep_empty)
    return _numbered(out.select("document_id", "section_name", "text", "ord").unionByName(_whole(documents, names)))


def news(documents: DataFrame) -> DataFrame:
    """One chunk, the text as it is, for each document that is not blank."""
    return documents.where(~F.col("text").rlike(BLANK)).select("document_id", F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("section_name"), "text")


def research(documents: DataFrame) -> DataFrame:
    """By headings marked with # or underlined with === or ---; text before the first and empty sections are dropped."""
    w = Window.partitionBy("document_id").orderBy("pos")
    line, nxt = F.col("line"), F.lead("line").over(w)
    rows = _lines(documents).withColumn("under", nxt.isNotNull() & nxt.rlike(SETEXT) & ~line.rlike(BLANK) & ~line.rlike(ATX) & ~line.rlike(SETEXT))
    rows = rows.withColumn("rule", F.coalesce(F.lag("under").over(w), F.lit(False)))
    name = F.when(line.rlike(ATX), F.regexp_extract(line, ATX, 2)).when(F.col("under"), stripped(line))
    rows = rows.select("document_id", "pos", name.alias("name"), F.when(name.isNull() & ~F.col("rule"), line).alias("line"))
    return _sections(rows, documents)


def filings(documents: DataFrame) -> DataFrame:
    """By item headings of at most 200 characters, named 'Item <number>. <title>'."""
    line = F.col("line")
    head = line.rlike(ITEM) & (F.length(stripped(line)) <= LONGEST_HEADING) & stripped(line).rlike(r"(?i)^item ")
    title = F.regexp_extract(line, ITEM, 2)
    name = F.when(head, F.concat(F.lit("Item "), F.upper(F.regexp_extract(line, ITEM, 1)), F.when(title != "", F.concat(F.lit(". "), title)).otherwise("")))
    rows = _lines(documents).select("document_id", "pos", name.alias("name"), F.when(name.isNull(), line).alias("line"))
    return _sections(rows, documents)


def transcripts(documents: DataFrame) -> DataFrame:
    """By speakers; a line that announces questions becomes an empty chunk named Q&A, after which text has no speaker
    until the next label."""
    line = F.col("line")
    divider = F.lower(stripped(line)).isin(*DIVIDERS)
    head, said = F.substring_index(line, ":", 1), F.substring(line, F.instr(line, ":") + 1, F.length(line))
    label = ~divider & F.contains(line, F.lit(":")) & head.rlike(LABEL)
    name = F.when(divider, "Q&A").when(label, stripped(head))
    text = F.when(divider, F.lit(None)).when(label, F.nullif(F.regexp_replace(said, r"(?U)^\s+", ""), F.lit(""))).otherwise(line)
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(documents).select("document_id", "pos", name.alias("name"), text.alias("line"), divider.alias("divider"))
    rows = rows.withColumn("mute", F.last(F.when(F.col("name").isNotNull(), F.col("divider")), ignorenulls=True).over(w))
    rows = rows.select("document_id", "pos", "name", F.when(~F.coalesce("mute", F.lit(False)), F.col("line")).alias("line"))
    return _sections(rows, documents, F.col("section_name") == "Q&A")


# ---------------------------------------------------------------- pieces of a bounded size
def paragraphs(text: Column) -> Column:
    """Paragraphs: runs of lines that are not blank."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"(?U)(\r\n|\r|\n)([^\S\n]*(\r\n|\r|\n))+", "\u0000"), "\u0000"), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), lambda p: ~p.rlike(BLANK))


def sub_chunks(text: Column, most: int) -> Column:
    """Paragraphs packed in order into pieces of at most ``most`` words; a longer paragraph is a piece of its own.

    A fold over the paragraphs of one text: an array of pieces and the words in the last one.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("words"))

    def step(acc: Column, p: Column) -> Column:
        n = word_tokens(p)
        fits = (acc["now"] != "") & (acc["words"] + n <= most)
        return (
            F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit("\n\n"), p).alias("now"), (acc["words"] + n).alias("words")))
            .when(acc["now"] == "", F.struct(acc["done"].alias("done"), p.alias("now"), n.alias("words")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), p.alias("now"), n.alias("words")))
        )

    return F.aggregate(paragraphs(text), empty, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def overlapped(pieces: Column, most: int, ratio: float = OVERLAP) -> Column:
    """Each piece but the first begins with the last words of the one before: ceil(most * ratio) of them, one at least."""
    r = min(max(ratio, 0.0), 0.5)
    n = max(1, -int(-(most * r) // 1)) if r else 0

    def tail(p: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(p, r"(?U)\s+", " ")), " ")
        return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), F.lit(n)), " ")

    if not n:
        return pieces
    return F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(tail(F.element_at(pieces, i)), F.lit("\n\n"), p)))


def expanded(chunks: DataFrame, most: int, ratio: float = OVERLAP) -> DataFrame:
    """Chunks cut into pieces of a bounded size, numbered through within a document."""
    rows = chunks.select("document_id", "chunk_index", "section_name", F.posexplode(overlapped(sub_chunks(F.col("text"), most), most, ratio)).alias("piece", "text"))
    w = Window.partitionBy("document_id").orderBy("chunk_index", "piece")
    return rows.withColumn("n", (F.row_number().over(w) - 1).cast("int")).select("document_id", F.col("n").alias("chunk_index"), "section_name", "text")


def truncated(text: Column, tokens: int) -> Column:
    """The leading paragraphs (parted by an empty line) within a budget of tokens of four characters; where the first
    alone is too long, that many characters."""
    parts = F.split(text, "\n\n")
    most = 4 * tokens
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("open"))

    def step(a: Column, p: Column) -> Column:
        chars = a["chars"] + F.length(p) + F.when(a["n"] > 0, 2).otherwise(0)
        ok = a["open"] & (chars <= most)
        return F.struct(F.when(ok, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(ok, chars).otherwise(a["chars"]).alias("chars"), ok.alias("open"))

    n = F.aggregate(parts, start, step, lambda a: a["n"])
    return F.when(n > 0, F.array_join(F.slice(parts, F.lit(1), n), "\n\n")).otherwise(F.substring(text, 1, most))
