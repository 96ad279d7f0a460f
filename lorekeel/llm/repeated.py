"""Problem 2: lines repeated across the articles of one source.

Text is cut into chunks where a rolling hash of the last bytes says so, and at the ends of lines, since
a line is what is cut out in the end; long lines so fall into several chunks. Every chunk is counted by
the articles of its source that have it. A line all of whose chunks are frequent is a candidate; the
articles that have the whole line are then counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.llm import blobs
from lorekeel.llm import bytescan as bs
from lorekeel.session import persist_table

WINDOW = 16
MASK = 31  # a chunk ends where the rolling hash has these bits clear: 32 bytes more on average
LEAST_ARTICLES = 5
LEAST_SHARE_INVERSE = 20  # 1 / 5 %
TOGETHER = 1000  # articles of a source that are read together

_SPACES = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_DIGIT = re.compile(r"(?![0-9])\d")
_KIND = np.zeros(256, np.uint8)  # 1 blank, 2 digit
for _c in b" \t\r\x0b\x0c\x1c\x1d\x1e\x1f":
    _KIND[_c] = 1
_KIND[48:58] = 2


def _plain(text: str) -> str:
    """Lower case; blanks and digits beyond ASCII become ASCII ones."""
    text = text.lower()
    if text.isascii():
        return text
    for c in _SPACES:
        if c in text:
            text = text.replace(c, " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _DIGIT.sub("0", text)
    return text


class LineChunks:
    """The lines of many bodies in their compared form, and the chunks of each."""

    def __init__(self, bodies: list[str | None]) -> None:
        raw = [(_plain(b or "") + "\n").encode("utf-8", "replace") for b in bodies]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        kind = _KIND[buf]
        buf = np.where(kind == 1, np.uint8(32), np.where(kind == 2, np.uint8(48), buf))
        again = np.zeros(len(buf), bool)
        again[1:] = (kind[1:] != 0) & (kind[1:] == kind[:-1])
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        buf, owner = buf[~again], owner[~again]
        edge = np.zeros(len(buf), bool)
        nl = buf == 10
        edge[1:] = (buf[1:] == 32) & nl[:-1]
        edge[:-1] |= (buf[:-1] == 32) & nl[1:]
        if len(buf) and buf[0] == 32:
            edge[0] = True
        buf, owner = buf[~edge], owner[~edge]
        end = np.flatnonzero(buf == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        doc = owner[end].astype(np.int64)
        no = np.arange(len(end)) - np.searchsorted(doc, doc)
        keep = end > start
        sums = bs.running(buf)
        start, end = start[keep], end[keep]
        self.doc, self.no = doc[keep], no[keep]
        self.line = bs.spans(sums, start, end)
        # Chunk ends: by content, where the window lies within the line; and at line ends.
        width = end - start
        inner = np.flatnonzero(width > WINDOW)
        pos = np.repeat(start[inner] + WINDOW, width[inner] - WINDOW) + bs.segment_ranges(width[inner] - WINDOW)
        cut = pos[(bs.spans(sums, pos - WINDOW, pos) & bs.U64(MASK)) == 0]
        stop = np.sort(np.concatenate((cut, end)))
        begin = np.concatenate(([0], stop[:-1]))
        line = np.searchsorted(end, stop)
        begin = np.maximum(begin, start[line]) if len(line) else begin
        self.chunk, self.chunk_line = bs.spans(sums, begin, stop), line


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, int, LineChunks]]:
    bodies = batch.column("body").to_pylist()
    for a, b in bs.chunks(len(x or "") + 1 for x in bodies):
        yield a, b, LineChunks(bodies[a:b])


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((y, x))
    x, y = x[o], y[o]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, bool)
    return x[new], y[new]


def frequent_chunks(articles: DataFrame) -> DataFrame:
    """(source, keys): chunks found in at least 5 articles and 5 % of the articles of their source.

    The counts are made per batch before anything is sent. A source has at most 20 times as many such
    chunks as its articles have chunks on average.
    """
    buckets = blobs.bucket_count(articles.count())

    def scatter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sources = batch.column("source").to_pylist()
            for a, b, x in _read(batch):
                names = sources[a:b]
                index = {s: i for i, s in enumerate(dict.fromkeys(names))}
                of_doc = np.array([index[s] for s in names], np.int64)
                d, c = _distinct(x.doc[x.chunk_line], x.chunk)
                o = np.lexsort((c, of_doc[d]))
                s, c = of_doc[d][o], c[o]
                first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))) if len(s) else np.zeros(0, np.int64)
                s, c, n = s[first], c[first], np.diff(np.concatenate((first, [len(s)])))
                to = ((c >> bs.U64(33)) % bs.U64(buckets)).astype(np.int64)
                listed = list(index)
                rows = [(listed[k // buckets], k % buckets, cc.tobytes(), nn.astype(np.int32).tobytes()) for k, (cc, nn) in blobs.split(s * buckets + to, c, n)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield from pa.table({"source": pa.array(cols[0], pa.string()), "bucket": pa.array(cols[1], pa.int32()), "keys": pa.array(cols[2], pa.binary()), "n": pa.array(cols[3], pa.binary())}).to_batches()

    def count(t: pa.Table) -> pa.Table:
        # A group is one bucket of one source, so a source with a third of all rows has many.
        h, n = blobs.flat(t["keys"], np.uint64), blobs.flat(t["n"], np.int32)
        u, inv = np.unique(h, return_inverse=True)
        total = np.bincount(inv, n, len(u))
        articles_of = t["articles"][0].as_py()
        ok = (total >= LEAST_ARTICLES) & (total * LEAST_SHARE_INVERSE >= articles_of)
        return pa.table({"source": t["source"].slice(0, 1), "keys": pa.array([u[ok].tobytes()], pa.binary())})

    per_source = articles.groupBy("source").agg(F.count(F.lit(1)).alias("articles"))
    sent = articles.select("source", "body").mapInArrow(scatter, "source string, bucket int, keys binary, n binary")
    joined = sent.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return joined.groupBy("source", "bucket").applyInArrow(count, "source string, keys binary").where(F.length("keys") > 0)


def repeated_lines(articles: DataFrame) -> DataFrame:
    """(document_id, line_no): each occurrence of a line that stands in at least 5 articles and at least 5 %
    of the articles of its source.

    Blank lines are no lines. Lines are compared without case, outer blanks, the length of blanks and the
    digits of numbers. A NULL source is a source of its own; a NULL body has no lines, but its row counts as
    an article. A line that stands twice in one article counts once and is reported twice.
    """
    found = persist_table(frequent_chunks(articles), "frequent-chunks")
    per_source = persist_table(articles.groupBy("source").agg(F.count(F.lit(1)).alias("articles")), "articles-of-sources")
    rows = persist_table(_candidates(articles, found, per_source), "line-candidates")
    sizes = per_source.withColumnRenamed("source", "s")
    counted = rows.groupBy("source", "line").agg(F.sum("first").alias("n")).join(sizes, F.col("source").eqNullSafe(F.col("s")))
    often = counted.where((F.col("n") >= LEAST_ARTICLES) & (F.col("n") * LEAST_SHARE_INVERSE >= F.col("articles"))).select(F.col("source").alias("src"), F.col("line").alias("ln"))
    return rows.join(often, (F.col("line") == F.col("ln")) & F.col("source").eqNullSafe(F.col("src")), "left_semi").select("document_id", "line_no")


def _candidates(articles: DataFrame, found: DataFrame, per_source: DataFrame) -> DataFrame:
    """(document_id, source, line_no, line, first): the lines all of whose chunks are frequent in their source.

    The articles of a source meet its frequent chunks in groups of ``TOGETHER`` articles, so a source with a third of all rows
    is as many groups as it needs, and nothing goes through the driver.
    """
    parts = per_source.where(F.col("articles") >= LEAST_ARTICLES).select(F.col("source").alias("s"), F.ceil(F.col("articles") / TOGETHER).cast("long").alias("parts"))
    same = F.col("source").eqNullSafe(F.col("s"))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # no source is a name of its own
    part = F.pmod(F.xxhash64("document_id", F.monotonically_increasing_id()), F.col("parts"))
    left = articles.select("document_id", "source", "body").where("body is not null").join(parts, same).select("document_id", "source", "body", name.alias("name"), part.alias("part"))
    right = found.join(parts, same).select(name.alias("name"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "keys")

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        known = np.sort(blobs.flat(b["keys"], np.uint64))
        held = [_out(a.slice(0, 0), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(known):
            for lo, hi, x in _read(a):
                k = np.minimum(np.searchsorted(known, x.chunk), len(known) - 1)
                line = np.flatnonzero(np.bincount(x.chunk_line[known[k] != x.chunk], minlength=len(x.line)) == 0)
                d, hash_ = x.doc[line], x.line[line]
                o = np.lexsort((line, hash_, d))
                new = np.concatenate(([True], (d[o][1:] != d[o][:-1]) | (hash_[o][1:] != hash_[o][:-1]))) if len(o) else np.zeros(0, bool)
                first = np.zeros(len(line), np.int64)
                first[o[new]] = 1
                held.append(_out(a.slice(lo, hi - lo), d, x.no[line].astype(np.int32), hash_.view(np.int64), first))
        return pa.concat_tables(held)

    return left.groupBy("name", "part").cogroup(right.groupBy("name", "part")).applyInArrow(meet, "document_id string, source string, line_no int, line long, first long")


def _out(t: pa.Table, doc: np.ndarray, no: np.ndarray, line: np.ndarray, first: np.ndarray) -> pa.Table:
    at = pa.array(doc.astype(np.int64))
    return pa.table({"document_id": t["document_id"].take(at), "source": t["source"].take(at), "line_no": pa.array(no), "line": pa.array(line), "first": pa.array(first)})


def without_lines(articles: DataFrame, lines: DataFrame) -> DataFrame:
    """``articles`` with the given (document_id, line_no) cut out of ``body``; all other columns as they are.

    ``lines`` is collected per document, so it is bounded by the lines of one body.
    """
    cut = lines.groupBy(F.col("document_id").alias("cut_id")).agg(F.collect_set("line_no").alias("cut_no"))
    kept = F.array_join(F.filter(F.split("body", "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("cut_no", i), F.lit(False))), "\n")
    return articles.join(cut, F.col("document_id") == F.col("cut_id"), "left").withColumn("body", kept).drop("cut_id", "cut_no")
