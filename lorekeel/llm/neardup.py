"""Problem 6: near-duplicate records, by T-occurrence search.

Two sets of shingles with Jaccard similarity t share at least T = ceil(t / (1 + t) * (|a| + |b|))
of them. All inverted lists of a record are ordered by length; the T - k longest are skipped, the rest
are merged, and a record met in k of them is a candidate whose remaining lists are probed. With the
longest lists left out of the merge, the lists that are merged are short: they belong to the rarest
shingles of each record.

In Spark: (1) the length of every list, counted where the shingle's bucket is; (2) each record picks its
short lists; (3) the lists are merged in their buckets into partial counts of pairs; (4) pairs with
k occurrences are probed against the whole sets. Exact copies are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.llm import blobs, stories
from lorekeel.llm import bytescan as bs
from lorekeel.session import persist_table

MERGED_HITS = 3
HOT_SHARE = 1000  # a list longer than one record in so many is hot: counted apart and split
HOT_SALTS = 6
_EXACT, _HOT = 200, 255


def _length_class(df: np.ndarray) -> np.ndarray:
    """List lengths as one byte: exact up to 200, then in steps."""
    steps = _EXACT + np.minimum(8 * np.log2(np.maximum(df, _EXACT) / _EXACT), _HOT - 1 - _EXACT)
    return np.where(df <= _EXACT, df, steps).astype(np.uint8)


def _shingled(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, document of each shingle, shingle) by chunks of records."""
    col = batch.column("words")
    size = blobs.lengths(col, stories.WORD)
    ids = batch.column("rid").to_numpy(zero_copy_only=False)
    for a, b in bs.chunks(size, 400_000):
        d, h = stories.shingles(blobs.flat(col.slice(a, b - a), stories.WORD), size[a:b], n)
        yield ids[a:b], d, h


def hot_shingles(table: DataFrame, n: int, records: int) -> np.ndarray:
    """Shingles whose lists are longer than ``records / HOT_SHARE``, sorted.

    Found on the records whose id hashes to 0 modulo 8. This only balances the load: which shingles are
    hot changes no result. There are at most HOT_SHARE times the mean set size of them.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            pick = bs.mix(batch.column("rid").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % bs.U64(8) == 0
            for _, _, h in _shingled(batch.filter(pa.array(pick)), n):
                u, c = np.unique(h, return_counts=True)
                u, c = u[c > 1], c[c > 1]
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "n"])

    least = max(64, records / HOT_SHARE / 8)
    rows = table.select("rid", "words").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def _in_sorted(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _table(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})


def similar_classes(table: DataFrame, least: float = stories.SIMILARITY, n: int = stories.SHINGLE, hits: int = MERGED_HITS) -> DataFrame:
    """(a, b, similarity): pairs of ids of ``table`` (rid, words) with similarity ``least`` or more, a < b.

    No pair is lost: with the lists of a record ordered by (length class, hash), two records that share T
    shingles share ``hits`` of the first |x| - T + hits of each, for hits <= T.
    """
    records = table.count()
    buckets = blobs.bucket_count(records)
    hot = hot_shingles(table, n, records)
    overlap = least / (1 + least)
    bin_, i32 = pa.binary(), pa.int32()
    place_type = np.uint16 if buckets < 1 << 16 else np.int32

    def scatter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, d, h in _shingled(batch, n):
                home = ((h >> bs.U64(32)) % bs.U64(buckets)).astype(np.int64)
                is_hot = _in_sorted(hot, h)
                back = (bs.mix(ids.astype(np.int64).view(np.uint64)) % bs.U64(buckets)).astype(np.int64)
                # Hot shingles need no count: they go straight to where their record is put together.
                to = np.where(is_hot, -1 - back[d], home)
                rows = []
                for k, (dd, hh, hm) in blobs.split(to, d, h, home):
                    who, cnt = np.unique(dd, return_counts=True)
                    rows.append((k, ids[who].astype(np.int64).tobytes(), cnt.astype(np.int32).tobytes(), hh.astype(np.uint32).tobytes(), hm.astype(place_type).tobytes() if k < 0 else b""))
                yield from _table(rows, ("bucket", "ids", "cnt", "low", "home"), (i32, bin_, bin_, bin_, bin_)).to_batches()

    def count(t: pa.Table) -> pa.Table:
        k = t["bucket"][0].as_py()
        ids, cnt, low = blobs.flat(t["ids"], np.int64), blobs.flat(t["cnt"], np.int32), blobs.flat(t["low"], np.uint32)
        rid = np.repeat(ids, cnt)
        if k < 0:
            cls, home = np.full(len(low), _HOT, np.uint8), blobs.flat(t["home"], place_type)
            back = np.full(len(low), -1 - k)
        else:
            _, inv, c = np.unique(low, return_inverse=True, return_counts=True)
            cls, home = _length_class(c)[inv], np.full(len(low), k, place_type)
            back = (bs.mix(rid.view(np.uint64)) % bs.U64(buckets)).astype(np.int64)
        rows = []
        for to, (r, lo, c, hm) in blobs.split(back, rid, low, cls, home):
            cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            rows.append((to, k, r[cut].tobytes(), np.diff(np.concatenate((cut, [len(r)]))).astype(np.int32).tobytes(), lo.tobytes(), c.tobytes(), hm.tobytes() if k < 0 else b""))
        return _table(rows, ("back", "home", "ids", "cnt", "low", "cls", "homes"), (i32, i32, bin_, bin_, bin_, bin_, bin_))

    def choose(t: pa.Table) -> pa.Table:
        ids, cnt, low, cls = blobs.flat(t["ids"], np.int64), blobs.flat(t["cnt"], np.int32), blobs.flat(t["low"], np.uint32), blobs.flat(t["cls"], np.uint8)
        per_row = blobs.lengths(t["low"], np.uint32)
        home = np.concatenate([np.frombuffer(x, place_type).astype(np.int32) if k < 0 else np.full(m, k, np.int32) for k, x, m in zip(t["home"].to_pylist(), t["homes"].to_pylist(), per_row.tolist(), strict=True)])
        rid, doc = np.unique(np.repeat(ids, cnt), return_inverse=True)
        size = np.bincount(doc)
        order = np.argsort((cls.astype(np.uint64) << bs.U64(56)) | (home.astype(np.uint64) << bs.U64(32)) | low, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        doc, low, cls, home = doc[order], low[order], cls[order], home[order]
        rank = bs.segment_ranges(size)
        # As the smaller record of a pair: T >= 2 t / (1 + t) |x|; as the larger one: T >= t |x|.
        few = size - np.ceil(2 * overlap * size - 1e-9).astype(np.int64) + hits
        many = size - np.ceil(least * size - 1e-9).astype(np.int64) + hits
        take = (rank < many[doc]) & (cls > 1)
        doc, low, cls, home, short = doc[take], low[take], cls[take], home[take], (rank < few[doc])[take]
        rows = []

        def emit(group: np.ndarray, d: np.ndarray, lo: np.ndarray, sh: np.ndarray) -> None:
            for g, (dd, ll, ss) in blobs.split(group, d, lo, sh):
                who, c = np.unique(dd, return_counts=True)
                o = np.argsort(dd, kind="stable")
                rows.append((g, rid[who].tobytes(), size[who].astype(np.int32).tobytes(), c.astype(np.int32).tobytes(), ll[o].tobytes(), ss[o].astype(np.uint8).tobytes()))

        cold = cls < _HOT
        emit(home[cold].astype(np.int64), doc[cold], low[cold], short[cold])
        # A hot list is split into parts, and every two parts meet in a group of their own.
        h = ~cold
        if h.any():
            part = (bs.mix(rid.view(np.uint64)) >> bs.U64(40)).astype(np.int64)[doc[h]] % HOT_SALTS
            for j in range(HOT_SALTS):
                lo_, hi_ = np.minimum(part, j), np.maximum(part, j)
                emit(buckets + (home[h] * HOT_SALTS + lo_) * HOT_SALTS + hi_, doc[h], low[h], short[h])
        return _table(rows, ("list_group", "ids", "size", "cnt", "low", "short"), (i32, bin_, bin_, bin_, bin_, bin_))

    def merge(t: pa.Table) -> pa.Table:
        g = t["list_group"][0].as_py() - buckets
        ids, size, cnt = blobs.flat(t["ids"], np.int64), blobs.flat(t["size"], np.int32), blobs.flat(t["cnt"], np.int32)
        low, short = blobs.flat(t["low"], np.uint32), blobs.flat(t["short"], np.uint8) > 0
        # Records in order of size, so that the smaller one of a pair comes first in a list.
        order = np.lexsort((ids, size))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, size = ids[order], size[order]
        doc = place[np.repeat(np.arange(len(cnt)), cnt)]
        o = np.argsort((low.astype(np.uint64) << bs.U64(32)) | doc.astype(np.uint64), kind="stable")
        doc, low, short = doc[o], low[o], short[o]
        cut = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, np.int64)
        length = np.diff(np.concatenate((cut, [len(low)])))
        left = np.repeat(cut + length, length) - np.arange(len(low)) - 1  # of the list, after each place
        part = (bs.mix(ids.view(np.uint64)) >> bs.U64(40)).astype(np.int64) % HOT_SALTS if g >= 0 else None
        at = np.flatnonzero(short & (left > 0))
        held: list[np.ndarray] = []
        out: list[pa.Table] = []

        def flush() -> None:
            if held:
                u, c = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                x, y = u // len(ids), u % len(ids)
                # Where T < hits, one occurrence is enough.
                need = np.ceil(overlap * (size[x] + size[y].astype(np.int64)) - 1e-9)
                c = np.where(need < hits, hits, c)
                a, b = ids[x], ids[y]
                out.append(blobs.pack_pairs(np.minimum(a, b), np.maximum(a, b), c, buckets))

        step = total = 0
        while len(at):
            step += 1
            x, y = doc[at], doc[at + step]
            ok = (size[y] * least <= size[x] + 1e-9) & (x != y)
            if part is not None:  # only pairs between the two parts of this group
                lo_, hi_ = g % (HOT_SALTS * HOT_SALTS) // HOT_SALTS, g % HOT_SALTS
                ok &= (np.minimum(part[x], part[y]) == lo_) & (np.maximum(part[x], part[y]) == hi_)
            held.append(x[ok] * len(ids) + y[ok])
            total += len(held[-1])
            if total > 2_000_000:
                flush()
                total = 0
            at = at[left[at] > step]
        flush()
        return pa.concat_tables(out) if out else blobs.pack_pairs(*[np.zeros(0, np.int64)] * 3, buckets)

    sent = table.select("rid", "words").mapInArrow(scatter, "bucket int, ids binary, cnt binary, low binary, home binary")
    counted = blobs.per_bucket(sent, "bucket", count, "back int, home int, ids binary, cnt binary, low binary, cls binary, homes binary")
    chosen = blobs.per_bucket(counted, "back", choose, "list_group int, ids binary, size binary, cnt binary, low binary, short binary")
    merged = blobs.per_bucket(chosen, "list_group", merge, blobs.PAIR_SCHEMA)
    candidates = persist_table(blobs.pairs_reaching(merged, hits).select("a", "b"), "near-candidates")
    return stories.verified(candidates, table, least, n)


def t_occurrence(small: int, large: int, least: float) -> int:
    """The overlap T that two sets of these sizes need."""
    return math.ceil(least / (1 + least) * (small + large) - 1e-9)


# ---------------------------------------------------------------- operators
def near_duplicate_classes(articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal stories and the links between different ones.

    Returns (members, representatives, links): members (rid, document_id, scraped_at, key), one row per
    article with a story; representatives (rid, key, ...), one row per class; links (a, b, similarity)
    between the rids of representatives.
    """
    s = stories.story_words(articles)
    c = stories.classes(s)
    links = persist_table(similar_classes(c), "near-links")
    return s.select("rid", "document_id", "scraped_at", "key"), c.select("rid", "document_id", "scraped_at", "key"), links


def near_duplicate_pairs(articles: DataFrame) -> DataFrame:
    """(document_id_a, document_id_b), the smaller first: all pairs of articles with near-equal stories.

    Articles without story, without body or with a story of under three words are in no pair. Rows that
    share a document_id make no pair with each other.
    """
    members, reps, links = near_duplicate_classes(articles)
    key = reps.select("rid", "key")
    linked = links.join(key.select(F.col("rid").alias("a"), F.col("key").alias("ka")), "a").join(key.select(F.col("rid").alias("b"), F.col("key").alias("kb")), "b").select("ka", "kb")
    ids = members.select("key", "document_id")
    # A class needs itself only where it has several members; the count is combined on the map side.
    several = ids.groupBy("key").count().where("count > 1").select(F.col("key").alias("ka"), F.col("key").alias("kb"))
    both = linked.unionByName(several)
    out = both.join(ids.select(F.col("key").alias("ka"), F.col("document_id").alias("x")), "ka").join(ids.select(F.col("key").alias("kb"), F.col("document_id").alias("y")), "kb")
    out = out.where((F.col("ka") != F.col("kb")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("document_id_a"), F.greatest("x", "y").alias("document_id_b"))


def near_duplicate_groups(articles: DataFrame) -> DataFrame:
    """(document_id, class_id, links): one row per article with a story; links counts the articles of
    other classes that are near to its own."""
    members, reps, links = near_duplicate_classes(articles)
    size = members.groupBy("key").count()
    sized = reps.join(size, "key").select("rid", "count")
    ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    n = ends.join(sized.select(F.col("rid").alias("b"), "count"), "b").groupBy("a").agg(F.sum("count").alias("links"))
    per_class = reps.join(n, reps.rid == n.a, "left").select("key", F.col("rid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(per_class, "key").select("document_id", "class_id", "links")
