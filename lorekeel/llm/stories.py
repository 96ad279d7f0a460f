"""Stories of articles as sequences of word hashes, and their classes of equal word sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.llm import blobs, boilerplate
from lorekeel.llm import bytescan as bs
from lorekeel.session import persist_table

SHINGLE = 3
SIMILARITY = 0.5
WORD = np.uint32


def story_words(articles: DataFrame, sample_pages: int = boilerplate.SAMPLE_PAGES) -> DataFrame:
    """(rid, document_id, scraped_at, key, words): the story of every article as packed word hashes.

    ``key`` is a digest of the words; articles with the same key tell the same story word by word.
    Articles whose story has fewer than three words have no run of three words and are left out. The
    table is written to the shared scratch folder, as every later step reads it.
    """
    m = boilerplate.sample_model(articles, sample_pages)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            words: list[bytes] = [b""] * batch.num_rows
            for a, b, x, story in boilerplate.scan_pages(batch, m):
                n = x.count[story]
                at = np.repeat(x.first[story], n) + bs.segment_ranges(n)
                w = (x.words.word[at] >> bs.U64(32)).astype(WORD)
                end = np.cumsum(np.bincount(x.doc[story], n, b - a).astype(np.int64))
                for k, (i, j) in enumerate(zip([0, *end[:-1]], end, strict=True)):
                    words[a + k] = w[i:j].tobytes()
            keep = [k for k, w in enumerate(words) if len(w) >= SHINGLE * WORD().itemsize]
            kept = [words[k] for k in keep]
            cols = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("rid", "document_id", "scraped_at")]
            key = pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, key, pa.array(kept, pa.binary())], ["rid", "document_id", "scraped_at", "key", "words"])

    src = articles.select(F.monotonically_increasing_id().alias("rid"), "document_id", F.unix_micros("scraped_at").alias("scraped_at"), "title", "body")
    return persist_table(src.mapInArrow(run, "rid long, document_id string, scraped_at long, key binary, words binary"), "story-words")


def classes(stories: DataFrame) -> DataFrame:
    """(rid, document_id, scraped_at, key, words) of the earliest article of every class of equal stories.

    The minimum is combined on the map side, so a class that holds a third of all rows sends one row
    per task.
    """
    first = F.min(F.struct(F.coalesce("scraped_at", F.lit(1 << 62)).alias("at"), F.coalesce("document_id", F.lit("")).alias("id"), "rid", "scraped_at", "document_id", "words")).alias("s")
    return persist_table(stories.groupBy("key").agg(first).select("s.rid", "s.document_id", "s.scraped_at", "key", "s.words"), "story-classes")


def shingles(words: np.ndarray, size: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of n words of many documents: (document, hash), ordered by both.

    ``words`` holds the words of all documents end to end, ``size`` the number of words of each.
    """
    doc = np.repeat(np.arange(len(size)), size)
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = bs.ngrams(words, n)
    d = doc[: len(h)]
    inside = d == doc[n - 1 :]
    d, h = d[inside], h[inside]
    order = _by_both(d, h)
    d, h = d[order], h[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.zeros(0, bool)
    return d[new], h[new]


def _by_both(d: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by d, then by h: one sort of both in one number, done again in full where the cut of h is not enough."""
    bits = max(1, int(d[-1]).bit_length()) if len(d) else 1  # d is in order
    order = np.argsort((d.astype(np.uint64) << bs.U64(64 - bits)) | (h >> bs.U64(bits)), kind="stable")
    x, y = d[order], h[order]
    return order if ((x[1:] != x[:-1]) | (y[1:] >= y[:-1])).all() else np.lexsort((h, d))


def probed(da: np.ndarray, ha: np.ndarray, db: np.ndarray, hb: np.ndarray, pairs: int) -> np.ndarray:
    """For each pair the number of shingles of a that are in the set of b, by binary search.

    Whether b is in the list of a shingle is whether the shingle is in the ordered set of b, so a list of any length is probed in
    the time its record takes, and is never read.
    """
    bits = bs.U64(max(1, int(max(pairs - 1, 1)).bit_length()))
    key = lambda d, h: (d.astype(np.uint64) << (bs.U64(64) - bits)) | (h >> bits)
    kb = key(db, hb)
    at = np.searchsorted(kb, key(da, ha))
    # The cut of a hash may be that of several: step on while the hash itself is another.
    hit = np.zeros(len(da), bool)
    live = np.flatnonzero(at < len(kb))
    at = at[live]
    while len(live):
        same = (db[at] == da[live]) & (hb[at] == ha[live])
        hit[live[same]] = True
        on = ~same & (kb[at] == key(da[live], ha[live])) & (at + 1 < len(kb))
        live, at = live[on], at[on] + 1
    return np.bincount(da[hit], minlength=pairs)


def verified(pairs: DataFrame, table: DataFrame, least: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """(a, b, similarity) of the pairs of ids whose stories reach the Jaccard similarity, exactly.

    ``pairs`` must have been written, as it is read twice. Word sequences of stories in no pair are
    dropped by a Bloom filter before the joins.
    """
    pairs = pairs.select("a", "b")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    words = blobs.keep_likely(table.select("rid", "words"), "rid", blobs.bloom(ids, "id"))
    joined = pairs.join(words.select(F.col("rid").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("rid").alias("b"), F.col("words").alias("wb")), "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = []
            for c in ("wa", "wb"):
                d, h = shingles(blobs.flat(batch.column(c), WORD), blobs.lengths(batch.column(c), WORD), n)
                sets.append((d, h, np.bincount(d, minlength=batch.num_rows)))
            (da, ha, na), (db, hb, nb) = sets
            both = probed(da, ha, db, hb, batch.num_rows)
            sim = both / np.maximum(na + nb - both, 1)
            ok = sim >= least
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array(sim[ok])], ["a", "b", "similarity"])

    return joined.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, similarity double")
