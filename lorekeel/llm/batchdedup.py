"""Problem 4: each new batch against all history.

``first_known`` takes every pair that reaches the similarity, from the exact overlap join of ``neardup``, and of those the earliest.

``HistoryIndex`` finds candidates by immutable suffix arrays merged logarithmically, which is not exact: it samples suffixes, links each to
the first and last record of its longest match only, and asks for a share of all words. The text is the stories of a batch, one word after the other. A suffix is told by the hashes of its first 5, 8 and 16 words in one
number, so that suffixes in the order of these numbers stand beside those they share most words with. An array is the suffixes
of one or more batches in that order and never changes; a batch's own suffixes are looked up in every array by binary search,
at 16 words first, then 8, then 5, so each finds its longest match; arrays of like size are merged, so there are
logarithmically many. The matches of a record are summed over its words as its coverage by each earlier record; what is
covered enough is compared exactly.

Suffixes are kept at the words where the hash of the first five is the less of two neighbours, so a common run of six words
always has one in common. Records under ``SMALL`` words keep all suffixes too, by 3, 5 and 8 words.

What this finds: where two stories of similarity 0.5 differ by replaced words, a ninth of the words at most are replaced, so the runs
between have eight words on average, and at least a third of the words lies in matches (for inserted words, a sixth). Where the
shorter story has under 24 words, both are small, and each run of three words counts. ``COVERAGE`` is below all of these.

Suffixes are divided among tasks by the hash of their first words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeel.llm import blobs, neardup, stories
from lorekeel.llm import bytescan as bs
from lorekeel.session import persist_table

LEVELS = (5, 8, 16)  # words of a suffix that are compared
SMALL, SMALL_LEVELS = 64, (3, 5, 8)
LENGTHS = np.array([3, 5, 8, 16])  # what the two bits of a match stand for
COVERAGE = 0.125
BLOCK = 4096
_CUTS = (0, 16, 32)  # bits below those of 16, 8 and 5 words in the number of a suffix


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on, zeros after the end."""
    return bs.ngrams(np.concatenate((words, np.zeros(n - 1, words.dtype))), n)


def suffixes(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, place, number, whether it is one of a small record's) of the suffixes that are kept, records in order."""
    doc = np.repeat(np.arange(len(size)), size)
    place = bs.segment_ranges(size)
    left = size[doc] - place  # words from here to the end
    out = []
    for levels, small in ((LEVELS, 0), (SMALL_LEVELS, 1)):
        pick = left >= levels[0]
        if small:
            pick &= size[doc] < SMALL
        if not pick.any():
            continue
        first = _runs(words, levels[0])
        if not small:
            # The less of two neighbours within a record.
            after = np.concatenate((first[1:], first[-1:]))
            before = np.concatenate((first[:1], first[:-1]))
            has_after, has_before = left > levels[0], place > 0
            pick &= ~has_after | (first <= after) | has_before & (first < before)
        at = np.flatnonzero(pick)
        key = first[at] & bs.U64(0xFFFFFFFF00000000)
        if small:
            key ^= bs.U64(0x5555555500000000)
        for n, shift in ((levels[1], 48), (levels[2], 48)):
            # Beyond the end of a record its number takes the place of words, so that no more words are shared than there are.
            h = _runs(words, n)[at]
            short = left[at] < n
            h = np.where(short, bs.mix(first[at] + doc[at].astype(np.uint64) * bs.U64(0x9E3779B97F4A7C15) + bs.U64(n)), h)
            key |= (h >> bs.U64(shift)) << bs.U64(16 if n == levels[1] else 0)
        out.append((doc[at], place[at], key, np.full(len(at), small)))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    d, q, h, k = (np.concatenate(x) for x in zip(*out, strict=True))
    o = np.argsort(d, kind="stable")
    return d[o], q[o], h[o], k[o]


class SuffixArray:
    """Suffixes in order of their numbers, each with its record (a number in the order of time). For every prefix that is compared
    the first and the last record that has it is found once."""

    def __init__(self, key: np.ndarray, doc: np.ndarray) -> None:
        self.key, self.doc = key, doc
        self.groups = []
        for cut in _CUTS:
            p = key >> bs.U64(cut)
            at = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)
            lo, hi = (f.reduceat(doc, at) if len(at) else doc for f in (np.minimum, np.maximum))
            self.groups.append((p[at], lo, hi))

    @staticmethod
    def of(key: np.ndarray, doc: np.ndarray) -> SuffixArray:
        o = np.argsort(key, kind="stable")
        return SuffixArray(key[o], doc[o])

    def merged(self, other: SuffixArray) -> SuffixArray:
        return SuffixArray.of(np.concatenate((self.key, other.key)), np.concatenate((self.doc, other.doc)))

    def search(self, key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, places in ``key`` that are met, first record, last record), the longest prefix first."""
        for level, (cut, (p, lo, hi)) in enumerate(zip(_CUTS, self.groups, strict=True)):
            if not len(p):
                return
            q = key >> bs.U64(cut)
            at = np.minimum(np.searchsorted(p, q), len(p) - 1)
            hit = np.flatnonzero(p[at] == q)
            yield level, hit, lo[at[hit]], hi[at[hit]]


class Segments:
    """The arrays of the records seen so far, in one task."""

    def __init__(self) -> None:
        self.held: list[SuffixArray] = []

    def search(self, key: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix the first and last record of its longest match, and its level; ``none``, -1 and 3 where there is none."""
        first, last, depth = np.full(len(key), none), np.full(len(key), -1), np.full(len(key), 3)
        for segment in self.held:
            for level, hit, lo, hi in segment.search(key):
                better = depth[hit] > level
                first[hit[better]], last[hit[better]], depth[hit[better]] = lo[better], hi[better], level
                same = depth[hit] == level
                first[hit[same]] = np.minimum(first[hit[same]], lo[same])
                last[hit[same]] = np.maximum(last[hit[same]], hi[same])
        return first, last, depth

    def add(self, segment: SuffixArray) -> None:
        """Append an array and merge those of like size."""
        self.held.append(segment)
        while len(self.held) > 1 and len(self.held[-2].key) <= 2 * len(self.held[-1].key):
            self.held[-2:] = [self.held[-2].merged(self.held[-1])]


def _within(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes, their records in order, the first and the last earlier record of the longest match among themselves, and its level."""
    n = len(key)
    first, last, depth = np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.full(n, 3)
    for level, cut in reversed(list(enumerate(_CUTS))):
        p = key >> bs.U64(cut)
        o = np.argsort(p, kind="stable")  # records stay in order
        new = np.concatenate(([True], p[o][1:] != p[o][:-1]))
        head = doc[o][np.flatnonzero(new)][np.cumsum(new) - 1]
        # The record before, a record that has the prefix twice being one.
        step = np.concatenate(([True], (doc[o][1:] != doc[o][:-1]) | new[1:]))
        start = np.flatnonzero(step)[np.cumsum(step) - 1]
        before = np.where(new[start], -1, doc[o][np.maximum(start - 1, 0)])
        hit = before >= 0
        first[o[hit]], last[o[hit]], depth[o[hit]] = head[hit], before[hit], level
    return first, last, depth


_SENT = "bucket int, rid binary, at binary, tie binary, total binary, cnt binary, key binary, place binary, far binary"


def _places(t: pa.Table) -> np.ndarray:
    """Places of suffixes, twice and one more for small records. They travel as two bytes, with two more where a record is long."""
    low = blobs.flat(t["place"], np.uint16).astype(np.int64)
    n = blobs.lengths(t["place"], np.uint16)
    far = t["far"].to_pylist()
    if any(far):
        low += np.concatenate([np.frombuffer(x, np.uint16) if x else np.zeros(k, np.uint16) for x, k in zip(far, n.tolist(), strict=True)]).astype(np.int64) << 16
    return low


def _scatter(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size = blobs.lengths(batch.column("words"), stories.WORD)
            rid, at = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rid", "at"))
            tie = np.array([int.from_bytes((x or "").encode()[:8].ljust(8, b"\0"), "big") >> 1 for x in batch.column("document_id").to_pylist()], np.int64)
            for a, b in bs.chunks(size, 400_000):
                d, q, h, small = suffixes(blobs.flat(batch.column("words").slice(a, b - a), stories.WORD), size[a:b])
                rows = []
                home = (bs.mix(h >> bs.U64(32)) % bs.U64(buckets)).astype(np.int64)
                for k, (dd, hh, qq) in blobs.split(home, d, h, q * 2 + small):
                    who, c = np.unique(dd, return_counts=True)
                    rows.append((k, rid[a + who].tobytes(), at[a + who].tobytes(), tie[a + who].tobytes(), size[a + who].astype(np.int32).tobytes(), c.astype(np.int32).tobytes(), hh.tobytes(), (qq & 0xFFFF).astype(np.uint16).tobytes(), (qq >> 16).astype(np.uint16).tobytes() if qq.max() >> 16 else b""))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                yield from pa.table({n: pa.array(c, pa.int32() if n == "bucket" else pa.binary()) for n, c in zip(("bucket", "rid", "at", "tie", "total", "cnt", "key", "place", "far"), cols, strict=True)}).to_batches()

    return run


MATCHES = "bucket int, a binary, b binary, least binary, cnt binary, seed binary"


def _packed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, place: np.ndarray, length: np.ndarray, buckets: int) -> pa.Table:
    """Matches (record a, record b, their words, place in a, which of LENGTHS) packed by pair: the words of the shorter record, and
    of each match its place and its words, which end with the record."""
    o = np.lexsort((place, b, a))
    a, b, least = a[o], b[o], np.minimum(na, nb)[o]
    seed = (place[o] * 32 + np.minimum(LENGTHS[length[o]], na[o] - place[o])).astype(np.uint32)
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    new[::60_000] = True  # a pair with very many matches is several
    cut = np.flatnonzero(new)
    count = np.diff(np.concatenate((cut, [len(a)])))
    home = (bs.mix(a[cut].astype(np.uint64) * bs.U64(0x9E3779B97F4A7C15) + b[cut].astype(np.uint64)) % bs.U64(buckets)).astype(np.int64)
    rows = []
    for k, (i,) in blobs.split(home, np.arange(len(cut))):
        at = np.repeat(cut[i], count[i]) + bs.segment_ranges(count[i])
        c = cut[i]
        rows.append((k, a[c].astype(np.int64).tobytes(), b[c].astype(np.int64).tobytes(), least[c].astype(np.int32).tobytes(), count[i].astype(np.uint16).tobytes(), seed[at].tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table({n: pa.array(c, pa.int32() if n == "bucket" else pa.binary()) for n, c in zip(("bucket", "a", "b", "least", "cnt", "seed"), cols, strict=True)})


def _covered(coverage: float):
    """(a, b) of the pairs whose matches cover so much of the shorter record: the words of a that lie in any match."""

    def run(t: pa.Table) -> pa.Table:
        a, b = blobs.flat(t["a"], np.int64), blobs.flat(t["b"], np.int64)
        least, cnt = blobs.flat(t["least"], np.int32).astype(np.int64), blobs.flat(t["cnt"], np.uint16).astype(np.int64)
        seed = blobs.flat(t["seed"], np.uint32).astype(np.int64)
        pair = np.repeat(np.arange(len(a)), cnt)
        o = np.lexsort((b, a))
        new = np.concatenate(([True], (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1]))) if len(a) else np.zeros(0, bool)
        who = np.empty(len(a), np.int64)
        who[o] = np.cumsum(new) - 1
        group = who[pair]
        start = seed // 32
        end = start + seed % 32
        o = np.lexsort((start, group))
        g, start, end = group[o], start[o], end[o]
        # The words up to the furthest end so far count once; places of one group lie above those of the group before.
        span = int(end.max(initial=0)) + 1
        far = np.maximum.accumulate(end + g * span) if len(g) else end
        seen = np.concatenate(([0], far[:-1])) if len(g) else end
        fresh = np.maximum(0, end + g * span - np.maximum(start + g * span, seen))
        covered = np.bincount(g, fresh, int(g.max(initial=-1)) + 1)
        one = np.zeros(len(covered), np.int64)
        one[who] = np.arange(len(a))
        ok = covered >= coverage * least[one] - 1e-9 if len(a) else np.zeros(0, bool)
        return pa.table({"a": pa.array(a[one[ok]]), "b": pa.array(b[one[ok]])})

    return run


def _replay(buckets: int):
    """One task: its batches in order of time, each searched in the arrays before it is added."""

    def run(t: pa.Table) -> pa.Table:
        rid, at, tie = (blobs.flat(t[c], np.int64) for c in ("rid", "at", "tie"))
        total, cnt = blobs.flat(t["total"], np.int32), blobs.flat(t["cnt"], np.int32)
        key, place = blobs.flat(t["key"], np.uint64), _places(t)
        order = np.lexsort((rid, tie, at))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        doc = np.repeat(number, cnt)
        rid, total = rid[order], total[order]
        o = np.argsort(doc, kind="stable")
        doc, key, place = doc[o], key[o], place[o]
        seg, found = Segments(), []
        i = 0
        while i < len(doc):
            # A block of consecutive records has an array of its own; what it meets within itself counts as well.
            j = min(i + BLOCK, len(doc))
            j = int(np.searchsorted(doc, doc[j - 1], "right"))
            k, d = key[i:j], doc[i:j]
            first, last, depth = seg.search(k, len(rid))
            own_first, own_last, own_depth = _within(k, d)
            nearer, same = own_depth < depth, own_depth == depth
            first = np.where(nearer, own_first, np.where(same, np.minimum(first, own_first), first))
            last = np.where(nearer, own_last, np.where(same, np.maximum(last, own_last), last))
            depth = np.minimum(depth, own_depth)
            length = 3 - depth - place[i:j] % 2
            for e, ok in ((first, depth < 3), (last, (depth < 2) & (last != first))):
                ok = ok & (e >= 0) & (e < d)
                found.append((d[ok], e[ok], place[i:j][ok] // 2, length[ok]))
            seg.add(SuffixArray.of(k, d))
            i = j
        x, y, q, length = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        return _packed(rid[x], rid[y], total[x], total[y], q, length, buckets)

    return run


def covered_pairs(table: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(a, b): record a is covered by the earlier record b, or the other way round, to the share ``coverage`` of the shorter one.

    ``table`` has rid, at (long), document_id, words. Each suffix links a record to the first and, if they have eight words in common, to
    the last earlier record of its longest match, so a group of any size gives two links for each suffix, not all pairs.
    """
    buckets = blobs.bucket_count(table.count())
    sent = table.select("rid", "at", "document_id", "words").mapInArrow(_scatter(buckets), _SENT)
    return blobs.per_bucket(blobs.per_bucket(sent, "bucket", _replay(buckets), MATCHES), "bucket", _covered(coverage), "a long, b long")


def first_known(articles: DataFrame) -> DataFrame:
    """(document_id, first_document_id): each article that an earlier one is near to, and the earliest such.

    Order is (scraped_at, document_id), NULL scraped_at last. Articles of equal stories are one class told
    by its earliest member, so copies cost one row each. Every pair of classes that reaches the similarity counts by itself:
    near to near is not taken for near.
    """
    s = stories.story_words(articles)
    c = stories.classes(s).withColumn("at", F.coalesce("scraped_at", F.lit(1 << 62)))
    linked = persist_table(neardup.similar_classes(c).select("a", "b"), "batch-links")
    first = _direct(linked, c).select("a", F.col("o.id").alias("document_id"))
    return _answers(s, c, first)


def _answers(s: DataFrame, c: DataFrame, first: DataFrame) -> DataFrame:
    """Articles of ``s`` with the first article of their class ``c``, or the earliest member of the class itself."""
    key = c.select(F.col("rid"), "key")
    by_class = first.join(key.withColumnRenamed("rid", "a"), "a").select("key", F.col("document_id").alias("first_document_id"))
    member = s.select("document_id", F.coalesce("scraped_at", F.lit(1 << 62)).alias("at"), "key")
    head = c.select("key", F.col("at").alias("head_at"), F.col("document_id").alias("head_id"))
    out = member.join(head, "key").join(by_class, "key", "left")
    later = (F.col("at") > F.col("head_at")) | (F.col("at") == F.col("head_at")) & (F.col("document_id") > F.col("head_id"))
    answer = F.coalesce("first_document_id", F.when(later, F.col("head_id")))
    return out.select("document_id", answer.alias("first_document_id")).where("first_document_id is not null")


def _direct(linked: DataFrame, c: DataFrame) -> DataFrame:
    """(a, o): for each linked class that has an earlier partner the earliest of them, as (at, id, rid)."""
    when = c.select(F.col("rid"), F.struct("at", F.coalesce("document_id", F.lit("")).alias("id"), "rid").alias("o"))
    # Both ends are classes in verified links: few, but not bounded, so they are joined, not collected.
    both = linked.join(when.select(F.col("rid").alias("a"), F.col("o").alias("oa")), "a").join(when.select(F.col("rid").alias("b"), F.col("o").alias("ob")), "b")
    flip = F.col("oa") < F.col("ob")
    both = both.select(F.when(flip, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(flip, F.col("oa")).otherwise(F.col("ob")).alias("o"))
    return both.groupBy("a").agg(F.min("o").alias("o"))


def _earliest(spark: SparkSession, linked: DataFrame, c: DataFrame) -> DataFrame:
    """(a, document_id): for each linked class its earliest partner, following links of links."""
    direct = persist_table(_direct(linked, c), "batch-first")
    now = direct
    while True:
        up = now.select(F.col("a").alias("x"), F.col("o").alias("up"))
        nxt = persist_table(now.join(up, F.col("o.rid") == F.col("x"), "left").select("a", F.least("o", F.coalesce("up", "o")).alias("o"), (F.coalesce("up", "o") < F.col("o")).alias("moved")), "batch-first")
        moved = nxt.where("moved").limit(1).count()
        now = nxt.select("a", "o")
        if not moved:
            break
    jump = now.alias("n").join(direct.select(F.col("a").alias("k"), F.col("o").alias("d")), F.col("n.a") == F.col("k")).where("n.o.rid != d.rid").select(F.col("n.a").alias("a"), F.col("n.o.rid").alias("b"))
    checked = stories.verified(persist_table(jump, "batch-jumps"), c).select(F.col("a").alias("x"), F.col("b").alias("y"))
    best = now.alias("n").join(direct.select(F.col("a").alias("k"), F.col("o").alias("d")), F.col("n.a") == F.col("k")).join(checked, (F.col("n.a") == F.col("x")) & (F.col("n.o.rid") == F.col("y")), "left")
    return best.select(F.col("n.a").alias("a"), F.when(F.col("y").isNotNull(), F.col("n.o.id")).otherwise(F.col("d.id")).alias("document_id"))


# ---------------------------------------------------------------- an index that lives on
FAN_IN = 4
_RECORD = ("rid", "document_id", "at", "key", "words")
_SEGMENT = "bucket int, keys binary, rids binary, ats binary, totals binary, places binary"


class HistoryIndex:
    """Suffix arrays and records of all batches accepted so far, in a folder; one writer at a time.

    ``add`` compares a batch with the history and then appends it: one new segment, the arrays of its own suffixes. Segments are
    never changed; when a level has FAN_IN of them, they are merged into one of the next level, so a suffix is written
    logarithmically often and a batch searches logarithmically many arrays. Which folders count is told by a manifest, written
    last and whole, so a job that breaks off leaves the index as it was. The texts of the history are read only for
    candidates, by a Bloom filter. The number of buckets is fixed when the index is made; take so many that one of the final history
    fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 48) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self) -> dict[str, list[str]]:
        """The folders of the newest manifest."""
        fs, p = self._fs(f"{self.path}/manifest")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p) if not x.getPath().getName().endswith(".tmp")) if fs.exists(p) else []
        if not names:
            return {"segments": [], "records": []}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{names[-1]}").collect()))

    def _publish(self, held: dict[str, list[str]]) -> None:
        """Write the manifest under another name and rename it: readers see the old one or the new one."""
        fs, p = self._fs(f"{self.path}/manifest")
        n = len(fs.listStatus(p)) if fs.exists(p) else 0
        _, tmp = self._fs(f"{self.path}/manifest/{n:010d}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        fs.rename(tmp, self._fs(f"{self.path}/manifest/{n:010d}")[1])

    def _segments(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _SEGMENT)
        return self.spark.read.schema(_SEGMENT).parquet(*[f"{self.path}/segments/{n}" for n in names])

    def records(self) -> DataFrame:
        names = self._manifest()["records"]
        schema = "rid long, document_id string, at long, key binary, words binary"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/records/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def add(self, articles: DataFrame) -> DataFrame:
        """(document_id, first_document_id) of the batch's articles that are known, within the batch or from before.

        A batch must not come before what is held: order is (scraped_at, document_id). Document ids must be unique over all
        batches, since an article is told by the 64-bit hash of its id.
        """
        s = persist_table(stories.story_words(articles).withColumn("rid", F.xxhash64("document_id")), "batch")
        c = persist_table(stories.classes(s).withColumn("at", F.coalesce("scraped_at", F.lit(1 << 62))), "batch-classes")
        segment = persist_table(self._own_segment(c), "batch-segment")
        manifest = self._manifest()
        held = self.records()
        found = segment.groupBy("bucket").cogroup(self._segments(manifest["segments"]).groupBy("bucket")).applyInArrow(self._search(), MATCHES)
        before = blobs.per_bucket(found, "bucket", _covered(COVERAGE), "a long, b long")
        cand = persist_table(before.unionByName(covered_pairs(c)).distinct(), "batch-candidates")
        ids = blobs.bloom(cand.select(F.col("b").alias("id")), "id")
        equal = c.select(F.col("rid").alias("a"), "key").join(held.select(F.col("rid").alias("b"), "key"), "key").select("a", "b")
        equal = persist_table(equal, "batch-equal")
        known = blobs.keep_likely(held, "rid", ids).select(*_RECORD).unionByName(held.join(equal.select(F.col("b").alias("rid")).distinct(), "rid", "left_semi").select(*_RECORD)).dropDuplicates(["rid"])
        every = persist_table(c.select(*_RECORD).unionByName(known), "batch-every")
        linked = persist_table(stories.verified(cand, every).select("a", "b").unionByName(equal), "batch-links")
        out = persist_table(_answers(s, c, _earliest(self.spark, linked, every)), "batch-known")
        self._append(segment, c, manifest)
        return out

    def _own_segment(self, c: DataFrame) -> DataFrame:
        sent = c.select("rid", "at", "document_id", "words").mapInArrow(_scatter(self.buckets), _SENT)

        def build(t: pa.Table) -> pa.Table:
            cnt = blobs.flat(t["cnt"], np.int32)
            rid, at = (np.repeat(blobs.flat(t[x], np.int64), cnt) for x in ("rid", "at"))
            return _segment_row(t["bucket"][0].as_py(), blobs.flat(t["key"], np.uint64), rid, at, np.repeat(blobs.flat(t["total"], np.int32), cnt), _places(t))

        return blobs.per_bucket(sent, "bucket", build, _SEGMENT)

    def _search(self):
        buckets = self.buckets

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            none = np.zeros(0, np.int64)
            if not left.num_rows or not right.num_rows:
                return _packed(none, none, none, none, none, none, buckets)
            mine, rid, total, place = (blobs.flat(left[x], t) for x, t in (("keys", np.uint64), ("rids", np.int64), ("totals", np.int32), ("places", np.uint32)))
            old_rid, old_at, old_total = (blobs.flat(right[x], t) for x, t in (("rids", np.int64), ("ats", np.int64), ("totals", np.int32)))
            # Records of the history in the order of time.
            known, at = np.unique(old_rid, return_index=True)
            order = np.lexsort((known, old_at[at]))
            number = np.empty(len(known), np.int64)
            number[order] = np.arange(len(known))
            ids, totals = known[order], old_total[at][order]
            seg = Segments()
            for keys, rids in zip(right["keys"].to_pylist(), right["rids"].to_pylist(), strict=True):
                seg.held.append(SuffixArray(np.frombuffer(keys, np.uint64), number[np.searchsorted(known, np.frombuffer(rids, np.int64))]))
            first, last, depth = seg.search(mine, len(ids))
            place = place.astype(np.int64)
            out = []
            for e, ok in ((first, depth < 3), (last, (depth < 2) & (last != first))):
                out.append((rid[ok], ids[e[ok]], total[ok], totals[e[ok]], place[ok] // 2, (3 - depth - place % 2)[ok]))
            return _packed(*(np.concatenate(c) for c in zip(*out, strict=True)), buckets)

        return run

    def _append(self, segment: DataFrame, c: DataFrame, manifest: dict[str, list[str]]) -> None:
        seq = 1 + max((int(n.split("-")[1]) for n in manifest["segments"]), default=-1)
        c.select(*_RECORD).write.mode("overwrite").parquet(f"{self.path}/records/{seq:010d}")
        segment.write.mode("overwrite").parquet(f"{self.path}/segments/00-{seq:010d}")
        names, gone = [*manifest["segments"], f"00-{seq:010d}"], []
        level = 0
        while len(mine := [n for n in names if n.startswith(f"{level:02d}-")]) >= FAN_IN:

            def merge(t: pa.Table) -> pa.Table:
                return _segment_row(t["bucket"][0].as_py(), *(blobs.flat(t[x], d) for x, d in (("keys", np.uint64), ("rids", np.int64), ("ats", np.int64), ("totals", np.int32), ("places", np.uint32))))

            new = f"{level + 1:02d}-{mine[-1].split('-')[1]}"
            blobs.per_bucket(self._segments(mine), "bucket", merge, _SEGMENT).write.mode("overwrite").parquet(f"{self.path}/segments/{new}")
            names = [n for n in names if n not in mine] + [new]
            gone += mine
            level += 1
        self._publish({"segments": sorted(names), "records": [*manifest["records"], f"{seq:010d}"]})
        for n in gone:
            fs, p = self._fs(f"{self.path}/segments/{n}")
            fs.delete(p, True)


def _segment_row(bucket: int, key: np.ndarray, rid: np.ndarray, at: np.ndarray, total: np.ndarray, place: np.ndarray) -> pa.Table:
    """One suffix array: in the order of its numbers, then of time."""
    o = np.lexsort((rid, at, key))
    cols = {"keys": key[o], "rids": rid[o].astype(np.int64), "ats": at[o].astype(np.int64), "totals": total[o].astype(np.int32), "places": place[o].astype(np.uint32)}
    return pa.table({"bucket": pa.array([bucket], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in cols.items()}})
