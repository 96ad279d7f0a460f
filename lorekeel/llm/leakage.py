"""Problem 8: evaluation texts that leak into a corpus, by latent semantic retrieval.

Passages of the corpus are TF-IDF vectors over hashed terms. A randomised singular value decomposition
of all passages is made in one pass: every task adds up its part of the product of the matrix, its transpose
and a random matrix. Each term then has a vector in the latent space; a window of words is the sum of its
terms. Windows of documents are searched by cosine among the windows of the evaluation items, and what is as near as asked for goes
on to a longest common subsequence. Equal windows are found by the signs of their latent coordinates (``Index``), near ones in cells
of windows around a leader, of which only those are entered that may hold one near enough (``Cells``).

* ``leaked_runs`` looks for runs of thirteen words. Any such run of a document holds a window of seven words that begins at a
  multiple of seven; term vectors are whole numbers, so it has exactly the vector of the same words of the item, and no run is lost.
  Around each pair of windows the common subsequence must have thirteen words, and then the words must follow each other.
* ``paraphrases`` looks for wider windows that say the same: by cosine, then by the share of words in the common subsequence, and
  the answer is looked for in the document. Windows begin at every ``STEP``-th word of a document (half of it in prompts), and
  one ends at its last word. If prompt or document is shorter than that, it is one window, and those of the other are as short.

Evaluation items are the stated query set; they go against all documents in blocks of ``BLOCK`` items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.llm import blobs, lookalike
from lorekeel.llm import bytescan as bs

TERMS = 8192  # hashed terms
RANK = 32
PASSAGE = 32  # words of a passage
RUN = 13
WIDE, STEP = 24, 12
COSINE = 0.8
CELL = 0.95  # cosine of the vectors of a cell with its first one
EXACT_BANDS, EXACT_SIGNS, EXACT_COSINE = 2, 24, 0.95  # of the search for equal words, whose vectors are equal
PAIRS = 200_000  # pairs of windows compared in one go
COMMON = 0.6
BLOCK = 5000
ROW_BLOCKS = 16


def _scan(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes end to end, number of words of each text); look-alikes are one."""
    s = bs.scan_words([lookalike.shape(t) if t else "" for t in texts])
    return s.word, np.bincount(s.word_text, minlength=len(texts))


def _random(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((TERMS, RANK)).astype(np.float32)


def _sum_by(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[cut], np.add.reduceat(rows, cut, axis=0)


@dataclass
class Space:
    """Term vectors of the latent space, as whole numbers, with the inverse document frequency in them."""

    terms: np.ndarray  # TERMS x RANK, int32
    energy: np.ndarray  # singular values


def fit(documents: DataFrame, text_column: str = "text", seed: int = 7) -> Space:
    """The latent space of all passages. A single pass over the corpus; tasks give one matrix of fixed size (1 MB)
    each, which are added up in the executors by blocks of rows."""

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = _random(seed)
        y = np.zeros((TERMS, RANK), np.float64)
        df = np.zeros(TERMS, np.int64)
        passages = 0
        for batch in it:
            texts = batch.column(0).to_pylist()
            for a, b in bs.chunks((len(t or "") + 1 for t in texts), 500_000):
                w, size = _scan(texts[a:b])
                if not len(w):
                    continue
                t = (w % bs.U64(TERMS)).astype(np.int64)
                passage = np.repeat(np.cumsum(np.maximum(1, -(-size // PASSAGE))) - np.maximum(1, -(-size // PASSAGE)), size) + bs.segment_ranges(size) // PASSAGE
                k, z = _sum_by(passage, omega[t])
                row = np.searchsorted(k, passage)
                o = np.argsort(t, kind="stable")
                term, part = _sum_by(t[o], z[row[o]])
                y[term] += part
                seen = np.unique(passage * TERMS + t) % TERMS
                df += np.bincount(seen, minlength=TERMS)
                passages += len(k)
        if passages:
            for i in range(ROW_BLOCKS):
                s = slice(i * TERMS // ROW_BLOCKS, (i + 1) * TERMS // ROW_BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([y[s].astype(np.float32).tobytes()], pa.binary()), pa.array([df[s].tobytes()], pa.binary()), pa.array([passages], pa.int64())], ["part", "y", "df", "n"])

    def add(t: pa.Table) -> pa.Table:
        y = np.sum([np.frombuffer(x, np.float32).astype(np.float64) for x in t["y"].to_pylist()], axis=0)
        df = np.sum([np.frombuffer(x, np.int64) for x in t["df"].to_pylist()], axis=0)
        return pa.table({"part": t["part"].slice(0, 1), "y": pa.array([y.tobytes()], pa.binary()), "df": pa.array([df.tobytes()], pa.binary()), "n": pa.array([sum(t["n"].to_pylist())], pa.int64())})

    schema = "part int, y binary, df binary, n long"
    rows = sorted(blobs.per_bucket(documents.select(text_column).mapInArrow(sketch, schema), "part", add, schema).collect())
    omega = _random(seed)
    if not rows:
        return Space(np.zeros((TERMS, RANK), np.int32), np.zeros(RANK))
    y = np.concatenate([np.frombuffer(r["y"], np.float64) for r in rows]).reshape(TERMS, RANK)
    df = np.concatenate([np.frombuffer(r["df"], np.int64) for r in rows])
    idf = np.log((rows[0]["n"] + 1) / (df + 1)) + 0.05
    # With D the diagonal of idf, the weighted matrix is A D and D y is its sketch for the random matrix
    # omega / idf; the small core then needs no second pass.
    core = omega.astype(np.float64).T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > value.max() * 1e-9
    root = vector[:, keep] / np.sqrt(value[keep])
    left, energy, _ = np.linalg.svd((idf[:, None] * y) @ root, full_matrices=False)
    v = np.zeros((TERMS, RANK))
    v[:, : left.shape[1]] = idf[:, None] * left
    v -= np.average(v, axis=0, weights=np.maximum(df, 1e-9))[None, :]  # so that signs split the windows evenly
    scale = (1 << 20) / max(np.abs(v).max(), 1e-12)
    return Space(np.round(v * scale).astype(np.int32), energy)


def spans(size: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of windows of ``width`` words at each ``step``-th word and at the end of texts that have so many."""
    size = size.astype(np.int64)
    n = np.where(size < width, 0, 1 + -(-np.maximum(size - width, 0) // step))
    text = np.repeat(np.arange(len(size)), n)
    return text, (np.cumsum(size) - size)[text] + np.minimum(bs.segment_ranges(n) * step, size[text] - width)


def _sums(space: Space, words: np.ndarray) -> np.ndarray:
    """Sums of the latent vectors of all words before each place; they wrap around, differences over up to 512 words do not."""
    sums = np.zeros((len(words) + 1, RANK), np.int32)
    np.cumsum(space.terms[(words % bs.U64(TERMS)).astype(np.int64)], axis=0, out=sums[1:], dtype=np.int32)
    return sums


def _vectors(space: Space, words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The latent vectors of the windows of ``width`` words at the places ``first``."""
    term = (words % bs.U64(TERMS)).astype(np.int32)
    out = np.zeros((len(first), RANK), np.int32)
    for k in range(width):
        out += space.terms[term[first + k]]
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _ranges(known: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into key, index into known) of all equal pairs, in pieces; ``known`` is sorted."""
    lo, hi = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
    n = hi - lo
    hit = np.flatnonzero(n)
    for a, b in bs.chunks(n[hit].tolist(), PAIRS):
        k = hit[a:b]
        i, j = np.repeat(k, n[k]), np.repeat(lo[k], n[k]) + bs.segment_ranges(n[k])
        for s in range(0, len(i), PAIRS):
            yield i[s : s + PAIRS], j[s : s + PAIRS]


class Index:
    """Vectors by the signs of some of their coordinates, in several sets (bands); a search compares by cosine what shares a band.

    Two vectors at an angle a share the signs of a band with probability about (1 - a / pi) ** signs; equal ones always do.
    """

    def __init__(self, vectors: np.ndarray, bands: int, signs: int) -> None:
        r = np.random.default_rng(11)
        self.unit = _unit(vectors)
        self.sets = np.zeros((RANK, bands), np.float32)  # a power of two for each sign of a band
        for k in range(bands):
            self.sets[r.permutation(RANK)[:signs], k] = 2.0 ** np.arange(signs)
        keys = self._keys(vectors)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 0)

    def _keys(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors > 0).astype(np.float32) @ self.sets).astype(np.int32)

    def near(self, vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in vectors, place in the index, cosine) of the pairs that share a band and are as near as asked for, each once."""
        unit = _unit(vectors)
        held = []
        keys = self._keys(vectors)
        for k in range(keys.shape[1]):
            for i, j in _ranges(self.keys[:, k], keys[:, k]):
                j = self.order[j, k]
                c = np.einsum("ij,ij->i", unit[i], self.unit[j])
                ok = c >= cosine - 1e-6
                held.append((i[ok], j[ok], c[ok]))
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        i, j, c = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first = np.unique(i * max(len(self.unit), 1) + j, return_index=True)
        return i[first], j[first], c[first]


class Cells:
    """Unit vectors in cells, each around its first one; a search enters only cells that may hold what is near enough.

    Angles obey the triangle inequality: what lies within an angle of a vector lies in a cell whose leader is no further than that
    and the radius of the cell. So nothing near enough is missed.
    """

    def __init__(self, vectors: np.ndarray, cell: float = CELL) -> None:
        self.unit = _unit(vectors)
        of = np.full(len(self.unit), -1)
        leaders: list[int] = []
        if cell >= 1:  # every vector leads itself
            of, leaders = np.arange(len(of)), list(range(len(of)))
        for i in range(len(of)):
            if of[i] < 0:
                near = self.unit @ self.unit[i]
                near[i] = 1
                of[(of < 0) & (near >= cell)] = len(leaders)
                leaders.append(i)
        self.leader = self.unit[leaders]
        own = np.arccos(np.clip(np.einsum("ij,ij->i", self.unit, self.leader[of]) if len(of) else np.zeros(0), -1, 1))
        self.radius = np.zeros(len(leaders))
        np.maximum.at(self.radius, of, own)
        self.members = np.argsort(of, kind="stable")
        self.count = np.bincount(of, minlength=len(leaders)) if len(of) else np.zeros(0, np.int64)
        self.first = np.cumsum(self.count) - self.count

    def near(self, vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in vectors, place among the held, cosine) of all pairs as near as asked for."""
        unit = _unit(vectors)
        reach = np.cos(np.minimum(np.arccos(min(cosine, 1.0)) + self.radius, np.pi)).astype(np.float32) - np.float32(1e-4)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for s in range(0, len(unit) if len(self.leader) else 0, 4096):
            i, c = np.nonzero(unit[s : s + 4096] @ self.leader.T >= reach)
            for a, b in bs.chunks(self.count[c].tolist(), PAIRS):
                k = c[a:b]
                x = np.repeat(i[a:b] + s, self.count[k])
                y = self.members[np.repeat(self.first[k], self.count[k]) + bs.segment_ranges(self.count[k])]
                near = np.einsum("ij,ij->i", unit[x], self.unit[y])
                ok = near >= cosine - 1e-6
                held.append((x[ok], y[ok], near[ok]))
        i, j, c = (np.concatenate(x) for x in zip(*held, strict=True))
        return i, j, c


def _items(items: DataFrame) -> Iterator[list[tuple[int, str, str]]]:
    rows = sorted(items.where("item_id is not null and prompt is not null").select("item_id", "prompt", "answer").distinct().collect())
    for i in range(0, len(rows), BLOCK):
        yield [(r[0], r[1], r[2] or "") for r in rows[i : i + BLOCK]]


def leaked_runs(documents: DataFrame, items: DataFrame, run: int = RUN, space: Space | None = None) -> DataFrame:
    """(item_id, doc_id): documents that share at least ``run`` consecutive words with the prompt of an item.

    Words are runs of letters and digits without case, in the form that look-alikes share. NULL or short
    texts and prompts share nothing; repeated rows give one row.
    """
    space = space or fit(documents)
    out: DataFrame | None = None
    for block in _items(items):
        part = _leaked_block(documents, block, run, space)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "item_id long, doc_id long")
    return out.distinct()


def _around(words: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, width: int, other: int) -> np.ndarray:
    """``width`` words from each place of ``first``; a value of its own (``other`` and down) where that is outside of [start, end)."""
    at = first[:, None] + np.arange(width)
    inside = (at >= start[:, None]) & (at < end[:, None])
    out = words[np.clip(at, 0, max(len(words) - 1, 0))] if len(words) else np.zeros(at.shape, np.uint64)
    return np.where(inside, out, np.uint64(other))


def _longest_run(same: np.ndarray) -> np.ndarray:
    """The longest run of true values in each row."""
    best = now = np.zeros(len(same), np.int64)
    for j in range(same.shape[1]):
        now = np.where(same[:, j], now + 1, 0)
        best = np.maximum(best, now)
    return best


def _leaked_block(documents: DataFrame, block: list[tuple[int, str, str]], run: int, space: Space) -> DataFrame:
    width = (run + 1) // 2  # any run holds a window of this width at a multiple of it
    w, size = _scan([p for _, p, _ in block])
    doc, first = spans(size, width, 1)
    index = Index(_vectors(space, w, first, width), EXACT_BANDS, EXACT_SIGNS)
    ids = np.array([i for i, _, _ in block], np.int64)
    item_start = np.cumsum(size) - size
    wide = 2 * run - width  # any run that holds the window lies within so many words around it

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("text").to_pylist()
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in bs.chunks((len(t or "") + 1 for t in texts), 500_000):
                words, n = _scan(texts[a:b])
                start = np.cumsum(n) - n
                d, f = aligned(n, width)
                i, j, _ = index.near(_vectors(space, words, f, width), EXACT_COSINE)
                if not len(i):
                    continue
                back = run - width
                here = _around(words, start[d[i]], (start + n)[d[i]], f[i] - back, wide, 1)
                there = _around(w, item_start[doc[j]], (item_start + size)[doc[j]], first[j] - back, wide, 2)
                ok = np.concatenate([lcs_lengths(here[k : k + 20_000], there[k : k + 20_000]) for k in range(0, len(i), 20_000)]) >= run
                ok[ok] = _longest_run(here[ok] == there[ok]) >= run
                pair = np.unique(np.stack([ids[doc[j[ok]]], d[i[ok]]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(doc_ids[a + pair[1]].astype(np.int64))], ["item_id", "doc_id"])

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(find, "item_id long, doc_id long")


def aligned(size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of the windows of texts that begin at multiples of their width."""
    n = size.astype(np.int64) // width
    text = np.repeat(np.arange(len(size)), n)
    return text, (np.cumsum(size) - size)[text] + bs.segment_ranges(n) * width


def lcs_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows of two arrays of words; those of ``x`` have 63 words at most.

    A row of the usual table is kept as bits, set where it does not rise: a word of ``y`` moves them all by one addition.
    """
    n, a = x.shape
    if a > 63:
        raise ValueError("more than 63 words")
    full = np.uint64((1 << a) - 1)
    level = np.full(n, full)
    place = np.zeros((n, 8), np.uint8)
    for j in range(y.shape[1]):
        bits = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little")
        place[:, : bits.shape[1]] = bits
        hit = level & place.view(np.uint64)[:, 0]
        level = ((level + hit) | (level - hit)) & full
    return a - np.bitwise_count(level).astype(np.int64)


def paraphrases(documents: DataFrame, items: DataFrame, cosine: float = COSINE, common: float = COMMON, space: Space | None = None) -> DataFrame:
    """(item_id, doc_id, cosine, common_words, answer_found): windows of a document that say what a prompt says.

    Of each item and document the best window: cosine in the latent space of ``cosine`` or more and a longest
    common subsequence of at least ``common`` of the window's words. answer_found tells whether the words of
    the answer stand in the document (NULL where there is no answer).
    """
    space = space or fit(documents)
    out: DataFrame | None = None
    for block in _items(items):
        part = _paraphrased_block(documents, block, cosine, common, space)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], "item_id long, doc_id long, cosine double, common_words int, answer_found boolean")
    best = F.max(F.struct("common_words", "cosine", "answer_found")).alias("m")
    return out.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", "m.cosine", "m.common_words", "m.answer_found")


def _paraphrased_block(documents: DataFrame, block: list[tuple[int, str, str]], cosine: float, common: float, space: Space) -> DataFrame:
    w, size = _scan([p for _, p, _ in block])
    item_sums = _sums(space, w)
    asked: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, Cells]] = {}

    def of_items(width: int, whole: bool) -> tuple[np.ndarray, np.ndarray, Cells]:
        """The windows of prompts of a width; ``whole``: of the prompts that are no longer."""
        if (width, whole) not in asked:
            doc, first = spans(np.where(size == width, size, 0) if whole else size, width, max(1, width * STEP // WIDE // 2))
            first = first + (item_at - item_at_whole(width))[doc] if whole else first
            asked[width, whole] = doc, first, Cells(item_sums[first + width] - item_sums[first], CELL if width == WIDE else 1.0)  # short texts are few
        return asked[width, whole]

    item_at = np.cumsum(size) - size

    def item_at_whole(width: int) -> np.ndarray:
        kept = np.where(size == width, size, 0)
        return np.cumsum(kept) - kept

    ids = np.array([i for i, _, _ in block], np.int64)
    answer, answer_size = _scan([x for _, _, x in block])
    at = np.cumsum(answer_size) - answer_size
    answers = [np.sort(answer[at[k] : at[k] + answer_size[k]]) for k in range(len(block))]

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("text").to_pylist()
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in bs.chunks((len(t or "") + 1 for t in texts), 500_000):
                words, n = _scan(texts[a:b])
                start = np.cumsum(n) - n
                for width in np.unique(np.minimum(np.concatenate((size, n)), WIDE)).tolist():
                    if not width:
                        continue
                    d, f = spans(n, width, max(1, width * STEP // WIDE))
                    # A pair of texts meets in windows of one width: as wide as the shorter one, WIDE at most.
                    whole = n[d] == width
                    for of_d, only in [(np.arange(len(d)), False)] if width == WIDE else [(np.flatnonzero(whole), False), (np.flatnonzero(~whole), True)]:
                        doc, first, index = of_items(width, only)
                        if not len(of_d) or not len(doc):
                            continue
                        i, j, near = index.near(_vectors(space, words, f[of_d], width), cosine)
                        lcs = np.zeros(len(i), np.int64)
                        for k in range(0, len(i), 20_000):
                            x, y = first[j[k : k + 20_000]], f[of_d[i[k : k + 20_000]]]
                            lcs[k : k + 20_000] = lcs_lengths(w[x[:, None] + np.arange(width)], words[y[:, None] + np.arange(width)])
                        ok = lcs >= common * width
                        i, j, lcs, near = i[ok], j[ok], lcs[ok], near[ok]
                        if not len(i):
                            continue
                        found = []
                        of = d[of_d[i]]
                        for x, y in zip(of.tolist(), doc[j].tolist(), strict=True):
                            own = words[start[x] : start[x] + n[x]]
                            found.append(None if not len(answers[y]) else bool(np.isin(answers[y], own).all()))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[doc[j]]), pa.array(doc_ids[a + of].astype(np.int64)), pa.array(near.astype(np.float64)), pa.array(lcs.astype(np.int32)), pa.array(found, pa.bool_())], ["item_id", "doc_id", "cosine", "common_words", "answer_found"])

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(find, "item_id long, doc_id long, cosine double, common_words int, answer_found boolean")
