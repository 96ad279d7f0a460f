"""Problem 1: page furniture mixed with the story.

A page is a tree: page, blocks (runs of lines between blank lines), lines. Every line is described by
features of itself, of its siblings and of its ancestors; gradient-boosted trees give each line a
probability of being story, and a decoder picks for every page and then for every block one of "all story", "no story" or
"mixed", so that a line can differ from its block, and a block from its page, only where those are mixed.

The trees are trained in place on a bounded sample of pages (``sample_pages``) whose lines get labels
from the rules in :func:`weak_label`, which are general patterns of web furniture in four languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.llm import bytescan as bs
from lorekeel.llm import trees

SAMPLE_PAGES = 2000

# ---------------------------------------------------------------- labels for training
_FURNITURE = re.compile(
    r"""
    ^(by|words|von|redacci[oó]n|propos\ recueillis)\b[:\s]+(par\s+)?\S+(\ \S+){0,7}(?<![.!?])$
  | ,\ (markets\ )?reporter$
  | ^(published|updated|last\ modified|publi[eé]|stand|actualizado|mis\ [aà]\ jour)\b.{0,12}\d
  | ^\d{1,2}[./]\d{1,2}[./]\d{4}\b | ^\d+\ (comments?|commentaires?|kommentare?|comentarios?)$
  | ^(picture|image\ caption|photo|bild|imagen|foto)\s*: | photo:\ archive$
  | ^(more\ on\ this|read\ next|related\ stories|most\ read|editor's\ picks|you\ may\ have\ missed|latest
     |[aà]\ lire\ aussi|les\ plus\ lus|mehr\ zum\ thema|meistgelesen|lea\ tambi[eé]n|lo\ m[aá]s\ le[ií]do)\s*(:|$)
  | ^(advertisement|anzeige|publicit[eé]|promoted|paid\ content|sponsored)\b | \bsale\ ends\ soon\b
  | ^\w+\d+(:|\ -|\ wrote)\s | ^reply\ from\b
  | by\ means\ of\ cookies | \bchange\ your\ choice\b | \bcontinuing\ to\ browse\b | ^see\ the\ list\ of\ purposes\b
  | \b(keep|store\ and\ read)\b.{0,40}\b(your\ (device|browser))\b | ^your\ privacy\ settings\b
  | traceurs | speichern\ daten\ auf | kleine\ textdateien | einwilligung | guardan\ archivos | recuerda\ su\ visita | cambiar\ su\ decisi
  | ©|\brights\ reserved\b|alle\ rechte|tous\ droits|reservados\ todos
  | ^(share\b.{0,30}|copy\ link|send\ to\ a\ friend.*|report\ an\ error.*|add\ to\ reading\ list|listen\ to\ this.*|back\ to\ top|text\ size.*)$
  | ^(partager|offrir|imprimer|retour\ en\ haut|artikel\ teilen|drucken|fehler\ melden|nach\ oben|compartir|imprimir|avisar|volver)\b
  | ^(download\ our\ app|sign\ up\ for|get\ the\ .*\ letter|want\ more\ like\ this|support\ independent|already\ a\ reader|you\ have\ \d+\ free)\b
  | ^(recevez\ la\ lettre|abonnez-vous|il\ vous\ reste|der\ morgenbrief|jetzt\ .*\ testen|sie\ haben\ noch|reciba|pruebe|le\ quedan)\b
  | ^(nothing\ here\ is\ advice|the\ author\ holds|prices\ delayed|the\ publisher\ is\ not|complaints\ procedure|terms\ of\ service\ \||about\ us\b)
  | ^(l'auteur\ ne\ d[eé]tient|cours\ diff[eé]r|mentions\ l[eé]gales|der\ verfasser|kurse\ mindestens|impressum|el\ autor\ no|precios\ con|aviso\ legal)
  | \btrading\ name\ of\ its\ publisher\b | ^(additional\ )?reporting\ (from|by)\b
  | ^first\ seen\ in\b | ^read\ by\ a\ machine\b | ^this\ article\ belongs\b
  | ^accept\ all\b
    """,
    re.I | re.X,
)
_NAVIGATION = re.compile(r" \| |\s>\s| · |  \S+( \S+)?  |^[A-Z]\S+( \S+)?  [A-Z]\S+( \S+)?$")
_SUBHEAD = re.compile(
    r"""^(the\ view\ from|what\ the\ \S+\ shows|who\ pays\ for|costs\ and|after\ the|next\ steps\ for|le\ cas\ de|et\ apr[eè]s\ le|wie\ es\ weitergeht
     |blick\ nach|la\ visi[oó]n\ de)\b|^\S+\ and\ the\ \S+$|^an?\ \S+\ \S+$|^une?\ \S+\ \S+$|^\S+\ und\ \S+$|^\#{1,6}\ """,
    re.I | re.X,
)
_LINK_MARK = re.compile(r"^([›•·*‣\-–]|\d{1,2}[.)])\s+")
_SENTENCE_END = tuple(".!?…\"”»“'")


def weak_label(line: str, title: str) -> int:
    """1 for a line of the story, 0 for furniture: the training label of one non-blank line."""
    flat = " ".join(line.split())
    low = flat.lower()
    bare = _LINK_MARK.sub("", low)
    if bare == " ".join(title.lower().split()) or _LINK_MARK.match(flat) and not flat.endswith((".", "!", "?")):
        return 0
    n = len(flat.split())
    if n <= 30 and (_FURNITURE.search(flat) or not flat.endswith(_SENTENCE_END) and _NAVIGATION.search(line.strip())):
        return 0
    if flat.endswith(_SENTENCE_END) and n >= 5:
        return 0 if re.search(r"©|\btrading name of its publisher\b", low) else 1
    return 1 if n <= 9 and _SUBHEAD.match(flat) else 0


# ---------------------------------------------------------------- features
_SPACE = np.zeros(256, bool)
for _c in b" \t\r\x0b\x0c":
    _SPACE[_c] = True
_FIRST = np.full(256, 3, np.float32)  # class of the first byte: digit 0, lower 1, upper 2, other 3, quote 4, dash 5, bullet 6, rights 7
_FIRST[48:58], _FIRST[97:123], _FIRST[65:91], _FIRST[0x80:] = 0, 1, 2, 2
_FIRST[34], _FIRST[39], _FIRST[45], _FIRST[42], _FIRST[1], _FIRST[2] = 4, 4, 5, 6, 6, 7
_LAST = np.full(256, 1, np.float32)  # class of the last byte: digit 0, letter 1, other 2, colon 3, quote 4, sentence mark 5
_LAST[48:58], _LAST[0:48], _LAST[58] = 0, 2, 3
_LAST[34], _LAST[39], _LAST[46], _LAST[33], _LAST[63] = 4, 4, 5, 5, 5
_NUMBER, _HANDLE = bs.U64(11), bs.U64(13)
_KINDS = {k: bs.U64(0xA24BAED4963EE407 * (i + 1) & (1 << 64) - 1) for i, k in enumerate(("head", "pair", "tail", "any", "line"))}


def _salt(h: np.ndarray, kind: str) -> np.ndarray:
    return bs.mix(h ^ _KINDS[kind])


@dataclass
class Lines:
    """The non-blank lines of the bodies in a chunk of pages, with what the features need."""

    doc: np.ndarray
    no: np.ndarray
    words: bs.Scan
    word: np.ndarray  # hash of every word of the chunk, numbers and handles as one each
    first: np.ndarray  # of each line: its first word
    count: np.ndarray  # and the number of its words
    block: np.ndarray
    keys: dict[str, np.ndarray]
    shape: dict[str, np.ndarray]


def read_lines(titles: list[str | None], bodies: list[str | None]) -> Lines:
    texts = [(t or "").replace("\n", " ") + "\n" + (b or "") for t, b in zip(titles, bodies, strict=True)]
    s = bs.scan_words(texts)
    buf = s.buf
    end = np.flatnonzero(buf == 10)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    doc = np.searchsorted(s.text_end, start, "right")
    title_row = np.searchsorted(doc, np.arange(len(texts)))
    no = np.arange(len(start)) - title_row[doc] - 1

    line_at = np.repeat(np.arange(len(start), dtype=np.int32), end - start + 1)

    def count_at(where: np.ndarray) -> np.ndarray:
        return np.bincount(line_at[where], minlength=len(start))

    blank = np.flatnonzero(_SPACE[buf])
    seen = end - start - count_at(blank)  # visible bytes of each line
    hidden = _SPACE[buf]
    hidden[end] = True
    at = np.flatnonzero(~hidden)
    b = np.cumsum(seen)
    a = b - seen
    keep = np.flatnonzero((no >= 0) & (seen > 0))

    def per_line(where: np.ndarray) -> np.ndarray:
        return count_at(where)[keep].astype(np.float32)

    digit = np.flatnonzero((buf >= 48) & (buf <= 57))
    double = blank[:-1][(np.diff(blank) == 1) & (buf[blank[:-1]] == 32) & ~hidden[np.minimum(blank[1:] + 1, len(buf) - 1)]] if len(blank) else blank
    stop = np.flatnonzero(buf[:-1] == 46) if len(buf) else blank
    stop = stop[buf[stop + 1] == 32]

    # Words: numbers are alike, and so are names with a number in them.
    digits = np.bincount(np.searchsorted(s.start, digit, "right") - 1, minlength=len(s.start)) if len(digit) else np.zeros(len(s.start), np.int64)
    word = np.where(digits > 0, np.where(s.end - s.start - digits > 1, _HANDLE, _NUMBER), s.word)
    first = np.searchsorted(s.start, start)
    count = np.diff(np.concatenate((first, [len(s.start)])))
    pad = np.concatenate((word, np.zeros(3, bs.U64)))
    n = count[keep]
    f = first[keep]
    empty = n == 0
    head, second = np.where(empty, 0, pad[f]), np.where(n > 1, pad[f + 1], 0)
    tail, before = np.where(empty, 0, pad[f + n - 1]), np.where(n > 1, pad[np.maximum(f + n - 2, 0)], 0)
    flow = bs.running(bs.mix(word) & bs.U64(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        pair = head * bs.U64(31) + second
        last_pair = tail * bs.U64(37) + before
    keys = {"head": _salt(head, "head"), "pair": _salt(pair, "pair"), "tail": _salt(last_pair, "tail"), "line": _salt(bs.spans(flow, f, f + n), "line")}

    # Likeness to the title.
    owner = np.repeat(np.arange(len(start)), count)
    in_title = np.repeat(no, count) == -1
    with np.errstate(over="ignore"):
        tagged = s.word + doc[owner].astype(bs.U64) * bs.U64(0x9E3779B97F4A7C15)
    known = np.sort(tagged[in_title])
    k = np.minimum(np.searchsorted(known, tagged), max(len(known) - 1, 0))
    hit = (known[k] == tagged) if len(known) else np.zeros(len(tagged), bool)
    hc = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
    shared = (hc[f + n] - hc[f]).astype(np.float32)
    title_words = count[title_row][doc[keep]].astype(np.float32)

    capital = np.zeros(len(word) + 1, np.int64)
    if len(word):
        w0 = buf[s.start]
        capital[1:] = np.cumsum(((w0 >= 65) & (w0 <= 90)) | (w0 >= 0xC3) & (w0 <= 0xC3))
    nw = np.maximum(n, 1).astype(np.float32)
    bytes_ = seen[keep].astype(np.float32)
    row = np.cumsum(np.concatenate(([0], np.diff(keep) > 1))) if len(keep) else keep
    new_doc = np.concatenate(([0], np.cumsum(np.diff(doc[keep]) != 0))) if len(keep) else keep
    block = row + new_doc
    block = np.unique(block, return_inverse=True)[1] if len(keep) else block
    shape = {
        "bytes": np.log1p(bytes_),
        "words": n.astype(np.float32),
        "capitals": (capital[f + n] - capital[f]) / nw,
        "upper": per_line(np.flatnonzero((buf >= 65) & (buf <= 90))) / np.maximum(bytes_, 1),
        "digits": per_line(digit) / np.maximum(bytes_, 1),
        "marks": per_line(np.flatnonzero((buf == 124) | (buf == 62) | (buf == 1))) + per_line(double),
        "stops": per_line(stop),
        "quotes": per_line(np.flatnonzero(buf == 34)),
        "colon": per_line(np.flatnonzero(buf == 58)),
        "first": _FIRST[buf[at[a[keep]]]] if len(keep) else np.zeros(0, np.float32),
        "last": _LAST[buf[at[b[keep] - 1]]] if len(keep) else np.zeros(0, np.float32),
        "depth": (at[a[keep]] - start[keep]).astype(np.float32) if len(keep) else np.zeros(0, np.float32),
        "length": bytes_ / nw,
        "echo": shared / nw,
        "echoed": shared / np.maximum(title_words, 1),
        "handle": (np.concatenate(([0], np.cumsum(word == _HANDLE)))[f + n] - np.concatenate(([0], np.cumsum(word == _HANDLE)))[f]).astype(np.float32),
    }
    return Lines(doc[keep], no[keep], s, word, f, n, block, keys, shape)


@dataclass
class Model:
    """Evidence of tokens (sorted hashes and their log-odds) and the trees over all features."""

    key: np.ndarray
    odds: np.ndarray
    forest: trees.Forest | None = None

    def evidence(self, h: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(h), np.float32)
        k = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where(self.key[k] == h, self.odds[k], 0).astype(np.float32)


_EDGE_WORDS = 9


def _sampled_words(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The first and last words of every line: hashes and the line of each."""
    take = np.minimum(x.count, _EDGE_WORDS)
    line = np.repeat(np.arange(len(x.count)), take)
    k = bs.segment_ranges(take)
    half = (take[line] + 1) // 2
    pos = np.where(k < half, k, x.count[line] - take[line] + k)
    return _salt(x.word[x.first[line] + pos], "any"), line


def _by_line(values: np.ndarray, count: np.ndarray, how: np.ufunc) -> np.ndarray:
    out = np.zeros(len(count), np.float32)
    has = count > 0
    if has.any():
        out[has] = how.reduceat(values, (np.cumsum(count) - count)[has])
    return out


def features(x: Lines, m: Model) -> np.ndarray:
    """Features x lines."""
    n = len(x.doc)
    h, _ = _sampled_words(x)
    ev = m.evidence(h)
    take = np.minimum(x.count, _EDGE_WORDS)
    own = dict(x.shape)
    own |= {k: m.evidence(v) for k, v in x.keys.items()}
    own |= {"max": _by_line(ev, take, np.maximum), "min": _by_line(ev, take, np.minimum), "mean": _by_line(ev, take, np.add) / np.maximum(take, 1)}
    first_of_doc = np.concatenate(([True], x.doc[1:] != x.doc[:-1])) if n else np.zeros(0, bool)
    doc_id = np.cumsum(first_of_doc) - 1
    size = np.bincount(doc_id, minlength=1) if n else np.zeros(1, np.int64)
    rank = np.arange(n) - np.flatnonzero(first_of_doc)[doc_id] if n else np.zeros(0, np.int64)
    lines = size[doc_id] if n else rank
    bsize = np.bincount(x.block, minlength=1) if n else np.zeros(1, np.int64)
    bfirst = np.cumsum(bsize) - bsize
    rows = list(own.values())
    rows += [rank / np.maximum(lines - 1, 1), rank, lines - 1 - rank, lines]
    rows += [np.bincount(doc_id, own["words"])[doc_id] / lines if n else rank]
    if n:
        rows += [bsize[x.block], np.bincount(x.block, own["words"])[x.block] / bsize[x.block], np.arange(n) - bfirst[x.block], np.bincount(x.block, own["mean"])[x.block] / bsize[x.block]]
    else:
        rows += [rank] * 4
    for step, names in ((1, ("words", "last", "mean", "pair", "line", "first")), (-1, ("words", "last", "mean", "pair", "line", "first")), (2, ("words", "pair", "line")), (-2, ("words", "pair"))):
        for name in names:
            v = np.full(n, -9, np.float32)
            if n > abs(step):
                src, dst = (slice(0, n - step), slice(step, n)) if step > 0 else (slice(-step, n), slice(0, n + step))
                same = doc_id[src] == doc_id[dst]
                v[dst] = np.where(same, own[name][src], -9)
            rows.append(v)
    return np.stack([np.asarray(r, np.float32) for r in rows])


# ---------------------------------------------------------------- training
def fit(pages: list[tuple[str | None, str | None]]) -> Model:
    """Train on pages (title, body). Evidence comes from one half, the trees from the other."""
    half = max(1, len(pages) // 2)
    parts = (pages[:half], pages[half:] or pages)
    data = []
    for part in parts:
        x = read_lines([t for t, _ in part], [b for _, b in part])
        split = [(b or "").split("\n") for _, b in part]
        y = np.array([weak_label(split[d][k], part[d][0] or "") for d, k in zip(x.doc.tolist(), x.no.tolist(), strict=True)], np.float64)
        data.append((x, y))
    x, y = data[0]
    h, line = _sampled_words(x)
    key = np.concatenate([*x.keys.values(), h])
    label = np.concatenate([*[y] * len(x.keys), y[line]])
    u, inv = np.unique(key, return_inverse=True)
    seen, pos = np.bincount(inv, minlength=len(u)), np.bincount(inv, label, len(u))
    keep = seen >= 3
    m = Model(u[keep], np.log((pos[keep] + 0.5) / (seen[keep] - pos[keep] + 0.5)).astype(np.float32))
    x, y = data[1]
    m.forest = trees.fit(features(x, m), y)
    return m


def sample_model(articles: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Model:
    """Train on about ``sample_pages`` pages, those with the smallest hashes of their ids (all, if there are fewer).

    A first count sets the hash below which pages are looked at, so that the driver gets a fixed number
    of pages however many there are.
    """
    n = articles.count()
    h = F.shiftrightunsigned(F.xxhash64("document_id"), 1)
    near = h <= min(2**63 - 1, (2**63 - 1) * (3 * sample_pages // 2 + 100) // max(n, 1))
    rows = articles.where(near).select("title", "body", h.alias("h"), "document_id").orderBy("h", "document_id").limit(sample_pages).select("title", "body").collect()
    return fit([(r[0], r[1]) for r in rows])


# ---------------------------------------------------------------- decoding
MIXED = 0.7  # what a block pays, in log-likelihood, for lines that differ from each other; a page, for blocks that do


def decode(margin: np.ndarray, block: np.ndarray, page: np.ndarray | None = None) -> np.ndarray:
    """Story or not, line by line, decided from the top: a page is all story, none or mixed, whichever costs least; in a mixed one
    each block is, and only in a mixed block may lines differ. So no line contradicts its block, and no block its page.

    ``block`` and ``page`` count from 0 in the order of the lines; without ``page`` each block is decided by itself.
    """
    if not len(margin):
        return np.zeros(0, bool)
    cost_story = np.logaddexp(0, -margin)
    cost_other = np.logaddexp(0, margin)
    k = int(block[-1]) + 1
    story, other = np.bincount(block, cost_story, k), np.bincount(block, cost_other, k)
    mixed = np.bincount(block, np.minimum(cost_story, cost_other), k) + MIXED
    kinds = np.stack([story, other, mixed])
    best = np.argmin(kinds, 0)
    if page is not None:
        of_page = np.zeros(k, np.int64)
        of_page[block] = page
        total = lambda cost: np.bincount(of_page, cost, int(page[-1]) + 1)
        whole = np.argmin(np.stack([total(story), total(other), total(kinds.min(0)) + MIXED]), 0)[of_page]
        best = np.where(whole == 2, best, whole)
    return np.where(best[block] == 2, margin > 0, best[block] == 0)


def story_mask(x: Lines, m: Model) -> np.ndarray:
    return decode(m.forest.margin(features(x, m)), x.block, x.doc) if len(x.doc) else np.zeros(0, bool)


def scan_pages(batch: pa.RecordBatch, m: Model) -> Iterator[tuple[int, int, Lines, np.ndarray]]:
    """Chunks of a batch with columns title and body: (from row, to row, lines, which are story)."""
    titles, bodies = batch.column("title").to_pylist(), batch.column("body").to_pylist()
    for a, b in bs.chunks(len(x or "") + len(t or "") + 2 for x, t in zip(bodies, titles, strict=True)):
        x = read_lines(titles[a:b], bodies[a:b])
        yield a, b, x, story_mask(x, m)


# ---------------------------------------------------------------- operators
def boilerplate_lines(articles: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(document_id, line_no) of every non-blank line that isn't story.

    A NULL or empty body has no lines; a NULL title echoes nothing. Repeated document ids give their
    lines once each per row. Other columns are ignored, whatever their names.
    """
    m = sample_model(articles, sample_pages)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column("document_id")
            for a, _, x, story in scan_pages(batch, m):
                off = ~story
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x.doc[off] + a)), pa.array(x.no[off].astype(np.int32))], ["document_id", "line_no"])

    return articles.select("document_id", "title", "body").mapInArrow(run, "document_id string, line_no int")


def main_text(articles: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(document_id, text): the story of each page, its lines joined by line breaks ('' where there is none)."""
    m = sample_model(articles, sample_pages)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bodies = batch.column("body").to_pylist()
            kept: list[list[str]] = [[] for _ in bodies]
            for a, b, x, story in scan_pages(batch, m):
                lines = [(t or "").split("\n") for t in bodies[a:b]]
                for d, k in zip(x.doc[story].tolist(), x.no[story].tolist(), strict=True):
                    kept[a + d].append(lines[d][k].strip())
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), pa.array(["\n".join(k) for k in kept], pa.string())], ["document_id", "text"])

    return articles.select("document_id", "title", "body").mapInArrow(run, "document_id string, text string")
