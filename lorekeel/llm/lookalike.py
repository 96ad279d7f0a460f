"""Problem 10: text that looks the same but is written with other characters.

The vocabulary of the corpus is kept as a trie whose edges are letters and accents as they look. A token is read as it stands,
character by character, by an automaton with weights: a character may follow any edge that it looks like (letters of other
scripts, forms of width), several edges (ligatures, composed accents) or none (what does not show) at no cost; every other
edit costs one, and the budget is zero by default. Of the words at the node reached, the most frequent is the canonical spelling.
What meets no word is normalized by table. Both ways give one form to all spellings that look the same.

Kept apart are case, visible accents, digits, words and line breaks.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.session import persist_table

VOCABULARY = 100_000  # the most frequent words, which go to the tasks; whether a word is among them changes no result
EXCEPTIONS = 200_000  # words whose canonical spelling is not that of the table: all of them go, more are refused

# Letters of other scripts that have the shape of a Latin letter.
_SHAPES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "κ": "k", "γ": "y", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "ӏ": "l",
    # Armenian
    "օ": "o", "Տ": "S", "ո": "n", "ս": "u", "հ": "h", "Օ": "O", "Լ": "L", "ց": "g", "զ": "q",
    # Latin letters kept apart only by code
    "ɡ": "g", "ɑ": "a",
}
_SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_HYPHENS = "".join(map(chr, [0x2010, 0x2011, 0x2012, 0x2013, 0x2043, 0x2212, 0xFE63, 0xFE58, 0xFF0D]))
_HIDDEN = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]))
_LIGATURES = range(0xFB00, 0xFB07)


def _zero_cost() -> dict[str, str]:
    """Characters and what they look like, '' for those that don't show; built from the tables above and
    from the width and ligature forms of the Unicode data."""
    out = {c: "" for c in _HIDDEN} | {c: " " for c in _SPACES} | {c: "-" for c in _HYPHENS}
    for k in [*range(0xFF01, 0xFFEF), *_LIGATURES, *range(0x3371, 0x3380)]:
        kind, _, rest = unicodedata.decomposition(chr(k)).partition("> ")
        if kind in ("<wide", "<narrow") or kind == "<compat" and k in _LIGATURES:
            out.setdefault(chr(k), unicodedata.normalize("NFKC", chr(k)))
    out |= _SHAPES
    for k in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:  # the same letters with an accent
        letter, *marks = unicodedata.normalize("NFD", chr(k))
        if letter in _SHAPES and marks and len(c := unicodedata.normalize("NFC", _SHAPES[letter] + "".join(marks))) == 1:
            out[chr(k)] = c
    for c in "ĳĲǆǅǄǉǈǇǌǋǊ":
        out[c] = unicodedata.normalize("NFKC", c)
    return out


ZERO_COST = _zero_cost()
_HIDDEN_CLASS = re.compile("[" + re.escape(_HIDDEN) + "]")
_CLASS = re.compile("[" + re.escape("".join(ZERO_COST)) + "]")
_CYRILLIC = {v: k for k, v in ZERO_COST.items() if "Ѐ" <= k <= "ӿ" and k not in "ӏӀҮ"}
_GREEK = {v: k for k, v in ZERO_COST.items() if "Ͱ" <= k <= "Ͽ" and k not in "ϲϳϹͿ"}
_OWN_CYRILLIC = re.compile("[" + "".join(chr(c) for c in range(0x400, 0x500) if chr(c) not in ZERO_COST) + "]")
_OWN_GREEK = re.compile("[" + "".join(chr(c) for c in range(0x370, 0x400) if chr(c) not in ZERO_COST and chr(c).isalpha()) + "]")
_BETWEEN = re.escape("".join(c for c, looks in ZERO_COST.items() if looks and not looks.isalnum()))  # odd blanks, hyphens, marks
_T = rf"[^\s!-/:-@\[-`{{-~{_BETWEEN}]"
_ODD_TOKEN = re.compile(rf"(?<!{_T})[0-9A-Za-z]*+(?=[^\x00-\x7f]){_T}+")
_STEPS: dict[str, str] = {}


def steps(char: str) -> str:
    """The edges that a character follows at no cost: what it looks like, accents apart; '' if it does not show."""
    out = _STEPS.get(char)
    if out is None:
        looks = "".join(ZERO_COST.get(x, x) for x in unicodedata.normalize("NFD", ZERO_COST.get(char, char)))
        out = _STEPS[char] = unicodedata.normalize("NFD", looks)
    return out


def path(token: str) -> str:
    """The edges of a whole token; several accents on one letter follow in one order."""
    out = "".join([steps(c) for c in token])
    return out if out.isascii() else unicodedata.normalize("NFD", out)


def shape(text: str) -> str:
    """What the text looks like: composed accents, one width, Latin letters for their look-alikes."""
    if text.isascii():
        return text
    # Hidden characters go first: they keep an accent from its letter.
    text = unicodedata.normalize("NFC", _HIDDEN_CLASS.sub("", text))
    looks = _CLASS.sub(lambda m: ZERO_COST[m.group()], text)
    return looks if looks.isascii() or looks == text else unicodedata.normalize("NFC", looks)


def by_table(looks: str) -> str:
    """The spelling of a word that is in no vocabulary, from what it looks like: its look-alike letters follow the
    script of its other letters."""
    if looks.isascii():
        return looks
    table = _CYRILLIC if _OWN_CYRILLIC.search(looks) else _GREEK if _OWN_GREEK.search(looks) else None
    return "".join(table.get(c, c) for c in looks) if table else looks


class Trie:
    """Words in a trie whose edges are what the letters look like; a node keeps its most frequent word."""

    __slots__ = ("next", "word")

    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.word: str | None = None

    def add(self, word: str) -> None:
        """Words must come in order of preference: the first one at a node stays."""
        at = self
        for c in path(word):
            at = at.next.setdefault(c, Trie())
        if at.word is None:
            at.word = word

    def search(self, token: str, budget: int = 0) -> str | None:
        """The word at the least cost within the budget; ties go to the first in order of the alphabet."""
        if not budget:
            at: Trie | None = self
            last = ""
            for char in token:
                for c in steps(char):
                    if unicodedata.combining(c) and unicodedata.combining(last or c) > unicodedata.combining(c):
                        return self.search(path(token)) if path(token) != token else None
                    at, last = at.next.get(c), c
                    if at is None:
                        return None
            return at.word
        # With a budget, all ways to read the token are followed.
        edges = path(token)
        # States are (node, place in the token) with the least cost that reaches them.
        best: tuple[int, str] | None = None
        layer: dict[tuple[int, int], tuple[int, Trie]] = {(id(self), 0): (0, self)}
        todo = [(0, self, 0)]
        while todo:
            cost, node, i = todo.pop()
            if i == len(edges) and node.word is not None and (best is None or (cost, node.word) < best):
                best = (cost, node.word)
            moves = []
            if i < len(edges):
                moves += [(cost + (c != edges[i]), n, i + 1) for c, n in node.next.items()]
                moves.append((cost + 1, node, i + 1))
            moves += [(cost + 1, n, i) for n in node.next.values()]
            for c, n, j in moves:
                key = (id(n), j)
                if c <= budget and (key not in layer or c < layer[key][0]):
                    layer[key] = (c, n)
                    todo.append((c, n, j))
        return best[1] if best else None


class Canon:
    """Canonical text: tokens through the trie, the rest by table."""

    def __init__(self, words: list[str], budget: int = 0) -> None:
        self.trie, self.budget = Trie(), budget
        for w in words:
            self.trie.add(w)
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        out = self.known.get(token)
        if out is None:
            if len(self.known) > 500_000:
                self.known.clear()
            out = self.known[token] = self.trie.search(token, self.budget) or by_table(shape(token))
        return out

    def text(self, text: str | None) -> str | None:
        """One form for all texts that look the same; NULL stays NULL.

        Tokens beyond ASCII go through the trie as they stand; what is between them goes by table. An ASCII token is what it looks
        like, and no canonical spelling in another script looks so (see ``_clean``).
        """
        if text is None or text.isascii():
            return text
        out, at = [], 0
        for m in _ODD_TOKEN.finditer(text):
            out += [shape(text[at : m.start()]), self.token(m.group())]
            at = m.end()
        out.append(shape(text[at:]))
        joined = "".join(out)
        return joined if joined.isascii() else unicodedata.normalize("NFC", joined)


def vocabulary(documents: DataFrame, size: int = VOCABULARY) -> list[str]:
    """Spellings from which canonical ones are chosen, the most frequent first: words of one script in composed form.

    Only words that are not plain ASCII, and their ASCII look-alikes, can be chosen against each other, so
    the counts are of words with a letter beyond ASCII. Counts are of all documents and words. Of the words that look alike the most
    frequent is canonical. The trie has the ``size`` most frequent of these, and all for which the table gives another spelling: a
    word that is in neither gets the same from the table.
    """

    def odd(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        clean: dict[str, bool] = {}
        for batch in it:
            for t in batch.column(0).to_pylist():
                if t and not t.isascii():
                    seen.update(_ODD_TOKEN.findall(t))
        words = [(looks, w, n, by_table(looks) == w) for w, n in seen.items() if clean.setdefault(w, _clean(w)) for looks in (shape(w),)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in words], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))], ["looks", "word", "n", "same"])

    counted = documents.select("text").mapInArrow(odd, "looks string, word string, n long, same boolean").groupBy("looks", "word", "same").agg(F.sum("n").alias("n"))
    best = persist_table(counted.groupBy("looks").agg(F.min(F.struct((-F.col("n")).alias("n"), "word", "same")).alias("b")).select("b.n", "b.word", "b.same"), "spellings")
    rows = best.where("same").orderBy("n", "word").limit(size).select("n", "word").unionByName(best.where("not same").select("n", "word").limit(EXCEPTIONS + 1)).collect()
    if sum(1 for _ in rows) > size + EXCEPTIONS:
        raise ValueError(f"more than {EXCEPTIONS} words that the table spells otherwise")
    return [r["word"] for r in sorted(rows)]


def _clean(word: str) -> bool:
    """A spelling that may be canonical: composed, nothing hidden, one script."""
    if unicodedata.normalize("NFC", word) != word:
        return False
    plain = latin = other = False
    for c in word:
        if c in _SHAPES or "Ͱ" <= c <= "ԯ":
            other = True
        elif c in ZERO_COST:
            return False
        elif c.isalpha():
            latin = latin or c < "ɐ"
        else:
            plain = True
    return not (latin and other) and (latin or other) and not plain and not (other and shape(word).isascii())


def canonical(documents: DataFrame, id_column: str, text_column: str, size: int = VOCABULARY, budget: int = 0) -> DataFrame:
    """(id, text, canonical): each document with the one form of its text."""
    words = vocabulary(documents.select(F.col(text_column).alias("text")), size)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(words, budget)
        for batch in it:
            out = pa.array([canon.text(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), out], ["id", "text", "canonical"])

    src = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string, canonical string")


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first: documents whose texts differ but look the same.

    NULL texts are in no pair; equal texts are no pair. Texts travel as digests; groups of one form and one
    text are left out before the join, so exact copies without a look-alike cost nothing.
    """
    words = vocabulary(documents)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(words)
        for batch in it:
            texts = batch.column("text").to_pylist()
            digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            own = [None if t is None else digest(t) for t in texts]
            form = []
            for t, o in zip(texts, own, strict=True):
                c = canon.text(t)
                form.append(o if c is t or c == t else digest(c))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary()), pa.array(form, pa.binary())], ["doc_id", "own", "form"])

    forms = persist_table(documents.where("text is not null and doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, own binary, form binary"), "text-forms")
    several = forms.groupBy("form").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo != hi").select("form")
    part = persist_table(forms.join(several, "form", "left_semi"), "look-alikes")
    a, b = part.select("form", F.col("doc_id").alias("doc_id_a"), F.col("own").alias("own_a")), part.select("form", F.col("doc_id").alias("doc_id_b"), F.col("own").alias("own_b"))
    return a.join(b, "form").where("own_a != own_b and doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()
