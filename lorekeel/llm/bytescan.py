"""Vectorised scanning of text: lines, words and their hashes for many texts at once.

All work is done by numpy over one buffer of UTF-8 bytes, so that no Python code runs per word or
per line. Hashes are polynomial: with ``S[i] = sum(c[j] * B**j for j < i)`` modulo 2**64, the hash of
the bytes from i to j is ``(S[j] - S[i]) * B**-i``; every word, line and window of a buffer
gets its hash from the same running sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, U64)
_NEG = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` for i < n, kept per process and grown when needed."""
    global _POW, _NEG
    if len(_POW) < n:
        m = max(n, 2 * len(_POW))
        a = np.full(m, _BASE, U64)
        b = np.full(m, _INV, U64)
        a[0] = b[0] = 1
        with np.errstate(over="ignore"):
            _POW, _NEG = np.cumprod(a), np.cumprod(b)
    return _POW, _NEG


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all of its bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(32))
        h = h * U64(0xD6E8FEB86659FD93)
        h = h ^ (h >> U64(29))
        h = h * U64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> U64(32))


def running(values: np.ndarray) -> np.ndarray:
    """The running sum from which :func:`spans` takes hashes."""
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(U64) + U64(1)) * p[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end)."""
    _, q = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(U64))


# Classes of bytes.
_IS_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _IS_WORD[_c] = True
_IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BULLET, RIGHTS, OTHER = "\x01", "\x02", "\x03"
# Characters that stay visible to the line features; every other symbol beyond ASCII becomes OTHER.
_SYMBOLS = {
    "›": BULLET, "•": BULLET, "·": BULLET, "‣": BULLET, "▪": BULLET, "◦": BULLET,
    "©": RIGHTS, "®": RIGHTS,
    "«": '"', "»": '"', "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "…": ".", "\u00a0": " ",
}
_BEYOND = re.compile(r"[^\w\x00-\x7f]|[^\W\x00-\xff]")


def _beyond(m: re.Match) -> str:
    c = m.group()
    if c.isalnum():
        return c.lower()
    return " " if c.isspace() else _SYMBOLS.get(c, OTHER)


def ascii_symbols(text: str) -> str:
    """Symbols beyond ASCII become ASCII, letters beyond Latin-1 lower case; the lines stay.

    Symbols of Latin-1 that are left are dealt with in the bytes, by :func:`scan_words`.
    """
    if text.isascii():
        return text
    for a, b in _SYMBOLS.items():
        if a in text:
            text = text.replace(a, b)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _BEYOND.sub(_beyond, text)
    return text


def fold_case(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, without changing a length."""
    low = _LOWER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3) + 1 if len(buf) > 1 else np.zeros(0, np.int64)
    if len(lead):
        b = low[lead]
        up = (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
        low[lead[up]] += 32
    return low


@dataclass
class Scan:
    """Words of a buffer that holds several texts.

    ``text_end[k]`` is the end of text k in the buffer; words are ordered, ``word_text`` says in which
    text a word is.
    """

    buf: np.ndarray
    text_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    word_text: np.ndarray


def scan_words(texts: list[str]) -> Scan:
    """Words (runs of letters and digits, case folded) of every text."""
    raw = [(ascii_symbols(t) + "\n").encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(bytearray(b"".join(raw)), np.uint8)
    lead = np.flatnonzero(buf == 0xC2)  # symbols and controls of Latin-1, but for three letters
    lead = lead[~np.isin(buf[lead + 1], (0xAA, 0xB5, 0xBA))]
    buf[lead] = buf[lead + 1] = 3
    end_of = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) if raw else np.zeros(0, np.int64)
    low = fold_case(buf)
    edge = np.diff(np.concatenate(([0], _IS_WORD[low].view(np.int8), [0])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = running(low)
    return Scan(buf, end_of, start, end, spans(sums, start, end), np.searchsorted(end_of, start, "right"))


def chunks(sizes: Iterable[int], limit: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``limit``; a row above it stands alone."""
    a = total = k = 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield a, k
            a, total = k, 0
        total += n
        k += 1
    if k > a:
        yield a, k


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n consecutive values."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - n + 1, U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * U64(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k].astype(U64)
    return mix(out)


def segment_ranges(count: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within every segment of the given lengths."""
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first, count)
