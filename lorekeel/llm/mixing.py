"""Problem 9: a mixture of sources at target shares of tokens.

Every document has a hash that orders the documents of its source once and for all. Taking the documents
below a threshold of that hash takes a known number of tokens, so a budget is a threshold. Tokens are
summed by source and hash bucket; the bucket in which the budget ends is split into buckets again, and
so on, until single documents are left. Only counts move; nothing is sorted. A larger budget has a
higher threshold, so mixtures of growing size are nested.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.session import persist_table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
BITS = 9  # buckets of one level
LEVELS = 7  # levels of a 63-bit hash

# The pattern that cuts text before byte pairs are merged, of the public byte-level vocabulary.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer; its files are read from ``folder`` and never copied."""
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, h): tokens of the whole text, and a 63-bit hash of the id.

    A NULL text has no tokens and is left out; a NULL source is kept. Texts are encoded whole, however long; the encoder's time
    grows in proportion to a text, runs without a blank included.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in it:
            texts = batch.column("text").to_pylist()
            n = [len(enc.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), batch.column("h")], ["doc_id", "source", "tokens", "h"])

    src = documents.where("text is not null").select("doc_id", "source", "text", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1).alias("h"))
    return src.mapInArrow(run, "doc_id long, source string, tokens long, h long")


@dataclass
class Plan:
    """What one source gives: ``full`` copies of every document and one more of those with a hash below ``threshold``."""

    source: str
    share: float
    cap: int
    tokens: int
    documents: int
    budget: int
    full: int
    rest: int
    threshold: int = 0


def largest_total(tokens: dict[str, int], share: dict[str, float], cap: dict[str, int]) -> float:
    """The most tokens at which every source with documents has its share within its cap. Shares count among the
    sources that have documents."""
    live = [s for s in share if tokens.get(s, 0) > 0 and share[s] > 0]
    whole = sum(share[s] for s in live)
    return min((cap[s] * tokens[s] * whole / share[s] for s in live), default=0.0)


def plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[Plan]:
    """Thresholds of all sources. ``targets`` (source, target_share, max_repeats) is small by nature; it and sums per
    source and bucket are all that reaches the driver: sources * 2**BITS rows for the first level, and as many
    for each later one, of which there are LEVELS at most."""
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect()}
    if not want:
        return []
    mine = counts.where(F.col("source").isin(list(want)))
    shift = 63 - BITS
    level = mine.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    have: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in want}
    for r in level:
        have[r["source"]][r["b"]] = (r["t"], r["n"])
    tokens = {s: sum(t for t, _ in b.values()) for s, b in have.items()}
    total = total_tokens if total_tokens is not None else int(largest_total(tokens, {s: w[0] for s, w in want.items()}, {s: w[1] for s, w in want.items()}))
    live = sum(w[0] for s, w in want.items() if tokens[s] > 0) or 1.0
    plans = []
    for s, (share, cap) in sorted(want.items()):
        budget = min(round(total * share / live), cap * tokens[s]) if tokens[s] else 0
        full = min(cap, budget // tokens[s]) if tokens[s] else 0
        plans.append(Plan(s, share, cap, tokens[s], sum(n for _, n in have[s].values()), budget, full, budget - full * tokens[s] if full < cap else 0))
    open_ = {p.source: p for p in plans if p.rest > 0}
    left = {s: p.rest for s, p in open_.items()}
    prefix = dict.fromkeys(open_, 0)  # the bucket in which the budget ends, as the leading bits of the hash
    for k in range(LEVELS):
        if k:
            shift = 63 - BITS * (k + 1)
            cond = F.lit(False)
            for s in open_:
                cond = cond | ((F.col("source") == s) & (F.shiftright("h", shift + BITS) == prefix[s]))
            have = {s: {} for s in open_}
            for r in mine.where(cond).groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():
                have[r["source"]][r["b"]] = (r["t"], r["n"])
        for s in list(open_):
            at = None
            for b, (t, n) in sorted(have[s].items()):
                if t > left[s]:
                    at = (b, n)
                    break
                left[s] -= t
            last = 63 - BITS * (k + 1)
            if at is None:  # the budget ends with this bucket
                open_[s].threshold = (prefix[s] + 1) << (last + BITS) if k else 1 << 63
                del open_[s]
            elif at[1] == 1 or k == LEVELS - 1:  # a single document that no longer fits
                open_[s].threshold = at[0] << last
                del open_[s]
            else:
                prefix[s] = at[0]
        if not open_:
            break
    return plans


def _copies(counts: DataFrame, plans: list[Plan]) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents that are taken."""
    n = F.lit(0)
    for p in plans:
        more = (F.col("h") < F.lit(min(p.threshold, 2**63 - 1))).cast("int") if p.threshold < 1 << 63 else F.lit(1)
        n = F.when(F.col("source") == p.source, p.full + more).otherwise(n)
    return counts.select("doc_id", "source", "tokens", n.cast("int").alias("copies")).where("copies > 0")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, folder: str = TOKENIZERS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies) and its shares.

    Without ``total_tokens`` the mixture is the largest at which every source with documents reaches its
    share within ``max_repeats``; with it, a source that cannot give its part gives all its cap allows and the
    shortfall shows in the shares. Documents of sources without a target are not taken. Shares:
    (source, target_share, actual_share, tokens, documents, distinct_documents, max_copies), one row per target.
    """
    counts = persist_table(token_counts(documents, folder, seed), "token-counts")
    mix = _copies(counts, plan(counts, targets, total_tokens))
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"), F.count(F.lit(1)).alias("distinct_documents"), F.max("copies").alias("max_copies"))
    got = got.withColumnRenamed("source", "s")
    rows = targets.where("source is not null").select("source", "target_share").join(got, F.col("source") == F.col("s"), "left").drop("s").na.fill(0, ["tokens", "documents", "distinct_documents", "max_copies"])
    whole = got.agg(F.sum("tokens").alias("whole"))
    shares = rows.join(F.broadcast(whole), how="left").select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), "tokens", "documents", "distinct_documents", "max_copies")
    return mix, shares
