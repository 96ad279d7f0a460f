"""Packed rows: many small records of one destination travel as arrays in one row.

A shuffle of packed rows costs the bytes of the arrays, not an object per record, and numpy works on
them as they arrive. Buckets are chosen by hash, so many that each has a bounded number of records on average.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.llm import bytescan as bs


RECORDS = 4000  # records of a bucket


def bucket_count(records: int) -> int:
    return max(24, -(-records // RECORDS))


def flat(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """All values of a column of packed arrays, end to end."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def lengths(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.fromiter((len(x) // size for x in column.to_pylist()), np.int64, len(column))


def split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of every bucket, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cols = [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    for i, j in zip(cut, [*cut[1:], len(b)], strict=True):
        yield int(b[i]), [c[i:j] for c in cols]


def per_bucket(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``fn`` on all packed rows of each bucket."""
    return df.groupBy(key).applyInArrow(fn, schema)


# ---------------------------------------------------------------- pairs
PAIR_SCHEMA = "bucket int, a binary, b binary, n binary"


def pack_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray, buckets: int) -> pa.Table:
    """Pairs of ids with a count, packed by the hash of the pair."""
    with np.errstate(over="ignore"):
        h = bs.mix(a.astype(np.uint64) * bs.U64(0x9E3779B97F4A7C15) + b.astype(np.uint64))
    rows = [(k, x.astype(np.int64).tobytes(), y.astype(np.int64).tobytes(), z.astype(np.int32).tobytes()) for k, (x, y, z) in split((h % bs.U64(buckets)).astype(np.int64), a, b, n)]
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "a": pa.array(cols[1], pa.binary()), "b": pa.array(cols[2], pa.binary()), "n": pa.array(cols[3], pa.binary())})


def sum_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its counts."""
    if not len(a):
        return a, b, n
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.add.reduceat(n, first)


def pairs_reaching(packed: DataFrame, least: int) -> DataFrame:
    """(a, b, n) of the pairs whose counts sum to ``least`` or more."""

    def run(t: pa.Table) -> pa.Table:
        a, b, n = sum_pairs(flat(t["a"], np.int64), flat(t["b"], np.int64), flat(t["n"], np.int32).astype(np.int64))
        k = n >= least
        return pa.table({"a": a[k], "b": b[k], "n": n[k]})

    return per_bucket(packed, "bucket", run, "a long, b long, n long")


# ---------------------------------------------------------------- a filter of fixed size
BLOOM_BITS = 1 << 23


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size (1 MB) over a column of longs; parts are united in the executors."""

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in it:
            for p in _bloom_bits(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    def unite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in it:
            for x in batch.column(0).to_pylist():
                bits |= np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    rows = ids.select(column).mapInArrow(local, "bits binary").repartition(1).mapInArrow(unite, "bits binary").collect()
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in rows:
        out |= np.frombuffer(r[0], np.uint8)
    return out


def _bloom_bits(ids: np.ndarray) -> list[np.ndarray]:
    h = bs.mix(ids.astype(np.int64).view(np.uint64))
    return [((h >> bs.U64(s)) % bs.U64(BLOOM_BITS)).astype(np.int64) for s in (0, 20, 40)]


def bloom_has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for p in _bloom_bits(ids):
        ok &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return ok


def keep_likely(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows whose id may be in the filter; a join afterwards removes the rest."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(bloom_has(bits, batch.column(column).to_numpy(zero_copy_only=False))))

    return df.mapInArrow(run, df.schema)


