"""Problem 5: the history of changing attributes, built from snapshots and updates.

Every row is an interval of one unit that starts when it takes effect. Rows are ordered by entity and
time over all tasks, so one entity may span many of them. Neighbouring runs of intervals are merged
pairwise where entity and payload are equal: each round puts two neighbouring stretches together, and the last run of the left
one takes in the first run of the right one or does not. So it goes within a task, and then in the same way across tasks, where
only the first and the last run of each task still have a neighbour to meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeel.session import persist_table

ATTRIBUTES = ("canonical_name", "subtype", "description", "valid_from", "valid_until", "status", "merged_into")


def plain(column: str | Column) -> Column:
    """Text without outer blanks and with single inner ones; empty is NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def payload(df: DataFrame, attributes: Sequence[str]) -> Column:
    """A digest of the compared form of the attributes; NULLs are left out of it, so NULL equals NULL only."""
    kinds = dict(df.dtypes)
    cols = [(plain(a) if kinds[a] == "string" else F.col(a)).alias(f"a{i}") for i, a in enumerate(attributes)]
    return F.unhex(F.md5(F.to_json(F.struct(*cols), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}))) if cols else F.lit(b"")


def merged_runs(entity: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """Which intervals start a run once neighbouring runs of equal entity and payload are merged, pairwise, in a logarithmic number
    of rounds.

    A stretch of 1, 2, 4, ... intervals is told by its first interval and by the start of its last run. Where the last run of a
    left stretch equals the first run of the right one, that run goes on, and where it was all the right one had, it is the last.
    """
    n = len(entity)
    starts = np.ones(n, bool)
    begin, last = np.arange(n), np.arange(n)
    while len(begin) > 1:
        left, right = np.arange(0, len(begin) - 1, 2), np.arange(1, len(begin), 2)
        run, first = last[left], begin[right]
        same = (entity[run] == entity[first]) & (payload[run] == payload[first])
        starts[first[same]] = False
        ends = np.where(same & (last[right] == first), run, last[right])
        odd = len(begin) % 2 == 1
        begin, last = np.append(begin[left], begin[-1:] if odd else []).astype(np.int64), np.append(ends, last[-1:] if odd else []).astype(np.int64)
    return starts


@dataclass
class _Edge:
    """The ends of what one task holds: its first run and its last one."""

    part: int
    first_entity: str
    first_payload: bytes
    first_start: int
    first_end: int | None  # None: the run goes on to the end of the task
    last_entity: str
    last_payload: bytes


def _settle(edges: list[_Edge]) -> tuple[set[int], dict[int, int]]:
    """Tasks whose first run continues the run before it, and for each task the end of its last run.

    The first and last runs of all tasks are merged like intervals; what a task's last run still needs is the first end after it.
    """
    runs = [(e.part, e.first_entity, e.first_payload, True) for e in edges] + [(e.part, e.last_entity, e.last_payload, False) for e in edges if e.first_end is not None]
    runs.sort(key=lambda r: (r[0], not r[3]))
    column = lambda k: np.array([r[k] for r in runs], object)
    starts = merged_runs(column(1), column(2))
    joined = {r[0] for r, new in zip(runs, starts.tolist(), strict=True) if r[3] and not new}
    ends: dict[int, int] = {}
    nxt: _Edge | None = None
    for e in reversed(edges):
        end = -1
        if nxt is not None and nxt.first_entity == e.last_entity:
            end = nxt.first_start if nxt.part not in joined else nxt.first_end if nxt.first_end is not None else ends[nxt.part]
        ends[e.part] = end
        nxt = e
    return joined, ends


def version_history(
    rows: DataFrame,
    attributes: Sequence[str] = ATTRIBUTES,
    entity: str = "entity_id",
    effective: Sequence[str] = ("updated_at", "created_at"),
    latest: Sequence[str] = ("snapshot_at", "snapshot_id"),
) -> DataFrame:
    """(entity, start_us, end_us): the versions of every entity with the period each was valid.

    A row takes effect at the first of ``effective`` that is not NULL. Of rows of one entity with the same effect
    time the greatest by ``latest`` holds (NULLs first); exact repeats change nothing. In order of effect time, a version
    starts at the first row and where an attribute differs from the row before; blanks at the ends and their
    length do not count, and empty equals NULL. end_us is the start of the next version, -1 if there is none.
    Rows without entity or effect time are left out. An empty table has no versions. Other columns are ignored.
    """
    at = F.coalesce(*[F.unix_micros(F.col(c).cast("timestamp")) for c in effective])
    base = rows.select(F.col(entity).cast("string").alias("entity"), at.alias("at"), F.struct(*[F.col(c) for c in latest]).alias("k"), payload(rows, attributes).alias("payload")).where("entity is not null and at is not null")
    # One row per entity and effect time; combined on the map side, and never a whole entity at once.
    held = base.groupBy("entity", "at").agg(F.max(F.struct("k", "payload")).alias("m")).select("entity", "at", F.col("m.payload").alias("payload"))
    ordered = held.repartitionByRange("entity", "at").sortWithinPartitions("entity", "at")
    schema = "part int, seq long, entity string, start_us long, end_us long, payload binary, head boolean, tail boolean, last_payload binary"

    def reduce_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq = 0
        open_: tuple[str, int, bytes, bool] | None = None  # entity, start, payload of the run not yet ended; whether it is the task's first
        out: list[tuple] = []
        for batch in it:
            if not batch.num_rows:
                continue
            e, t, p = batch.column("entity").to_numpy(zero_copy_only=False), batch.column("at").to_numpy(zero_copy_only=False), np.array(batch.column("payload").to_pylist(), object)
            same = np.zeros(len(e), bool)
            same[1:] = e[1:] == e[:-1]
            starts = merged_runs(e, p)
            if open_ is not None and open_[0] == e[0]:
                same[0], starts[0] = True, open_[2] != p[0]
            for i in np.flatnonzero(starts).tolist():
                if open_ is not None:
                    out.append((part, seq, open_[0], open_[1], int(t[i]) if same[i] else -1, open_[2] if open_[3] else None, open_[3], False, None))
                    seq += 1
                open_ = (e[i], int(t[i]), p[i], seq == 0 and open_ is None)
            if out:
                yield _batch(out)
                out = []
        if open_ is not None:
            yield _batch([(part, seq, open_[0], open_[1], -1, open_[2] if open_[3] else None, open_[3], True, open_[2])])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary())
        names = ("part", "seq", "entity", "start_us", "end_us", "payload", "head", "tail", "last_payload")
        return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), types, strict=True)], names)

    runs = persist_table(ordered.mapInArrow(reduce_runs, schema), "version-runs")
    # Two rows per task at most reach the driver.
    edge_rows = runs.where("head or tail").orderBy("part", "seq").collect()
    edges: list[_Edge] = []
    for r in edge_rows:
        if r["head"]:
            edges.append(_Edge(r["part"], r["entity"], bytes(r["payload"]), r["start_us"], None if r["tail"] else r["end_us"], r["entity"], bytes(r["payload"])))
        if r["tail"]:
            edges[-1].last_entity, edges[-1].last_payload = r["entity"], bytes(r["last_payload"])
    joined, ends = _settle(edges)
    fixes = rows.sparkSession.createDataFrame([(e.part, e.part in joined, ends[e.part]) for e in edges], "fix_part int, joined boolean, last_end long")
    out = runs.join(F.broadcast(fixes), F.col("part") == F.col("fix_part")).where("not (head and joined)")
    return out.select(F.col("entity").alias(entity), "start_us", F.when(F.col("tail"), F.col("last_end")).otherwise(F.col("end_us")).alias("end_us"))


def as_of(history: DataFrame, at_us: int, entity: str = "entity_id") -> DataFrame:
    """The version of every entity that was valid at a moment."""
    return history.where((F.col("start_us") <= at_us) & ((F.col("end_us") == -1) | (F.col("end_us") > at_us))).select(entity, "start_us", "end_us")
