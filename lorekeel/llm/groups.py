"""Problem 7: one group for all records linked directly or through others.

Union-find runs inside each partition of the edges and keeps a spanning forest only: at most one edge
for each node but the roots. Forests of several partitions are merged in rounds, each with a fraction
of the partitions, until a forest that one task may hold (``bound`` edges) is left and finished there. Where
the forest of the whole graph is larger than that, the rest is done by joins: every node is hung on
the smallest node of its neighbourhood until nothing moves, so no task ever holds an unbounded part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeel.session import persist_table, task_count

BOUND = 2_000_000  # edges of a forest that one task may hold
SHRINK = 4


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph with these edges: (root, node) with the smallest node as the root.

    ``a`` and ``b`` are comparable values. Components are found by hanging every root on the smallest
    neighbouring root and halving paths, over whole arrays.
    """
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        lo, hi = np.minimum(px, py), np.maximum(px, py)
        live = lo != hi
        if not live.any():
            break
        x, y, lo, hi = x[live], y[live], lo[live], hi[live]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    k = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[parent[k]], nodes[k]


def _reduce(edges: DataFrame, parts: int, bound: int) -> DataFrame:
    """The forest of each of ``parts`` partitions. Rows come in any order; a partition above ``bound`` rows is
    reduced as it is read, so it holds its forest and one piece."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in it:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n > bound:
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
        if held:
            r, c = forest(*map(np.concatenate, zip(*held, strict=True)))
            for i in range(0, len(r), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(r[i : i + 100_000], pa.int64()), pa.array(c[i : i + 100_000], pa.int64())], ["a", "b"])

    # By the smaller end, so that the stars of earlier rounds stay together as far as they can.
    return edges.repartition(parts, F.hash("a") if parts > 1 else F.lit(0)).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, root): every node of the edges (a, b: long, not NULL) and the smallest node of its component."""
    edges = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    parts = task_count(edges)
    now = persist_table(_reduce(edges, parts, bound), "forest")
    n = now.count()
    while parts > 1:
        parts = max(1, parts // SHRINK)
        if n > bound * parts:
            # A forest too large for fewer tasks: finish by joins.
            return _by_joins(now)
        now = persist_table(_reduce(now, parts, bound), "forest")
        n = now.count()
    child = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return child.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _by_joins(edges: DataFrame) -> DataFrame:
    """Components by alternating large-star and small-star steps; each step is a grouping combined on the map side
    and a join, so a node with any number of neighbours is spread over tasks."""
    now = edges.distinct()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours of a node hang on the smallest node around it.
        large = persist_table(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct(), "large-star")
        # Small star: smaller neighbours, and the node itself, hang on the smallest.
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(low, "a").select(F.col("m").alias("a"), "b").where("a != b").unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b")))
        nxt = persist_table(hung.distinct(), "small-star")
        same = nxt.count() == now.count() and nxt.join(now, ["a", "b"], "left_anti").limit(1).count() == 0
        now = nxt
        if same:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def salt_of(ids: DataFrame, most: int = 16) -> int:
    """A salt under which no two of the distinct ``id`` share a 64-bit name; among a billion ids the first one fails in 3 of 100 cases."""
    for salt in range(most):
        name = ids.groupBy(F.xxhash64("id", F.lit(salt)).alias("name")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        if not name.where("lo != hi").limit(1).count():
            return salt
    raise ValueError("too many ids for 64-bit names")


def entity_groups(entities: DataFrame, matches: DataFrame, bound: int = BOUND) -> DataFrame:
    """(entity_id, group_id) of the entities linked, directly or through others, to another record of ``entities``.

    Links come from merged_into and from matches (left_id, right_id), in both directions, and also run through
    ids that are not in entities; those are not reported. group_id is the smallest entity_id of the group
    that is in entities. NULL ids, self links and repeated links change nothing; an entity_id on several rows is one record.
    """
    links = entities.select(F.col("entity_id").alias("x"), F.col("merged_into").alias("y")).unionByName(matches.select(F.col("left_id").alias("x"), F.col("right_id").alias("y")))
    links = links.where("x is not null and y is not null and x != y")
    # Union-find works on 64-bit names of the ids, under a salt by which no two are alike.
    ids = entities.select(F.col("entity_id").alias("id")).where("id is not null").unionByName(links.select(F.explode(F.array("x", "y")).alias("id")))
    salt = F.lit(salt_of(ids))
    edges = persist_table(links.select(F.xxhash64("x", salt).alias("a"), F.xxhash64("y", salt).alias("b")), "links")
    groups = persist_table(components(edges, bound), "groups")
    own = entities.select("entity_id").where("entity_id is not null").distinct().withColumn("node", F.xxhash64("entity_id", salt))
    member = own.join(groups, "node")
    named = member.groupBy("root").agg(F.min("entity_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "group_id")
    return member.join(named, "root").select("entity_id", "group_id")
