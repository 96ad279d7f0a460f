"""Sinks: JSON lines, JSON-LD, Parquet, CSV, one-row JSON documents, seed files, and indented JSON for people."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAPSHOT_VERSION = 1


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_ld(path: str, **streams: DataFrame) -> None:
    """Streams as lines of JSON-LD, one node each; the context gives every stream the graph as its name.

    Nodes are lines, so a graph of any size is written by all tasks.
    """
    context = json.dumps({k: "@graph" for k in sorted(streams)})
    for name, df in streams.items():
        node = F.struct(F.lit(name).alias("stream"), *[F.col(c) for c in df.columns])
        line = F.concat(F.lit('{"@context": ' + context + ', "@graph": ['), F.to_json(node), F.lit("]}"))
        df.select(line.alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def json_ld_document(path: str, **streams: DataFrame) -> None:
    """Streams as one JSON-LD document: the context names the graph after each stream, and every stream is an array of its rows.

    The document is a text of many lines written in order of stream and row by one task, row by row, so it need not fit anywhere.
    """
    names = sorted(streams)
    rows = None
    for k, name in enumerate(names):
        df = streams[name]
        one = df.select(F.lit(k).alias("k"), F.lit(1).alias("at"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no stream")
    spark = rows.sparkSession
    head = json.dumps({"@context": {k: "@graph" for k in names}})[:-1]
    frame = [(k, 0, (head if not k else "]") + f', "{name}": [') for k, name in enumerate(names)] + [(len(names), 0, "]}")]
    # A row but the first of its stream begins with a comma: the least row of a stream is found by an aggregate.
    least = rows.groupBy("k").agg(F.min("value").alias("least"))
    ranked = rows.join(F.broadcast(least), "k")
    sorted_ = ranked.select("k", "at", F.when(F.col("value") == F.col("least"), F.lit(0)).otherwise(1).alias("later"), "value").unionByName(spark.createDataFrame(frame, "k int, at int, value string").withColumn("later", F.lit(0)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in it:
            out = []
            for k, at, value in zip(*(batch.column(c).to_pylist() for c in ("k", "at", "value")), strict=True):
                out.append(f", {value}" if at and last == (k, 1) else value)
                last = (k, at)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    in_order = sorted_.orderBy("k", "at", "later", "value").coalesce(1).sortWithinPartitions("k", "at", "later", "value")
    in_order.select("k", "at", "value").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def indented(df: DataFrame, most: int = 100_000) -> str:
    """Rows as indented JSON, for people; a frame of more than ``most`` rows is refused."""
    lines = [r[0] for r in df.limit(most + 1).select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("j")).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rows: write JSON lines")
    return json.dumps([json.loads(x) for x in lines], indent=2, ensure_ascii=False)


def seed_snapshot(df: DataFrame, path: str, reason: str, version: int = 1) -> None:
    """Entities (canonical_name, entity_type, subtype, description, aliases) as a file that the seed reader takes, in order of name and type."""
    e = F.struct("canonical_name", "entity_type", "subtype", "description", "aliases")
    doc = df.agg(F.array_sort(F.collect_list(e)).alias("entities")).select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(reason).alias("reason"), "entities")).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def document(df: DataFrame, path: str, **more: object) -> None:
    """A frame of one row as a JSON document with a version."""
    row = F.struct(F.lit(SNAPSHOT_VERSION).alias("schema_version"), *[F.lit(v).alias(k) for k, v in more.items()], *[F.col(c) for c in df.columns])
    df.select(F.to_json(row).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark, path: str) -> DataFrame:
    """A document written by :func:`document`; another version is an error."""
    df = spark.read.json(path)
    if df.where(~F.col("schema_version").eqNullSafe(F.lit(SNAPSHOT_VERSION))).limit(1).count():
        raise ValueError("unknown schema_version")
    return df
