"""Streams: articles appended once, and windows over events.

Exactly-once by key: each micro-batch is deduplicated against the table it is appended to, not against unbounded
state, so a restart or a repeated file changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lorekeel.operators import articles as ar


def _held(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append_new(path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """A sink that appends the articles of a batch that the table at ``path`` does not hold yet."""

    def write(batch: DataFrame, epoch: int) -> None:
        ar.save(batch, _held(batch.sparkSession, path, schema)).write.mode("append").parquet(path)

    return write


def article_stream(spark: SparkSession, landing: str, schema: StructType, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Articles of a landing folder into a table: all that is there now, or every so often."""
    src = spark.readStream.schema(schema).parquet(landing)
    w = src.writeStream.foreachBatch(append_new(table, schema)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def status_changes(runs: DataFrame) -> DataFrame:
    """Of polled states (run_id, polled_at, status) those that differ from the one before."""
    before = F.lag("status").over(Window.partitionBy("run_id").orderBy("polled_at"))
    return runs.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col("status"))).drop("_b")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events by type in windows of time; works on a stream and on a table. An extension: the knowledge graph
    itself needs no windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")
