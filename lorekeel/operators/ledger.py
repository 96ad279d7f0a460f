"""The ledger: logs in which the latest row of a key holds, and numbers for rows that are appended.

Runs, their metrics and their failures are appended as events; what holds is a view, an aggregate that is combined on
the map side. So no row is ever changed in place, and a job that is repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from lorekeel.errors import RunNotFound
from lorekeel.schemas import RUN_STATUSES
from lorekeel.session import persist_table

RUN = ("run_id", "started_at", "finished_at", "status", "document_count", "entity_count", "relationship_count", "error_message")
METRICS = ("chunks", "mentions", "resolved", "proposals", "relationships", "input_tokens", "output_tokens", "wall_clock_seconds")


def latest(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of each key; of equal ones the greatest in its other columns."""
    rest = [c for c in events.columns if c not in key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("e")
    return events.groupBy(*key).agg(best).select(*key, *[F.col(f"e.{c}").alias(c) for c in (*order, *rest)]).select(events.columns)


# ---------------------------------------------------------------- runs
def started(runs: DataFrame) -> DataFrame:
    """The events of runs that begin: running, nothing counted yet. ``step`` orders the events of a run."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("document_count", "entity_count", "relationship_count")]
    none = F.lit(None)
    return runs.select("run_id", "started_at", none.cast("timestamp").alias("finished_at"), F.lit("running").alias("status"), *zero, none.cast("string").alias("error_message"), F.lit(0).alias("step"))


def finished(runs: DataFrame) -> DataFrame:
    """The events of runs that end, with their counts: those with an end and a status that ends a run."""
    ends = [s for s in RUN_STATUSES if s != "running"]
    return runs.where(F.col("finished_at").isNotNull() & F.col("status").isin(ends)).select(*RUN, F.lit(1).alias("step"))


def runs_now(events: DataFrame) -> DataFrame:
    """Each run as its last event has it."""
    return latest(events, ("run_id",), ("step",)).select(*RUN)


def run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run of that id; an unknown one is an error."""
    one = runs.where(F.col("run_id") == run_id)
    if not one.limit(1).count():
        raise RunNotFound(run_id)
    return one


def replaced(held: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``held`` with the rows of ``new`` in place of those of the same key; of several new ones for a key the greatest."""
    k = list(key)
    rest = [c for c in held.columns if c not in k]
    one = new.groupBy(*k).agg(F.max(F.struct(*rest)).alias("r")).select(*k, *[F.col(f"r.{c}").alias(c) for c in rest]).select(held.columns)
    return held.join(one.select(k), k, "left_anti").unionByName(one)


def metrics_of(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with their metrics, NULL where none were saved."""
    return runs.select(*RUN).join(metrics, "run_id", "left")


def failed(failures: DataFrame, run_id: str) -> DataFrame:
    """(document_id) of the documents that failed in a run, to be taken up again."""
    return failures.where(F.col("run_id") == run_id).select("document_id").distinct()


# ---------------------------------------------------------------- numbers
def numbered(rows: DataFrame, order: Sequence[str], name: str, first: Column | int = 1) -> DataFrame:
    """``rows`` with consecutive numbers in an order over all of them.

    Rows are sorted by ranges, numbered within their task, and moved up by the sizes of the tasks before: one number for
    each task travels, no row does twice.
    """
    local = persist_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = local.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("_part", "n"))).alias("s"))
    before = listed.select(F.explode("s").alias("x"), "s").select(F.col("x._part").alias("_part"), F.aggregate("s", F.lit(0).cast("long"), lambda a, y: a + F.when(y["_part"] < F.col("x._part"), y["n"]).otherwise(0)).alias("_before"))
    start = F.lit(first) if isinstance(first, int) else first
    return local.join(F.broadcast(before), part == F.col("_part")).withColumn(name, start + F.col("_before") + at).drop("_id", "_part", "_before")


def with_previous(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with previous_value (of the row before in its key, NULL if there is none) and is_first; strings, none NULL but the value.

    Rows are sorted by ranges of key and order, so a key with any number of rows spans many tasks; only the last row of each task
    travels to the next one.
    """
    spark = rows.sparkSession
    order_ = rows.repartitionByRange(key, order).sortWithinPartitions(key, order)
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_lead", BooleanType()), StructField("_tail", BooleanType()), StructField("previous_value", StringType()), StructField("is_first", BooleanType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, None
        for batch in it:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held(False)
            k, v = batch.column(key).to_pylist(), batch.column(value).to_pylist()
            before = [last, *zip(k, v, strict=True)][:-1]
            first = [b is None or b[0] != x for b, x in zip(before, k, strict=True)]
            prev = [None if f else b[1] for f, b in zip(first, before, strict=True)]
            lead = [last is None, *[False] * (batch.num_rows - 1)]
            last = (k[-1], v[-1])

            def held(end: bool, batch=batch, lead=lead, prev=prev, first=first) -> pa.RecordBatch:
                n = batch.num_rows
                more = [pa.array([part] * n, pa.int32()), pa.array(lead), pa.array([*[False] * (n - 1), end]), pa.array(prev, pa.string()), pa.array(first)]
                return pa.RecordBatch.from_arrays([*batch.columns, *more], [f.name for f in schema.fields])

        if held is not None:
            yield held(True)

    done = persist_table(order_.mapInArrow(run, schema), "previous")
    ends = sorted(done.where("_tail").select("_part", key, value).collect())
    fixes = spark.createDataFrame([(b[0], a[1], a[2]) for a, b in zip(ends, ends[1:], strict=False)], "_of int, _key string, _value string")
    out = done.join(F.broadcast(fixes), (F.col("_part") == F.col("_of")) & F.col("_lead") & (F.col(key) == F.col("_key")), "left")
    known = F.col("_of").isNotNull()
    return out.withColumn("previous_value", F.when(known, F.col("_value")).otherwise(F.col("previous_value"))).withColumn("is_first", F.col("is_first") & ~known).drop("_part", "_lead", "_tail", "_of", "_key", "_value")


def appended(log: DataFrame, records: DataFrame, operation: str, changed_at: Column, order: Sequence[str]) -> DataFrame:
    """New revisions of records for a log (history_id, changed_at, operation, the record): numbers go on from the last one."""
    top = log.agg(F.coalesce(F.max("history_id"), F.lit(0)).alias("_top"))
    rows = numbered(records, order, "_n", 0).crossJoin(F.broadcast(top)).withColumn("history_id", F.col("_top") + 1 + F.col("_n")).drop("_n", "_top")
    rows = rows.withColumn("operation", F.lit(operation)).withColumn("changed_at", changed_at)
    return rows.select([c for c in log.columns if c in rows.columns])


def synced_aliases(held: DataFrame, new: DataFrame) -> DataFrame:
    """The alias table after the aliases of some entities were given anew: (entity_id, aliases) in ``new``.

    All rows of those entities go, an empty list included; each pair comes once, in the spelling given; NULL aliases are left out.
    """
    fresh = new.select("entity_id", F.explode("aliases").alias("alias")).where("alias is not null").distinct()
    return held.select("entity_id", "alias").join(new.select("entity_id"), "entity_id", "left_anti").unionByName(fresh)


def import_counters(candidates: DataFrame, created: DataFrame, *by: str) -> DataFrame:
    """(.., seen, created, skipped) of an import, by stage or type."""
    n = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("seen"))
    c = created.groupBy(*by).agg(F.count(F.lit(1)).alias("created"))
    return n.join(c, list(by), "left").na.fill(0, ["created"]).withColumn("skipped", F.col("seen") - F.col("created"))
