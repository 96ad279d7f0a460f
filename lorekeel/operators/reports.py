"""Reports as lines of text: what the frames of runs, snapshots and collisions say, for people.

A report is a frame (line_no, line), made from frames of a few rows, so it can be written or shown like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(*columns: Column) -> Column:
    """Numbered lines of a row; those that are NULL are left out."""
    return F.posexplode(F.array_compact(F.array(*columns))).alias("line_no", "line")


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value.cast("string"))


def run_report(runs: DataFrame, run_id: str, stats: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """A run: its state, what it counted, what the tables hold of it (``stats``: run_id, documents, mentions, entities, relationships)
    and its metrics where there are any. A failed run says so first; an unknown one has no line."""
    one = runs.where(F.col("run_id") == run_id).join(stats, "run_id", "left")
    cost = []
    if metrics is not None:
        one = one.join(metrics.select("run_id", "input_tokens", "output_tokens", "wall_clock_seconds"), "run_id", "left")
        cost = [F.concat(F.lit("tokens: "), F.col("input_tokens").cast("string"), F.lit(" in, "), F.col("output_tokens").cast("string"), F.lit(" out")), _labelled("seconds", F.round("wall_clock_seconds", 1))]
    head = F.when(F.col("status") == "failed", F.lit("THIS RUN FAILED"))
    times = [F.concat(F.lit(f"{k}: "), F.date_format(f"{k}_at", "yyyy-MM-dd HH:mm:ss")) for k in ("started", "finished")]
    counted = [_labelled(k, F.col(c)) for k, c in (("documents processed", "document_count"), ("mentions saved", "entity_count"), ("relationships saved", "relationship_count"), ("distinct entities", "entities"))]
    return one.select(_lines(head, _labelled("run", F.col("run_id")), _labelled("status", F.col("status")), *times, *counted, *cost, _labelled("error", F.col("error_message"))))


def diff_report(named: DataFrame, what: str) -> DataFrame:
    """The sides of a diff (side, n, names), in the order base, head, both."""
    order = F.when(F.col("side") == "base", 0).when(F.col("side") == "head", 1).otherwise(2)
    text = F.concat(F.lit(f"{what}, "), F.when(F.col("side") == "both", "in both").otherwise(F.concat(F.lit("only in "), F.col("side"))), F.lit(": "), F.col("n").cast("string"), F.when(F.col("names") != "", F.concat(F.lit(" ("), F.col("names"), F.lit(")"))).otherwise(""))
    return named.select(order.alias("line_no"), text.alias("line"))


def health_report(totals: DataFrame) -> DataFrame:
    """A frame of one row as one line for each column."""
    return totals.select(_lines(*[_labelled(c.replace("_", " "), F.col(c)) for c in totals.columns]))


def collision_report(members: DataFrame) -> DataFrame:
    """(alias, line): an alias with the entities that have it (alias, entity_id, canonical_name, entity_type), by name."""
    one = F.struct("canonical_name", "entity_type", F.substring("entity_id", 1, 8).alias("id"))
    rows = members.groupBy("alias").agg(F.array_sort(F.collect_set(one)).alias("m"))
    shown = F.transform("m", lambda x: F.concat(x["canonical_name"], F.lit(" ("), x["entity_type"], F.lit(", "), x["id"], F.lit(")")))
    return rows.select("alias", F.concat(F.col("alias"), F.lit(": "), F.size("m").cast("string"), F.lit(" entities: "), F.array_join(shown, "; ")).alias("line"))
