"""Command line. ``python -m lorekeel.cli COMMAND --help`` has the arguments of each command.

Every command makes a frame from the tables of a folder and shows it or writes it (``--out``, ``--format``); what is made for
people are lines of text.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeel import sinks
from lorekeel.errors import EngineError, ValidationError
from lorekeel.operators import articles, detection, graph, ledger, lookups, mentions, merging, reports
from lorekeel.plans import catalogue, pipeline
from lorekeel.session import local_session, read_table
from lorekeel.sources import readers

FORMATS = {"jsonl": sinks.jsonl, "csv": sinks.csv, "parquet": sinks.parquet}
Command = Callable[[SparkSession, argparse.Namespace], DataFrame]
_COMMANDS: dict[str, tuple[Command, list[tuple[str, dict]]]] = {}


def command(*arguments: tuple[str, dict]) -> Callable[[Command], Command]:
    """Register a command under the name of its function, with its arguments besides the folder of the tables."""

    def add(f: Command) -> Command:
        _COMMANDS[f.__name__.replace("_", "-")] = f, list(arguments)
        return f

    return add


def _t(spark: SparkSession, a: argparse.Namespace, *names: str) -> list[DataFrame]:
    return [read_table(spark, a.data, n) for n in names]


@command(("name", {}))
def run(spark, a):
    """A query of the catalogue."""
    if a.name not in catalogue.queries():
        raise ValidationError(f"no query {a.name}")
    return catalogue.queries()[a.name](spark, a.data)


@command()
def health(spark, a):
    """Totals of the tables and the quality of the articles."""
    e, p, r, x = _t(spark, a, "entities", "provenance", "relationships", "articles")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return reports.health_report(n(e, "entities").crossJoin(n(p, "mentions")).crossJoin(n(r, "relationships")).crossJoin(articles.quality(x)))


@command(("--entity-id", {}), ("--name", {}), ("--hops", {"type": int, "default": 1}), ("--min-confidence", {"type": float}))
def subgraph(spark, a):
    """The neighbourhood of an entity as one JSON object."""
    e, al, r = _t(spark, a, "entities", "entity_aliases", "relationships")
    near, edges, documents = graph.subgraph(e, al, r, graph.root_of(e, a.entity_id, a.name), a.hops, a.min_confidence)
    rows = lambda df, order, name: df.agg(F.array_sort(F.collect_list(F.struct(order, *[F.col(c) for c in df.columns if c != order]))).alias(name))
    one = rows(near, "position", "entities").crossJoin(rows(edges, "position", "relationships")).crossJoin(documents.agg(F.array_sort(F.collect_list("document_id")).alias("documents")))
    return one.select(F.to_json(F.struct(F.lit(a.hops).alias("hops"), "entities", "relationships", "documents")).alias("line"))


@command(("--run-id", {"required": True}), ("--now", {"default": catalogue.NOW}), ("--reprocess", {"action": "store_true"}))
def ingest(spark, a):
    """The mentions that documents add to the table."""
    docs = read_table(spark, a.data, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", "doc_type", "source")
    return pipeline.ingest(docs, *_t(spark, a, "entities", "entity_aliases", "provenance"), run_id=a.run_id, detected_at=a.now, reprocess=a.reprocess).provenance


@command(("--text", {}), ("--article", {}))
def preview(spark, a):
    """What the dictionary finds in one text or article file, and what each occurrence may mean."""
    d = readers.single_article(spark, a.text, a.article).select("document_id", F.col("body").alias("text"))
    e, al = _t(spark, a, "entities", "entity_aliases")
    known = detection.dictionary(e.where("status = 'active'"), al)
    return detection.with_candidates(detection.detect(d, known), known).orderBy("span_start", F.desc("span_end"))


@command()
def audit_aliases(spark, a):
    """Aliases of several entities."""
    e, al = _t(spark, a, "entities", "entity_aliases")
    return reports.collision_report(mentions.collisions(al, e)).select("line").orderBy("line")


@command(("--least", {"type": int, "default": 2}), ("--tokens", {"type": int, "default": 5}), ("--days", {"type": float, "default": 1.0}))
def audit_provenance(spark, a):
    """Thin, short and narrow evidence in long form."""
    return mentions.findings(*_t(spark, a, "entities", "provenance"), a.least, a.tokens, a.days)


@command(("--from", {"dest": "day_from", "required": True}), ("--until", {"required": True}))
def backfill(spark, a):
    """The articles of a range of days, each url once."""
    if a.day_from > a.until:
        raise ValidationError("--from is after --until")
    return articles.backfill(read_table(spark, a.data, "articles"), a.day_from, a.until)


@command(("labelled", {}))
def benchmark(spark, a):
    """What the dictionary finds in labelled articles, scored article by article."""
    docs, expected = readers.labelled(spark, a.labelled)
    e, al = _t(spark, a, "entities", "entity_aliases")
    known = detection.dictionary(e, al)
    hit = detection.prescan(detection.detect(docs.select("document_id", F.col("body").alias("text")), known), known).join(e.select("entity_id", F.lower("canonical_name").alias("name"), "entity_type"), "entity_id")
    want = expected.select("document_id", F.lower("canonical_name").alias("name"), "entity_type")
    return merging.article_scores(hit, want, "document_id", "name", "entity_type")


@command(("--type", {}), ("--subtype", {}), ("--since", {}), ("--relationships", {"action": "store_true"}))
def export(spark, a):
    """A slice of the entities, or the relationships that touch it."""
    if a.subtype and not a.type:
        raise ValidationError("--subtype needs --type")
    e, al, r = _t(spark, a, "entities", "entity_aliases", "relationships")
    part = lookups.export_slice(e, a.type, a.subtype, a.since)
    return lookups.touching(r, part) if a.relationships else lookups.with_aliases(part, al)


def _new_seeds(spark, a, files: list[str]) -> DataFrame:
    rows = readers.seed(spark, files).withColumn("seed_id", F.struct("stage", "pos"))
    return merging.seed_import(rows, read_table(spark, a.data, "entities"))


@command(("file", {}))
def seed(spark, a):
    """The records of a seed file that are new."""
    return _new_seeds(spark, a, [a.file])


@command(("folder", {}))
def populate(spark, a):
    """Of all seed files of a folder the records seen, created and skipped, by stage."""
    files = readers.seed_files(spark, a.folder)
    return ledger.import_counters(readers.seed(spark, files), _new_seeds(spark, a, files), "stage")


@command(("landed", {}), ("--kind", {"required": True, "choices": sorted(readers.CATEGORIES)}))
def wikidata_seed(spark, a):
    """Landed answers of a knowledge base as entities that are not held yet."""
    rows = readers.imported(spark.read.text(a.landed, wholetext=True).withColumnRenamed("value", "body"), a.kind)
    e, al = _t(spark, a, "entities", "entity_aliases")
    return merging.external_import(rows, e, lookups.external_ids(al, "wikidata:"))


@command(("base", {}), ("head", {}))
def run_diff(spark, a):
    """The entities of two runs side by side."""
    e, p, runs = _t(spark, a, "entities", "provenance", "ingestion_runs")
    for r in (a.base, a.head):
        ledger.run(runs, r)
    return reports.diff_report(merging.named_diff(merging.diff(merging.touched(p, a.base), merging.touched(p, a.head)), e), "entities").orderBy("line_no")


@command(("run_id", {}))
def run_report(spark, a):
    """A run in lines of text."""
    p, r, runs = _t(spark, a, "provenance", "relationships", "ingestion_runs")
    ledger.run(runs, a.run_id)
    return reports.run_report(runs, a.run_id, merging.run_stats(p, r, runs)).orderBy("line_no")


def _profile(spark, a) -> DataFrame:
    e, r, p, al = _t(spark, a, "entities", "relationships", "provenance", "entity_aliases")
    return merging.quality_profile(e, r, p, mentions.collisions(al, e))


@command(("--baseline", {}), ("--max-drop", {"type": float, "default": 10.0}), ("--max-collisions", {"type": int, "default": 0}))
def validate_snapshot(spark, a):
    """The profile of the tables, or the bounds it breaks against a baseline that was written as Parquet."""
    now = _profile(spark, a)
    return merging.breaches(spark.read.parquet(a.baseline), now, a.max_drop, a.max_collisions) if a.baseline else now


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lorekeel", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    sub.add_parser("list", help="The names of the queries.")
    s = sub.add_parser("serve", help="Read-only answers over HTTP.")
    s.add_argument("data")
    s.add_argument("--port", type=int, default=8000)
    for name, (f, arguments) in _COMMANDS.items():
        one = sub.add_parser(name, help=f.__doc__)
        # What a command is about comes first, then the folder of the tables.
        for flag, more in arguments:
            one.add_argument(flag, **more)
        one.add_argument("data")
        one.add_argument("--out")
        one.add_argument("--format", choices=sorted(FORMATS), default="jsonl")
    a = p.parse_args(argv)
    if a.do == "list":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    spark = local_session()
    if a.do == "serve":
        from lorekeel import api

        api.serve(spark, a.data, a.port)
        return 0
    try:
        df = _COMMANDS[a.do][0](spark, a)
    except EngineError as e:
        p.error(str(e))
    if a.out:
        FORMATS[a.format](df, a.out)
    elif "line" in df.columns:
        print("\n".join(r["line"] for r in df.limit(10_000).collect()))
    else:
        df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
