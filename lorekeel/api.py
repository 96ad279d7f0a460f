"""Read-only answers over HTTP: lists and records of the tables of a folder as JSON.

``answer`` is the whole of it, a function from path and arguments to a status and a value, so it can stand behind any server;
``serve`` puts it behind the one of the standard library. Lists are pages of a bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeel.operators import articles, graph, lookups, mentions, merging
from lorekeel.session import read_table

MOST = 500  # rows of a page
Handler = Callable[["Tables", dict[str, str], tuple[str, ...]], object]
_ROUTES: list[tuple[re.Pattern, Handler]] = []


class Tables:
    def __init__(self, spark: SparkSession, data: str) -> None:
        self._at = spark, data

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(*self._at, name)


class Missing(LookupError):
    """Nothing is there."""


def route(pattern: str) -> Callable[[Handler], Handler]:
    def add(f: Handler) -> Handler:
        _ROUTES.append((re.compile(pattern + r"/?"), f))
        return f

    return add


def _page(q: dict[str, str]) -> tuple[int, int]:
    limit, offset = int(q.get("limit", 50)), int(q.get("offset", 0))
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return min(limit, MOST), offset


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def _one(df: DataFrame) -> dict:
    rows = _rows(df.limit(1))
    if not rows:
        raise Missing
    return rows[0]


@route("/health")
def _health(t, q, path):
    return {"status": "ok", "entities": t.entities.count(), "relationships": t.relationships.count(), "mentions": t.provenance.count()}


@route("/entities")
def _entities(t, q, path):
    return _rows(lookups.with_aliases(lookups.listed(t.entities, q.get("q"), q.get("type"), q.get("status"), *_page(q)), t.entity_aliases))


@route("/entities/([^/]+)")
def _entity(t, q, path):
    e = t.entities.where(F.col("entity_id") == path[0])
    return _one(lookups.with_aliases(e, t.entity_aliases)) | _one(graph.detail_counts(e, lookups.relationships_for(t.relationships, path[0]), t.provenance.where(F.col("entity_id") == path[0])))


@route("/entities/([^/]+)/relationships")
def _of_entity(t, q, path):
    limit, offset = _page(q)
    return _rows(lookups.relationships_for(t.relationships, path[0]).orderBy("source_id", "target_id", "relation_type").offset(offset).limit(limit))


@route("/entities/([^/]+)/provenance")
def _mentions(t, q, path):
    limit, offset = _page(q)
    return _rows(t.provenance.where(F.col("entity_id") == path[0]).orderBy(F.desc("detected_at"), "prov_id").offset(offset).limit(limit))


@route("/relationships")
def _relationships(t, q, path):
    limit, offset = _page(q)
    least = float(q["min_confidence"]) if "min_confidence" in q else None
    df = lookups.listed_relationships(t.relationships, q.get("entity_id"), q.get("source_id"), q.get("target_id"), q.get("relation_type"), least)
    return _rows(df.orderBy("source_id", "target_id", "relation_type").offset(offset).limit(limit))


@route("/runs")
def _runs(t, q, path):
    return _rows(merging.recent_runs(t.ingestion_runs, _page(q)[0]))


@route("/runs/([^/]+)")
def _run(t, q, path):
    return _one(t.ingestion_runs.where(F.col("run_id") == path[0]))


@route("/scrape/articles")
def _articles(t, q, path):
    return _rows(articles.page(t.articles, q.get("source"), *_page(q)).drop("body"))


@route("/kg/alias-audit")
def _audit(t, q, path):
    limit, offset = _page(q)
    return _rows(mentions.scored_collisions(t.entity_aliases, t.entities, t.provenance).orderBy(F.desc("members"), "alias").offset(offset).limit(limit))


def answer(spark: SparkSession, data: str, path: str) -> tuple[int, object]:
    """(status, value) of a path with its arguments: 404 where nothing is there, 400 for arguments that are none."""
    at = urlsplit(path)
    for pattern, f in _ROUTES:
        if m := pattern.fullmatch(at.path):
            try:
                return 200, f(Tables(spark, data), dict(parse_qsl(at.query)), m.groups())
            except Missing:
                break
            except ValueError as e:
                return 400, {"detail": str(e)}
    return 404, {"detail": "not found"}


def serve(spark: SparkSession, data: str, port: int) -> None:
    class Server(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, value = answer(spark, data, self.path)
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    ThreadingHTTPServer(("127.0.0.1", port), Server).serve_forever()
