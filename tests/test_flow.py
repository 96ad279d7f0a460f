import json

from pyspark.sql import functions as F

from lorekeel import schemas, sinks
from lorekeel.operators import articles as ar
from lorekeel.operators import responses
from lorekeel.plans import catalogue, pipeline
from lorekeel.streaming import ingest as st
from tests.conftest import rows


def article(i, url, body, source="s"):
    return (url, "t", body, source, None, None, f"id{i}", None)


def articles(spark, *a):
    return spark.createDataFrame([article(i, *x) for i, x in enumerate(a)], schemas.ARTICLE)


def test_save_drops_content_and_urls_once(spark):
    held = articles(spark, ("u0", "Same  Body"))
    new = articles(spark, ("u1", "same body"), ("u2", "x"), ("u3", " X "), ("u0", "other"), ("u4", ""), ("u5", ""), ("u2", "y"))
    assert [r["url"] for r in ar.save(new, held).orderBy("url").collect()] == ["u2", "u4", "u5"]
    assert ar.save(new.limit(0), held).count() == 0


def test_stream_appends_each_article_once(spark, tmp_path):
    land, table, cp = (str(tmp_path / x) for x in ("land", "table", "cp"))
    articles(spark, ("u1", "a"), ("u2", "b"), ("u3", "a")).write.parquet(land)
    st.article_stream(spark, land, schemas.ARTICLE, table, cp).awaitTermination()
    articles(spark, ("u4", "b"), ("u5", "c")).write.mode("append").parquet(land)
    st.article_stream(spark, land, schemas.ARTICLE, table, cp).awaitTermination()
    assert [r["url"] for r in spark.read.parquet(table).orderBy("url").collect()] == ["u1", "u2", "u5"]


def test_event_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r["event_type"], r["events"]) for r in st.event_windows(e).orderBy("start").collect()] == [("a", 2), ("b", 1)]


def test_ingest_is_idempotent(spark):
    docs = spark.createDataFrame([("d-1", "Acme met Bo. Acme won.", "news", "s"), ("d2", "nothing", "odd", "s")], "document_id string, text string, doc_type string, source string")
    e = spark.createDataFrame([("1", "Acme", "organization", "active"), ("2", "Bo", "person", "active"), ("3", "Bo", "place", "active")], "entity_id string, canonical_name string, entity_type string, status string")
    a = spark.createDataFrame([], schemas.ALIAS)
    held = spark.createDataFrame([], schemas.PROVENANCE)
    r = pipeline.ingest(docs, e, a, held, "run", "2024-01-01")
    assert rows(r.provenance.select("entity_id", "document_id", "mention_text")) == [("1", "d1", "acme")]
    assert [x["candidate_ids"] for x in r.unresolved.collect()] == [["2", "3"]]
    again = pipeline.ingest(docs, e, a, r.provenance.select(schemas.PROVENANCE.fieldNames()), "run2", "2024-01-02")
    assert again.provenance.count() == 0


def test_model_stage_isolates_failures(spark):
    c = spark.createDataFrame([("1", "t", ["x"], "b"), ("2", "t", ["y"], "b")], "chunk_id string, text string, candidate_ids array<string>, block string")
    answer = json.dumps({"entities": [{"surface_form": "a", "context_snippet": "s", "entity_id": "x"}]})
    got = pipeline.ask_model(c, lambda: responses.Scripted([answer])).orderBy("chunk_id").collect()
    assert got[0]["error"] is None and got[0]["resolved"][0]["entity_id"] == "x" and "no candidate" in got[1]["error"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    sinks.json_ld(str(tmp_path / "ld"), entities=df)
    assert json.loads(spark.read.text(str(tmp_path / "ld/entities")).first()[0])["@graph"] == [{"stream": "entities", "n": 1, "s": "a"}]
    sinks.document(df, str(tmp_path / "doc"))
    assert sinks.read_document(spark, str(tmp_path / "doc")).first()["n"] == 1


def test_catalogue_runs_on_empty_tables(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    names = ("articles", "entities", "entity_aliases", "entity_snapshots", "provenance", "relationships", "ingestion_runs", "documents")
    for n in names:
        spark.read.parquet(f"{src}/{n}.parquet").limit(0).write.parquet(str(tmp_path / f"{n}.parquet"))
    for name in ("co_mention_pairs", "quality_snapshot", "score_alias_collisions", "k_hop_nodes", "p5_found", "segment_research", "detect_mentions", "run_stats", "fit_candidates"):
        catalogue.queries()[name](spark, str(tmp_path)).collect()


def test_every_query_with_sql_is_registered():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 100
