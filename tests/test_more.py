import json
import random

import pytest
from pyspark.sql import functions as F

from lorekeel import errors, schemas, sinks
from lorekeel.operators import budget, detection, extraction, graph, ledger, merging, reports, responses
from lorekeel.sources import readers
from tests.conftest import rows

TIME = "2024-01-01 00:00:00"
def now():
    return F.lit(TIME).cast("timestamp")


# ---------------------------------------------------------------- ledger
def test_runs_metrics_and_failures_are_latest_wins(spark):
    r = spark.createDataFrame([("a", TIME, TIME, "completed", 3, 4, 5, None), ("b", TIME, None, "running", 9, 9, 9, None), ("c", TIME, TIME, "failed", 1, 0, 0, "x")], "run_id string, started_at string, finished_at string, status string, document_count long, entity_count long, relationship_count long, error_message string")
    r = r.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})
    events = ledger.started(r).unionByName(ledger.finished(r))
    assert rows(ledger.runs_now(events.unionByName(events)).select("run_id", "status", "document_count")) == [("a", "completed", 3), ("b", "running", 0), ("c", "failed", 1)]
    assert ledger.runs_now(events.limit(0)).count() == 0
    with pytest.raises(errors.RunNotFound):
        ledger.run(r, "zz")
    held = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, chunks long")
    new = spark.createDataFrame([("b", 5), ("b", 4), ("c", None)], held.schema)
    assert rows(ledger.replaced(held, new, ["run_id"])) == [("a", 1), ("b", 5), ("c", None)]
    failures = spark.createDataFrame([("a", "d2"), ("a", "d1"), ("a", "d1"), ("b", "d3")], "run_id string, document_id string")
    assert rows(ledger.failed(failures, "a")) == [("d1",), ("d2",)]


def test_numbers_are_consecutive_over_tasks(spark):
    values = [f"{i:04d}" for i in range(500)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    got = ledger.numbered(df, ["v"], "n", 10).orderBy("v").collect()
    assert [r["n"] for r in got] == list(range(10, 510))
    assert ledger.numbered(df.limit(0), ["v"], "n").count() == 0


def test_rows_before_over_tasks(spark):
    r = random.Random(2)
    data = [("hot" if r.random() < 0.5 else f"k{r.randrange(9)}", i, r.choice(["a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(r.sample(data, 400), "k string, n long, v string").repartition(6)
    last, want = {}, []
    for k, n, v in data:
        want.append((k, n, v, last.get(k, (None,))[0], k not in last))
        last[k] = (v,)
    got = [tuple(x) for x in ledger.with_previous(df, "k", "n", "v").orderBy("n").collect()]
    assert got == want and ledger.with_previous(df.limit(0), "k", "n", "v").count() == 0


def test_aliases_are_synced(spark):
    held = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], schemas.ALIAS)
    new = spark.createDataFrame([("2", ["x", None, "x", "B"]), ("3", [])], "entity_id string, aliases array<string>")
    assert rows(ledger.synced_aliases(held, new)) == [("1", "a"), ("2", "B"), ("2", "x")]


# ---------------------------------------------------------------- stages
def _new(name, kind="topic"):
    return {"surface_form": name, "context_snippet": "s", "entity_id": None, "new_entity": {"canonical_name": name, "entity_type": kind, "description": "d"}}


def test_discovery_spoils_only_its_own_chunk(spark):
    good, bad = json.dumps({"entities": [_new("Rain")]}), json.dumps({"entities": [{"surface_form": "x", "context_snippet": "s", "entity_id": "1"}]})

    class Provider(responses.Scripted):
        def generate(self, prompt, system=""):
            return (bad if "BAD" in prompt else good), responses.Usage(len(prompt), 1)

    c = spark.createDataFrame([("1", "fine " * 40_000), ("2", "BAD"), ("3", None)], "chunk_id string, text string")
    got = {r["chunk_id"]: r for r in extraction.discover(c, Provider).collect()}
    assert got["1"]["proposals"][0]["canonical_name"] == "Rain" and got["1"]["input_tokens"] < 20_000
    assert got["2"]["proposals"] == [] and "candidate" in got["2"]["error"] and got["3"]["error"] is None
    assert extraction.discover(c.limit(0), Provider).count() == 0


def test_relationships_are_extracted_and_kept(spark):
    answer = json.dumps({"relationships": [
        {"source": "e1", "target": "Bo", "relation_type": "leads", "context_snippet": "Acme is led", "valid_from": "2024-03", "confidence": 2},
        {"source": "NEW CO", "target": "e1", "relation_type": "supplies", "context_snippet": "sold", "valid_until": "nonsense", "confidence": True},
        {"source": "e1", "target": "nobody", "relation_type": "knows", "context_snippet": "z"},
    ]})
    known = [("e1", "Acme", "acme"), ("e2", "Bo", "Bo")]
    c = spark.createDataFrame([("1", "t", known, [("New Co", "organization", None, "e3")]), ("2", "t", [], None)], "chunk_id string, text string, known array<struct<entity_id: string, name: string, surface_form: string>>, new array<struct<canonical_name: string, entity_type: string, subtype: string, entity_id: string>>")
    got = {r["chunk_id"]: r for r in extraction.relate(c, lambda: responses.Scripted([answer])).collect()}
    assert [(x["source_id"], x["target_id"], x["valid_from"], x["valid_until"], x["confidence"]) for x in got["1"]["relationships"]] == [("e1", "e2", "2024-03-01", None, 1.0), ("e3", "e1", None, None, None)]
    assert got["2"]["relationships"] == [] and got["2"]["input_tokens"] == 0
    flat = extraction.relate(c, lambda: responses.Scripted([answer])).select(F.lit("d1").alias("document_id"), F.lit(0).alias("chunk_index"), F.explode("relationships").alias("r"))
    new = flat.select("document_id", "chunk_index", "r.source_id", "r.target_id", "r.relation_type", F.col("r.context_snippet").alias("snippet"), F.col("r.valid_from").cast("timestamp").alias("valid_from"), F.col("r.valid_until").cast("timestamp").alias("valid_until"), "r.confidence")
    kept = extraction.persisted_relationships(new.unionByName(new), spark.createDataFrame([], schemas.RELATIONSHIP), "run", now())
    assert rows(kept.select("source_id", "target_id", "description", "run_id")) == [("e1", "e2", "Acme is led", "run"), ("e3", "e1", "sold", "run")]


def test_proposals_become_entities_once(spark):
    p = spark.createDataFrame([("d", 0, "Rain", "topic", "short", "s", "x"), ("d", 1, "rain", "topic", "longer one", "s", "y"), ("d", 1, "Bo", "person", None, "s", "z"), ("d", 2, "Bo", "place", "q", "s", "z")], "document_id string, chunk_index int, canonical_name string, entity_type string, description string, source string, context_snippet string")
    held = spark.createDataFrame([], schemas.PROVENANCE)
    e, m = extraction.persisted_proposals(p, held, "run", now())
    assert rows(e.select("canonical_name", "description", "status")) == [("rain", "longer one", "active")]
    assert rows(m.select("mention_text", "context_snippet")) == [("rain", "y")]
    again = extraction.persisted_proposals(p, m.select(schemas.PROVENANCE.fieldNames()), "run2", now())
    assert again[1].count() == 0 and rows(again[0].select("entity_id")) == rows(e.select("entity_id"))


def test_questions():
    assert budget.first_question("", "body") == "TEXT:\nbody"
    q = budget.first_question("BLOCK", "body", [("Acme", "1"), ("acme", "1"), ("Bo", "2")])
    assert q == "BLOCK\n\nPREVIOUSLY RESOLVED ENTITIES:\n- Acme (id=1)\n- Bo (id=2)\n\nTEXT:\nbody"
    block = budget.listed_entities([("Acme", "1")], [("New", "topic", "rain"), ("X", "person", None)])
    assert block == "ENTITIES IN THIS TEXT:\n\n- Acme (id=1)\n- New (topic / rain, NEW — not yet in KG)\n- X (person, NEW — not yet in KG)"
    assert budget.listed_entities([]) == "" and budget.second_question("", "t") == "TEXT:\nt"


def test_providers_behind_an_address():
    sent = []

    def send(url, body, headers):
        sent.append((url, body, headers))
        return {"content": [{"text": "{}"}], "usage": {"input_tokens": 3, "output_tokens": 2}} if "system" in body else {"message": {"content": "{}"}}

    h, o = responses.hosted("m", "key", "http://h"), responses.local("m")
    h.send = o.send = send
    assert h.generate("p", "s") == ("{}", responses.Usage(3, 2)) and o.generate("p", "s") == ("{}", responses.Usage(0, 0))
    assert sent[0][1]["system"] == "s" and sent[1][1]["messages"][0] == {"role": "system", "content": "s"}
    o.send = lambda *a: {}
    with pytest.raises(responses.ProviderError):
        o.generate("p")
    with pytest.raises(responses.ProviderError):
        responses.try_import("no_such_module_at_all", "this")
    assert [responses.day(x) for x in ("2024-2-3", "2024", "2024-13", " 2024-05 ", 7, None, "")] == ["2024-02-03", "2024-01-01", None, "2024-05-01", None, None, None]


# ---------------------------------------------------------------- graph
def test_merges_stop_at_circles_and_follow_chains(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(37)]
    circle = [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("self", "self")]
    m = graph.closed_merges(spark.createDataFrame(chain + circle, "old_id string, new_id string"))
    assert rows(m) == sorted((f"c{i}", "c37") for i in range(37))
    assert graph.closed_merges(m.limit(0)).count() == 0


def test_subgraph_and_its_errors(spark):
    e = spark.createDataFrame([("1", "Zed", "person", None, "d", "active"), ("2", "Amy", "person", None, "d", "active"), ("3", "zed", "place", None, "d", "active")], "entity_id string, canonical_name string, entity_type string, subtype string, description string, status string")
    r = spark.createDataFrame([("1", "2", "knows", None, "doc", 0.9), ("1", "2", "knows", None, "doc2", 0.9), ("2", "9", "knows", None, None, None)], "source_id string, target_id string, relation_type string, valid_from timestamp, document_id string, confidence double").withColumn("discovered_at", F.lit(None).cast("timestamp"))
    a = spark.createDataFrame([("2", "b"), ("2", "a")], schemas.ALIAS)
    near, edges, documents = graph.subgraph(e, a, r, "1", 2)
    assert [(x["entity_id"], x["aliases"]) for x in near.orderBy("position").collect()] == [("1", []), ("2", ["a", "b"])]
    assert edges.count() == 2 and rows(documents) == [("doc",)]
    assert graph.subgraph(e, a, r, "1", 0)[1].count() == 0
    assert graph.root_of(e, name="AMY") == "2"
    with pytest.raises(errors.ResolutionAmbiguous):
        graph.root_of(e, name="zed")
    with pytest.raises(errors.EntityNotFound):
        graph.root_of(e, entity_id="7")
    with pytest.raises(errors.ValidationError):
        graph.root_of(e)
    assert rows(graph.detail_counts(e, r.unionByName(r.limit(1).withColumn("target_id", F.lit("1"))), spark.createDataFrame([("1",), (None,)], "entity_id string"))) == [("1", 3, 1), ("2", 3, 0), ("3", 0, 0)]


def test_both_plans_of_the_dictionary_agree(spark):
    r = random.Random(4)
    words = ["acme", "acme corp", "corp", "aa", "aaa", "a.b", "$$", "é", "o'hara", "New York", "york new"]
    texts = ["".join(r.choice(["acme", "corp", " ", "a", ".b", "$", "é", "O'Hara", "new", " york ", "-", "\n"]) for _ in range(60)) for _ in range(80)] + [None, "", "acme", "aaaa aaa"]
    d = spark.createDataFrame([(w.lower(), str(i)) for i, w in enumerate([*words, " "])], "alias string, entity_id string")
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")
    one, other = rows(detection.detect(docs, d)), rows(detection.detect(docs, d, most=2))
    for window in (5, 20, 100):
        near = rows(detection.detect_with_snippets(docs, d, window))
        assert near == rows(detection.detect_with_snippets(docs, d, window, most=2)) and [x[:4] for x in near] == one
    assert one == other == rows(detection.detect_by_join(docs, d)) and len(one) > 50 and any(x[1] == "$$" for x in one)


# ---------------------------------------------------------------- snapshots and reports
def test_profiles_and_their_bounds(spark):
    e = spark.createDataFrame([(str(i), "person" if i % 2 else "place", "s" if i % 3 == 0 else None) for i in range(10)], "entity_id string, entity_type string, subtype string")
    none = spark.createDataFrame([], "x int")
    c = spark.createDataFrame([("b", "1"), ("b", "2"), ("a", "1"), ("a", "3")], "alias string, entity_id string")
    old = merging.quality_profile(e, none, none, c.limit(0))
    new = merging.quality_profile(e.limit(9), none, none, c)
    assert [tuple(r) for r in new.where("section = 'collision'").collect()] == [("collision", "a", "person", 2), ("collision", "b", "person,place", 2)]
    assert rows(merging.breaches(old, new, 10.0, 2)) == []  # both bounds are reached, none is passed
    assert [r["rule"] for r in merging.breaches(old, new, 9.9, 1).collect()] == ["entity drop", "alias collisions"]
    assert rows(merging.breaches(old.limit(0), new, 0.0, 2)) == []


def test_reports(spark):
    runs = spark.createDataFrame([("r", "2024-01-01 10:00:00", None, "failed", 3, 2, 1, "boom")], "run_id string, started_at string, finished_at string, status string, document_count long, entity_count long, relationship_count long, error_message string")
    runs = runs.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})
    stats = spark.createDataFrame([("r", 5)], "run_id string, entities long")
    lines = [r["line"] for r in reports.run_report(runs, "r", stats).orderBy("line_no").collect()]
    assert lines[0] == "THIS RUN FAILED" and lines[-1] == "error: boom" and "distinct entities: 5" in lines and reports.run_report(runs, "q", stats).count() == 0
    sides = spark.createDataFrame([(f"{i:02d}", "base") for i in range(20)] + [("x", "both")], "entity_id string, side string")
    named = {r["side"]: (r["n"], r["names"]) for r in merging.named_diff(sides, spark.createDataFrame([("00", "A"), ("03", "B"), ("19", "C")], "entity_id string, canonical_name string")).collect()}
    assert named == {"base": (20, "A, B"), "both": (1, "")}


# ---------------------------------------------------------------- sources and sinks
def test_feeds_of_both_kinds(spark):
    rss = "<rss><channel><item><title>T</title><link>http://a</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="http://self"/><link href="http://b"/><summary>s</summary><updated>2024-03-05T11:00:00Z</updated></entry></feed>'
    f = spark.createDataFrame([("x", 0, rss), ("y", 1, atom), ("z", 2, "<broken"), ("n", 3, None)], "source string, feed_order int, xml string")
    items = readers.feed_items(f, linked_only=False)
    assert readers.feed_items(f).count() == 2
    assert rows(items.select("source", "url", "title", "body")) == [("x", "", "no link", ""), ("x", "http://a", "T", ""), ("y", "http://b", "A", "s")]
    dates = items.select("url", F.unix_timestamp(readers.feed_date(F.col("published_text"))).alias("t")).where("url != ''").orderBy("url").collect()
    assert dates[1]["t"] - dates[0]["t"] == 3600

    def decode(url):
        if url == "http://b":
            raise OSError
        return url + "/to" if url else None

    assert rows(readers.redirected(items.select("source", "url"), decode)) == [("x", ""), ("x", "http://a/to"), ("y", "http://b")]
    s = readers.sources(spark)
    assert s.where("source = 'bbc'").count() == 16 and s.select("url").distinct().count() == 18 and not s.where("source = 'reuters'").first()["full_text"]


def test_queries_of_the_knowledge_base(spark):
    for k in readers.CATEGORIES:
        q = readers.sparql(k, 7)
        assert "LIMIT 7" in q and q.count("{") == q.count("}") and q.index("LIMIT") < q.index("OPTIONAL")
    with pytest.raises(errors.ValidationError):
        readers.sparql("company", 0)
    waits, answers = [], iter([(429, ""), (503, ""), (200, "ok")])
    assert readers.fetched("q", lambda q: next(answers), wait=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ConnectionError):
        readers.fetched("q", lambda q: (404, ""), wait=waits.append)
    v = lambda **k: {a: {"value": b} for a, b in k.items()}
    answer = json.dumps({"results": {"bindings": [v(item="u/Q1", itemLabel="Acme", ticker="AC", exchangeLabel="NYSE", countryLabel="US", description="maker"), v(item="u/Q1", itemLabel="Acme", isin="I1"), v(item="u/Q2", itemLabel="Q2"), v(item="u/Q3")]}})
    landed = spark.createDataFrame([(answer,)], "body string")
    one = readers.imported(landed, "company").collect()
    assert len(one) == 1 and one[0]["aliases"] == ["wikidata:Q1", "ticker:AC", "isin:I1"] or one[0]["aliases"] == ["wikidata:Q1", "isin:I1", "ticker:AC"]
    text = {r["description"] for r in readers.bindings_to_entities(readers.bindings(landed, ["item", "itemLabel", "ticker", "exchangeLabel", "countryLabel", "description"]), "company").collect()}
    assert text == {"Acme is a publicly listed company, headquartered in US, listed on NYSE under ticker AC. maker", "Acme is a publicly listed company."}
    bank = spark.createDataFrame([("u/Q5", "BoX", "X"), ("u/Q6", "BoY", None)], "item string, itemLabel string, countryLabel string")
    assert sorted(r["description"] for r in readers.bindings_to_entities(bank, "central_bank").collect()) == ["BoX is the central bank of X. Sets monetary policy and influences the country's currency.", "BoY is a central bank."]


def test_seed_files_and_articles(spark, tmp_path):
    e = spark.createDataFrame([("Acme", "organization", None, "d", ["a"]), ("Bo", "person", "x", None, [])], "canonical_name string, entity_type string, subtype string, description string, aliases array<string>")
    (tmp_path / "wikidata").mkdir()
    sinks.seed_snapshot(e, str(tmp_path / "out"), "why")
    part = next((tmp_path / "out").glob("part-*"))
    part.rename(tmp_path / "seed.json")
    (tmp_path / "wikidata" / "b.json").write_text((tmp_path / "seed.json").read_text())
    (tmp_path / "wikidata" / "a.json").write_text((tmp_path / "seed.json").read_text())
    files = readers.seed_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in files] == ["seed.json", "a.json", "b.json"]
    assert rows(readers.seed(spark, files[:1]).select("canonical_name", "aliases")) == [("Acme", ["a"]), ("Bo", [])]
    one = readers.single_article(spark, text="body").first()
    assert one["body"] == "body" and one["doc_type"] == "news" and len(one["document_id"]) == 32
    with pytest.raises(errors.ValidationError):
        readers.single_article(spark)
    (tmp_path / "l.json").write_text(json.dumps({"articles": [{"document_id": "1", "body": "b", "entities": [{"canonical_name": "x", "entity_type": "nonsense"}]}]}))
    with pytest.raises(errors.ValidationError):
        readers.labelled(spark, str(tmp_path / "l.json"))


def test_documents_for_others(spark, tmp_path):
    e = spark.createDataFrame([("2", 'B"'), ("1", "A"), ("1", "A")], "entity_id string, name string")
    r = spark.createDataFrame([], "source_id string")
    sinks.json_ld_document(str(tmp_path / "ld"), entities=e, relationships=r)
    text = "\n".join(next((tmp_path / "ld").glob("part-*")).read_text().splitlines())
    doc = json.loads(text)
    assert doc["@context"] == {"entities": "@graph", "relationships": "@graph"} and doc["relationships"] == [] and [x["name"] for x in doc["entities"]] == ["A", "A", 'B"']
    assert json.loads(sinks.indented(e)) == [{"entity_id": "2", "name": 'B"'}, {"entity_id": "1", "name": "A"}, {"entity_id": "1", "name": "A"}] and "\n  " in sinks.indented(e)
    with pytest.raises(ValueError):
        sinks.indented(e, 2)


def test_queries_of_records_on_empty_tables(spark, tmp_path):
    from lorekeel.plans import catalogue, records

    for n in ("articles", "entities", "entity_aliases", "entity_snapshots", "provenance", "relationships", "ingestion_runs", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").limit(0).write.parquet(str(tmp_path / f"{n}.parquet"))
    names = [k for k, f in catalogue.queries().items() if f.__module__ == records.__name__]
    assert len(names) > 30
    for name in names:
        catalogue.queries()[name](spark, str(tmp_path)).collect()


def test_totals_and_the_resolver_that_has_nothing_to_ask(spark):
    from lorekeel.plans import pipeline

    r = spark.createDataFrame([("done", 3, 1, 2), ("skipped", 9, 9, 9), ("failed", 1, 0, 0)], "status string, mentions long, proposals long, relationships long")
    assert rows(merging.run_totals(r)) == [(1, 1, 1, 4, 1, 2)] and rows(merging.run_totals(r.limit(0))) == [(0, 0, 0, 0, 0, 0)]

    class Echo(responses.Scripted):
        def generate(self, prompt, system=""):
            assert "PREVIOUSLY" in prompt and prompt.endswith("TEXT:\nt")
            return json.dumps({"entities": []}), responses.Usage(1, 1)

    c = spark.createDataFrame([("1", "t", ["x"], "b", "PREVIOUSLY ..."), ("2", "t", [], None, None), ("3", "t", None, None, None)], "chunk_id string, text string, candidate_ids array<string>, block string, before string")
    got = {x["chunk_id"]: (x["error"], x["input_tokens"]) for x in pipeline.ask_model(c, Echo).collect()}
    assert got == {"1": (None, 1), "2": (None, 0), "3": (None, 0)}
