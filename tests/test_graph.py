from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeel.operators import graph, lookups, mentions, merging, responses
from tests.conftest import rows

R = "source_id string, target_id string, relation_type string, description string, qualifier_id string, relation_kind_id string, valid_from timestamp, valid_until timestamp, document_id string, discovered_at timestamp, run_id string, confidence double"
D = lambda y: datetime(y, 1, 1)


def edge(s, t, label="r", a=None, b=None, conf=1.0, text="d"):
    return (s, t, label, text, None, None, a, b, "doc", D(2020), "run", conf)


def test_bounds_of_active_and_as_of(spark):
    r = spark.createDataFrame([edge("a", "b", "open"), edge("a", "b", "ended", None, D(2020)), edge("a", "b", "future", D(2022)), edge("a", "b", "today", D(2021), D(2021))], R)
    now = F.lit("2021-01-01").cast("timestamp")
    assert {x["relation_type"] for x in lookups.as_of(r, now).collect()} == {"open", "today"}
    assert {x["relation_type"] for x in lookups.active(r, now).collect()} == {"open", "future"}


def test_k_hop_with_cycle_loop_and_weak_edge(spark):
    r = spark.createDataFrame([edge("a", "b"), edge("b", "c"), edge("c", "a"), edge("c", "d"), edge("d", "d"), edge("d", "e", conf=0.1), edge("a", "b")], R)
    for hops, nodes in ((0, {"a": 0}), (1, {"a": 0, "b": 1, "c": 1}), (3, {"a": 0, "b": 1, "c": 1, "d": 2})):
        n, e = graph.k_hop(r, "a", hops, 0.5)
        assert dict(rows(n)) == nodes
        assert (("b", "c") in {(x["source_id"], x["target_id"]) for x in e.collect()}) == (hops > 1)


def test_merge_chains_collisions_and_circles(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "old_id string, new_id string")
    assert rows(graph.closed_merges(m)) == [("a", "c"), ("b", "c")]
    p = spark.createDataFrame([("a", "d1", "m", "s1", "t1", None, None), ("c", "d1", "m", "s2", "t2", None, None), (None, "d1", "m", "s", "t", None, None)], "entity_id string, document_id string, mention_text string, source string, context_snippet string, detected_at timestamp, run_id string")
    got = graph.redirect_provenance(p, graph.closed_merges(m)).select("entity_id", "source")
    assert rows(got) == [("c", "s2")]  # the survivor's own row
    r = spark.createDataFrame([edge("a", "c"), edge("b", "z"), edge("c", "z")], R)
    assert rows(graph.redirect_relationships(r, graph.closed_merges(m), drop_loops=True).select("source_id", "target_id")) == [("c", "z")]


def test_null_valid_from_is_one_key(spark):
    r = spark.createDataFrame([edge("a", "b"), edge("a", "b"), edge("a", "b", a=D(2020)), edge("a", "b", a=D(2021), b=D(2020))], R)
    assert graph.dedup_edges(r).count() == 3
    assert graph.save_edges(r, r.limit(1)).count() == 1


def test_alias_twins_collide_without_case(spark):
    e = spark.createDataFrame([("1", "X", "person"), ("2", "Y", "person")], "entity_id string, canonical_name string, entity_type string")
    a = spark.createDataFrame([("1", "Fed"), ("2", "fed"), ("2", "fed"), ("1", "É"), ("2", "é"), ("9", "fed"), ("1", None)], "entity_id string, alias string")
    assert {(r["alias"], r["entity_id"]) for r in mentions.collisions(a, e).collect()} == {("fed", "1"), ("fed", "2"), ("é", "1"), ("é", "2")}


def test_proposals_longest_wins_and_conflicts_drop(spark):
    p = spark.createDataFrame([("d", 0, "Acme", "organization", "x"), ("d", 1, "ACME", "organization", "longer"), ("d", 2, "Bo", "person", "y"), ("d", 3, "bo", "place", "y"), ("d", 4, None, "place", "y")], "document_id string, chunk_index int, canonical_name string, entity_type string, description string")
    assert rows(merging.proposals(p).select("canonical_name", "description")) == [("ACME", "longer")]
    assert rows(merging.conflicts(p)) == [("d", "bo", "person,place")]


def test_seed_rows_see_each_other(spark):
    s = spark.createDataFrame([(1, "A", "person"), (2, "a", "person"), (3, "B", "person")], "seed_id int, canonical_name string, entity_type string")
    held = spark.createDataFrame([("b", "person")], "canonical_name string, entity_type string")
    assert [r["seed_id"] for r in merging.seed_import(s, held).collect()] == [1]


def test_response_rules():
    ok = '{"entities": [{"surface_form": "a", "context_snippet": "s", "entity_id": "1"}, {"surface_form": "b", "context_snippet": "s", "entity_id": "", "new_entity": {"canonical_name": "B", "entity_type": "person", "description": "d"}}]}'
    resolved, new = responses.check_entities(ok, ["1"])
    assert [r["entity_id"] for r in resolved] == ["1"] and [n["canonical_name"] for n in new] == ["B"]
    for bad in ("x", "[]", '{"entities": 1}', '{"entities": [1]}', ok.replace('"1"', '"2"'), ok.replace('"s"', '""'), ok.replace("person", "robot"), ok.replace('"entity_id": ""', '"entity_id": "1"')):
        with pytest.raises(responses.ResponseError):
            responses.check_entities(bad, ["1"])
    rel = '{"relationships": [{"source": "1", "target": "Bo", "relation_type": "r", "context_snippet": "s", "confidence": true}, {"source": "1", "target": "1", "relation_type": "r", "context_snippet": "s"}, {"source": "1", "target": "?", "relation_type": "r", "context_snippet": "s"}]}'
    got = responses.check_relationships(rel, ["1", "2"], {"bo": "2"})
    assert [(g["source_id"], g["target_id"], g["confidence"]) for g in got] == [("1", "2", None)]
    assert responses.confidence(7) == 1.0 and responses.confidence("1") is None


def test_retry_and_fallback():
    p = responses.Scripted(["nonsense", '{"entities": []}'])
    assert responses.ask(p, "q", lambda t: responses.check_entities(t, []))[0] == ([], []) and "not accepted" in p.calls[1]
    f = responses.Fallback(responses.Scripted(["{}"]), responses.Scripted(['{"entities": [{"entity_id": "1"}]}']))
    assert f.generate("q")[0].startswith('{"entities"')
