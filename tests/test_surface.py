import json

import pytest

from lorekeel import api, cli
from lorekeel.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_answers_over_http(spark):
    get = lambda path: api.answer(spark, DATA, path)
    status, e = get("/entities?type=person&limit=3")
    assert status == 200 and len(e) == 3 and all(x["entity_type"] == "person" for x in e)
    one = get(f"/entities/{e[0]['entity_id']}")[1]
    assert one["canonical_name"] == e[0]["canonical_name"] and one["relationships"] >= 0 and one["mentions"] >= 0
    assert len(get(f"/entities/{catalogue.HOT}/relationships?limit=2")[1]) <= 2 and get(f"/entities/{catalogue.HOT}/provenance")[0] == 200
    assert get("/entities/none")[0] == get("/nowhere")[0] == get("/runs/none")[0] == 404
    assert get("/entities?limit=x")[0] == get("/runs?offset=-1")[0] == 400
    assert get("/health")[1]["status"] == "ok" and len(get("/runs?limit=2")[1]) == 2 and len(get("/scrape/articles?limit=2")[1]) == 2
    assert get("/relationships?min_confidence=0.99&limit=1")[0] == get("/kg/alias-audit?limit=1")[0] == 200


@pytest.mark.parametrize("args", [
    ["health"], ["subgraph", "--entity-id", catalogue.HOT, "--hops", "1"], ["audit-aliases"], ["audit-provenance"], ["backfill", "--from", "2024-01-01", "--until", "2024-12-31"],
    ["export", "--type", "person"], ["run-diff", catalogue.RUN_A, catalogue.RUN_B], ["run-report", catalogue.RUN_A], ["validate-snapshot"], ["preview", "--text", "nothing here"], ["run", "mention_counts"],
])
def test_commands(spark, capsys, args):
    assert cli.main([*args, DATA]) == 0 and capsys.readouterr().out.strip()


@pytest.mark.parametrize("args", [["subgraph", "--hops", "1"], ["subgraph", "--name", "no such entity"], ["run-report", "zz"], ["export", "--subtype", "x"], ["run", "zz"], ["backfill", "--from", "2025-01-01", "--until", "2024-01-01"]])
def test_commands_refuse(spark, args):
    with pytest.raises(SystemExit):
        cli.main([*args, DATA])


def test_snapshot_against_itself_and_import(spark, tmp_path, capsys):
    base = str(tmp_path / "base")
    assert cli.main(["validate-snapshot", DATA, "--out", base, "--format", "parquet"]) == 0
    assert cli.main(["validate-snapshot", "--baseline", base, DATA, "--out", str(tmp_path / "b"), "--format", "jsonl"]) == 0
    assert not any(p.read_text() for p in (tmp_path / "b").glob("part-*"))
    landed = tmp_path / "landed.json"
    landed.write_text(json.dumps({"results": {"bindings": [{"item": {"value": "u/Q1"}, "itemLabel": {"value": "Quite New"}}]}}))
    assert cli.main(["wikidata-seed", str(landed), "--kind", "index", DATA]) == 0
    assert "Quite New" in capsys.readouterr().out
