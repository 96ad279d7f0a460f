import random
from datetime import datetime, timedelta

import numpy as np

from lorekeel.operators import versions
from tests.conftest import rows

SCHEMA = "snapshot_id long, snapshot_at timestamp, entity_id string, canonical_name string, subtype string, description string, valid_from timestamp, valid_until timestamp, status string, merged_into string, created_at timestamp, updated_at timestamp, extra string"
T0 = datetime(2024, 1, 1)


def row(i, e, name, at, created=T0, status="active", description="d"):
    return (i, T0 + timedelta(days=i), e, name, None, description, None, None, status, None, created, at, "x")


def brute(data):
    held = {}
    for r in data:
        at = r[11] or r[10]
        if r[2] is None or at is None:
            continue
        key = (r[2], at)
        if key not in held or (r[1], r[0]) > (held[key][1], held[key][0]):
            held[key] = r
    out = []
    for e in {k[0] for k in held}:
        starts, last = [], None
        for (_, at), r in sorted((k, v) for k, v in held.items() if k[0] == e):
            norm = tuple((" ".join(x.split()) or None) if isinstance(x, str) else x for x in r[3:10])
            if norm != last:
                starts.append(int((at - datetime(1970, 1, 1)).total_seconds() * 1e6))
            last = norm
        out += [(e, a, b) for a, b in zip(starts, starts[1:] + [-1])]
    return sorted(out)


def test_runs_merge_like_a_plain_scan():
    for n in range(0, 70):
        r = np.random.default_rng(n)
        entity, payload = np.sort(r.integers(0, 4, n)), r.integers(0, 2, n)
        plain = [i == 0 or entity[i] != entity[i - 1] or payload[i] != payload[i - 1] for i in range(n)]
        assert versions.merged_runs(entity, payload).tolist() == plain


def test_versions_come_through_merged_runs(spark, monkeypatch):
    df = spark.createDataFrame([row(i, "e", "A", T0 + timedelta(hours=i)) for i in range(9)], SCHEMA)
    assert len(rows(versions.version_history(df))) == 1
    monkeypatch.setattr(versions, "merged_runs", lambda entity, payload: np.ones(len(entity), bool))
    assert len(rows(versions.version_history(df))) > 1


def test_versions_against_brute_force_with_a_hot_entity(spark):
    r = random.Random(5)
    data = []
    for i in range(600):
        e = "hot" if r.random() < 0.5 else f"e{r.randrange(40)}"
        name = r.choice(["A", "A ", " A", "B", "", None])
        data.append(row(i, e, name, T0 + timedelta(hours=r.randrange(200)) if r.random() < 0.9 else None, description=r.choice(["d", "d  d", "d d"])))
    data += data[:20]  # exact repeats
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert rows(versions.version_history(df)) == brute(data)


def test_empty_table_nulls_and_one_row(spark):
    assert rows(versions.version_history(spark.createDataFrame([], SCHEMA))) == []
    df = spark.createDataFrame([row(1, None, "A", T0), row(2, "e", None, None, created=None), row(3, "f", "A", T0)], SCHEMA)
    assert rows(versions.version_history(df)) == [("f", int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6), -1)]


def test_as_of(spark):
    h = spark.createDataFrame([("e", 0, 10), ("e", 10, -1)], "entity_id string, start_us long, end_us long")
    assert rows(versions.as_of(h, 9)) == [("e", 0, 10)] and rows(versions.as_of(h, 10)) == [("e", 10, -1)]
