from __future__ import annotations

import pytest

from tidegraph.api import Database
from tidegraph.cli import main

SCHEMA = "op string, kind string, record_id string, node_id long, payload string, src long, dst long, edge_type int, weight_million long"


def record(op, name, node=None, payload=None):
    return (op, "RECORD", name, node, payload, None, None, None, None)


def edge(op, src, dst, kind, w):
    return (op, "EDGE", None, None, None, src, dst, kind, w)


def test_commits_checkpoints_and_pinned_views(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    put = lambda *rows: db.commit(spark.createDataFrame(rows, SCHEMA))["commit"]
    assert db.status()["records"] == 0
    first = put(record("PUT", "a", 1, "x"), record("PUT", "a", 1, "x"), record("PUT", "b", 2, "y"), edge("PUT", 1, 2, 4, 900_000), edge("PUT", 2, 3, 5, 800_000))
    before = db.status()
    db.checkpoint()
    assert {k: v for k, v in db.status().items() if "check" not in k} == {k: v for k, v in before.items() if "check" not in k}
    put(record("DELETE", "b"), record("PUT", "a", 1, "z"), edge("DELETE", 2, 3, 5, 800_000), record("DELETE", "never"))
    assert [tuple(r) for r in db.records().collect()] == [("a", 1, "z")]
    assert sorted(r["record_id"] for r in db.records(first).collect()) == ["a", "b"]
    assert db.edges().count() == 1 and db.edges_of(2).count() == 1 and db.record("a").count() == 1
    db.checkpoint()
    assert db._folded().filter("is_deleted").count() == 3 and [tuple(r) for r in db.records().collect()] == [("a", 1, "z")]
    assert db.verify() == {"unresolved_edges": 1, "shared_nodes": 0}
    assert {r["node_id"]: r["energy"] for r in db.wave([1]).collect()} == {1: 1.0, 2: 0.675}
    for bad in ([edge("PUT", 1, 2, 11, 0)], [edge("PUT", 1, 2, 1, 2_000_000)], [record("PUT", "")], [record("ODD", "a")], [record("PUT", "a", 1, "p"), record("PUT", "a", 1, "q")]):
        with pytest.raises(ValueError):
            put(*bad)


def test_cli_lists_and_tells_sql(capsys):
    assert main(["list"]) == 0 and main(["sql", "p1_found"]) == 0
    out = capsys.readouterr().out
    assert "hop_wave_orders" in out and "durable_edge" in out
