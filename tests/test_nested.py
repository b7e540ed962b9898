"""Nested records: shapes, positions and keys, against a plain recursive reading."""

import json
from datetime import datetime

import pytest

from quarrylight.operators import nested

T = datetime(2025, 1, 1)
ITEMS = "item_id string, checks string, repro string, gates string, loaded_at timestamp, extra string"
LOG = "seq bigint, fields string, loaded_at timestamp"


def items(spark, rows):
    return spark.createDataFrame([(i, c, r, g, T, "x") for i, c, r, g in rows], ITEMS)


def log(spark, rows):
    return spark.createDataFrame([(s, f, T) for s, f in rows], LOG)


def got(spark, it, lg=()):
    return sorted(tuple(r) for r in nested.child_records(items(spark, it), log(spark, lg)).collect())


def test_checks_and_words(spark):
    rows = got(spark, [("A", json.dumps([{"run": ["a", "b"]}, None, {"run": "one word"}, {}]), None, None)])
    assert rows == [("work_items", "A", "check", 0, -1), ("work_items", "A", "check", 2, -1), ("work_items", "A", "run", 0, 0), ("work_items", "A", "run", 0, 1), ("work_items", "A", "run", 2, 0)]


def test_lone_object_and_json_in_a_string(spark):
    lone = got(spark, [("A", json.dumps({"run": ["x"]}), json.dumps({"run": ["r", "", None, "s"]}), None)])
    assert lone == [("work_items", "A", "check", 0, -1), ("work_items", "A", "repro_run", 0, 0), ("work_items", "A", "repro_run", 0, 3), ("work_items", "A", "run", 0, 0)]
    assert got(spark, [("A", json.dumps(json.dumps([{"run": ["x"]}])), None, None)]) == [("work_items", "A", "check", 0, -1), ("work_items", "A", "run", 0, 0)]


def test_gates(spark):
    g = [{"id": "g1", "options": ["y", {"label": "n"}], "host_check": {"run": ["p", "q"]}}, {"id": "g2", "options": None}]
    want = [("gate", 0, -1), ("gate", 1, -1), ("host_run", 0, 0), ("host_run", 0, 1), ("option", 0, 0), ("option", 0, 1)]
    assert [r[2:] for r in got(spark, [("A", None, None, json.dumps(g))])] == want
    keyed = {"g1": g[0], "g2": g[1]}
    assert [r[2:] for r in got(spark, [("A", None, None, json.dumps(keyed))])] == want
    assert [r[2:] for r in got(spark, [("A", None, None, json.dumps(g[0]))])] == [w for w in want if w[:2] != ("gate", 1)]


def test_void_texts_and_tables(spark):
    assert got(spark, [("A", "null", "", "[]"), ("B", None, "  ", "{}")]) == []
    assert got(spark, []) == []
    assert got(spark, [("A", "{broken", None, None)]) == [("work_items", "A", "check", 0, -1)]


def test_log_fields(spark):
    rows = [(1, json.dumps({"item": "a, b,,c", "state": "x,y", "gates": [{"id": 1}, None], "n": None, "step": {"k": [1, 2]}, "e": []})), (2, None), (3, json.dumps(json.dumps({"topic": "t"}))), (1, json.dumps({"item": "a, b,,c", "state": "x,y", "gates": [{"id": 1}, None], "n": None, "step": {"k": [1, 2]}, "e": []}))]
    want = [("1", "gates", 0, -1), ("1", "item", 0, -1), ("1", "item", 1, -1), ("1", "item", 3, -1), ("1", "state", 0, -1), ("1", "step", 0, -1), ("3", "topic", 0, -1)]
    assert [r[1:] for r in got(spark, [], rows)] == want


def test_log_goes_through_the_relations(spark):
    f = {"item": "a, b", "gates": [{"id": "g", "options": ["y", {"label": "n"}]}], "step": {"no": 3, "at": {"host": "h"}, "tries": [{"exit": 1}, {"exit": 0}]}, "fields": {"item": "c,d"}}
    lg = log(spark, [(7, json.dumps(f)), (8, json.dumps([{"item": "x,y"}])), (9, "torn {")])
    rows = {r.row_id: r for r in nested.relations(items(spark, []), lg).collect()}
    assert {r.tbl for r in rows.values()} == {"coord_log"}
    assert json.loads(rows["7/step:0"].columns) == {"no": "3", "at.host": "h"}
    tries = [rows[f"7/step:0/tries:{i}"] for i in (0, 1)]
    assert [(r.parent, r.parent_id, json.loads(r.columns)) for r in tries] == [("step", "7/step:0", {"exit": "1"}), ("step", "7/step:0", {"exit": "0"})]
    assert rows["7/gates:0/options:1"].parent_id == "7/gates:0" and json.loads(rows["7/gates:0/options:1"].columns) == {"label": "n"}
    assert [json.loads(rows[f"7/item:{i}"].columns)["value"] for i in (0, 1)] == ["a", "b"]
    assert json.loads(rows["7/fields:0/item:0"].columns) == {"value": "c,d"} and json.loads(rows["9/fields:0"].columns) == {"value": "torn {"}
    assert [r[1:] for r in sorted(tuple(r) for r in nested.child_records(items(spark, []), lg).collect())] == [("7", "fields", 0, -1), ("7", "gates", 0, -1), ("7", "item", 0, -1), ("7", "item", 1, -1), ("7", "step", 0, -1)]


def test_repeated_deliveries_and_ids(spark):
    rows = [("A ", json.dumps([{"run": ["x"]}]), None, None), ("a", json.dumps([{"run": ["x"]}]), None, None), (None, json.dumps([{"run": ["x"]}]), None, None)]
    assert len(got(spark, rows)) == 2


def test_plan_inlines_singletons_and_keeps_shared_repeated_and_recursive():
    edges = [("", "a", False), ("a", "b", False), ("a", "c", True), ("a", "d", False), ("c", "d", False), ("d", "e", False), ("e", "d", False)]
    assert nested.inline_plan(edges).tables == {"c", "d", "e"}


def test_relations_keep_keys(spark):
    it = items(spark, [("A", json.dumps([{"run": ["x"], "exit": 1, "env": {"K": "v"}}]), None, None)])
    rows = {r.row_id: r for r in nested.work_relations(it).collect()}
    assert rows["A/checks:0"].fields == {"exit": "1", "env.K": "v"}
    assert rows["A/checks:0/run:0"].parent_id == "A/checks:0" and rows["A/checks:0/run:0"].fields == {"value": "x"}


def test_very_deep_record_does_not_break(spark):
    deep = "[" * 150 + "1" + "]" * 150
    assert got(spark, [("A", deep, None, None)])


def test_deep_texts_are_read_and_written():
    deep = "[" * 20_000 + '{"a": [1, -2.5, "x\\n", null, true, {}, []]}' + "]" * 20_000
    v = nested.parsed(deep)
    assert isinstance(v, list) and nested.dumps(v) == deep
    for text in ('{"a": 1, "b": [2, {"c": "d"}], "e": {}}', "[]", "3", '"s"', '[1, [2, [3]], {"k": null}]'):
        assert nested.deep_loads(text) == json.loads(text) and json.loads(nested.deep_dumps(json.loads(text))) == json.loads(text)
    for text in ("[1,", "[1}", '{"a" 1}', "[1] 2", "", "{1: 2}", "nul"):
        with pytest.raises(ValueError):
            nested.deep_loads(text)


def test_records_deeper_than_pythons_stack(spark):
    n = 1500
    recursive = '{"a": ' * n + '{"w": "end"}' + "}" * n
    single = "".join(f'{{"k{i}": ' for i in range(n)) + "7" + "}" * n
    df = spark.createDataFrame([("1", recursive), ("2", single)], "id string, c string")
    edges = [tuple(r) for r in nested.schema_graph(df, ["c"]).collect()]
    assert len(edges) == 2 + 2 + n
    rows = nested.shred(df, "id", ["c"], nested.inline_plan(edges)).collect()
    ends = [r for r in rows if r.fields and r.fields.get("w") == "end"]
    assert len(ends) == 1 and ends[0].pos == [0] * n and sum(r.relation == "a" for r in rows) == n
    assert [list(r.fields.values()) for r in rows if r.record_id == "2"] == [["7"]]
