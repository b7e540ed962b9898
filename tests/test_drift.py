"""Schema drift: chunks give what a plain fold over all files gives."""

import json
import random

from quarrylight.operators import drift

H = "store string, run string, header string, change string"


def plain(rows):
    by = {}
    for s, r, h in rows:
        try:
            v = json.loads(h) if h is not None else None
        except ValueError:
            continue
        if isinstance(v, dict) and s is not None and r is not None:
            by.setdefault(s, {})[r] = {k: drift.json_type(x) for k, x in v.items()}
    out = set()
    for s, files in by.items():
        state, before = {}, None
        for r in sorted(files):
            now = files[r]
            if before is not None:
                come, gone, pairs = drift.step(before, now)
                out |= {(s, r, f, "added") for f in come} | {(s, r, f, "removed") for f in gone} | {(s, r, n, "renamed") for _, n in pairs}
                state |= {n: state.get(o) for o, n in pairs}
            for f, t in now.items():
                if t is not None:
                    if state.get(f) not in (None, t):
                        out.add((s, r, f, "type"))
                    state[f] = t
            before = now
    return out


def got(spark, rows):
    return {tuple(r) for r in drift.changes(spark.createDataFrame([(*r, "c") for r in rows], H)).collect()}


def test_each_change(spark):
    rows = [("s", "1", '{"a": 1, "kb_commit": "x"}'), ("s", "2", '{"a": null, "kbCommit": "y", "n": [1]}'), ("s", "3", '{"a": 1.5, "kbCommit": "z"}'), ("s", "4", "{torn"), ("s", "5", '{"a": 2.0, "kbCommit": {}}'), ("s", "5", '{"kbCommit": {}, "a": 2.0}')]
    assert got(spark, rows) == {("s", "2", "kbCommit", "renamed"), ("s", "2", "n", "added"), ("s", "3", "n", "removed"), ("s", "3", "a", "type"), ("s", "5", "kbCommit", "type")}


def test_many_files_and_chunks(spark):
    rng = random.Random(5)
    names = ["pipe_ver", "pipeline", "retrieval", "lanes", "notes", "kb_sha", "kb_commit"]
    values = [1, 2.5, "t", None, [1], {"k": 1}, True]
    rows = []
    for i in range(300):
        v = {n: rng.choice(values) for n in rng.sample(names, rng.randint(1, 5))}
        rows.append((rng.choice(["hot", "hot", "b", "c"]), f"{i:04d}", json.dumps(v) if rng.random() > 0.05 else '{"x'))
    assert got(spark, rows) == plain(rows)


def test_void(spark):
    assert got(spark, []) == set()
    assert got(spark, [(None, "1", "{}"), ("s", None, "{}"), ("s", "1", None), ("s", "2", ""), ("s", "3", "[1]"), ("s", "4", "{}")]) == set()


def test_names_alike():
    assert drift.alike("kb_commit", "kbCommit") and drift.alike("retrieval", "retr_ver") and drift.alike("pipe_ver", "distill_pipeline")
    assert not drift.alike("platform", "pipeline") and not drift.alike("limits", "lanes") and not drift.alike("retrieval_version", "pipeline_version")


def test_unified_keeps_typed_branches(spark):
    df = spark.createDataFrame([("s", "1", '{"a": 1, "b": [1, 2]}', ""), ("s", "2", '{"a": 3.0}', ""), ("s", "3", '{"a": "x"}', "")], H)
    r = {(x.run, x.field): x for x in drift.unified(df).collect()}
    assert r["1", "a"].as_integer == 1 and r["2", "a"].as_number == 3.0 and r["2", "a"].canonical == "3" and r["3", "a"].as_text == "x" and r["1", "b"].as_json == "[1,2]"
    assert {tuple(x)[:3] for x in drift.alternatives(df).collect()} == {("a", "integer", 1), ("a", "number", 1), ("a", "string", 1), ("b", "array", 1)}


def test_paths_below_the_top_level(spark):
    a = {"retrieval": {"major": 3, "lanes": ["x", {"k": 1.50}], "old": None}, "a.b": 1}
    df = spark.createDataFrame([("s", "1", json.dumps(a), ""), ("s", "1", json.dumps(a), ""), ("s", "2", '{"retrieval": {"major": "4"}}', ""), ("s", "3", json.dumps('{"retrieval": [7, 8]}'), ""), ("s", "4", "{torn", "")], H)
    r = {(x.run, x.field, tuple(x.pos)): x for x in drift.unified(df).collect()}
    assert r["1", "retrieval.major", ()].as_integer == 3 and r["2", "retrieval.major", ()].as_text == "4"
    assert r["1", "retrieval.lanes[]", (0,)].as_text == "x" and r["1", "retrieval.lanes[].k", (1,)].as_number == 1.5
    assert r["1", "retrieval.old", ()].type is None and r["1", "a\\.b", ()].as_integer == 1
    assert [r["3", "retrieval[]", (i,)].as_integer for i in (0, 1)] == [7, 8] and len(r) == 13
    kinds = {tuple(x) for x in drift.path_alternatives(df).collect()}
    assert {k for k in kinds if k[0].startswith("retrieval") and k[0] != "retrieval"} == {("retrieval.major", "integer", 1, "1"), ("retrieval.major", "string", 1, "2"), ("retrieval.lanes", "array", 1, "1"), ("retrieval.lanes[]", "string", 1, "1"), ("retrieval.lanes[]", "object", 1, "1"), ("retrieval.lanes[].k", "number", 1, "1"), ("retrieval[]", "integer", 1, "3")}


def test_one_table_and_where_alternatives_appear(spark, monkeypatch):
    monkeypatch.setattr(drift, "CHUNK", 2)
    rows = [("s", "1", '{"run": 1, "a": true, "A": "x"}', ""), ("s", "2", '{"run": "r", "a": null}', ""), ("t", "1", json.dumps('{"a": {"k": [1, 2.50]}}'), "")]
    df = spark.createDataFrame(rows, H)
    t = drift.table_of(df)
    assert t.columns == ["store", "run", "h_A", "h_a_2", "h_run"]
    assert sorted(tuple(x) for x in t.toDF(*"abcde").collect()) == [("s", "1", "x", "true", "1"), ("s", "2", None, None, "r"), ("t", "1", None, '{"k":[1,2.5]}', None)]
    assert {(x.store, x.field, x.type, x.first_run, x.files, x.alternative) for x in drift.appearing(df).collect()} == {("s", "run", "integer", "1", 1, 1), ("s", "run", "string", "2", 1, 2), ("s", "a", "boolean", "1", 1, 1), ("s", "A", "string", "1", 1, 1), ("t", "a", "object", "1", 1, 1)}
    assert [x.as_boolean for x in drift.unified(df).where("field = 'a' and run = '1' and store = 's'").collect()] == [True]
    empty = drift.table_of(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["store", "run"]
