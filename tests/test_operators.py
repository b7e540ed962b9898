"""Reference operators on micro cases, readers on small files, and every SQL twin at the smallest size."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarrylight.operators import events as E
from quarrylight.operators import ledger as L
from quarrylight.operators import search as S
from quarrylight.sources import readers as R
from quarrylight.streaming import flows

T = datetime(2025, 1, 1)


def ev(spark, rows):
    return spark.createDataFrame([(i, T + timedelta(hours=h), u, k, v) for i, (u, h, k, v) in enumerate(rows)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")


def test_interval_join_bounds_and_leftovers(spark):
    e = ev(spark, [(1, 1, "view", 0.0), (1, 5, "view", 0.0), (1, 5, "buy", 0.0), (1, 0, "buy", 0.0), (2, 3, "buy", 0.0), (1, 99, "buy", 0.0)])
    w = E.windows(e, "view")
    assert {(r.event_id, r.wid) for r in E.assign(w, e.where("event_type = 'buy'")).collect()} == {(2, 1), (5, 1)}
    assert {r.event_id for r in E.leftovers(w, e.where("event_type = 'buy'")).collect()} == {3, 4}


def test_sessions_and_runs(spark):
    e = ev(spark, [(1, 0, "a", 1.0), (1, 24, "a", 3.0), (1, 49, "b", 2.0), (2, 0, None, None)])
    assert sorted((r.user_id, r.session, r.events) for r in E.sessions(e, 86_400).collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
    assert sorted((r.user_id, r.run, r.length) for r in E.runs(e, "user_id", "event_type", ["ts"]).collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
    assert {(r.user_id, r.growth, r.steps) for r in E.growth(e, "user_id", "value", ["ts"]).collect()} == {(1, 2.0, 1), (2, 0.0, 0)}


def test_open_spans(spark):
    rows = [("k", 1, "release"), ("k", 2, "claim"), ("k", 3, "claim"), ("k", 4, "release"), ("k", 5, "release"), ("k", 6, "claim"), ("m", 1, "x")]
    df = spark.createDataFrame([(k, s, T + timedelta(hours=s), x) for k, s, x in rows], "key string, seq bigint, at_ts timestamp_ntz, kind string")
    got = sorted((r.key, r.span, r.opened.hour, r.closed and r.closed.hour, r.events) for r in E.open_spans(df, "key", "kind", ["claim"], ["release"]).collect())
    assert got == [("k", 1, 2, 5, 4), ("k", 2, 6, None, 1)]


def test_even_share_and_trim(spark):
    e = spark.createDataFrame([("1", ["a", "b", "a"], 10), ("1", ["a", "b", "a"], 10), ("2", [], 5), ("3", None, 5), ("4", ["a"], 3)], "entry_id string, articles array<string>, chars int")
    assert {(r.part, r.share) for r in E.even_share(e, "articles", "chars").collect()} == {("a", 8.0), ("b", 5.0)}
    three = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 900.0), ("y", 1.0), ("y", 1.0), ("y", 2.0), ("y", 2.0), ("y", 900.0)], "k string, v double")
    assert E.trimmed(three, "k", "v").count() == 7


def test_ranking_ties_and_fusion(spark):
    u = spark.createDataFrame([(f"u{i}", "p", "", b, True) for i, b in enumerate(["ring mode", "ring mode", "other", ""])], "unit_id string, path string, section string, body string, tagged boolean")
    q = spark.createDataFrame([("q", "ring"), ("z", "")], "qid string, question string")
    assert [(r.unit_id, r.pos) for r in S.top(S.rank(u, q), 5).orderBy("pos").collect()] == [("u0", 1), ("u1", 2)]
    assert {r.qid: r.verdict for r in S.verdicts(u, q).collect()}["z"] == "none"
    lists = spark.createDataFrame([("q", "a", "x", 1), ("q", "a", "y", 2), ("q", "b", "y", 1), ("q", "b", "y", 3)], "qid string, ranking string, item string, pos int")
    assert [(r.item, r.score) for r in S.fuse(lists).orderBy(F.desc("score")).collect()] == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9))]
    picked = S.registered({"rev": lambda g: list(g["item"])[::-1], "bad": lambda g: 1 / 0}, "rev", lists.where("ranking = 'a'"))
    assert [r.item for r in picked.orderBy("pos").collect()] == ["y", "x"]


def test_ledger_ties(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("m", "z")], "key string, v string")
    assert {(r.key, r.v, r.n) for r in L.usual(df, "key", "v").collect()} == {("k", "a", 1), ("m", "z", 1)}


def test_markdown_and_ledgers(spark):
    text = "---\ntopic: x\n---\n# T\n\n## Facts\n- one\n  more [DOC S-1]\n- two\n\npara\ngoes on\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```sh\nx\n\ny\n```\nend"
    rows = R.markdown_units(spark.createDataFrame([("p", text), ("q", "")], "path string, content string")).orderBy("path", "line").collect()
    assert [(r.line, r.section, r.text, r.code) for r in rows] == [(7, "Facts", "one more [DOC S-1]", False), (9, "Facts", "two", False), (11, "Facts", "para goes on", False), (16, "Facts", "| 1 | 2 |", False), (18, "Facts", "x  y", True), (22, "Facts", "end", False)]
    e = R.ledger_entries(spark.createDataFrame([("p", "x\n- a\n b\n- c")], "path string, content string")).orderBy("entry").collect()
    assert [(r.line, r.end, r.text) for r in e] == [(2, 3, "- a b"), (4, 4, "- c")]


def test_files_spool_and_feeds(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "b.csv").write_bytes(b"a\0b")
    assert [r.path.rsplit("/", 1)[1] for r in R.files(spark, str(tmp_path)).collect()] == ["a.md"]
    (tmp_path / "s.jsonl").write_text('{"id": "1", "ts": "x"}\nnot json\n')
    assert sorted((r.id or "", r._bad or "") for r in R.spool(spark, str(tmp_path / "s.jsonl"), "id string, ts string").cache().collect()) == [("", "not json"), ("1", "")]
    feed = spark.createDataFrame([('<feed><entry><title>A &amp; B</title><link href="u"/><updated>2025</updated><summary>s</summary></entry></feed>',)], "xml string")
    assert [tuple(r) for r in R.atom_entries(feed).collect()] == [("A & B", "2025", "u", "s")]
    log = {"resourceLogs": [{"resource": {"attributes": [{"key": "k", "value": {"stringValue": "v"}}]}, "scopeLogs": [{"scope": {"name": "n"}, "logRecords": [{"timeUnixNano": "1000000000", "body": {"stringValue": "b"}, "attributes": [], "other": 1}]}]}]}
    r = R.otlp_logs(spark.createDataFrame([(json.dumps(log),)], "value string")).first()
    assert (r.resource, r.scope, r.body, r.attributes) == ({"k": "v"}, "n", "b", {})
    src = spark.createDataFrame([("a.py", "import os\nfrom x.y import z"), ("requirements.txt", "a==1.2\nb>=3"), ("package.json", '{"dependencies": {"q": "^1.0"}}')], "path string, content string")
    assert {(r.name, r.line) for r in R.imports(src).collect()} == {("os", 1), ("x.y", 2)}
    assert {(r.pin, r.value) for r in R.pins(src).collect()} == {("a", "1.2"), ("q", "1.0")}


def test_index_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("u", "a", 1), ("v", "b", 2)], "unit_id string, term string, tf int")
    R.write_index(p, str(tmp_path / "ix"))
    assert [tuple(r) for r in R.lookup(spark, str(tmp_path / "ix"), ["b"]).collect()] == [("v", "b", 2)]


def test_stream_leases(spark, tmp_path):
    rows = [("k", "claim", "a", 1), ("k", "claim", "b", 2), ("k", "release", "a", 3), ("m", "claim", "c", 4)]
    spark.createDataFrame(rows, "key string, kind string, holder string, seq bigint").write.parquet(str(tmp_path / "in"))
    s = flows.source(spark, str(tmp_path / "in"))
    assert {tuple(r) for r in flows.run(flows.lease_states(s), "update").collect()} == {("k", None, 3), ("m", "c", 1)}


def twins():
    return sorted(set(entry.oracle_sql()) & set(entry.queries()))


@pytest.mark.parametrize("name", twins())
def test_sql_twin(spark, sf, name):
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    text = lambda v: str(round(v, 6) if isinstance(v, float) else v)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want
