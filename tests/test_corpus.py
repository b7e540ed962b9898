"""Corpus, usage and set operators on micro cases, and on empty tables."""

import glob
import os
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from quarrylight.operators import corpus as C
from quarrylight.operators import diff as D
from quarrylight.operators import events as E
from quarrylight.operators import ledger as L
from quarrylight.operators import search as S
from quarrylight.operators import sets
from quarrylight.operators import usage as U
from quarrylight.plans import corpus, usage
from quarrylight.plans import sets as set_plans

T = datetime(2025, 1, 1)
LINES = "path string, line_no int, section string, body string, tag string, added_on date, removed_on date"


def test_empty_tables(spark, sf, tmp_path):
    for f in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(f).limit(0).coalesce(1).write.parquet(str(tmp_path / os.path.basename(f)))
    own = ("tool_tree", "spend_table", "half_leakage", "agreement_scores")  # these have a total of their own
    for p in (corpus, usage, set_plans):
        for name, q in p.queries().items():
            if name not in own:
                assert q(spark, str(tmp_path)).count() == 0, name


def test_outcomes_and_moves(spark):
    d = date(2025, 1, 1)
    rows = [("a/x", 1, None, "t", None, d, date(2025, 2, 1)), ("b/y", 7, None, "t", None, date(2025, 2, 1), None), ("a/x", 2, None, "u", "DOC", d, date(2025, 2, 1)), (None, 3, None, None, None, None, None)]
    lines = spark.createDataFrame(rows, LINES)
    cites = spark.createDataFrame([(x, y) for x, y in [("a/x:1", "2025-01-01"), ("a/x:1", "2025-03-01"), ("a/x:1", "2024-03-01"), ("a/x:2", "2025-03-01"), ("a/x:9", "2025-03-01"), ("c:1", "2025-03-01"), ("c:1", "bad"), (None, None)]], "line string, day string")
    got = {(r.line, str(r.day)): r.outcome for r in C.outcomes(lines, cites).collect()}
    assert got == {("a/x:1", "2025-01-01"): "valid", ("a/x:1", "2025-03-01"): "moved", ("a/x:1", "2024-03-01"): "later", ("a/x:2", "2025-03-01"): "ended", ("a/x:9", "2025-03-01"): "no line", ("c:1", "2025-03-01"): "no path"}
    assert [(r.old_line, r.new_line) for r in C.moved_lines(lines).collect()] == [("a/x:1", "b/y:7")]


def test_quotes_and_globs(spark):
    docs = spark.createDataFrame([(1, "Set the Ring", "first SET  the *ring*, then"), (2, "set the ring", "reset the ringing"), (3, None, "x"), (4, "a b c", None)], "doc_id bigint, title string, text string")
    assert [r.doc_id for r in C.quoted(docs).collect()] == [1]
    items = spark.createDataFrame([("i", ["kb/a/**", "kb/*.md", "kb/b+c.md", "**", None, " "]), (None, ["kb/**"])], "item_id string, touches array<string>")
    paths = spark.createDataFrame([("kb/a/b/c.md",), ("kb/d.md",), ("kb/b+c.md",), ("other",)], "path string")
    assert {(r.pattern, r.files) for r in C.touched(items, paths).collect()} == {("kb/a/**", 1), ("kb/*.md", 2), ("kb/b+c.md", 1), ("**", 4)}


def test_keyed_merge_keeps_the_newest_value(spark):
    df = spark.createDataFrame([("k", "a", None, T, 1), ("k", "b", "x", T - timedelta(1), 2), ("k", " ", "y", T + timedelta(1), 3), ("k", "c", "z", T, 4)], "id string, u string, v string, at timestamp, n bigint")
    r = C.keyed_merge(df, "id", "at", "n", ["u", "v"]).first()
    assert (r.u, r.v, r.merged, r.conflicts) == ("a", "y", 4, 1)


def test_batches_and_fits(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([3, 3, 3, 20, 1, None])] + [(None, 0, 1)], "g string, n int, chars int")
    assert sorted((r.n, r.batch) for r in sets.batches(df, "g", ["n"], "chars", 2, 6).where("g = 'g'").collect()) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 3)]
    assert sorted(r.n for r in sets.first_fit(df, "g", ["n"], "chars", 8).where("g = 'g'").collect()) == [0, 1, 4, 5]


def test_similar_texts_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choices("alpha beta gamma delta ring mode scope".split(), k=rng.randint(0, 6))) for _ in range(60)]
    ws = {i: frozenset(t.split()) for i, t in enumerate(texts)}
    least = {}
    for i in range(60):
        least.setdefault(ws[i], f"{i:02d}")
    got = {r.key: (r.class_id, r.likes) for r in sets.similar(spark.createDataFrame([(f"{i:02d}", t) for i, t in enumerate(texts)] + [("x", None), (None, "ring")], "key string, t string"), "key", "t").collect()}
    for i in range(60):
        w = ws[i]
        likes = sum(1 for o in least if o and w and o != w and len(w & o) >= 2 and round(len(w & o) / len(w), 2) >= 0.6)
        assert got[f"{i:02d}"] == ((least[w] if w else None), likes)


def test_similar_texts_of_all_lengths(spark, monkeypatch):
    import random

    rng = random.Random(4)
    vocab = [f"w{i:02d}" for i in range(60)]
    texts = [" ".join(rng.sample(vocab[: rng.choice((8, 12, 60))], rng.randint(1, 7))) for _ in range(120)]
    texts += [" ".join(rng.sample(vocab, rng.randint(9, 55))) for _ in range(40)]
    # 28 of 47 words are .60 when rounded; they are the frequent ones, so that the rare ones don't lead there
    texts += [" ".join(vocab[:28] + [f"only{i}" for i in range(19)]), " ".join(vocab[:28])] + [" ".join(vocab[:28:2] + [f"only{i}"]) for i in range(19)]
    df = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "key string, t string")
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(frozenset(t.split()), f"{i:03d}")
    like = {w: sorted(k for o, k in least.items() if o != w and len(w & o) >= 2 and round(len(w & o) / len(w), 2) >= 0.6) for w in least}
    want = {f"{i:03d}": (len(x := like[frozenset(t.split())]), x[0] if x else None) for i, t in enumerate(texts)}
    for most in (8, 1):
        monkeypatch.setattr(sets, "SUBSETS", most)
        assert {r.key: (r.likes, r.first) for r in sets.similar(df, "key", "t").collect()} == want, most


def test_similar_texts_are_not_listed_in_pairs(spark, request):
    n = 900  # all alike: 809,100 pairs
    df = spark.range(n).select(F.format_string("%04d", "id").alias("key"), F.format_string("report check add side%02d%02d", (F.col("id") / 30).cast("int"), F.col("id") % 30).alias("t"))
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    was = written()
    rows = sets.similar(df, "key", "t").collect()
    assert {(r.likes, r.first) for r in rows} == {(n - 1, "0000"), (n - 1, "0001")}
    now = written()
    assert n < now - was < 60 * n


def test_places_refusals_and_first(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id"))
    assert all(r.pos == (r.id - 41) % 1000 + 1 for r in L.rotated(df, "id", 40).collect())
    allowed = spark.range(10_001).select(F.col("id").cast("string").alias("before"), (F.col("id") + 1).cast("string").alias("state"))
    moves = spark.createDataFrame([("k", "10000", 1), ("k", "10001", 2), ("k", "5", 3)], "key string, state string, seq int")
    assert [r.seq for r in E.refused(moves, "key", "state", "seq", allowed).collect()] == [3]
    rows = spark.createDataFrame([("a", None, 2), ("a", 1, 1), ("b", 3, 3), (None, 0, 0)], "k string, o int, v int")
    assert {tuple(r) for r in L.first_wins(rows, "k", ["o"]).collect()} == {("a", None, 2), ("b", 3, 3)}


def test_neighbours_in_parts(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(80, None)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = sorted(tuple(r) for r in L.neighbours(v, 3).collect())
    monkeypatch.setattr(L, "QUERY_BYTES", 50)
    monkeypatch.setattr(L, "BLOCK", 1)
    assert sorted(tuple(r) for r in L.neighbours(v, 3).collect()) == whole and len(whole) == 9


def test_bootstrap(spark):
    df = spark.createDataFrame([("g", k, float(k % 2)) for k in range(400)] + [("one", 1, 5.0), ("none", 2, None)], "g string, k int, v double")
    r = {x.g: x for x in D.bootstrap(df, "g", "k", "v").collect()}
    assert r["g"].mean == 0.5 and 0.43 < r["g"].low < 0.47 and 0.53 < r["g"].high < 0.57 and (r["one"].low, r["one"].high) == (5.0, 5.0) and "none" not in r


def test_aliases_and_parts(spark):
    q = spark.createDataFrame([("q", "Where is the out of office box"), ("z", "office out")], "qid string, question string")
    a = spark.createDataFrame([("out of office", "automatic replies"), ("box", "mailbox"), ("", "x")], "term string, canonical string")
    assert {(r.qid, r.term, r.weight) for r in S.expand(q, a).collect()} == {("q", "automatic", 0.25), ("q", "reply", 0.25), ("q", "mailbox", 0.5)} or {r.term for r in S.expand(q, a).collect()} == {S_stem for S_stem in ("automatic", "repli", "mailbox")}
    u = spark.createDataFrame([("u", "dir/ring-mode.md", "", "SkipRingLevel v2.10", True), ("s", "dir/ring-mode.md", "Summary", "alpha", True)], "unit_id string, path string, section string, body string, tagged boolean")
    t = {(r.unit_id, r.term): (r.tf, r.n, r.own) for r in S.unit_terms(u).collect()}
    assert t["u", "dir"] == (1.0, 1, False) and t["u", "ring-mod"] == (1.0, 1, True) and t["u", "ring"] == (2.0, 2, True) and t["u", "2.10"] == (1.0, 1, True)
    assert t["u", "alpha"] == (0.1, 0, False) and t["s", "alpha"] == (1.0, 1, True)


def test_totals_of_a_tree(spark, sf):
    t = U.tool_tree(spark.read.parquet(f"{sf}/run_entries.parquet")).collect()
    assert all(r.parts is None or r.parts == r.entries for r in t)
