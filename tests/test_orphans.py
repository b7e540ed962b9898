"""Orphan references: the state is the same however arrivals are cut into batches."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarrylight.operators import orphans

D = datetime(2025, 1, 1)
REFS = "src_table string, src_id string, ref_id string, key string, at timestamp"
EVENTS = "key string, at timestamp, delta int"


def day(n):
    return None if n is None else D + timedelta(days=n)


def state(spark, batches):
    s = orphans.OrphanState()
    for refs, events in batches:
        s = s.advance(spark.createDataFrame([("t", i, k, k, day(n)) for i, k, n in refs], REFS), spark.createDataFrame([(k, day(n), d) for k, n, d in events], EVENTS))
    return {(r.src_id, r.ref_id) for r in s.orphans().collect()}


def test_waiting_arriving_and_reopened(spark):
    first = ([("1", "p", 10)], [])
    assert state(spark, [first]) == {("1", "p")}
    assert state(spark, [first, ([], [("p", 3, 1)])]) == set()
    assert state(spark, [first, ([], [("p", 3, 1)]), ([], [("p", 10, -1)])]) == {("1", "p")}
    assert state(spark, [first, ([], [("p", 11, 1)])]) == {("1", "p")}


def test_removed_and_added_again(spark):
    events = [("p", 1, 1), ("p", 5, -1), ("p", 8, 1)]
    assert state(spark, [([("1", "p", 4), ("2", "p", 5), ("3", "p", 8), ("4", "p", None)], events)]) == {("2", "p"), ("4", "p")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(refs=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 9)), max_size=8), life=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 9), st.integers(1, 5)), max_size=5), cut=st.integers(0, 8))
def test_batches_do_not_matter(spark, refs, life, cut):
    refs = [(str(i), k, n) for i, (k, n) in enumerate(refs)]
    events = [e for k, a, n in life for e in ((k, a, 1), (k, a + n, -1))]
    want = {(i, k) for i, k, n in refs if not any(x == k and a <= n < a + m for x, a, m in life)}
    assert state(spark, [(refs[:cut], events[cut:]), (refs[cut:], events[:cut])]) == want


def test_tables_with_nulls_repeats_and_nothing(spark):
    w = "item_id string, depends_on array<string>, filed_at timestamp, dropped_at timestamp, loaded_at timestamp, ref_id string"
    items = spark.createDataFrame([("A", ["b ", "C", "", None], day(5), None, day(6), "clash"), ("A", ["b ", "C", "", None], day(5), None, day(7), "clash"), ("B", None, day(1), day(5), day(2), None), (None, ["A"], None, None, None, None)], w)
    e = "entry_id string, day string, citations array<struct<line:string,tag:string,verdict:string>>, loaded_at timestamp"
    entries = spark.createDataFrame([("e1", "2025-01-03", [("p:1", None, None), ("p:2", None, None), (None, None, None)], day(9)), ("e1", "2025-01-03", [("p:2", None, None)], day(9)), ("e2", "bad day", [("p:1", None, None)], day(9)), ("e3", None, None, None)], e)
    k = "path string, line_no int, added_on date, removed_on date"
    lines = spark.createDataFrame([("p", 1, D.date(), None)], k)
    rows = sorted(tuple(r) for r in orphans.found(items, entries, lines).collect())
    assert rows == [("run_entries", "e1", "p:2", "2025-01"), ("run_entries", "e2", "p:1", None), ("work_items", "A", "C", "2025-01"), ("work_items", "A", "b ", "2025-01")]
    none = orphans.found(items.limit(0), entries.limit(0), lines.limit(0))
    assert none.count() == 0


def test_large_index_takes_the_shuffled_way(spark, monkeypatch):
    monkeypatch.setattr(orphans, "SMALL_INDEX", 0)
    refs = [(str(i), "hot" if i % 3 else f"k{i}", 5) for i in range(60)]
    first = (refs, [("hot", 1, 1), ("k0", 1, 1)])
    assert state(spark, [first]) == {(str(i), f"k{i}") for i in range(3, 60, 3)}
    assert state(spark, [first, ([], [("hot", 5, -1), ("k3", 2, 1)])]) == {(r[0], r[1]) for r in refs if r[1] not in ("k0", "k3")}


def test_a_batch_writes_only_the_parts_of_its_keys(spark):
    s = orphans.OrphanState().advance(spark.createDataFrame([("t", str(i), f"k{i}", f"k{i}", day(5)) for i in range(40)], REFS), spark.createDataFrame([(f"k{i}", day(1), 1) for i in range(20)], EVENTS))
    n = s.advance(spark.createDataFrame([], REFS), spark.createDataFrame([("k0", day(2), -1)], EVENTS))
    moved = [b for b in range(orphans.BUCKETS) if n.refs[b][0] is not s.refs[b][0]]
    assert len(moved) == 1 and sum(n.index.get(b) is not s.index.get(b) for b in range(orphans.BUCKETS)) == 1
    assert {r.ref_id for r in n.orphans().collect()} == {"k0", *(f"k{i}" for i in range(20, 40))}


def test_snapshots_of_a_stream(spark, tmp_path):
    rows = [("r", "1", "p", 10, None), ("e", None, "p", 3, 1), ("e", None, "p", 10, -1)]
    for i, (what, sid, key, at, delta) in enumerate(rows):
        spark.createDataFrame([(i, what, sid, key, day(at), delta)], "n int, what string, sid string, key string, at timestamp, delta int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def split(df):
        return df.where("what = 'r'").selectExpr("'t' as src_table", "sid as src_id", "key as ref_id", "key", "at"), df.where("what = 'e'").select("key", "at", "delta")

    s = spark.readStream.schema("n int, what string, sid string, key string, at timestamp, delta int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    orphans.fold_stream(s, split, str(tmp_path / "check"), str(tmp_path / "out"))
    got = {r.batch: r.orphans for r in spark.read.schema("src_table string, period string, orphans bigint, batch int").parquet(str(tmp_path / "out")).collect()}
    assert sum(got.values()) == 2 and len(got) == 2
