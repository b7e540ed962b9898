"""Packing: every token placed once, no container over its capacity, only long texts split, little left over."""

import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.integers(64, 90))
def test_patterns_use_every_item_once(counts, capacity):
    used = Counter()
    for uses, times in packing.patterns(counts, capacity):
        assert sum(s * n for s, n in uses) <= capacity and times > 0
        for s, n in uses:
            used[s] += n * times
    assert used == Counter(counts)


def test_gaps_are_filled():
    rng = random.Random(1)
    counts = Counter(min(512, int(rng.lognormvariate(4.5, 1)) + 1) for _ in range(20000))
    found = packing.patterns(counts, 512)
    n = sum(t for _, t in found)
    assert n <= 1.01 * sum(s * c for s, c in counts.items()) / 512 + 1
    assert len(found) < 4 * len(counts)


def first_fit(sizes, capacity):
    room = []
    for n in sorted(sizes, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(capacity)
            k = len(room) - 1
        room[k] -= n
    return len(room)


def limits(spark, rows):
    return spark.createDataFrame(rows, "route string, capacity int, tokens string")


def test_frame(spark):
    rng = random.Random(3)
    sizes = [0, 0, 0, 100, 100, 250, 300, 301, 1000] + [rng.randint(1, 99) for _ in range(300)]
    sized = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens int")
    rows = packing.pack(sized, limits(spark, [("a", 100, "x"), ("b", 300, "x"), ("bad", 0, "x"), (None, 5, "x"), ("none", None, "x")])).collect()
    caps = {"a": 100, "b": 300}
    assert {r.route for r in rows} == set(caps)
    for route, cap in caps.items():
        mine = [r for r in rows if r.route == route]
        spans, fill, docs, group = defaultdict(list), Counter(), defaultdict(list), {}
        for r in mine:
            spans[r.container].append((r.offset, r.offset + r.tokens))
            fill[r.container] += r.tokens
            docs[r.doc_id].append((r.tok_from, r.tokens))
            assert group.setdefault(r.container, r.step_group) == r.step_group
        assert max(fill.values()) <= cap and set(fill) == set(range(max(fill) + 1))
        for s in spans.values():
            s = sorted(x for x in s if x[1] > x[0])
            assert all(a[1] <= b[0] for a, b in zip(s, s[1:])) and (not s or s[-1][1] <= cap)
        for d, n in enumerate(sizes):
            assert sum(t for _, t in docs[d]) == n and (len(docs[d]) == 1 or n > cap)
            at = 0
            for f, t in sorted(docs[d]):
                assert f == at
                at += t
        whole = sum(n // cap for n in sizes)
        assert len(fill) <= whole + first_fit([n % cap for n in sizes if n % cap], cap) + 1
        assert max(Counter(group.values()).values()) <= packing.GROUP


def test_nothing(spark):
    sized = spark.createDataFrame([], "doc_id bigint, tokens int")
    assert packing.pack(sized, limits(spark, [("a", 10, "")])).count() == 0
    one = spark.createDataFrame([(1, 5)], "doc_id bigint, tokens int")
    assert packing.pack(one, limits(spark, [])).count() == 0
    void = packing.pack(spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, tokens int"), limits(spark, [("a", 10, "")])).collect()
    assert [(r.container, r.offset, r.tokens) for r in void] == [(0, 0, 0)] * 2


def test_step_groups_cost_about_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = {x.route: x for x in packing.report(packing.pack_documents(docs, spark.read.parquet(f"{sf}/pack_limits.parquet"))).collect()}
    assert r["lookup"].filled > 0.9 and r["lookup"].containers <= r["lookup"].least_containers * 1.1 + 1
