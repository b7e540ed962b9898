"""Tree contraction against a plain search from every node."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarrylight.operators import hierarchy


def search(links):
    out = defaultdict(set)
    for u, v in links:
        out[u].add(v)
    pairs = {}
    for u in list(out):
        level, dist, seen = {u}, 0, {}
        while level:
            dist += 1
            level = {w for x in level for w in out.get(x, ()) if w not in seen}
            seen |= {w: dist for w in level}
        pairs |= {(u, w): d for w, d in seen.items()}
    return pairs


def reach(spark, links):
    df = spark.createDataFrame([("l", u, v) for u, v in links], "link string, u string, v string")
    return {(r.u, r.y): r.dist for r in hierarchy.reach(df).collect()}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=16))
def test_any_graph(spark, links):
    links = [(str(a), str(b)) for a, b in links]
    assert reach(spark, links) == search(links)


def test_long_chain_into_a_circle(spark):
    links = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("c40", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("x", "c20"), ("s", "s")]
    assert reach(spark, links) == search(links)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, parent string, depends_on array<string>, u string")


def test_items(spark):
    df = items(spark, [("A", None, ["b", " B ", "zz", None], "u"), ("B", " a", None, "u"), ("B", " a", None, "u"), ("C", "b", [], "u"), ("D", "e", None, "u"), ("E", "D", None, "u"), ("F", "D", None, "u"), (None, "A", ["A"], "u"), ("G", "", None, None)])
    assert {tuple(r) for r in hierarchy.found(df).collect()} == {("parent", "B", "A"), ("parent", "C", "B"), ("parent", "C", "A"), ("parent", "D", "E"), ("parent", "D", "D"), ("parent", "E", "D"), ("parent", "E", "E"), ("parent", "F", "D"), ("parent", "F", "E"), ("depends_on", "A", "B")}
    t = {r.item_id: (r.root_id, r.depth, r.path, r.descendants, r.state) for r in hierarchy.tree(df).collect()}
    assert t["C"] == ("A", 2, "A/B/C", 0, "tree") and t["A"] == ("A", 0, "A", 2, "tree")
    assert t["D"] == (None, None, None, 2, "circle") and t["F"][4] == "below circle" and t["G"][0] == "G"


def test_ladder_deeper_than_any_number_of_rounds(spark):
    links = [(f"{a}{i}", f"{b}{i + 1}") for i in range(260) for a in "ab" for b in "ab"]
    got = reach(spark, links)
    assert len(got) == 2 * sum(2 * k for k in range(1, 261)) and got["a0", "b260"] == 260
    nodes = spark.createDataFrame([(f"{a}{i}",) for i in range(261) for a in "ab"] + [("x",), ("y",), ("z",)], "u string")
    df = spark.createDataFrame(links + [("x", "y"), ("y", "y"), ("z", "a250")], "u string, v string")
    d = {r.u: r.depth for r in hierarchy.depths(df, nodes).collect()}
    assert d["a0"] == 260 and d["b260"] == 0 and d["z"] == 11 and "x" not in d and "y" not in d


def test_weights_on_the_way_of_a_core_edge(spark):
    # a chain between two nodes of a circle, and a shorter way beside it
    links = [("a", "c0"), *[(f"c{i}", f"c{i + 1}") for i in range(9)], ("c9", "b"), ("b", "a"), ("a", "d"), ("d", "b"), ("b", "d")]
    assert reach(spark, links) == search(links)


def test_causes_by_normalised_ids(spark):
    rows = [("A", "draft", ["b"]), (" b ", "new", None), ("B", "draft", None), ("c", "new", [" B"])]
    df = spark.createDataFrame([(i, None, d, s) for i, s, d in rows], "item_id string, parent string, depends_on array<string>, status string")
    assert {(r.item_id, r.causes, r.first_cause) for r in hierarchy.causes(df).collect()} == {("A", 1, "B"), ("c", 1, "B")}


def test_nothing(spark):
    assert hierarchy.found(items(spark, [])).count() == 0
    assert hierarchy.tree(items(spark, [])).count() == 0
