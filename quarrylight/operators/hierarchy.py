"""Parent-child links of unknown depth: tree contraction, then expansion in reverse.

Contraction works on edges (link, u, v, via): u reaches v, past the nodes in via. Every round, in one pass,

* rakes leaves: nodes nothing points to leave, with their edges as the record of how to restore them;
* compresses unary chains: a node with one way in and one way out, whose hash is less than its neighbours', is spliced
  out of its chain: the edge into it goes on to its end, its own edge is its record. A third of a chain goes each time.

Leaves and chains are a constant share of every forest, so forests are gone after a number of rounds that grows with the
logarithm of their nodes. Rounds end when nothing is left to rake or splice, when no more than REST of the edges is left,
or when two rounds on end took less than SHRINK of them: what remains then, the core, holds circles, what lies below
them, and graphs that are no forests (nodes with several ways out and in). The core's closure is found by doubling exact
walks, in as many rounds as the logarithm of its longest shortest path. The records are then undone from the last to the first: a node reaches the
nodes on its recorded edges, and all that their ends reach. As each round's records are a constant share of the rest,
what the undoing reads adds up to a constant times the result.

Defined results: links to unknown ids, null and blank ids are left out; repeated links count once; a node on a circle
reaches itself; several links out of a node are allowed (``depends_on``); dist is the least number of steps. There is
no limit on depth, rounds or sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.session import materialise, release

_EDGE = ["link", "u", "v", "via"]


def links_of(items: DataFrame) -> DataFrame:
    """link, u, v of the items' parent and depends_on, both ends spelled as in item_id, each link once."""
    norm = lambda c: F.lower(F.trim(c))
    ids = items.where("trim(item_id) != ''").groupBy(norm("item_id").alias("k")).agg(F.max("item_id").alias("v"))
    up = items.select(F.lit("parent").alias("link"), norm("item_id").alias("a"), norm("parent").alias("b"))
    dep = items.select(F.lit("depends_on").alias("link"), norm("item_id").alias("a"), F.explode("depends_on").alias("b")).withColumn("b", norm("b"))
    raw = up.unionByName(dep).where("a != '' and b != ''").distinct()
    return raw.join(ids.select(F.col("k").alias("b"), "v"), "b").join(ids.select(F.col("k").alias("a"), F.col("v").alias("u")), "a").select("link", "u", "v")


#: Least share of the edges that a round of contraction is to take; two rounds below it end the contraction.
SHRINK = 0.08
#: Share of all edges at which the rest is left to the core's closure, whatever it is.
REST = 1 / 16


def _nodes(edges: DataFrame, k: int) -> DataFrame:
    """link, n, leaf, cut, nxt, pre, via_out of the nodes that leave in round k. Constant state for each node, however hot."""
    out = edges.select("link", F.col("u").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("string").alias("pre"), F.col("v").alias("nxt"), F.col("via").alias("via_out"))
    into = edges.select("link", F.col("v").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("u").alias("pre"), F.lit(None).cast("string").alias("nxt"), F.lit(None).cast("array<string>").alias("via_out"))
    deg = out.unionByName(into).groupBy("link", "n").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.max("pre").alias("pre"), F.max("nxt").alias("nxt"), F.max("via_out").alias("via_out"))
    h = lambda c: F.xxhash64(F.col(c), F.lit(k))
    unary = (F.col("i") == 1) & (F.col("o") == 1) & (F.col("pre") != F.col("n")) & (F.col("nxt") != F.col("n"))
    cut = unary & (h("n") < h("pre")) & (h("n") < h("nxt"))
    return deg.select("link", "n", (F.col("i") == 0).alias("leaf"), unary.alias("unary"), F.coalesce(cut, F.lit(False)).alias("cut"), "pre", "nxt", "via_out")


def contract(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The records of each round (link, u, v, via), and the core's edges. One job a round."""
    records = []
    now = materialise(edges.withColumn("via", F.array().cast("array<string>")).select(*_EDGE), "contract")
    slow = k = 0
    least = None
    while True:
        n = _nodes(now, k)
        gone = n.where("leaf or cut").select("link", F.col("n").alias("u"), F.lit(True).alias("gone"))
        # the one edge into a node that is cut is known by both its ends, so no hot end is a join key
        cut = n.where("cut").select("link", F.col("pre").alias("u"), F.col("n").alias("v"), "nxt", "via_out")
        j = now.join(gone, ["link", "u"], "left").join(cut, ["link", "u", "v"], "left")
        via = F.when(F.col("nxt").isNotNull(), F.concat("via", F.array("v"), "via_out")).otherwise(F.col("via"))
        rows = j.select("link", "u", F.coalesce("nxt", "v").alias("v"), via.alias("via"), F.coalesce("gone", F.lit(False)).alias("rec"))
        seen = Observation()
        cut_of = rows.observe(seen, F.count("*").alias("all"), F.count_if("rec").alias("rec"))
        both = materialise(cut_of, f"contract{k}", by="rec")
        total, raked = seen.get["all"], seen.get["rec"]
        if raked:
            records.append(both.where("rec").select(*_EDGE))
        elif total and n.where("unary").limit(1).count():
            raked = -1  # no luck with the hashes of this round
        if not total or not raked:
            return records, both.where("not rec").select(*_EDGE)
        least = total * REST if least is None else least
        slow = slow + 1 if 0 <= raked < SHRINK * total else 0
        now = both.where("not rec").select(*_EDGE)
        if slow == 2 or total - raked <= least:
            return records, now
        k += 1


def _steps(edges: DataFrame) -> DataFrame:
    """link, u, y, dist: what an edge itself reaches, its via nodes and its end."""
    return edges.select("link", "u", F.posexplode(F.concat("via", F.array("v"))).alias("p", "y")).select("link", "u", "y", (F.col("p") + 1).alias("dist"))


def _least(df: DataFrame) -> DataFrame:
    return df.groupBy("link", "u", "y").agg(F.min("dist").alias("dist"))


def closure(links: DataFrame) -> DataFrame:
    """link, u, y, dist over weighted edges (link, u, v, dist): all that is reached, at the least weight.

    Doubling of exact walks: ``walks`` has the least weight of the walks of exactly 2^k edges, ``known`` that of the walks
    of fewer than 2^k. A longer walk begins with one of exactly 2^k, so each round joins the walks with what is known and
    with themselves; when a round changes nothing in what is known, all is known.
    """
    on = (F.col("a.link") == F.col("b.link")) & (F.col("a.y") == F.col("b.u"))
    go_on = lambda a, b: a.alias("a").join(b.alias("b"), on).select("a.link", "a.u", "b.y", (F.col("a.dist") + F.col("b.dist")).alias("dist"))
    walks = known = _least(links.select("link", "u", F.col("v").alias("y"), "dist"))
    table, before = None, None
    while True:
        # both are written by one job
        longer = known if table is None else known.unionByName(walks).unionByName(go_on(walks, known))
        ahead = walks if table is None else go_on(walks, walks)
        both = longer.withColumn("walk", F.lit(False)).unionByName(ahead.withColumn("walk", F.lit(True)))
        seen = Observation()
        least = both.groupBy("link", "u", "y", "walk").agg(F.min("dist").alias("dist")).observe(seen, F.count_if(~F.col("walk")).alias("n"), F.sum(F.when(~F.col("walk"), F.col("dist"))).alias("sum"), F.count_if("walk").alias("ahead"))
        now = materialise(least.select("link", "u", "y", "dist", "walk"), "closure", by="walk")
        if table is not None:
            release(table)
        table = now
        walks, known = now.where("walk").drop("walk"), now.where("not walk").drop("walk")
        state = (seen.get["n"], seen.get["sum"])
        if state == before or not seen.get["ahead"]:
            return known
        before = state


def core_reach(core: DataFrame) -> DataFrame:
    """link, u, y, dist for the nodes of the core: the closure between the ends of its edges, then the nodes on the way."""
    pairs = closure(core.select("link", "u", "v", (F.size("via") + 1).alias("dist")))
    # the nodes spliced into a core edge are reached by whoever reaches the edge's start
    inner = core.where(F.size("via") > 0).select("link", F.col("u").alias("s"), F.posexplode("via").alias("p", "y"))
    own = inner.select("link", F.col("s").alias("u"), "y", (F.col("p") + 1).alias("dist"))
    far = pairs.select("link", "u", F.col("y").alias("s"), F.col("dist").alias("d")).join(inner, ["link", "s"]).select("link", "u", "y", (F.col("d") + F.col("p") + 1).alias("dist"))
    return _least(pairs.unionByName(own).unionByName(far))


def reach(links: DataFrame, keep: bool = True) -> DataFrame:
    """link, u, y, dist: every node reached from u in one or more steps, with the least number of steps.

    With keep=False the last, largest part is not written: for a result that is read once.
    """
    records, core = contract(links.where("u is not null and v is not null").distinct())
    parts = [materialise(core_reach(core), "reach-core")]
    for k, rec in reversed(list(enumerate(records))):
        known = reduce(DataFrame.unionByName, parts).select("link", F.col("u").alias("v"), F.col("y"), F.col("dist").alias("d"))
        ends = rec.select("link", "u", "v", (F.size("via") + 1).alias("n"))
        beyond = ends.join(known, ["link", "v"]).select("link", "u", "y", (F.col("n") + F.col("d")).alias("dist"))
        part = _least(_steps(rec).unionByName(beyond))
        parts.append(materialise(part, f"reach{k}") if keep or k else part)
    return reduce(DataFrame.unionByName, parts)


def found(items: DataFrame) -> DataFrame:
    """p3_found: link, item_id, reached_id."""
    return reach(links_of(items), keep=False).select("link", F.col("u").alias("item_id"), F.col("y").alias("reached_id"))


def tree(items: DataFrame) -> DataFrame:
    """item_id, root_id, depth, path, descendants, state of every item by its parent links.

    path goes from the root to the item, joined by '/'. state is 'tree', 'circle' (the item is on a circle) or
    'below circle'; root, depth and path are null where there is no root.
    """
    r = reach(links_of(items).where("link = 'parent'"))
    norm = F.lower(F.trim("item_id"))
    nodes = items.where("trim(item_id) != ''").groupBy(norm.alias("k")).agg(F.max("item_id").alias("u")).select("u")
    on = r.where("u = y").select("u").distinct().withColumn("on_circle", F.lit(True))
    ups = r.join(on.withColumnRenamed("u", "y").withColumnRenamed("on_circle", "to_circle"), "y", "left").groupBy("u").agg(
        F.max("to_circle").alias("to_circle"), F.sort_array(F.collect_list(F.struct("dist", "y")), asc=False).alias("up"), F.max("dist").alias("depth")
    )
    down = r.where("u != y").groupBy(F.col("y").alias("u")).agg(F.count("*").alias("descendants"))
    j = nodes.join(ups, "u", "left").join(on, "u", "left").join(down, "u", "left")
    tied = F.col("to_circle").isNotNull()
    path = F.concat_ws("/", F.transform(F.coalesce("up", F.array().cast("array<struct<dist:int,y:string>>")), lambda s: s["y"]), F.col("u"))
    return j.select(
        F.col("u").alias("item_id"),
        F.when(tied, None).otherwise(F.coalesce(F.col("up")[0]["y"], F.col("u"))).alias("root_id"),
        F.when(tied, None).otherwise(F.coalesce("depth", F.lit(0))).cast(T.IntegerType()).alias("depth"),
        F.when(tied, None).otherwise(path).alias("path"),
        F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants"),
        F.when(F.col("on_circle"), "circle").when(tied, "below circle").otherwise("tree").alias("state"),
    )


def depths(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, depth of every node that reaches no circle: the length of its longest way down. nodes has the column u.

    A node has walks of every length up to its depth. The ends of all walks of 1, 2, 4, ... edges are found by doubling;
    each node's depth is then read bit by bit from the longest on. So the rounds grow with the logarithm of the depth.
    """
    r = reach(links.select(F.lit("").alias("link"), "u", "v"))
    circle = r.where("u = y").select("u").distinct()
    tied = materialise(circle.unionByName(r.join(circle.select(F.col("u").alias("y")), "y", "left_semi").select("u")).distinct(), "tied")
    free = links.select("u", "v").distinct().join(tied, "u", "left_anti")
    powers = [materialise(free, "walks")]
    while True:
        w = powers[-1]
        seen = Observation()
        nxt = w.join(w.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v")).distinct().observe(seen, F.count("*").alias("n"))
        nxt = materialise(nxt, "walks")
        if not seen.get["n"]:
            break
        powers.append(nxt)
    # where the walks of the length read so far end; a node without a longer one keeps what it has
    at = nodes.select("u").distinct().join(tied, "u", "left_anti").select("u", F.col("u").alias("v"), F.lit(0).alias("depth"))
    for k in reversed(range(len(powers))):
        on = at.join(powers[k].select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v"), (F.col("depth") + (1 << k)).alias("depth")).distinct()
        on = materialise(on, "depth")
        at = materialise(on.unionByName(at.join(on.select("u").distinct(), "u", "left_anti")), "depth")
    return at.groupBy("u").agg(F.max("depth").alias("depth"))


def levels(items: DataFrame, link: str = "depends_on") -> DataFrame:
    """depth, items: how many items stand at each depth of their dependencies; items that reach a circle have none."""
    nodes = items.where("trim(item_id) != ''").groupBy(F.lower(F.trim("item_id")).alias("k")).agg(F.max("item_id").alias("u"))
    return depths(links_of(items).where(F.col("link") == link), nodes).groupBy("depth").agg(F.count("*").alias("items"))


def causes(items: DataFrame, states: tuple[str, ...] = ("draft", "dropped")) -> DataFrame:
    """item_id, causes, first_cause: the items in one of the states that each item depends on, near or far."""
    r = reach(links_of(items).where("link = 'depends_on'"), keep=False)
    norm = F.lower(F.trim("item_id"))
    spelled = items.where("trim(item_id) != ''").groupBy(norm.alias("k")).agg(F.max("item_id").alias("y"), F.max(F.col("status").isin(*states)).alias("hit"))
    c = spelled.where("hit").select("y")
    return r.join(c, "y").select("u", "y").distinct().groupBy(F.col("u").alias("item_id")).agg(F.count("*").alias("causes"), F.min("y").alias("first_cause"))
