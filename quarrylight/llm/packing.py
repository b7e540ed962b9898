"""Filling fixed-capacity containers with texts: hierarchical multi-length packing.

Sizes are whole numbers of tokens no larger than the capacity, so all that a packing needs to know of the corpus is
how many items of each size there are: at most capacity + 1 numbers for each container size, whatever the corpus.

1. Texts longer than the capacity are split into full pieces and a rest; no other text is split.
2. Sizes are routed to tiers (more than half the capacity, more than a quarter, ...). Tier by tier, windows are headed
   by the tier's largest size left, filled from the same tier, and their gaps from the shorter tiers, largest first.
   A window's pattern is repeated as often as the counts allow, so there are about as many patterns as sizes.
3. Containers are dealt to step groups by falling cost (sum of squared lengths) in a snake, so that the groups of
   containers that are used in one step cost about the same.
4. Every item is numbered among those of its size and finds its container by a search in the patterns' ranges. The
   numbering is salted: items of one size are numbered in parts whose counts are added up before. There are so many
   parts that the most frequent size (as a rule the full pieces of long texts) has about PART items in each.

Defined results: empty and null texts have 0 tokens, take no space and are dealt over the containers; repeated texts
are items of their own; a text of exactly the capacity fills a container; limits that are null or below 1 are left
out; with no items there are no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.llm.tokens import TOKENIZERS, lengths
from quarrylight.session import materialise

#: Tiers of sizes: above 1/2, 1/4, 1/8 of the capacity, and the rest.
TIERS = 4
#: Parts in which the items of one size are numbered, at least, and items of one part, about.
BUCKETS, PART = 64, 50_000
#: Routes that are packed by one plan; more are packed in blocks.
ROUTES = 500
#: Containers of one step group.
GROUP = 8


def tier(size: int, capacity: int, tiers: int = TIERS) -> int:
    t = 0
    while t < tiers - 1 and size * 2 ** (t + 1) <= capacity:
        t += 1
    return t


def patterns(counts: dict[int, int], capacity: int, tiers: int = TIERS) -> list[tuple[list[tuple[int, int]], int]]:
    """The packing of counts {size: items}: ([(size, uses)], repetitions) with sizes in falling order."""
    left = {s: n for s, n in counts.items() if s > 0 and n > 0}
    sizes = [sorted(s for s in left if tier(s, capacity, tiers) == t) for t in range(tiers)]
    out = []
    for t in range(tiers):
        while sizes[t]:
            room = capacity
            uses: list[tuple[int, int]] = []
            for own in range(t, tiers):  # its own tier first, then the gap from shorter tiers
                pool = sizes[own]
                at = bisect_right(pool, room)
                while at:
                    s = pool[at - 1]
                    n = min(room // s, left[s])
                    uses.append((s, n))
                    room -= n * s
                    at = min(at - 1, bisect_right(pool, room))
            times = min(left[s] // n for s, n in uses)
            out.append((uses, times))
            for s, n in uses:
                left[s] -= n * times
                if not left[s]:
                    pool = sizes[tier(s, capacity, tiers)]
                    pool.pop(bisect_right(pool, s) - 1)
    return out


class Layout:
    """Where the item of a size with a given number goes: arrays to be searched, bounded by the number of sizes."""

    def __init__(self, found: list[tuple[list[tuple[int, int]], int]], group: int = GROUP):
        rows, cost_of, base = [], [], 0
        taken: dict[int, int] = {}
        for uses, times in found:
            at = 0
            for s, n in uses:
                lo = taken.get(s, 0)
                rows.append((s, lo, base, n, at, len(cost_of)))
                taken[s] = lo + n * times
                at += s * n
            cost_of.append((sum(s * s * n for s, n in uses), base, times))
            base += times
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 6)
        self.key, self.lo, self.base, self.per, self.at, self.of = a[:, 0] << 40 | a[:, 1], a[:, 1], a[:, 2], a[:, 3], a[:, 4], a[:, 5]
        self.containers = base
        self.groups = -(-base // group)
        # the first place of each pattern's containers in the order of falling cost
        self.place = np.zeros(len(cost_of), np.int64)
        n = 0
        for k in sorted(range(len(cost_of)), key=lambda k: (-cost_of[k][0], k)):
            self.place[k] = n
            n += cost_of[k][2]

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """container, offset in it and step group of items; items of size 0 are dealt over all containers."""
        if not len(self.key):
            z = np.zeros(len(size), np.int64)
            return z, z, z
        k = np.searchsorted(self.key, size << 40 | rank, "right") - 1
        k = np.maximum(k, 0)
        nth = rank - self.lo[k]
        container = self.base[k] + nth // self.per[k]
        at = self.at[k] + nth % self.per[k] * size
        void = size == 0
        spread = rank % max(1, self.containers)
        if void.any():
            bases = np.unique(self.base)
            container = np.where(void, spread, container)
            at = np.where(void, 0, at)
            first = np.zeros(len(bases), np.int64)
            first[np.searchsorted(bases, self.base)] = self.of
            of = np.where(void, first[np.searchsorted(bases, container, "right") - 1], self.of[k])
            start = np.where(void, bases[np.searchsorted(bases, container, "right") - 1], self.base[k])
        else:
            of, start = self.of[k], self.base[k]
        place = self.place[of] + (container - start)
        turn, r = np.divmod(place, max(1, self.groups))
        return container, at, np.where(turn % 2 == 0, r, self.groups - 1 - r)


def pieces(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """route, capacity, doc_id, piece, tok_from, tokens: the items to pack for every route.

    limits has one row for each route; they become part of the plan (see ROUTES).
    """
    caps = limits.where("capacity >= 1 and route is not null").groupBy("route").agg(F.max("capacity").alias("capacity"))
    routes = [F.struct(F.lit(r["route"]).alias("route"), F.lit(r["capacity"]).cast("int").alias("capacity")) for r in caps.orderBy("route").collect()]
    j = sized.select("doc_id", "tokens", F.explode(F.array(*routes)).alias("r")).select("doc_id", "tokens", "r.*")
    n = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int")
    p = j.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    start = (F.col("piece").cast("bigint") * F.col("capacity")).alias("tok_from")
    return p.select("route", "capacity", "doc_id", "piece", start, F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("tokens"))


def numbered(items: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """items with rank: their number among those of the same route and size, from 0."""
    b = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    keys = ["route", "tokens", "bucket"]
    before = W.partitionBy("route", "tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = b.groupBy(*keys).count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(W.partitionBy(*keys).orderBy("doc_id", "piece")) - 1
    return b.withColumn("own", own).join(base, keys).withColumn("rank", F.col("base") + F.col("own")).drop("bucket", "own", "base")


def _blocks(limits: DataFrame) -> list[DataFrame]:
    """limits cut into parts of at most ROUTES routes."""
    routes = limits.where("capacity >= 1 and route is not null").select("route").distinct()
    n = -(-routes.count() // ROUTES)
    return [limits] if n < 2 else [limits.where(F.pmod(F.xxhash64("route"), F.lit(n)) == k) for k in range(n)]


def pack(sized: DataFrame, limits: DataFrame, tiers: int = TIERS, group: int = GROUP) -> DataFrame:
    """route, capacity, doc_id, piece, tok_from, tokens, container, offset, tier, step_group: a row for each item.

    sized has doc_id and tokens, one row for each text.
    """
    if limits.where("capacity >= 1 and route is not null").limit(1).count() == 0:
        return sized.sparkSession.createDataFrame([], "route string, capacity int, doc_id bigint, piece int, tok_from bigint, tokens int, container bigint, offset int, tier int, step_group bigint")
    blocks = _blocks(limits)
    if len(blocks) > 1:
        return reduce(DataFrame.unionByName, [pack(sized, b, tiers, group) for b in blocks])
    items = pieces(sized, limits)
    # at most capacity + 1 rows for each route
    counts: dict[str, dict[int, int]] = {}
    caps: dict[str, int] = {}
    for r in items.groupBy("route", "capacity", "tokens").count().collect():
        counts.setdefault(r["route"], {})[r["tokens"]] = r["count"]
        caps[r["route"]] = r["capacity"]
    layouts = {r: Layout(patterns(c, caps[r], tiers), group) for r, c in counts.items()}
    shared = sized.sparkSession.sparkContext.broadcast(layouts)
    names = ["route", "capacity", "doc_id", "piece", "tok_from", "tokens", "container", "offset", "tier", "step_group"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            route = b.column(0).to_numpy(zero_copy_only=False)
            cap, size, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 5, 6))
            container, at, step = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for r, lay in shared.value.items():
                m = route == r
                if m.any():
                    container[m], at[m], step[m] = lay.find(size[m], rank[m])
            t = np.zeros(b.num_rows, np.int32)
            for k in range(1, tiers):
                t += (size * 2**k <= cap).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(container), pa.array(at.astype(np.int32)), pa.array(t), pa.array(step)], names=names)

    kind = dict(sized.dtypes)["doc_id"]
    most = max((n for c in counts.values() for n in c.values()), default=0)
    return numbered(items, max(BUCKETS, -(-most // PART))).select(*names[:6], "rank").mapInArrow(place, f"route string, capacity int, doc_id {kind}, piece int, tok_from bigint, tokens int, container bigint, offset int, tier int, step_group bigint")


def pack_documents(docs: DataFrame, limits: DataFrame, tokenizer: str = "byte_bpe_50k", where: str = TOKENIZERS) -> DataFrame:
    """The texts of docs, sized by a public tokenizer, in the containers of every route."""
    return pack(materialise(lengths(docs, tokenizer=tokenizer, where=where), "lengths"), limits)


def report(packed: DataFrame) -> DataFrame:
    """route, capacity, items, tokens, containers, least_containers, filled, step_groups, step_cost_spread."""
    c = packed.groupBy("route", "capacity", "container", "step_group").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens").cast("bigint") * F.col("tokens")).alias("cost"))
    g = c.groupBy("route", "capacity", "step_group").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count("*").alias("n"))
    return g.groupBy("route", "capacity").agg(
        F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum("n").alias("containers"),
        F.ceil(F.sum("tokens") / F.first("capacity")).alias("least_containers"),
        F.round(F.sum("tokens") / (F.sum("n") * F.first("capacity")), 6).alias("filled"),
        F.count("*").alias("step_groups"), F.round(F.stddev_pop("cost") / F.avg("cost"), 6).alias("step_cost_spread"),
    )
