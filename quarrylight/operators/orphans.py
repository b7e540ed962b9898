"""References to records that do not exist: keyed pending-orphan state, maintained incrementally.

Parents are a stream of signed events (key, at, delta): +1 when a record comes into being at that time, -1 when it is
removed. A reference (key, at) is an orphan while the deltas of its key up to its time sum to no more than 0. The sum
is what the state keeps for each reference, so every batch is a small update, in whatever order batches arrive:

* new references probe the parent index (all events known so far),
* arriving parents raise the balance of references that wait for them,
* deletions lower it again, which reopens references that had been settled.

The state is cut by key into BUCKETS parts, for the index as for the references. A batch reads and writes only the parts
that hold a key it brings events for; its new references are added as files of their own, and probe only the parts of
the index that hold their keys. Each epoch ends with a snapshot of the counts for each period, of the references that
wait then.

Defined results: a null or blank key is no reference; a reference without a time is an orphan whatever parents there
are, with a null period; repeated references (same table, record, spelling and time) count once; an empty parent
table leaves every reference an orphan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import empty, materialise

REFS = ["src_table", "src_id", "ref_id", "key", "at"]
#: Keys of an index up to which it is broadcast (counted first); a row is a key's history, some hundred bytes.
SMALL_INDEX = 20_000
#: Parts of the state. A batch touches the parts of its keys.
BUCKETS = 16


def bucket() -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")


def index_of(events: DataFrame) -> DataFrame:
    """key, steps: one row for each key, with its events in time order and the running balance after each.

    A row is as long as a record's own history of removals and returns, not as the references to it.
    """
    per = events.where("key is not null and at is not null").groupBy("key", "at").agg(F.sum("delta").alias("delta"))
    steps = F.array_sort(F.collect_list(F.struct("at", "delta")))
    return per.groupBy("key").agg(steps.alias("steps"))


def balance_at(steps: str, at: str) -> F.Column:
    known = F.filter(F.col(steps), lambda s: s["at"] <= F.col(at))
    return F.coalesce(F.aggregate(known, F.lit(0).cast("bigint"), lambda a, s: a + s["delta"]), F.lit(0).cast("bigint"))


def probe(refs: DataFrame, index: DataFrame, small: bool | None = None) -> DataFrame:
    """refs with the column change: what the index's events add to each reference's balance.

    A small index (its keys are counted) is broadcast. Otherwise heavy keys, of which there can be but few, are joined
    by broadcast of their own index rows, so that no task gets the third of all rows that may share a key; the rest is
    shuffled by key.
    """
    change = balance_at("steps", "at").alias("change")
    if small is None:
        small = index.limit(SMALL_INDEX + 1).count() <= SMALL_INDEX
    if small:
        return refs.join(F.broadcast(index), "key", "left").select(*refs.columns, change)
    parts = 256
    counts = refs.groupBy("key").count()
    total = counts.agg(F.sum("count").alias("n")).first()["n"] or 0
    heavy = counts.where(F.col("count") > max(total // parts, 10_000)).select("key")  # fewer than `parts` keys
    heavy_index = F.broadcast(index.join(F.broadcast(heavy), "key", "left_semi"))
    hot = refs.join(F.broadcast(heavy), "key", "left_semi").join(heavy_index, "key", "left").select(*refs.columns, change)
    cold = refs.join(F.broadcast(heavy), "key", "left_anti").join(index.hint("merge"), "key", "left").select(*refs.columns, change)
    return hot.unionByName(cold)


def merged(index: DataFrame, arrived: DataFrame) -> DataFrame:
    """The index with the histories of the arrived keys added: deltas of the same time are one step."""
    steps = index.select("key", F.explode("steps").alias("s")).unionByName(arrived.select("key", F.explode("steps").alias("s")))
    return index_of(steps.select("key", "s.at", "s.delta"))


_INDEX = "key string, steps array<struct<at: timestamp, delta: bigint>>, bucket int"


@dataclass
class OrphanState:
    """index: the parent index by bucket; refs: REFS and balance by bucket (several tables where several batches came).
    """

    index: dict[int, DataFrame] = field(default_factory=dict)
    refs: dict[int, list[DataFrame]] = field(default_factory=dict)

    def advance(self, new_refs: DataFrame, new_events: DataFrame, cut: bool = True) -> OrphanState:
        """The state after one more batch. With cut=False its tables are not written (for a last batch)."""
        spark = new_refs.sparkSession
        # sorted by bucket, so that a filter on it passes over the other row groups
        keep = (lambda df, name: materialise(df.sortWithinPartitions("bucket"), name)) if cut else (lambda df, name: df)
        fresh = new_refs.select(*REFS, bucket())
        arrived = materialise(index_of(new_events).select("*", bucket()).sortWithinPartitions("bucket"), "arrived")
        known = {r["bucket"]: r["n"] for r in arrived.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row for each bucket
        touched = sorted(known)
        mine = lambda df, bs: df.where(F.col("bucket").isin(*bs)) if len(bs) < BUCKETS else df
        # 1. the index: only the parts with keys of the batch are merged and written again
        old_parts = _tables([self.index[b] for b in touched if b in self.index])
        index = dict(self.index)
        if touched:
            whole = arrived
            if old_parts is not None:
                whole = keep(merged(mine(old_parts, touched), arrived).select("*", bucket()), "index")
            index |= dict.fromkeys(touched, whole)
        # 2. new references probe the index
        at_hand = [t.where(F.col("bucket").isin(*[b for b in index if index[b] is t])) for t in _distinct(index.values())]
        all_index = reduce(DataFrame.unionByName, at_hand) if at_hand else empty(spark, _INDEX)
        probed = probe(fresh, all_index.drop("bucket")).select(*REFS, F.col("change").alias("balance"), "bucket")
        # 3. old references of the touched parts are settled or reopened
        refs = {b: list(ts) for b, ts in self.refs.items()}
        waiting = _tables([t for b in touched for t in refs.get(b, ())])
        if waiting is not None:
            moved = probe(mine(waiting, touched), arrived.drop("bucket")).select(*REFS, (F.col("balance") + F.col("change")).alias("balance"), "bucket")
            refs |= dict.fromkeys(touched, [keep(moved, "refs")])
        probed = keep(probed, "new-refs")
        return OrphanState(index, {b: [*refs.get(b, ()), probed] for b in range(BUCKETS)})

    def all_refs(self) -> DataFrame:
        tables = _distinct(t for ts in self.refs.values() for t in ts)
        parts = []
        for t in tables:
            bs = [b for b, ts in self.refs.items() if any(x is t for x in ts)]
            parts.append((t.where(F.col("bucket").isin(*bs)) if len(bs) < BUCKETS else t).select(*REFS, "balance"))
        return reduce(DataFrame.unionByName, parts)

    def orphans(self) -> DataFrame:
        """src_table, src_id, ref_id, period of every reference that waits for its parent, each once."""
        waiting = self.all_refs().where("at is null or balance <= 0")
        return waiting.select("src_table", "src_id", "ref_id", F.date_format("at", "yyyy-MM").alias("period")).distinct()

    def snapshot(self) -> DataFrame:
        """src_table, period, orphans: the counts to keep for each period."""
        return self.orphans().groupBy("src_table", "period").agg(F.count("*").alias("orphans"))


def _distinct(tables) -> list[DataFrame]:
    out: list[DataFrame] = []
    for t in tables:
        if not any(t is x for x in out):
            out.append(t)
    return out


def _tables(tables: list[DataFrame]) -> DataFrame | None:
    found = _distinct(tables)
    return reduce(DataFrame.unionByName, found) if found else None


def item_refs(items: DataFrame) -> DataFrame:
    """The entries of depends_on as references, by normalised id; arrived is when the row was delivered."""
    return items.select(F.col("item_id").alias("src_id"), F.col("filed_at").alias("at"), F.col("loaded_at").alias("arrived"), F.explode("depends_on").alias("ref_id")).where("trim(ref_id) != '' and src_id is not null").select(
        F.lit("work_items").alias("src_table"), "src_id", "ref_id", F.concat(F.lit("item:"), F.lower(F.trim("ref_id"))).alias("key"), "at", "arrived"
    )


def item_events(items: DataFrame) -> DataFrame:
    """An item comes into being at filed_at and goes at dropped_at; a repeated delivery is no second item."""
    one = items.where("item_id is not null").groupBy(F.lower(F.trim("item_id")).alias("k")).agg(F.min("filed_at").alias("a"), F.max("dropped_at").alias("r"), F.min("loaded_at").alias("arrived"))
    key = F.concat(F.lit("item:"), "k").alias("key")
    return one.select(key, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("r").alias("at"), F.lit(-1).alias("delta")))).alias("e"), "arrived").where("e.at is not null").select("key", "e.at", "e.delta", "arrived")


def citation_refs(entries: DataFrame) -> DataFrame:
    """The citations of run entries as references to kb lines on the entry's day."""
    day = F.to_timestamp(F.try_to_date("day", "yyyy-MM-dd")) if hasattr(F, "try_to_date") else F.to_timestamp("day", "yyyy-MM-dd")
    return entries.select(F.col("entry_id").alias("src_id"), day.alias("at"), F.col("loaded_at").alias("arrived"), F.explode("citations.line").alias("ref_id")).where("trim(ref_id) != '' and src_id is not null").select(
        F.lit("run_entries").alias("src_table"), "src_id", "ref_id", F.concat(F.lit("line:"), "ref_id").alias("key"), "at", "arrived"
    )


def line_events(lines: DataFrame) -> DataFrame:
    """A kb line is there from added_on until removed_on; it may come again. It arrives on the day it is added."""
    one = lines.where("path is not null and line_no is not null").select("path", "line_no", "added_on", "removed_on").distinct()
    key = F.concat(F.lit("line:"), "path", F.lit(":"), F.col("line_no").cast("string")).alias("key")
    add = F.struct(F.to_timestamp("added_on").alias("at"), F.lit(1).alias("delta"))
    gone = F.struct(F.to_timestamp("removed_on").alias("at"), F.lit(-1).alias("delta"))
    return one.select(key, F.explode(F.array(add, gone)).alias("e")).where("e.at is not null").select("key", "e.at", "e.delta", F.col("e.at").alias("arrived"))


def bounds(items: DataFrame, epochs: int) -> list:
    """The times at which the epochs but the last end: the time in which items arrived, cut evenly."""
    span = items.agg(F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b")).first()
    if span["a"] is None:
        return []
    return [span["a"] + (span["b"] - span["a"]) * k / epochs for k in range(1, epochs)]


def batches(refs: DataFrame, events: DataFrame, ends: list) -> list[tuple[DataFrame, DataFrame]]:
    """refs and events cut at the times in ends by the column arrived; rows without one come with the first batch."""
    out = []
    for k in range(len(ends) + 1):
        here = F.lit(True)
        if k:
            here &= F.col("arrived") >= F.lit(ends[k - 1])
        if k < len(ends):
            here &= F.col("arrived") < F.lit(ends[k])
        here = F.coalesce(here, F.lit(k == 0))
        out.append((refs.where(here).drop("arrived"), events.where(here).drop("arrived")))
    return out


def orphan_states(items: DataFrame, entries: DataFrame, lines: DataFrame, ends: list) -> list[list[OrphanState]]:
    """The states after each batch, for work items and for run entries.

    Items and kb lines keep apart: items refer to items, of which there are as many as references; entries refer to kb
    lines, a small table.
    """
    out = []
    for refs, events in ((item_refs(items), item_events(items)), (citation_refs(entries), line_events(lines))):
        states = [OrphanState()]
        parts = batches(refs, events, ends)
        for k, (r, e) in enumerate(parts):
            states.append(states[-1].advance(r, e, cut=k < len(parts) - 1))
        out.append(states[1:])
    return out


def found(items: DataFrame, entries: DataFrame, lines: DataFrame, epochs: int = 2) -> DataFrame:
    """p2_found: every dangling reference, with its table and month, after the batches of all epochs."""
    a, b = orphan_states(items, entries, lines, bounds(items, epochs))
    return a[-1].orphans().unionByName(b[-1].orphans())


def snapshots(items: DataFrame, entries: DataFrame, lines: DataFrame, epochs: int = 3) -> DataFrame:
    """p2_counts: epoch, src_table, period, orphans: the counts at the end of each epoch, of what had arrived by then."""
    per = orphan_states(items, entries, lines, bounds(items, epochs))
    return reduce(DataFrame.unionByName, [s.snapshot().select(F.lit(k).cast("bigint").alias("epoch"), "*") for states in per for k, s in enumerate(states)])


def fold_stream(stream: DataFrame, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, sink: str) -> None:
    """Feed a stream's batches to the state; each batch's snapshot goes to a folder of its own below sink.

    split cuts a batch into references (REFS) and events (key, at, delta). The batches run in one driver, which holds
    the state; a batch that comes again overwrites its snapshot.
    """
    from quarrylight.streaming.flows import each_batch

    states: dict[int, OrphanState] = {-1: OrphanState()}

    def one(df: DataFrame, batch: int) -> None:
        refs, events = split(df)
        states[batch] = states[max(k for k in states if k < batch)].advance(refs, events)
        states[batch].snapshot().write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    each_batch(stream, one, checkpoint)
