"""Event and session analytics: windows, interval joins, spans, runs, leases, quantile trims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as X

OPEN_END = "9999-01-01"


def sessions(events: DataFrame, idle: int) -> DataFrame:
    """user_id, session, started, ended, events: a session ends when nothing comes for more than idle seconds."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.date_trunc("second", F.lag("ts").over(w)))
    fresh = F.when(gap.isNull() | (gap > idle), 1).otherwise(0)
    run = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def windows(events: DataFrame, start: str) -> DataFrame:
    """user_id, wid, start_ts, end_ts: from each start event to the user's next one; the last stays open."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = events.where(F.col("event_type") == start)
    return s.select("user_id", F.col("event_id").alias("wid"), F.col("ts").alias("start_ts"), F.coalesce(F.lead("ts").over(w), F.lit(OPEN_END).cast("timestamp_ntz")).alias("end_ts"))


def assign(wins: DataFrame, rows: DataFrame) -> DataFrame:
    """event_id, user_id, wid, start_ts: the window that holds each row, both ends included; of two the later start.

    Windows of a user follow one another, so a row's window is the last that begins no later: one sort by user and
    time over the union of both, instead of a join of all rows with all windows.
    """
    a = wins.select("user_id", F.col("start_ts").alias("ts"), F.lit(0).alias("side"), F.col("wid").alias("id"), F.struct("start_ts", "wid", "end_ts").alias("win"))
    b = rows.select("user_id", "ts", F.lit(1).alias("side"), F.col("event_id").alias("id"), F.lit(None).cast(a.schema["win"].dataType).alias("win"))
    w = W.partitionBy("user_id").orderBy("ts", "side", "id").rowsBetween(W.unboundedPreceding, 0)
    j = a.unionByName(b).withColumn("last", F.last("win", ignorenulls=True).over(w))
    return j.where("side = 1 and last is not null and ts <= last.end_ts").select(F.col("id").alias("event_id"), "user_id", F.col("last.wid").alias("wid"), F.col("last.start_ts").alias("start_ts"))


def leftovers(wins: DataFrame, rows: DataFrame) -> DataFrame:
    """event_id, user_id of the rows no window holds; they wait, they are not dropped."""
    return rows.select("event_id", "user_id").join(assign(wins, rows).select("event_id"), "event_id", "left_anti")


def open_spans(rows: DataFrame, key: str, column: str, opens: list[str], closes: list[str]) -> DataFrame:
    """key, span, opened, closed, events: spans from an opening event (after none or a closing one) to the last close.

    Events before the first opening are in no span; a span that is not closed has no closed time.
    """
    w = W.partitionBy("key").orderBy("seq")
    mark = F.when(F.col(column).isin(*opens), 1).when(F.col(column).isin(*closes), -1)
    e = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "seq", "at_ts", mark.alias("m")).where("m is not null")
    first = F.when((F.col("m") == 1) & (F.coalesce(F.lag("m").over(w), F.lit(-1)) == -1), 1).otherwise(0)
    s = e.withColumn("first", first).withColumn("span", F.sum("first").over(w.rowsBetween(W.unboundedPreceding, 0))).where("span > 0")
    return s.groupBy("key", "span").agg(F.min(F.when(F.col("m") == 1, F.col("at_ts"))).alias("opened"), F.max(F.when(F.col("m") == -1, F.col("at_ts"))).alias("closed"), F.count("*").alias("events"))


def moves(rows: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """before, state, moves: how often each state followed each other one."""
    w = W.partitionBy(key).orderBy(order)
    return rows.select(F.lag(state).over(w).alias("before"), F.col(state).alias("state")).groupBy("before", "state").agg(F.count("*").alias("moves"))


def refused(rows: DataFrame, key: str, state: str, order: str, allowed: DataFrame) -> DataFrame:
    """The rows whose move (before, state) is not among the allowed ones, however many are allowed."""
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("before", F.lag(state).over(w)).where("before is not null").join(allowed.select("before", state).distinct(), ["before", state], "left_anti")


def held_seconds(rows: DataFrame, key: str, state: str, ts: str, order: str, which: str) -> DataFrame:
    """key, seconds, times: how long each key stood in a state, until its next event."""
    w = W.partitionBy(key).orderBy(order)
    sec = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    r = rows.withColumn("until", F.lead(ts).over(w)).where((F.col(state) == which) & F.col("until").isNotNull())
    return r.groupBy(F.col(key).alias("key")).agg(F.sum(sec("until") - sec(ts)).alias("seconds"), F.count("*").alias("times"))


def leases(rows: DataFrame, ttl: int) -> DataFrame:
    """key, holder, since, lapses: who holds each key after its last event; a lease ends by release or after ttl seconds."""
    last = rows.where(F.lower("kind").isin("claim", "release")).groupBy("key").agg(F.max_by(F.struct("kind", "holder", "at_ts"), "seq").alias("e"))
    now = rows.agg(F.max("at_ts").alias("now"))  # one row
    held = last.where("e.kind = 'claim'").crossJoin(F.broadcast(now))
    lapses = F.expr(f"e.at_ts + interval {ttl} seconds")
    return held.where(lapses > F.col("now")).select("key", "e.holder", F.col("e.at_ts").alias("since"), lapses.alias("lapses"))


def runs(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, run, value, length: stretches of equal values in order."""
    w = W.partitionBy(key).orderBy(*order)
    fresh = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    r = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def growth(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, growth, steps: what the next value is more by, where it does not shrink."""
    w = W.partitionBy(key).orderBy(*order)
    r = rows.select(key, (F.lead(value).over(w) - F.col(value)).alias("more"))
    return r.groupBy(key).agg(F.round(F.sum(F.when(F.col("more") >= 0, F.col("more")).otherwise(0.0)), 6).alias("growth"), F.count_if(F.col("more") >= 0).alias("steps"))


def trimmed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows without values over p75 + 3 (p75 - p25) of their key, where it has at least 4."""
    q = rows.groupBy(key).agg(F.expr(f"percentile({value}, array(0.25, 0.75))").alias("q"), F.count("*").alias("n"))
    limit = F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0])
    return rows.join(q, key).where((F.col("n") < 4) | (F.col(value) <= limit)).drop("q", "n")


def repeats(rows: DataFrame, who: str, what: str, least: int) -> DataFrame:
    """who, what, times: what was done at least so often in the last closed ISO week."""
    weeks = rows.withColumn("week", X.iso_week(F.col("ts")))
    last = weeks.agg(F.max("week").alias("last"))
    closed = weeks.crossJoin(F.broadcast(last)).where("week < last").agg(F.max("week").alias("week"))
    return weeks.join(F.broadcast(closed), "week", "left_semi").groupBy(who, what).agg(F.count("*").alias("times")).where(F.col("times") >= least)


def even_share(entries: DataFrame, parts: str, amount: str) -> DataFrame:
    """part, share, entries: each entry's amount shared evenly by the distinct parts it names; each entry counts once."""
    one = entries.groupBy("entry_id").agg(F.first(parts, ignorenulls=True).alias("p"), F.max(amount).alias("a"))
    names = F.array_distinct("p")
    e = one.select(F.explode(names).alias("part"), (F.col("a") / F.size(names)).alias("share")).where("part is not null")
    return e.groupBy("part").agg(F.round(F.sum("share"), 6).alias("share"), F.count("*").alias("entries"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """left with the values of the latest row of right at or before its time; a union and a window, no range join."""
    cols = [c for c in left.columns if c not in (*keys, ts)]
    a = left.select(*keys, ts, F.lit(1).alias("_side"), F.struct(*cols).alias("_row"))
    b = right.select(*keys, ts, F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    w = W.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    j = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return j.where("_side = 1").select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols], ts, *[F.col(f"_last.{v}").alias(v) for v in values])
