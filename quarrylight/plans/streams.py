"""Streaming queries over the events table, run to its end, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.session import ship
from quarrylight.streaming import flows as S


def _events(s, d):
    ship(s)
    e = S.source(s, f"{d}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def queries() -> dict:
    return {
        "stream_dedupe": lambda s, d: S.run(S.deduplicated(_events(s, d), "event_id", "ts").select("event_id", "user_id", "event_type")),
        "stream_tumbling": lambda s, d: S.run(S.tumbling(_events(s, d), "ts", ["event_type"]), "complete").withColumn("start", F.col("start").cast("timestamp_ntz")),
        "stream_sliding": lambda s, d: S.run(S.sliding(_events(s, d), "ts", ["event_type"]), "complete").withColumn("start", F.col("start").cast("timestamp_ntz")),
        "stream_sessions": lambda s, d: S.run(S.sessions(_events(s, d), "ts", "user_id"), "complete").select("user_id", "events"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "stream_dedupe": "select event_id, user_id, event_type from events",
        "stream_tumbling": "select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as events from events group by 1, 2",
        "stream_sliding": "select start, event_type, count(*) as events from (select event_type, unnest([date_trunc('day', ts) + (cast(floor(hour(ts) / 6) as int) - k) * interval 6 hours for k in [0, 1, 2, 3]]) as start from events) group by 1, 2",
        "stream_sessions": "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 24 hours then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from g) select user_id, count(*) as events from s group by user_id, n",
    }
