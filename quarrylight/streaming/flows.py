"""Streams: de-duplication, tumbling, sliding and session windows, leases, and orphan state fed batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.session import shared_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    one = path.endswith(".parquet") and not _is_dir(spark, path)
    r = spark.readStream.schema(schema)
    return r.option("pathGlobFilter", name).parquet(folder) if one else r.parquet(path)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and give what it has written."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/quarrylight/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(schema).parquet(f"{base}/out")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/{batch:08d}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress), default=0)
    return spark.read.schema(schema).parquet(f"{base}/out/{last:08d}")


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "30 days") -> DataFrame:
    """Each key once; its state is dropped when the watermark has passed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str, by: list[str], size: str = "1 day", late: str = "1 day") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("events"))
    return w.select(F.col("window.start").alias("start"), *by, "events")


def sliding(stream: DataFrame, ts: str, by: list[str], size: str = "1 day", slide: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *by).agg(F.count("*").alias("events"))
    return w.select(F.col("window.start").alias("start"), *by, "events")


def sessions(stream: DataFrame, ts: str, by: str, idle: str = "24 hours", late: str = "1 day") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.session_window(ts, idle), by).agg(F.count("*").alias("events"))
    return w.select(F.col("session_window.start").alias("start"), by, "events")


def lease_states(stream: DataFrame) -> DataFrame:
    """key, holder, revision: the state of each key's lease after its events (columns key, kind, holder, seq)."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, revision = state.get if state.exists else (None, 0)
        for e in pd.concat(list(parts)).sort_values("seq").itertuples():
            if e.kind == "claim" and holder in (None, e.holder):
                holder = e.holder
            elif e.kind == "release" and e.holder == holder:
                holder = None
            revision += 1
        state.update((holder, revision))
        yield pd.DataFrame({"key": [key[0]], "holder": [holder], "revision": [revision]})

    out = "key string, holder string, revision bigint"
    return stream.groupBy("key").applyInPandasWithState(fold, out, "holder string, revision bigint", "update", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed every micro-batch of a stream to f, exactly once as far as f is idempotent by batch number."""
    stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
