"""Document change analysis: section hashes, section deltas, passage location, exact copies, bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as X


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, heading, line: the lines of texts that hold something, with the heading they stand under."""
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(r"^#{1,6} "), F.trim(F.regexp_replace("line", r"^#+ ", "")))
    return lines.withColumn("heading", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(""))).where("trim(line) != ''")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, heading, lines, hash: a fingerprint of each section's lines in order; headings themselves don't count."""
    body = lines_of(docs).where(~F.col("line").rlike(r"^#{1,6} "))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("line")))), lambda x: x["line"]), "\n")
    return body.groupBy("doc_id", "heading").agg(F.count("*").alias("lines"), F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


def section_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, heading, state: same, changed, added or removed, for the sections of two versions of texts."""
    a, b = sections(old).withColumnRenamed("hash", "a").drop("lines"), sections(new).withColumnRenamed("hash", "b").drop("lines")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, ["doc_id", "heading"], "full_outer").select("doc_id", "heading", state.alias("state"))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, size: the class of exact copies each text is in, named by its least id. Null texts are left out.

    Only hashes are shuffled; a class may be as large as it is, for its least id and size are aggregates.
    """
    h = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size")), "h").select("doc_id", "class_id", "size")


def located(docs: DataFrame, facts: DataFrame, widest: int = 3) -> DataFrame:
    """doc_id, start, lines, cover: where each document's fact (doc_id, fact) stands best in its text.

    A window is up to ``widest`` lines. A term weighs ln((N + 1) / (df + .5)) by the lines of its document; a window
    covers the share of the fact's weight it holds, less .05 for each line after the first; terms the text does not
    have add .5 to what is to be covered. Of equals the first and shortest window wins; under .4 none.
    """
    lines = lines_of(docs).withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")))
    size = lines.groupBy("doc_id").agg(F.count("*").alias("total"))
    word = lambda c: F.explode(F.array_distinct(F.filter(X.words(F.col(c)), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$")))).alias("w")
    asked = facts.select("doc_id", word("fact"))
    held = lines.select("doc_id", "n", word("line")).join(asked, ["doc_id", "w"])
    df = held.groupBy("doc_id", "w").agg(F.count("*").alias("df")).join(size, "doc_id").withColumn("weight", F.log((F.col("total") + 1) / (F.col("df") + 0.5)))
    known = df.groupBy("doc_id").agg(F.sum("weight").alias("sum"), F.count("*").alias("hit"))
    need = asked.groupBy("doc_id").agg(F.count("*").alias("asked")).join(known, "doc_id").withColumn("need", F.col("sum") + 0.5 * (F.col("asked") - F.col("hit")))
    spans = F.explode(F.array(*[F.struct((F.col("n") - back).alias("start"), F.lit(k).alias("lines")) for k in range(1, widest + 1) for back in range(k)])).alias("s")
    in_window = held.select("doc_id", "w", spans).select("doc_id", "w", "s.*").join(size, "doc_id").where("start >= 1 and start + lines - 1 <= total").select("doc_id", "start", "lines", "w").distinct()
    got = in_window.join(df.select("doc_id", "w", "weight"), ["doc_id", "w"]).groupBy("doc_id", "start", "lines").agg(F.sum("weight").alias("got"))
    cover = F.round(F.col("got") / F.col("need") - 0.05 * (F.col("lines") - 1), 6)
    best = got.join(need, "doc_id").withColumn("cover", cover).withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("cover"), "start", "lines")))
    return best.where("r = 1 and cover >= 0.4").select("doc_id", "start", "lines", "cover")


def bootstrap(rows: DataFrame, group: str, key: str, value: str, resamples: int = 1000, seed: int = 11) -> DataFrame:
    """group, n, mean, low, high: the mean of each group with a 95 % interval.

    The unit is the key: its repeated rows stay together. Every key is drawn a Poisson number of times in each resample,
    from a hash of key, resample and seed, so a draw needs no shuffle of its own and is the same on every run. Each task
    adds up two numbers for each group and resample; rows are not multiplied. The bounds are the means at the places
    int(.025 m) and min(m - 1, int(.975 m)) of the m sorted ones.
    """
    one = rows.groupBy(group, key).agg(F.sum(value).cast("double").alias("s"), F.count(value).cast("double").alias("c"))
    edges, p, total = [], math.exp(-1), 0.0
    for n in range(12):
        total += p
        edges.append(total)
        p /= n + 1
    kind = dict(rows.dtypes)[group]
    hashed = one.select(group, "s", "c", F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("h"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, bottom = {}, {}
        reps = np.arange(resamples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            gs = b.column(0).to_pylist()
            s, c, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            h = np.ascontiguousarray(h, np.int64).view(np.uint64)
            for at, g in enumerate(gs):
                # a mix of the key's hash and the resample's number, made uniform
                x = h[at] + reps
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                times = np.searchsorted(edges, u, "right")
                if g not in top:
                    top[g], bottom[g] = np.zeros(resamples), np.zeros(resamples)
                top[g] += times * (s[at] if s[at] == s[at] else 0.0)
                bottom[g] += times * c[at]
        out = [(g, r, float(top[g][r]), float(bottom[g][r])) for g in top for r in range(resamples)]
        a = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(a[0], b_type), pa.array(a[1], pa.int32()), pa.array(a[2], pa.float64()), pa.array(a[3], pa.float64())], names=[group, "rep", "s", "c"])

    b_type = pa.string() if kind == "string" else None
    m = hashed.mapInArrow(draw, f"`{group}` {kind}, rep int, s double, c double").groupBy(group, "rep").agg((F.sum("s") / F.when(F.sum("c") > 0, F.sum("c"))).alias("m")).where("m is not null")
    sorted_ = m.groupBy(group).agg(F.sort_array(F.collect_list("m")).alias("ms"))  # as many as there are resamples
    n = F.size("ms")
    ends = sorted_.select(group, F.round(F.col("ms")[F.floor(0.025 * n).cast("int")], 6).alias("low"), F.round(F.col("ms")[F.least(n - 1, F.floor(0.975 * n).cast("int"))], 6).alias("high"))
    return one.groupBy(group).agg(F.count("*").alias("n"), F.round(F.sum("s") / F.sum("c"), 6).alias("mean")).join(ends, group)
