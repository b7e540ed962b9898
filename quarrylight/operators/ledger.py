"""Ledger analytics: tags and citations, audits, comparisons, freshness, calibration, sampling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.session import materialise


def tag_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, kind, ids, note: a row for each part of each evidence tag of the texts."""
    return docs.select("doc_id", "source", F.explode(X.tags(F.col(text))).alias("t")).select("doc_id", "source", "t.kind", "t.ids", "t.note")


def reverse_index(tags: DataFrame) -> DataFrame:
    """id, used_in, docs: the documents that cite each id, in order."""
    one = tags.select("doc_id", F.explode("ids").alias("id")).distinct()
    used = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ";")
    return one.groupBy("id").agg(used.alias("used_in"), F.count("*").alias("docs"))


def audit(lines: DataFrame) -> DataFrame:
    """path with its counts of facts, of facts with each kind of tag, and of ended ones."""
    kind = lambda k: F.count_if(F.col("tag") == k)
    return lines.groupBy("path").agg(
        F.count("*").alias("facts"), F.count("tag").alias("tagged"), kind("DOC").alias("doc"), kind("CODE").alias("code"), kind("DER").alias("der"),
        kind("COMMUNITY").alias("community"), kind("UNK").alias("unk"), F.count_if(F.col("removed_on").isNotNull()).alias("ended"),
    )


def front_matter(docs: DataFrame) -> DataFrame:
    """doc_id, topic, priority, status, sources of the texts that begin with a header between --- lines."""
    head = F.regexp_extract("text", r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    value = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    return docs.where("text like '---%'").select("doc_id", value("topic").alias("topic"), value("priority").alias("priority"), value("status").alias("status"), X.split_list(F.coalesce(value("sources"), F.lit(""))).alias("sources"))


def line_similarity(lines: DataFrame) -> DataFrame:
    """path, line_no, similarity, simhash: each line against the one before it in its file, by 3-word shingles."""
    one = lines.where("path is not null").groupBy("path", "line_no").agg(F.max("body").alias("body"))
    s = one.withColumn("sh", X.shingles(F.lower("body"))).withColumn("before", F.lag("sh").over(W.partitionBy("path").orderBy("line_no")))
    return s.where("before is not null").select("path", "line_no", F.round(X.jaccard(F.col("sh"), F.col("before")), 6).alias("similarity"), X.simhash(F.col("sh")).alias("simhash"))


def usual(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n: the most common value of each key, the first in text order on ties."""
    c = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), value))).where("r = 1").drop("r")


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, old, new, state: the entries of each key before and after; a key on one side only is added or removed."""
    n = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.countDistinct("entry_id").alias(name))
    j = n(old, "old").join(n(new, "new"), "key", "full_outer")
    return j.select("key", "old", "new", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed").alias("state"))


def freshness(docs: DataFrame, today: str = "2026-06-30", lifetime: int = 180) -> DataFrame:
    """source, docs, newest, age_days, stale: the age of each source's newest document against a lifetime in days."""
    g = docs.where("retrieved_at is not null").groupBy("source").agg(F.count("*").alias("docs"), F.max("retrieved_at").alias("newest"))
    age = F.datediff(F.lit(today).cast("date"), F.col("newest").cast("date")).cast("bigint")
    return g.select("source", "docs", "newest", age.alias("age_days"), (age > lifetime).alias("stale"))


def change_interval(headers: DataFrame) -> DataFrame:
    """store, checks, changes, mean_days: the mean time between changes of the commit that files of a store name.

    Estimated from whether each check found a change; null under two checks or two changes.
    """
    commit = F.coalesce(*[F.get_json_object("header", f"$.{k}") for k in ("kb_commit", "kbCommit", "commit", "kb_sha")])
    one = headers.where("store is not null and run is not null").groupBy("store", "run").agg(F.max(commit).alias("commit"))
    at = F.try_to_timestamp(F.substring("run", 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
    w = W.partitionBy("store").orderBy("run")
    r = one.where("commit is not null").withColumn("at", at).withColumn("moved", (F.col("commit") != F.lag("commit").over(w)).cast("int"))
    g = r.groupBy("store").agg(F.count("*").alias("checks"), F.coalesce(F.sum("moved"), F.lit(0)).alias("changes"), ((F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))) / 86400).alias("days"))
    n = F.col("checks") - 1
    mean = (F.col("days") / n) / -F.log((n - F.least("changes", n) + 0.5) / (n + 0.5))
    return g.select("store", "checks", "changes", F.when((F.col("checks") >= 2) & (F.col("changes") >= 2), F.round(mean, 6)).alias("mean_days"))


def newest_versions(entries: DataFrame) -> DataFrame:
    """product, version: the greatest build number named with each product; versions compare by their numbers."""
    m = entries.select(F.regexp_extract("question", r"(?i)why does (\w+) ignore", 1).alias("product"), F.regexp_extract("question", r"(?i)on build (\d+(?:\.\d+)+)", 1).alias("version"))
    m = m.where("product != '' and version != ''").select(F.lower("product").alias("product"), "version").distinct()
    return m.groupBy("product").agg(F.max_by("version", F.struct(X.version_key(F.col("version")), "version")).alias("version"))


def month_change(orders: DataFrame) -> DataFrame:
    """month, total, change: each month's total and its change in percent."""
    m = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    before = F.lag("total").over(W.orderBy("month"))  # a row for each month
    return m.select("month", "total", F.round(100 * (F.col("total") - before) / before, 4).alias("change"))


def priced(lines: DataFrame, tiers: list[tuple[int, float]]) -> DataFrame:
    """tier, lines, price: prices by the tier of the quantity; tiers are (from, factor) in rising order."""
    tier, factor = F.lit(tiers[0][0]), F.lit(tiers[0][1])
    for low, f in tiers[1:]:
        tier, factor = F.when(F.col("l_quantity") >= low, low).otherwise(tier), F.when(F.col("l_quantity") >= low, f).otherwise(factor)
    return lines.groupBy(tier.alias("tier")).agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * factor), 2).alias("price"))


def _hash(c: str) -> Column:
    return F.sha2(F.col(c).cast("string"), 256)


def round_robin(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows, in turn from every group, in an order fixed by a hash."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(_hash(key), key))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(n)


def per_kind(rows: DataFrame, kind: str, key: str, n: int) -> DataFrame:
    """At most n rows of each kind, chosen by a hash."""
    r = F.row_number().over(W.partitionBy(kind).orderBy(_hash(key), key))
    return rows.withColumn("r", r).where(F.col("r") <= n).drop("r")


def positions(rows: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """rows with their place from 1 in a total order, without one task for all: ranges, their sizes, ranks within them."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, 8)
    cut = materialise(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return cut.withColumn("_own", own).join(F.broadcast(base.select("_part", "_base")), "_part").withColumn(name, (F.col("_base") + F.col("_own")).cast("bigint")).drop("_part", "_base", "_own")


def rotated(rows: DataFrame, key: str, after) -> DataFrame:
    """rows with pos: the order of a scan that goes on after a key and comes round to it."""
    return positions(rows, [F.col(key) <= after, F.col(key)])


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in order. An aggregate of constant state, so that a hot key is combined first."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    # nulls come first, as in a window
    first = F.min(F.struct(*[x for c in order for x in (F.col(c).isNotNull().alias(f"_{c}"), F.col(c))], *rest)).alias("r")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)]).select(*rows.columns)


def best_cut(rows: DataFrame, positive: Column, score: str, grid: list[float]) -> DataFrame:
    """cut, balanced: the cut of a grid with the best balanced accuracy, the lower one on ties. One pass over the rows."""
    p, n = F.sum(positive.cast("int")), F.sum((~positive).cast("int"))
    parts = [F.struct(F.lit(c).alias("cut"), F.round((F.sum((positive & (F.col(score) >= c)).cast("int")) / p + F.sum((~positive & (F.col(score) < c)).cast("int")) / n) / 2, 6).alias("balanced")) for c in grid]
    return rows.agg(F.array(*parts).alias("g")).select(F.inline("g")).orderBy(F.desc("balanced"), "cut").limit(1)


def phrase_runs(lines: DataFrame) -> DataFrame:
    """path, line_no, added_on, run: the longest run of words of a line that also stand in its section's name or path."""
    w = lines.select("path", "line_no", "added_on", X.words(F.regexp_replace(F.concat_ws(" ", "section", "path"), r"[/_\-.]", " ")).alias("q"), F.posexplode(X.words(F.col("body"))).alias("p", "word"))
    hit = w.where(F.array_contains("q", F.col("word")))
    key = ["path", "line_no", "added_on"]
    island = hit.withColumn("g", F.col("p") - F.row_number().over(W.partitionBy(*key).orderBy("p")))
    return island.groupBy(*key, "g").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("run"))


#: Query vectors that a task holds at once, and the most bytes of them that are broadcast.
BLOCK, QUERY_BYTES = 2_000, 200_000_000


def neighbours(vectors: DataFrame, k: int, every: int = 20) -> DataFrame:
    """vec_id, neighbour, similarity, pos: for every id divisible by ``every`` its k nearest of all vectors by cosine.

    The queries are a stated twentieth of the rows. They go to the tasks in parts: each part of at most QUERY_BYTES is
    broadcast in a pass of its own over the vectors, each task keeps its k best. Null vectors are neither asked nor found.
    """
    q = vectors.where((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull()).select("vec_id", "embedding")
    size = q.agg(F.sum(F.size("embedding").cast("bigint") * 8 + 16).alias("bytes")).first()["bytes"] or 0
    parts = max(1, -(-size // QUERY_BYTES))
    found = [_near(vectors, q.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p), k) for p in range(parts)]
    pos = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour"))
    return reduce(DataFrame.unionByName, found).withColumn("pos", pos).where(F.col("pos") <= k)


def _near(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.collect()  # at most QUERY_BYTES of vectors
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    m = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ids, all_m = shared.value
        for b in batches:
            if not b.num_rows or not len(all_ids):
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            v = np.array(b.column(1).to_pylist(), np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            for at in range(0, len(all_ids), BLOCK):
                ids, m = all_ids[at : at + BLOCK], all_m[at : at + BLOCK]
                sim = np.round(m @ v.T, 4)
                sim[ids[:, None] == own[None, :]] = -9
                order = np.lexsort((np.broadcast_to(own, sim.shape), -sim), axis=1)[:, :k]
                s = np.take_along_axis(sim, order, 1)
                keep = s > -9
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, order.shape[1])[keep.ravel()]), pa.array(own[order][keep]), pa.array(s[keep])], names=["vec_id", "neighbour", "similarity"])

    return vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(near, "vec_id bigint, neighbour bigint, similarity double")
