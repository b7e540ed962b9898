"""Corpus assembly and its ledgers: roots, topics, sources, context references, and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as X

#: Order in which roots are served.
ROOTS = ("public", "local", "_self")


def root_of(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def roots(lines: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """root, place, files, lines of every served root, in the order of ROOTS, others after them by name; only: serve these."""
    r = lines.where("path is not null").withColumn("root", root_of(F.col("path")))
    if only:
        r = r.where(F.col("root").isin(*only))
    g = r.groupBy("root").agg(F.countDistinct("path").alias("files"), F.count("*").alias("lines"))
    known = F.coalesce(*[F.when(F.col("root") == x, i) for i, x in enumerate(ROOTS)], F.lit(len(ROOTS)))
    # a row for each root
    return g.withColumn("place", F.row_number().over(W.orderBy(known, "root")).cast("bigint"))


def stem_of(path: Column) -> Column:
    """The topic of a file: its path without what tells its parts apart (-2, -legacy) and without its ending."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[a-z]+$", ""), r"-(?:\d+|legacy)$", "")


def topic_files(lines: DataFrame) -> DataFrame:
    """topic, files, n: the files of each topic in order."""
    one = lines.where("path is not null").select(stem_of(F.col("path")).alias("topic"), "path").distinct()
    return one.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("path")), ";").alias("files"), F.count("*").alias("n"))


def union_units(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """part, id, text: fact units (part 0), untagged lines (1), ledger entries (2); a view is a prefix of parts."""
    uid = F.concat_ws(":", "path", F.col("line_no").cast("string"), F.col("added_on").cast("string"))
    own = lines.where("path is not null and line_no is not null").select(F.when(F.col("tag").isNotNull(), 0).otherwise(1).cast("bigint").alias("part"), uid.alias("id"), F.col("body").alias("text"))
    entries = ledger.where("item_id is not null").groupBy(F.lower(F.trim("item_id")).alias("k")).agg(F.max("item_id").alias("id"), F.max(F.concat_ws(" ", "title", "goal")).alias("text"))
    return own.unionByName(entries.select(F.lit(2).cast("bigint").alias("part"), "id", "text"))


def source_rows(docs: DataFrame) -> DataFrame:
    """source, doc_id, topic: one row for each source, its first document wins; docs: how many there are."""
    return docs.where("source is not null").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("topic", "doc_id").alias("topic"), F.count("*").alias("docs"))


def keyed_merge(rows: DataFrame, key: str, order: str, tie: str, columns: list[str]) -> DataFrame:
    """One row for each key: of every column the first value that is neither null nor empty, newest order first.

    Equal times go by tie. conflicts counts the columns that have two values of the winning time. One aggregate, no sort.
    """
    at = F.struct(F.coalesce(F.col(order).cast("timestamp"), F.lit("1900-01-01").cast("timestamp")), -F.col(tie))
    full = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    aggs = [F.max_by(F.when(full(c), F.col(c)), F.when(full(c), at)).alias(c) for c in columns]
    newest = [F.max(F.when(full(c), F.coalesce(F.col(order).cast("timestamp"), F.lit("1900-01-01").cast("timestamp")))).alias(f"_{c}") for c in columns]
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs, *newest, F.count("*").alias("merged"))
    same = rows.join(one.select(key, *[F.col(f"_{c}") for c in columns]), key).groupBy(key).agg(
        *[F.countDistinct(F.when(full(c) & (F.coalesce(F.col(order).cast("timestamp"), F.lit("1900-01-01").cast("timestamp")) == F.col(f"_{c}")), F.col(c))).alias(f"n_{c}") for c in columns]
    )
    conflicts = sum((F.when(F.col(f"n_{c}") > 1, 1).otherwise(0) for c in columns), F.lit(0)).cast("bigint")
    return one.select(key, *columns, "merged").join(same.select(key, conflicts.alias("conflicts")), key)


def context_refs(log: DataFrame) -> DataFrame:
    """seq, kind, value of the references ``kind:value`` that keys of the log's events hold; a bare key is an item."""
    key = F.get_json_object("fields", "$.key")
    one = log.where(key.isNotNull()).groupBy("seq").agg(F.max(key).alias("key"))
    has = F.col("key").contains(":")
    return one.select("seq", F.when(has, F.split_part("key", F.lit(":"), F.lit(1))).otherwise("item").alias("kind"), F.when(has, F.regexp_replace("key", r"^[^:]*:", "")).otherwise(F.col("key")).alias("value"))


def pointers(docs: DataFrame) -> DataFrame:
    """path, symbol, docs: the code pointers ``path#symbol`` of CODE parts, with the documents that hold them."""
    p = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"CODE [^\];]*?([\w./\-]+\.\w+#\w+)"), F.lit(1))).alias("p")).distinct()
    return p.groupBy(F.split_part("p", F.lit("#"), F.lit(1)).alias("path"), F.split_part("p", F.lit("#"), F.lit(2)).alias("symbol")).agg(F.count("*").alias("docs"))


def expansions(lines: DataFrame, cites: DataFrame) -> DataFrame:
    """fact_key, questions, asked: for tagged lines, how many distinct questions cite them, and the first in text order.

    cites has line (path:line_no) and question. Lines are joined by their place, facts by their key.
    """
    keyed = lines.where("tag is not null and body is not null").select(F.concat("path", F.lit(":"), "line_no").alias("line"), X.fact_key(F.col("body")).alias("fact_key")).distinct()
    q = cites.where("question is not null and trim(question) != ''").select("line", "question").distinct()
    return keyed.join(q, "line").groupBy("fact_key").agg(F.countDistinct("question").alias("questions"), F.min("question").alias("first"))


def cited(entries: DataFrame) -> DataFrame:
    """entry_id, day, question, line, tag, verdict: the citations of entries, each entry once."""
    one = entries.where("entry_id is not null").groupBy("entry_id").agg(F.min_by(F.struct("day", "question", "citations"), F.struct("loaded_at", "run")).alias("e"))
    return one.select("entry_id", "e.day", "e.question", F.explode("e.citations").alias("c")).select("entry_id", "day", "question", "c.line", "c.tag", "c.verdict")


def outcomes(lines: DataFrame, cites: DataFrame) -> DataFrame:
    """line, day, outcome of every cited place: valid, later, ended, moved, no line or no path, by the first that fits.

    moved: the text the place had stands on another place on that day. Places are joined by path and number.
    """
    at = cites.where("line is not null").select("line", F.try_to_date("day", "yyyy-MM-dd").alias("day")).where("day is not null").distinct()
    own = lines.where("path is not null and line_no is not null").select(F.concat("path", F.lit(":"), "line_no").alias("line"), "path", "body", "added_on", "removed_on")
    holds = lambda d: (F.col("added_on") <= F.col(d)) & (F.col("removed_on").isNull() | (F.col("removed_on") > F.col(d)))
    j = at.join(own, "line", "left")
    per = j.groupBy("line", "day").agg(F.max(F.coalesce(holds("day"), F.lit(False))).alias("valid"), F.count("added_on").alias("known"), F.min("added_on").alias("first"), F.max_by("body", F.when(F.col("added_on") <= F.col("day"), F.col("added_on"))).alias("body"))
    paths = own.select("path").distinct().withColumn("has_path", F.lit(True))
    gone = per.where("not valid and known > 0 and first <= day and body is not null")
    moved = gone.select("line", "day", "body").join(own.select("body", F.col("line").alias("other"), "added_on", "removed_on"), "body").where((F.col("other") != F.col("line")) & holds("day")).select("line", "day").distinct().withColumn("moved", F.lit(True))
    r = per.withColumn("path", F.regexp_replace("line", r":\d+$", "")).join(paths, "path", "left").join(moved, ["line", "day"], "left")
    what = F.when(F.col("valid"), "valid").when((F.col("known") > 0) & (F.col("first") > F.col("day")), "later").when(F.col("moved"), "moved").when(F.col("known") > 0, "ended").when(F.col("has_path"), "no line").otherwise("no path")
    return r.select("line", "day", what.alias("outcome"))


def glob_regex(glob: Column) -> Column:
    """A glob as a regular expression: ** any path, * within a name."""
    x = F.regexp_replace(glob, r"([.+()\[\]{}^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\*\*", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*"), F.lit("$"))


def touched(items: DataFrame, paths: DataFrame) -> DataFrame:
    """pattern, files, items: how many files (column path) each glob of the items' touches meets, and how many items name it.

    Globs are cut at their first wildcard into a folder, and joined with the files by it: each file is listed once under
    each of its folders and under its own path, so it is an equality join, and the pattern is tried on few.
    """
    names = items.where("item_id is not null").select(F.lower(F.trim("item_id")).alias("i"), F.explode("touches").alias("pattern")).where("trim(pattern) != ''").distinct()
    globs = names.groupBy("pattern").agg(F.countDistinct("i").alias("items"))
    wild = F.col("pattern").contains("*")
    g = globs.withColumn("at", F.when(wild, F.regexp_extract("pattern", r"^([^*]*/|)", 1)).otherwise(F.col("pattern"))).withColumn("rx", glob_regex(F.col("pattern")))
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    f = paths.select("path").where("path is not null").distinct().select("path", F.explode(F.concat(ups, F.array("path"))).alias("at"))
    hit = g.join(f, "at").where(F.expr("path rlike rx")).groupBy("pattern").agg(F.countDistinct("path").alias("files"))
    return globs.join(hit, "pattern", "left").select("pattern", F.coalesce("files", F.lit(0)).cast("bigint").alias("files"), "items")


def flags(lines: DataFrame, cites: DataFrame) -> DataFrame:
    """path, flags: reports of misses on places that still hold a line on the report's day, counted once for each entry."""
    bad = cites.where("verdict = 'missed' and line is not null").select("entry_id", "line", F.try_to_date("day", "yyyy-MM-dd").alias("day")).distinct()
    own = lines.select(F.concat("path", F.lit(":"), "line_no").alias("line"), "path", "added_on", "removed_on")
    hit = bad.join(own, "line").where("added_on <= day and (removed_on is null or removed_on > day)")
    return hit.groupBy("path").agg(F.countDistinct("entry_id", "line").alias("flags"))


def audit_full(lines: DataFrame, cites: DataFrame) -> DataFrame:
    """path, facts, tagged, ended, gaps, conflicts, flags: gaps are untagged lines, conflicts texts held twice at a time."""
    a = lines.groupBy("path").agg(F.count("*").alias("facts"), F.count("tag").alias("tagged"), F.count_if(F.col("removed_on").isNotNull()).alias("ended"), F.count_if(F.col("tag").isNull() & F.col("removed_on").isNull()).alias("gaps"))
    twice = lines.where("removed_on is null and body is not null").groupBy("path", "body").agg(F.countDistinct("tag").alias("tags")).where("tags > 1").groupBy("path").agg(F.count("*").alias("conflicts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return a.join(twice, "path", "left").join(flags(lines, cites), "path", "left").select("path", "facts", "tagged", "ended", "gaps", zero("conflicts"), zero("flags"))


def history(lines: DataFrame) -> DataFrame:
    """path, line_no, versions, texts, first, last, open: the versions of each place over time."""
    return lines.where("path is not null and line_no is not null").groupBy("path", "line_no").agg(F.count("*").alias("versions"), F.countDistinct("body").alias("texts"), F.min("added_on").alias("first"), F.max("added_on").alias("last"), F.max(F.col("removed_on").isNull()).alias("open"))


def moved_lines(lines: DataFrame) -> DataFrame:
    """fact_key, old_line, new_line: texts that were removed from one file and added to another on that day or later.

    Of several new places the earliest counts, then the first in order. Joined by the key of the text.
    """
    k = lines.where("path is not null and body is not null").select(X.fact_key(F.col("body")).alias("fact_key"), "path", F.concat("path", F.lit(":"), "line_no").alias("line"), "added_on", "removed_on")
    old = k.where("removed_on is not null").select("fact_key", F.col("path").alias("p"), F.col("line").alias("old_line"), "removed_on")
    j = old.join(k.select("fact_key", "path", F.col("line").alias("new_line"), "added_on"), "fact_key").where("path != p and added_on >= removed_on")
    return j.groupBy("fact_key", "old_line").agg(F.min_by("new_line", F.struct("added_on", "new_line")).alias("new_line"))


def fingerprints(lines: DataFrame, day: str) -> DataFrame:
    """path, print: a fingerprint of each file's lines as they stood on a day."""
    now = lines.where(F.col("path").isNotNull() & (F.col("added_on") <= F.lit(day).cast("date")) & (F.col("removed_on").isNull() | (F.col("removed_on") > F.lit(day).cast("date"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("body", F.lit("")).alias("body")))), lambda x: F.concat(x["line_no"].cast("string"), F.lit(" "), x["body"])), "\n")
    return now.groupBy("path").agg(F.substring(F.sha2(text, 256), 1, 16).alias("print"))


def refresh(lines: DataFrame, before: str, after: str) -> DataFrame:
    """path, todo: what an index built on one day has to do on another: keep, rebuild, add or drop each file."""
    a, b = fingerprints(lines, before).withColumnRenamed("print", "a"), fingerprints(lines, after).withColumnRenamed("print", "b")
    todo = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "drop").when(F.col("a") == F.col("b"), "keep").otherwise("rebuild")
    return a.join(b, "path", "full_outer").select("path", todo.alias("todo"))


def postings_arrays(terms: DataFrame) -> DataFrame:
    """term, units, tfs: the postings of each term as two arrays of one order (columns unit_id, term, tf)."""
    p = F.array_sort(F.collect_list(F.struct("unit_id", "tf")))
    g = terms.groupBy("term").agg(p.alias("p"))
    return g.select("term", F.array_join(F.transform("p", lambda x: x["unit_id"]), ";").alias("units"), F.array_join(F.transform("p", lambda x: x["tf"].cast("string")), ";").alias("tfs"))


def quoted(docs: DataFrame, fewest: int = 3, most: int = 40) -> DataFrame:
    """doc_id of the documents whose title, of so many words, stands in their text, whatever the case and the blanks."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    t, n = plain(F.col("title")), F.size(F.split(plain(F.col("title")), " "))
    inside = F.concat(F.lit(" "), plain(F.col("text")), F.lit(" ")).contains(F.concat(F.lit(" "), t, F.lit(" ")))
    return docs.where(F.col("title").isNotNull() & (t != "") & (n >= fewest) & (n <= most) & inside).select("doc_id")


def nested_strings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value: every text in a JSON value, at whatever depth, by the path of keys to it (positions left out)."""
    from quarrylight.operators.drift import branches
    from quarrylight.operators.nested import parsed

    import pyarrow as pa

    kind = dict(rows.dtypes)[key]

    def walk(batches):
        for b in batches:
            ids, paths, values = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                v = parsed(text)
                if isinstance(v, list):
                    v = {"": v}
                if isinstance(v, dict):
                    for path, _, x in branches(v):
                        if isinstance(x, str):
                            ids.append(i)
                            paths.append(path)
                            values.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[key, "path", "value"])

    return rows.select(key, column).mapInArrow(walk, f"`{key}` {kind}, path string, value string")
