"""Sources: files of a corpus, Markdown and CSV units, JSON-lines spools, run stores, telemetry, feeds, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as X


def files(spark: SparkSession, root: str, pattern: str = "*.{md,csv}", largest: int = 4_000_000) -> DataFrame:
    """path, content of the text files below a folder: none that is over ``largest`` bytes or holds a NUL."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return raw.where((F.col("length") <= largest) & ~F.col("path").rlike(r"/(?:\.git|node_modules|__pycache__)/")).select("path", F.decode("content", "utf-8").alias("content")).where(~F.col("content").contains("\0"))


def markdown_units(docs: DataFrame) -> DataFrame:
    """path, line, section, text, tags, code: the units of Markdown texts (columns path, content).

    The body begins after the header between --- lines. A heading sets the section; a bullet or a table row begins a
    unit; the lines inside a closed fence are one unit; a blank line ends a unit; other lines go on with it or begin a
    paragraph. A table's separator row, and the header row above it where it has no tag, are left out. Every text is cut at its own lines; a unit is put together from them
    by running counts, so no text is read as one piece of state in Python.
    """
    body = F.regexp_replace("content", r"\r\n?", "\n")
    lines = docs.select("path", F.posexplode(F.split(body, "\n")).alias("pos", "raw"))
    w = W.partitionBy("path").orderBy("pos")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    dash = F.col("raw").rlike(r"^---\s*$")
    lines = lines.withColumn("dashes", F.sum(dash.cast("int")).over(upto)).withColumn("headed", F.max(F.when(F.col("pos") == 0, dash.cast("int"))).over(upto) == 1)
    lines = lines.where(~F.col("headed") | (F.col("dashes") > 2) | ((F.col("dashes") == 2) & ~dash))
    fence = F.col("raw").rlike(r"^\s*(?:```|~~~)").cast("int")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.coalesce(F.sum("fence").over(before), F.lit(0)))
    inside = (F.col("fences") % 2 == 1) | (F.col("fence") == 1)
    heading = ~inside & F.col("raw").startswith("#")
    blank = ~inside & (F.trim("raw") == "")
    row = ~inside & F.col("raw").rlike(r"^\s*\|")
    bullet = ~inside & F.col("raw").rlike(r"^\s*[-*] ")
    lines = lines.withColumn("code", inside).withColumn("heading", heading).withColumn("blank", blank).withColumn("row", row)
    ended = F.coalesce(F.lag(F.col("heading") | F.col("blank") | F.col("row") | ((F.col("fence") == 1) & (F.col("fences") % 2 == 1))).over(w), F.lit(True))
    opens = bullet | row | ((F.col("fence") == 1) & (F.col("fences") % 2 == 0)) | (~inside & ended)
    lines = lines.withColumn("section", F.last(F.when(F.col("heading"), F.trim(F.regexp_replace("raw", r"^#+\s*", ""))), ignorenulls=True).over(upto)).withColumn("unit", F.sum(opens.cast("int")).over(upto))
    separator = lambda c: F.coalesce(c, F.lit("")).rlike(r"^\s*\|[\s:|\-]+\|?\s*$")
    lines = lines.withColumn("all_fences", F.sum("fence").over(W.partitionBy("path"))).withColumn("next", F.lead("raw").over(w))
    header = F.col("row") & separator(F.col("next")) & (F.size(X.tags(F.col("raw"))) == 0)
    unclosed = F.col("code") & (F.col("all_fences") % 2 == 1) & (F.col("fences") == F.col("all_fences"))
    kept = lines.where(~F.col("heading") & ~F.col("blank") & ~(F.col("row") & separator(F.col("raw"))) & ~header & (F.col("fence") == 0) & ~unclosed)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: F.trim(x["raw"])), " ")
    g = kept.groupBy("path", "unit").agg((F.min("pos") + 1).alias("line"), F.first("section").alias("section"), F.max("code").alias("code"), joined.alias("text"))
    return g.select("path", "line", "section", F.trim(F.when(F.col("code"), F.col("text")).otherwise(F.regexp_replace("text", r"^[-*] +", ""))).alias("text"), X.tags(F.col("text")).alias("tags"), "code").where("text != ''")


def csv_units(rows: DataFrame, key: str) -> DataFrame:
    """key, text: each row of a table as one unit 'column=value; ...', empty cells left out."""
    cells = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in rows.columns]
    return rows.select(key, F.concat_ws("; ", *cells).alias("text"))


def ledger_entries(docs: DataFrame) -> DataFrame:
    """path, entry, line, end, text: top-level bullets of ledgers (columns path, content), each to the line before the next."""
    lines = docs.select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "raw"))
    w = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("raw").rlike(r"^(?:[-*] |### )").cast("int")
    e = lines.withColumn("entry", F.sum(start).over(w)).where("entry > 0 and trim(raw) != ''")
    return e.groupBy("path", "entry").agg((F.min("pos") + 1).alias("line"), (F.max("pos") + 1).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: F.trim(x["raw"])), " ").alias("text"))


def spool(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines with a column _bad for lines that are none; bad lines are kept to be counted."""
    return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def run_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, entries) of run files: the first line of each file is its header; an entry id counts in its first run."""
    lines = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("file"))
    head = lines.where(F.get_json_object("value", "$.pipeline").isNotNull() | F.get_json_object("value", "$.counts").isNotNull())
    entries = lines.where(F.get_json_object("value", "$.id").isNotNull()).select(F.get_json_object("value", "$.id").alias("id"), "file", "value")
    first = F.row_number().over(W.partitionBy("id").orderBy("file"))
    return head.select("file", F.col("value").alias("header")), entries.withColumn("_r", first).where("_r = 1").drop("_r")


def otlp_logs(payloads: DataFrame, column: str = "value") -> DataFrame:
    """resource, scope, at, body, attributes of OTLP JSON logs, flattened; keys the schema does not name are dropped."""
    attr = "array<struct<key: string, value: struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>>>"
    schema = f"struct<resourceLogs: array<struct<resource: struct<attributes: {attr}>, scopeLogs: array<struct<scope: struct<name: string>, logRecords: array<struct<timeUnixNano: string, body: struct<stringValue: string>, attributes: {attr}>>>>>>>"
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    as_map = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(attr)), lambda a: F.struct(a["key"], text(a["value"]))))
    r = payloads.select(F.from_json(column, schema).alias("p")).select(F.explode("p.resourceLogs").alias("r"))
    s = r.select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", "s.scope.name", F.explode("s.logRecords").alias("l"))
    return s.select(as_map(F.col("resource.attributes")).alias("resource"), F.col("name").alias("scope"), F.timestamp_micros((F.col("l.timeUnixNano").cast("bigint") / 1000).cast("bigint")).alias("at"), F.col("l.body.stringValue").alias("body"), as_map(F.col("l.attributes")).alias("attributes"))


def atom_entries(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """title, updated, link, text of the entries of Atom feeds."""
    blocks = feeds.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))).alias("e"))
    part = lambda tag: X.html_text(F.regexp_extract("e", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    return blocks.select(part("title").alias("title"), part("updated").alias("updated"), F.regexp_extract("e", r"<link\b[^>]*href=\"([^\"]*)\"", 1).alias("link"), part("(?:summary|content)").alias("text"))


def pins(docs: DataFrame) -> DataFrame:
    """path, pin, value: versions that requirement lists, package manifests and build files (path, content) ask for."""
    found = lambda pattern: F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    req = F.when(F.col("path").rlike(r"requirements[^/]*\.txt$"), found(r"(?m)^[A-Za-z0-9_.\-]+==[^\s;#]+"))
    npm = F.when(F.col("path").endswith("package.json"), found(r"\"[@A-Za-z0-9_./\-]+\"\s*:\s*\"[\^~>=<]*\d[^\"]*\""))
    toml = F.when(F.col("path").endswith(".toml"), found(r"(?m)^[A-Za-z0-9_.\-]+\s*=\s*\"[\^~>=<]*\d[^\"]*\""))
    p = docs.select("path", F.explode(F.coalesce(req, npm, toml, F.array().cast("array<string>"))).alias("p"))
    return p.select("path", F.regexp_extract("p", r"^\"?([@A-Za-z0-9_./\-]+)", 1).alias("pin"), F.regexp_extract("p", r"(?:==|[:=])\s*\"?[\^~>=<]*([^\"\s]+)", 1).alias("value"))


def imports(docs: DataFrame) -> DataFrame:
    """path, name, line: what source files (path, content) import, by the kind of file."""
    lines = docs.select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "raw"))
    py = F.when(F.col("path").endswith(".py"), F.regexp_extract("raw", r"^\s*(?:from|import)\s+([\w.]+)", 1))
    js = F.when(F.col("path").rlike(r"\.[jt]sx?$"), F.regexp_extract("raw", r"(?:from|require\()\s*['\"]([^'\"]+)", 1))
    cs = F.when(F.col("path").endswith(".cs"), F.regexp_extract("raw", r"^\s*using\s+([\w.]+)\s*;", 1))
    return lines.select("path", F.coalesce(py, js, cs).alias("name"), (F.col("pos") + 1).alias("line")).where("name is not null and name != ''")


def write_index(postings: DataFrame, path: str) -> None:
    """Keep postings sorted by term, so that a lookup reads few row groups."""
    postings.repartitionByRange("term").sortWithinPartitions("term", "unit_id").write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The postings of some terms; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("term").isin(terms))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV folder with a header and plain line ends."""
    rows.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_events(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
