"""Usage, cost, lifecycles and replays over entries and the coordination log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as X

#: Verdicts from the worst to the best.
RANKS = ("none", "weak", "good")


def once(entries: DataFrame, *columns: str) -> DataFrame:
    """Each entry once, its first delivery: entry_id and the columns named."""
    return entries.where("entry_id is not null").groupBy("entry_id").agg(F.min_by(F.struct(*columns), F.struct("loaded_at", "run")).alias("e")).select("entry_id", "e.*")


def events_once(log: DataFrame) -> DataFrame:
    """seq, kind, at_ts and the usual fields of the log's events, each seq once, kinds in lower case."""
    field = lambda k: F.get_json_object("fields", f"$.{k}").alias(k)
    names = ("item", "state", "key", "holder", "operator", "id", "ref", "to", "session", "job", "op", "target")
    return log.where("fields is not null").dropDuplicates(["seq"]).select("seq", F.lower("kind").alias("kind"), "at_ts", *[field(k) for k in names])


def rollup(entries: DataFrame) -> DataFrame:
    """surface, part, entries, chars: each entry once with its greatest size; part: work on an item, or main."""
    one = entries.where("entry_id is not null").groupBy("entry_id").agg(F.max("chars").alias("chars"), F.max("surface").alias("surface"), F.max("item").alias("item"))
    return one.groupBy("surface", F.when(F.col("item").isNull(), "main").otherwise("item").alias("part")).agg(F.count("*").alias("entries"), F.sum("chars").alias("chars"))


def tool_tree(entries: DataFrame) -> DataFrame:
    """surface, route, size_class, entries, bad, chars, level, parts: counts of every level of a tree, and of its children.

    parts is the sum of a node's children, which has to be its own count (null for leaves).
    """
    one = once(entries, "surface", "route", "chars", "verdict").select(F.coalesce("surface", F.lit("?")).alias("surface"), F.coalesce("route", F.lit("?")).alias("route"), X.size_class(F.col("chars")).alias("size_class"), "chars", (F.col("verdict") == "none").alias("bad"))
    g = one.rollup("surface", "route", "size_class").agg(F.count("*").alias("entries"), F.count_if("bad").alias("bad"), F.sum("chars").alias("chars"), F.grouping_id().cast("bigint").alias("level"))
    up = lambda level, keys: g.where(F.col("level") == level).groupBy(*keys).agg(F.sum("entries").alias("parts"))
    nodes = [g.where("level = 0").withColumn("parts", F.lit(None).cast("bigint"))]
    nodes.append(g.where("level = 1").join(up(0, ["surface", "route"]), ["surface", "route"]).select(*g.columns, "parts"))
    nodes.append(g.where("level = 3").join(up(1, ["surface"]), ["surface"]).select(*g.columns, "parts"))
    nodes.append(g.where("level = 7").crossJoin(F.broadcast(g.where("level = 3").agg(F.sum("entries").alias("parts")))).select(*g.columns, "parts"))  # one row
    return nodes[0].unionByName(nodes[1]).unionByName(nodes[2]).unionByName(nodes[3])


def failures(entries: DataFrame) -> DataFrame:
    """print, line, entries, first: questions that tell of an error, grouped by what stays when ids and numbers are left out."""
    line = X.error_line(F.col("question"))
    e = once(entries, "question").where(F.lower("question").rlike(r"\b(error|warning|fails?|failed)\b")).select("entry_id", line.alias("line"))
    return e.groupBy("line").agg(F.count("*").alias("entries"), F.min("entry_id").alias("first")).select(F.substring(F.sha2("line", 256), 1, 12).alias("print"), "line", "entries", "first")


def run_summary(entries: DataFrame, most: int = 20) -> DataFrame:
    """run, entries, worst, surfaces, articles: the worst verdict, the surfaces in order, the first articles of each run."""
    rank = F.coalesce(*[F.when(F.col("verdict") == v, i) for i, v in enumerate(RANKS)])
    one = entries.where("run is not null and entry_id is not null").groupBy("run", "entry_id").agg(F.max("verdict").alias("verdict"), F.max("surface").alias("surface"), F.max("article").alias("article"))
    g = one.groupBy("run").agg(F.count("*").alias("entries"), F.min(rank).alias("r"), F.array_sort(F.collect_set("surface")).alias("s"), F.array_sort(F.collect_set("article")).alias("a"))
    worst = F.coalesce(*[F.when(F.col("r") == i, v) for i, v in enumerate(RANKS)])
    return g.select("run", "entries", worst.alias("worst"), F.array_join("s", ";").alias("surfaces"), F.array_join(F.slice("a", 1, most), ";").alias("articles"))


def declared(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """run, declared, found, state: the entries that a run's header counts against those that are there."""
    h = headers.where("run is not null").groupBy("run").agg(F.max(F.get_json_object("header", "$.counts.entries").try_cast("bigint")).alias("declared"))
    e = entries.where("run is not null and entry_id is not null").groupBy("run").agg(F.countDistinct("entry_id").alias("found"))
    state = F.when(F.col("declared").isNull(), "not declared").when(F.col("found").isNull(), "no entries").when(F.col("found") > F.col("declared"), "more than declared").when(F.col("found") == F.col("declared"), "as declared").otherwise("fewer")
    return h.join(e, "run", "full_outer").select("run", "declared", "found", state.alias("state"))


def daily(entries: DataFrame) -> DataFrame:
    """day, surface, entries, chars, items: what was used on each day, every entry once."""
    return once(entries, "day", "surface", "chars", "item").where("day is not null").groupBy("day", "surface").agg(F.count("*").alias("entries"), F.sum("chars").alias("chars"), F.countDistinct("item").alias("items"))


def expensive(entries: DataFrame, k: int = 25) -> DataFrame:
    """place, article, chars, entries: the articles with most characters, shared evenly where an entry has several."""
    one = once(entries, "articles", "chars").select(F.array_distinct("articles").alias("a"), "chars")
    share = one.select(F.explode("a").alias("article"), (F.col("chars") / F.size("a")).alias("share")).where("article is not null")
    g = share.groupBy("article").agg(F.round(F.sum("share"), 4).alias("chars"), F.count("*").alias("entries"))
    # the best k of every part first, then of all
    return g.orderBy(F.desc("chars"), "article").limit(k).withColumn("place", F.row_number().over(W.orderBy(F.desc("chars"), "article")).cast("bigint"))


def spend(entries: DataFrame) -> DataFrame:
    """month, intent, entries, chars: sums of each month and intent, of each month, and of all."""
    one = once(entries, "day", "intent", "chars").select(F.coalesce(F.substring("day", 1, 7), F.lit("?")).alias("month"), F.coalesce("intent", F.lit("?")).alias("intent"), "chars")
    return one.rollup("month", "intent").agg(F.count("*").alias("entries"), F.sum("chars").alias("chars"))


def history(entries: DataFrame) -> DataFrame:
    """surface, chain, change: the entries of each month as a chain, and the last one's change in percent."""
    one = once(entries, "day", "surface").where("day is not null and surface is not null").groupBy("surface", F.substring("day", 1, 7).alias("month")).agg(F.count("*").alias("n"))
    g = one.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("c"))  # a value for each month
    last, before = F.try_element_at("c", F.lit(-1))["n"], F.when(F.size("c") > 1, F.element_at("c", -2)["n"])
    return g.select("surface", F.array_join(F.transform("c", lambda x: x["n"].cast("string")), " -> ").alias("chain"), F.round(100 * (last - before) / before, 4).alias("change"))


def pairs(rows: DataFrame, key: str, column: str, start: str, stop: str) -> DataFrame:
    """key, started, stopped, seconds: each stop with the start right before it among both; unpaired ones are left out."""
    w = W.partitionBy(key).orderBy("seq")
    e = rows.where(F.col(key).isNotNull() & F.col(column).isin(start, stop)).select(F.col(key).alias("key"), F.col("seq"), F.col("at_ts"), F.col(column).alias("what"))
    w = W.partitionBy("key").orderBy("seq")
    e = e.withColumn("before", F.lag("what").over(w)).withColumn("started", F.lag("at_ts").over(w)).where((F.col("what") == stop) & (F.col("before") == start))
    sec = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    return e.select("key", "started", F.col("at_ts").alias("stopped"), (sec("at_ts") - sec("started")).alias("seconds"))


def lifecycles(rows: DataFrame, items: DataFrame, start: str = "claimed", done: str = "landed", newest: int = 30) -> DataFrame:
    """kind, n, p25, p50, p75 of the seconds from an item's last start before its newest end to that end.

    Negative spans are left out; the newest of each kind count; of these, spans over p75 + 3 (p75 - p25) are left out
    where there are at least 4.
    """
    e = rows.where(F.col("item").isNotNull() & F.col("state").isin(start, done))
    end = e.where(F.col("state") == done).groupBy("item").agg(F.max("seq").alias("end"), F.max_by("at_ts", "seq").alias("end_ts"))
    begin = e.where(F.col("state") == start).join(end, "item").where("seq < end").groupBy("item").agg(F.max_by("at_ts", "seq").alias("start_ts"), F.max("end").alias("end"), F.max("end_ts").alias("end_ts"))
    sec = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    kinds = items.where("item_id is not null").groupBy(F.lower(F.trim("item_id")).alias("k")).agg(F.max("kind").alias("kind"))
    d = begin.withColumn("k", F.lower(F.trim("item"))).join(kinds, "k").select("kind", "end", "item", (sec("end_ts") - sec("start_ts")).alias("s")).where("s >= 0")
    d = d.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("end"), "item"))).where(F.col("r") <= newest)
    q = d.groupBy("kind").agg(F.expr("percentile(s, array(0.25, 0.75))").alias("q"), F.count("*").alias("m"))
    kept = d.join(q, "kind").where((F.col("m") < 4) | (F.col("s") <= F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0])))
    p = lambda x: F.round(F.expr(f"percentile(s, {x})"), 4)
    return kept.groupBy("kind").agg(F.count("*").alias("n"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"))


def state_at(rows: DataFrame, ts: str) -> DataFrame:
    """state, items: how many items stood in each state at a time."""
    now = rows.where(F.col("item").isNotNull() & F.col("state").isNotNull() & (F.col("at_ts") <= F.lit(ts).cast("timestamp_ntz"))).groupBy("item").agg(F.max_by("state", "seq").alias("state"))
    return now.groupBy("state").agg(F.count("*").alias("items"))


def reopened(rows: DataFrame, closed: tuple[str, ...] = ("landed", "completed")) -> DataFrame:
    """item, closed_seq, reopened_seq: items that moved on after they had been closed."""
    e = rows.where("item is not null and state is not null")
    first = e.where(F.col("state").isin(*closed)).groupBy("item").agg(F.min("seq").alias("closed_seq"))
    return e.where(~F.col("state").isin(*closed)).join(first, "item").where("seq > closed_seq").groupBy("item").agg(F.max("closed_seq").alias("closed_seq"), F.min("seq").alias("reopened_seq"))


def open_questions(rows: DataFrame) -> DataFrame:
    """id, asked, ref: questions nobody has answered. An answer names its question's id."""
    ask = rows.where("kind = 'ask' and id is not null").groupBy("id").agg(F.min("at_ts").alias("asked"), F.min_by("ref", "seq").alias("ref"))
    return ask.join(rows.where("kind = 'answer' and id is not null").select("id").distinct(), "id", "left_anti")


def answered(rows: DataFrame) -> DataFrame:
    """seq, id, ask_seq, how: the question of each answer, by its id, else the last one before it with the same ref."""
    ask = rows.where("kind = 'ask'").select("id", "ref", F.col("seq").alias("ask_seq"))
    ans = rows.where("kind = 'answer'").select("seq", "id", "ref")
    by_id = ask.where("id is not null").groupBy("id").agg(F.min("ask_seq").alias("by_id"))
    w = W.partitionBy("ref").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    both = ask.select("ref", F.col("ask_seq").alias("at"), F.lit(0).alias("side"), F.col("ask_seq").alias("q")).unionByName(ans.select("ref", F.col("seq").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("q")))
    by_ref = both.where("ref is not null").withColumn("by_ref", F.last("q", ignorenulls=True).over(w)).where("side = 1").select(F.col("at").alias("seq"), "by_ref")
    j = ans.select("seq", "id").join(by_id, "id", "left").join(by_ref, "seq", "left")
    return j.select("seq", "id", F.coalesce("by_id", "by_ref").alias("ask_seq"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_ref").isNotNull(), "ref").otherwise("none").alias("how"))


def operators(rows: DataFrame) -> DataFrame:
    """operator, events, kinds, items, last: what each operator did."""
    return rows.where("operator is not null").groupBy("operator").agg(F.count("*").alias("events"), F.countDistinct("kind").alias("kinds"), F.countDistinct("item").alias("items"), F.max("at_ts").alias("last"))


#: Fields that an event of a kind must have.
SHAPES = {"claim": ("key", "holder"), "release": ("key",), "progress": ("item", "state"), "ask": ("id", "ref", "to"), "answer": ("id", "ref", "state"), "job": ("job", "op", "state"), "blocked": ("session", "state"), "intent": ("session",), "heartbeat": ("session",), "code_added": ("target",)}


def shape_problems(rows: DataFrame) -> DataFrame:
    """seq, kind, problem: fields that an event lacks, and kinds that are not known."""
    lack = F.filter(F.array(*[F.when((F.col("kind") == k) & F.col(f).isNull(), F.lit(f"no {f}")) for k, fs in SHAPES.items() for f in fs], F.when(~F.col("kind").isin(*SHAPES), F.lit("unknown kind"))), lambda x: x.isNotNull())
    return rows.select("seq", "kind", F.explode(lack).alias("problem"))


def breaker(rows: DataFrame, key: str, bad: Column, least: int = 3) -> DataFrame:
    """key, run, opened, failures: stretches of at least so many failures on end; the breaker opens at the last needed."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    good = F.sum((~bad).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    runs = rows.select(key, "ts", "event_id", bad.alias("bad"), good.alias("run")).where("bad").withColumn("n", F.row_number().over(W.partitionBy(key, "run").orderBy("ts", "event_id")))
    return runs.groupBy(key, "run").agg(F.max(F.when(F.col("n") == least, F.col("ts"))).alias("opened"), F.count("*").alias("failures")).where(F.col("failures") >= least)


def ticks(rows: DataFrame, key: str, value: str, drop: float = 0.5) -> DataFrame:
    """key, day, requests, compactions, repeats: steps on each day, falls to less than drop of the step before, repeats of a type."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    r = rows.select(key, F.to_date("ts").alias("day"), (F.col(value) < drop * F.lag(value).over(w)).alias("fall"), (F.col("event_type") == F.lag("event_type").over(w)).alias("again"))
    return r.groupBy(key, "day").agg(F.count("*").alias("requests"), F.count_if("fall").alias("compactions"), F.count_if("again").alias("repeats"))


def work_split(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """item, chars, rework_chars, entries: each item's entries, and those of days in which it had been refused and not closed.

    A refused window goes from the first 'refused' to the next 'landed' or 'released' of the item, both days included.
    """
    from quarrylight.operators.events import open_spans

    spans = open_spans(rows.where("item is not null"), "item", "state", ["refused"], ["landed", "released"]).select(F.lower(F.trim("key")).alias("k"), F.to_date("opened").alias("a"), F.coalesce(F.to_date("closed"), F.lit("9999-01-01").cast("date")).alias("b"))
    e = once(entries, "item", "day", "chars").where("item is not null").select("entry_id", F.lower(F.trim("item")).alias("k"), F.try_to_date("day", "yyyy-MM-dd").alias("day"), F.coalesce("chars", F.lit(0)).alias("chars"))
    inside = e.join(spans, "k").where("day between a and b").select("entry_id").distinct().withColumn("in", F.lit(True))
    j = e.join(inside, "entry_id", "left")
    return j.groupBy(F.col("k").alias("item")).agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("in"), F.col("chars")).otherwise(0)).alias("rework_chars"), F.count("*").alias("entries"))


def reuse(entries: DataFrame, days: int = 7) -> DataFrame:
    """question, asked, stored, reused: questions asked again; an answer is stored anew when the one before it is too old.

    A question is reused when it comes within so many days of the one before it.
    """
    q = once(entries, "day", "question").select(F.try_to_date("day", "yyyy-MM-dd").alias("day"), F.lower(F.trim("question")).alias("question")).where("day is not null and question != ''")
    per = q.groupBy("question", "day").agg(F.count("*").alias("n"))
    gap = F.datediff("day", F.lag("day").over(W.partitionBy("question").orderBy("day")))
    g = per.withColumn("gap", gap).groupBy("question").agg(F.sum("n").alias("asked"), F.count_if(F.col("gap").isNull() | (F.col("gap") > days)).alias("stored"))
    return g.where("asked > 1").select("question", "asked", "stored", (F.col("asked") - F.col("stored")).alias("reused"))


def count_maps(headers: DataFrame) -> DataFrame:
    """store, name, total, files: the maps of counts of a store's headers, added up by key; each file once."""
    one = headers.where("store is not null and run is not null").groupBy("store", "run").agg(F.max(F.get_json_object("header", "$.counts")).alias("c"))
    m = one.select("store", F.explode(F.from_json("c", "map<string,bigint>")).alias("name", "n")).where("n is not null")
    return m.groupBy("store", "name").agg(F.sum("n").alias("total"), F.count("*").alias("files"))


def agreement(entries: DataFrame) -> DataFrame:
    """n, accuracy, precision, recall, kappa of the entries' verdict 'good' against whether a citation of theirs answered."""
    e = once(entries, "verdict", "citations").where("verdict is not null and size(citations) > 0")
    x = e.select((F.col("verdict") == "good").alias("p"), F.exists("citations", lambda c: F.coalesce(c["verdict"] == "answered", F.lit(False))).alias("t"))
    c = lambda p, t: F.count_if((F.col("p") == p) & (F.col("t") == t)).cast("double")
    m = x.agg(F.count("*").alias("n"), c(True, True).alias("tp"), c(True, False).alias("fp"), c(False, True).alias("fn"), c(False, False).alias("tn"))
    pe = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (F.col("n") * F.col("n"))
    acc = (F.col("tp") + F.col("tn")) / F.col("n")
    return m.select("n", F.round(acc, 6).alias("accuracy"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"), F.round((acc - pe) / (1 - pe), 6).alias("kappa"))
