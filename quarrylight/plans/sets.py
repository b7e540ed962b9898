"""Queries of near duplicates, order, batching, sampling and sets, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.operators import sets as S
from quarrylight.operators.usage import once
from quarrylight.plans.usage import _once
from quarrylight.session import table as t


def _titles(s, d):
    return t(s, d, "work_items").where("item_id is not null").groupBy(F.lower(F.trim("item_id")).alias("item")).agg(F.max("title").alias("title"))


def _asked(s, d):
    w = once(t(s, d, "run_entries"), "article", "question").where("article is not null").select(F.col("article").alias("key"), F.explode(X.words(F.col("question"))).alias("word"))
    return w.where(~F.col("word").isin(*X.STOP) & (F.length("word") > 2))


def queries() -> dict:
    lines = lambda s, d: t(s, d, "kb_lines")
    ent = lambda s, d: t(s, d, "run_entries")
    return {
        "similar_titles": lambda s, d: S.similar(_titles(s, d), "item", "title").withColumnRenamed("key", "item"),
        "work_order": lambda s, d: S.work_order(t(s, d, "work_items")),
        "natural_order": lambda s, d: lines(s, d).where("path is not null").select("path").distinct().groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(S.natural_key(F.col("path")))), lambda x: x["all"]), ";").alias("paths")),
        "judge_batches": lambda s, d: S.batches(lines(s, d).where("path is not null and line_no is not null").select("path", "line_no", F.coalesce(F.col("added_on").cast("string"), F.lit("")).alias("added"), F.coalesce(F.length("body"), F.lit(0)).alias("chars")), "path", ["line_no", "added"], "chars", 5, 400).groupBy("path", "batch").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars")),
        "brief_packing": lambda s, d: S.first_fit(lines(s, d).where("path is not null and line_no is not null").select("path", "line_no", F.coalesce(F.col("added_on").cast("string"), F.lit("")).alias("added"), F.coalesce(F.length("body"), F.lit(0)).alias("chars")), "path", ["line_no", "added"], "chars", 600).select("path", "line_no", "chars"),
        "merged_pieces": lambda s, d: S.merged_pieces(lines(s, d), 300),
        "seeded_arms": lambda s, d: S.arms(lines(s, d).where("body is not null").select(F.coalesce("section", F.lit("?")).alias("section"), "body").distinct(), "section", "body").groupBy("section", "arm").agg(F.count("*").alias("lines"), F.min("body").alias("first")),
        "phase_sample": lambda s, d: S.phase_sample(once(ent(s, d), "verdict"), F.coalesce(F.col("verdict") == "none", F.lit(False)), "entry_id", 10).groupBy("verdict").agg(F.count("*").alias("entries")),
        "question_overlap": lambda s, d: S.overlap(once(ent(s, d), "question", "surface").where("surface = 'prompt'"), once(ent(s, d), "question", "surface").where("surface = 'mcp'"), "question"),
        "half_leakage": lambda s, d: _leak(once(ent(s, d), "question")),
        "uncovered_words": lambda s, d: S.uncovered(_asked(s, d), lines(s, d).where("path is not null").select(F.col("path").alias("key"), F.explode(X.words(F.col("body"))).alias("word"))).groupBy("key").agg(F.count("*").alias("words"), F.min("word").alias("first")),
        "shared_words": lambda s, d: _shared(s, d),
        "closed_items": lambda s, d: once(ent(s, d), "item").where("item is not null").select("entry_id", F.lower(F.trim("item")).alias("k")).join(t(s, d, "work_items").where("status in ('done', 'dropped')").select(F.lower(F.trim("item_id")).alias("k")).distinct(), "k", "left_anti").groupBy(F.col("k").alias("item")).agg(F.count("*").alias("entries")),
    }


def _leak(one):
    """halves of the entries by hash, and the texts that stand in both."""
    h = F.conv(F.substring(F.sha2("entry_id", 256), 1, 2), 16, 10).cast("int") % 2
    return S.overlap(one.where(h == 0), one.where(h == 1), "question").agg(F.count("*").alias("texts"), F.sum("left").alias("left"), F.sum("right").alias("right"))


def _shared(s, d):
    """class, pairs: how much of the words of an entry's question its article's lines hold: at least .75, .5, or less."""
    asked = once(t(s, d, "run_entries"), "article", "question").where("article is not null").select("entry_id", F.col("article").alias("path"), F.explode(F.array_distinct(X.words(F.col("question")))).alias("word")).where(~F.col("word").isin(*X.STOP) & (F.length("word") > 1))
    have = t(s, d, "kb_lines").where("path is not null").select("path", F.explode(X.words(F.col("body"))).alias("word")).distinct().withColumn("has", F.lit(1))
    g = asked.join(have, ["path", "word"], "left").groupBy("entry_id").agg(F.count("*").alias("n"), F.count("has").alias("k"))
    share = F.col("k") / F.col("n")
    return g.groupBy(F.when(share >= 0.75, "most").when(share >= 0.5, "half").otherwise("less").alias("part")).agg(F.count("*").alias("entries"))


_NORM = r"regexp_replace(trim(regexp_replace(lower(question), '\s+', ' ', 'g')), '[?.!]+$', '')"
_STOP = ", ".join(f"'{w}'" for w in X.STOP)
_LINES = "(select path, line_no, coalesce(cast(added_on as varchar), '') as added, coalesce(length(body), 0) as chars from kb_lines where path is not null and line_no is not null)"


def _ov(a: str, b: str, src: str) -> str:
    one = lambda w, n: f"(select {_NORM} as text, count(*) as {n} from {src} where question is not null and {w} group by 1 having text <> '')"
    return f"select text, \"left\", \"right\" from {one(a, chr(34) + 'left' + chr(34))} join {one(b, chr(34) + 'right' + chr(34))} using (text)"


def _greedy(keep: str) -> str:
    """A recursive walk over each path's lines in order."""
    return f"with recursive o as (select *, row_number() over (partition by path order by line_no, added) as n from {_LINES}), r as ({keep})"


def oracle_sql() -> dict[str, str]:
    half = "('0x' || substr(sha256(entry_id), 1, 2))::int % 2"
    word = f"unnest(regexp_extract_all(lower(%s), '{X.WORD}')) as word"
    return {
        "similar_titles": f"""with x as (select lower(trim(item_id)) as item, max(title) as title from work_items where item_id is not null group by 1),
s as (select item, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 1 and w not in ({_STOP})))) as ws from x where title is not null),
c as (select ws, min(item) as class_id from s where len(ws) > 0 group by 1),
p as (select a.class_id, count(*) as likes, min(b.class_id) as first from c a join c b on a.class_id <> b.class_id and len(list_intersect(a.ws, b.ws)) >= 2 and round(len(list_intersect(a.ws, b.ws)) / len(a.ws), 2) >= 0.6 group by 1)
select item, class_id, coalesce(likes, 0) as likes, first from s left join c using (ws) left join p using (class_id)""",
        "work_order": "with o as (select lower(trim(item_id)) as k, max(item_id) as item_id, max(status) as status, coalesce(min(priority), 'P9') as priority, min(filed_at) as filed_at from work_items where item_id is not null group by 1), d as (select distinct lower(trim(item_id)) as k, lower(trim(x)) as d from (select item_id, unnest(depends_on) as x from work_items where item_id is not null) where trim(x) <> ''), w as (select k from d where d not in (select k from o where status in ('done', 'dropped'))) select item_id, priority, row_number() over (order by priority, filed_at nulls first, item_id) as place from o where status = 'todo' and k not in (select k from w)",
        "natural_order": r"select split_part(path, '/', 1) as root, string_agg(path, ';' order by regexp_extract(path, '^(\D*)', 1), coalesce(try_cast(regexp_extract(path, '(\d+)', 1) as bigint), -1), path) as paths from (select distinct path from kb_lines where path is not null) group by 1",
        "judge_batches": _greedy("select path, n, chars, 0 as batch, 1 as k, chars as used from o where n = 1 union all select o.path, o.n, o.chars, case when r.k >= 5 or r.used + o.chars > 400 then batch + 1 else batch end, case when r.k >= 5 or r.used + o.chars > 400 then 1 else r.k + 1 end, case when r.k >= 5 or r.used + o.chars > 400 then o.chars else r.used + o.chars end from r join o on o.path = r.path and o.n = r.n + 1") + " select path, cast(batch as bigint) as batch, count(*) as lines, cast(sum(chars) as bigint) as chars from r group by 1, 2",
        "brief_packing": _greedy("select path, n, line_no, chars, case when chars <= 600 then chars else 0 end as used, chars <= 600 as kept from o where n = 1 union all select o.path, o.n, o.line_no, o.chars, case when r.used + o.chars <= 600 then r.used + o.chars else r.used end, r.used + o.chars <= 600 from r join o on o.path = r.path and o.n = r.n + 1") + " select path, line_no, chars from r where kept",
        "merged_pieces": "with recursive o as (select path, section, length as chars, row_number() over (partition by path, section order by line_no, added_on) as n from (select path, coalesce(section, '') as section, line_no, added_on, length(body) as length from kb_lines where path is not null and body is not null and removed_on is null)), r as (select path, section, n, chars, 0 as piece, chars as used from o where n = 1 union all select o.path, o.section, o.n, o.chars, case when r.used + o.chars > 300 then piece + 1 else piece end, case when r.used + o.chars > 300 then o.chars else r.used + o.chars end from r join o on o.path = r.path and o.section = r.section and o.n = r.n + 1) select path, section, cast(piece as bigint) as piece, count(*) as lines, cast(sum(chars) as bigint) as chars from r group by 1, 2, 3",
        "seeded_arms": "with o as (select distinct coalesce(section, '?') as section, body from kb_lines where body is not null), r as (select *, row_number() over (partition by section order by sha256('7|' || section || '|' || body), body) as r, count(*) over (partition by section) as n from o) select section, case when r <= floor(n * 0.5) then 'on' else 'off' end as arm, count(*) as lines, min(body) as first from r group by 1, 2",
        "phase_sample": f"select verdict, count(*) as entries from {_once('verdict')} where coalesce(verdict = 'none', false) or ('0x' || substr(sha256(entry_id), 1, 4))::bigint % 10 = 0 group by 1",
        "question_overlap": _ov("surface = 'prompt'", "surface = 'mcp'", _once("question", "surface")),
        "half_leakage": f"select count(*) as texts, cast(sum(\"left\") as bigint) as \"left\", cast(sum(\"right\") as bigint) as \"right\" from ({_ov(half + ' = 0', half + ' = 1', _once('question'))})",
        "uncovered_words": f"select key, count(*) as words, min(word) as first from (select article as key, word from (select article, {word % 'question'} from {_once('article', 'question')} where article is not null) where word not in ({_STOP}) and length(word) > 2 except select path, word from (select path, {word % 'body'} from kb_lines where path is not null)) group by 1",
        "shared_words": f"select case when k / n >= 0.75 then 'most' when k / n >= 0.5 then 'half' else 'less' end as part, count(*) as entries from (select entry_id, count(*) as n, count(h.word) as k from (select distinct entry_id, article as path, word from (select entry_id, article, {word % 'question'} from {_once('article', 'question')} where article is not null) where word not in ({_STOP}) and length(word) > 1) a left join (select distinct path, word from (select path, {word % 'body'} from kb_lines where path is not null)) h using (path, word) group by 1) group by 1",
        "closed_items": f"select lower(trim(item)) as item, count(*) as entries from {_once('item')} where item is not null and lower(trim(item)) not in (select lower(trim(item_id)) from work_items where status in ('done', 'dropped') and item_id is not null) group by 1",
    }
