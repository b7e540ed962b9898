"""Queries of corpus assembly, ledgers and their joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.operators import corpus as C
from quarrylight.operators import search as S
from quarrylight.plans.retrieval import _base, units
from quarrylight.session import table as t


def queries() -> dict:
    lines = lambda s, d: t(s, d, "kb_lines")
    cites = lambda s, d: C.cited(t(s, d, "run_entries"))
    return {
        "roots": lambda s, d: C.roots(lines(s, d)),
        "roots_served": lambda s, d: C.roots(lines(s, d), ("public", "_self")),
        "topic_files": lambda s, d: C.topic_files(lines(s, d)),
        "corpus_units": lambda s, d: C.union_units(lines(s, d), t(s, d, "work_items")).groupBy("part").agg(F.count("*").alias("units"), F.sum(F.length("text")).alias("chars")),
        "source_rows": lambda s, d: C.source_rows(t(s, d, "documents")),
        "source_lookup": lambda s, d: C.source_rows(t(s, d, "documents")).join(C.source_rows(t(s, d, "documents").where("lang = 'de'")).select("source"), "source", "left_semi"),
        "keyed_merge": lambda s, d: C.keyed_merge(t(s, d, "documents").select("doc_id", "source", "lang", "title", "topic", "retrieved_at"), "source", "retrieved_at", "doc_id", ["lang", "title", "topic"]),
        "context_refs": lambda s, d: C.context_refs(t(s, d, "coord_log")).groupBy("kind").agg(F.count("*").alias("events"), F.countDistinct("value").alias("things")),
        "code_pointers": lambda s, d: C.pointers(t(s, d, "documents")),
        "fact_expansions": lambda s, d: C.expansions(lines(s, d), cites(s, d)),
        "sources_per_line": lambda s, d: cites(s, d).where("line is not null").groupBy("line").agg(F.countDistinct("entry_id").alias("entries"), F.countDistinct("tag").alias("tags")),
        "citation_outcomes": lambda s, d: C.outcomes(lines(s, d), cites(s, d)),
        "anchor_breakdown": lambda s, d: C.outcomes(lines(s, d), cites(s, d)).groupBy(C.root_of(F.col("line")).alias("root"), F.when(F.col("outcome") == "valid", "located").otherwise("lost").alias("state")).agg(F.count("*").alias("anchors")),
        "glob_overlap": lambda s, d: C.touched(t(s, d, "work_items"), lines(s, d).select(F.concat(F.lit("kb/"), "path").alias("path"))),
        "feedback_flags": lambda s, d: C.flags(lines(s, d), cites(s, d)),
        "audit_full": lambda s, d: C.audit_full(lines(s, d), cites(s, d)),
        "line_history": lambda s, d: C.history(lines(s, d)),
        "moved_lines": lambda s, d: C.moved_lines(lines(s, d)),
        "index_refresh": lambda s, d: C.refresh(lines(s, d), "2025-06-30", "2025-12-31"),
        "postings_arrays": lambda s, d: C.postings_arrays(S.unit_terms(units(s, d)).where("n > 0").select("unit_id", "term", F.col("n").alias("tf"))),
        "facts_by_root": lambda s, d: lines(s, d).where("path is not null").groupBy(C.root_of(F.col("path")).alias("root"), "tag").agg(F.count("*").alias("facts"), F.count_if(F.col("removed_on").isNull()).alias("open")),
        "facts_by_prefix": lambda s, d: lines(s, d).where("path like 'public/devices/%' and tag in ('DOC', 'CODE')").select("path", "line_no", "added_on", "tag", "body"),
        "line_range": lambda s, d: lines(s, d).where(F.col("line_no").between(10, 20)).select("path", "line_no", "added_on", "body"),
        "topics_by_domain": lambda s, d: lines(s, d).where("path is not null").select(F.substring_index("path", "/", 2).alias("domain"), C.stem_of(F.col("path")).alias("topic")).distinct().groupBy("domain").agg(F.count("*").alias("topics"), F.array_join(F.array_sort(F.collect_list("topic")), ";").alias("names")),
        "opening_lines": lambda s, d: lines(s, d).where("path is not null and removed_on is null").groupBy("path", "section").agg(F.min_by("body", F.struct("line_no", "added_on")).alias("body"), F.min("line_no").alias("line_no")),
        "coverage_table": lambda s, d: lines(s, d).where("path is not null").groupBy("path").agg(F.countDistinct("line_no").alias("lines")).join(cites(s, d).where("line is not null").select(F.regexp_replace("line", r":\d+$", "").alias("path"), "entry_id").distinct().groupBy("path").agg(F.count("*").alias("used_in")), "path", "left").fillna({"used_in": 0}),
        "stale_by_domain": lambda s, d: t(s, d, "documents").where("retrieved_at is not null").groupBy(F.split_part("topic", F.lit("/"), F.lit(1)).alias("domain")).agg(F.count("*").alias("docs"), F.count_if(F.col("retrieved_at") < F.lit("2026-01-01").cast("timestamp")).alias("stale")),
        "source_delta": lambda s, d: t(s, d, "documents").where("source is not null and retrieved_at is not null").groupBy("source").agg(F.min("retrieved_at").alias("first")).groupBy(F.date_format("first", "yyyy-MM").alias("month")).agg(F.count("*").alias("new_sources")),
        "reading_queue": lambda s, d: t(s, d, "documents").groupBy("source").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"), F.count("*").alias("docs")),
        "host_share": lambda s, d: _shares(t(s, d, "documents")),
        "language_by_source": lambda s, d: S_usual(t(s, d, "documents").where("source is not null and lang is not null").select("source", F.lower("lang").alias("lang"))),
        "json_strings": lambda s, d: C.nested_strings(t(s, d, "coord_log").where("fields is not null").select("seq", "fields").distinct(), "seq", "fields").where("path = 'state'").groupBy("value").agg(F.countDistinct("seq").alias("events")),
        "retained_runs": lambda s, d: t(s, d, "run_headers").where("run is not null and store is not null").select("store", "run").distinct().withColumn("place", _newest()).where("place <= 3"),
        "result_handles": lambda s, d: t(s, d, "run_entries").where("question is not null").select(F.substring(F.sha2(F.concat_ws("|", F.trim(F.regexp_replace(F.lower("question"), r"\s+", " ")), F.coalesce("route", F.lit(""))), 256), 1, 12).alias("handle"), "entry_id").groupBy("handle").agg(F.countDistinct("entry_id").alias("entries")),
        "freshness_cues": lambda s, d: t(s, d, "run_entries").where(F.lower("question").rlike(r"\b(latest|newest|current|since|version|build)\b")).groupBy(F.regexp_extract(F.lower("question"), r"\b(latest|newest|current|since|version|build)\b", 1).alias("cue")).agg(F.countDistinct("entry_id").alias("entries")),
    }


def _newest():
    from pyspark.sql import Window as W

    return F.row_number().over(W.partitionBy("store").orderBy(F.desc("run"))).cast("bigint")


def S_usual(rows):
    from quarrylight.operators.ledger import usual

    return usual(rows, "source", "lang")


def _shares(docs):
    """source, docs, share: each source's share of its root's documents (the topic's first part)."""
    g = docs.where("source is not null").groupBy(F.coalesce(F.split_part("topic", F.lit("/"), F.lit(1)), F.lit("?")).alias("root"), "source").agg(F.count("*").alias("docs"))
    total = g.groupBy("root").agg(F.sum("docs").alias("total"))
    return g.join(total, "root").select("root", "source", "docs", F.round(F.col("docs") / F.col("total"), 6).alias("share"))


_CITED = "(select entry_id, day, question, c.line as line, c.tag as tag, c.verdict as verdict from (select entry_id, e.day as day, e.question as question, unnest(e.citations) as c from (select entry_id, arg_min(struct_pack(day := day, question := question, citations := citations), (loaded_at, run)) as e from run_entries where entry_id is not null group by 1)))"
_OUT = f"""with c as (select distinct line, try_cast(day as date) as day from {_CITED} where line is not null and try_cast(day as date) is not null),
k as (select path || ':' || line_no as line, path, body, added_on, removed_on from kb_lines where path is not null and line_no is not null),
p as (select c.line, c.day, coalesce(bool_or(k.added_on <= c.day and (k.removed_on is null or k.removed_on > c.day)), false) as valid, count(k.added_on) as known, min(k.added_on) as first, arg_max(k.body, k.added_on) filter (where k.added_on <= c.day) as body from c left join k using (line) group by 1, 2),
o as (select line, day, case when valid then 'valid' when known > 0 and first > day then 'later' when known > 0 and exists (select 1 from k where k.body = p.body and k.line <> p.line and k.added_on <= p.day and (k.removed_on is null or k.removed_on > p.day)) then 'moved' when known > 0 then 'ended' when regexp_replace(line, ':\\d+$', '') in (select path from k) then 'no line' else 'no path' end as outcome from p)
"""
_FLAGS = f"(select k.path, count(distinct (c.entry_id, c.line)) as flags from (select distinct entry_id, line, try_cast(day as date) as day from {_CITED} where verdict = 'missed' and line is not null) c join kb_lines k on k.path || ':' || k.line_no = c.line and k.added_on <= c.day and (k.removed_on is null or k.removed_on > c.day) group by 1)"
_SRC = "(select source, min(doc_id) as doc_id, arg_min(struct_pack(t := topic), doc_id).t as topic, count(*) as docs from documents where source is not null group by 1)"
_FP = "(select path, substr(sha256(string_agg(line_no || ' ' || coalesce(body, ''), chr(10) order by line_no, coalesce(body, ''))), 1, 16) as fp from kb_lines where path is not null and added_on <= date '{d}' and (removed_on is null or removed_on > date '{d}') group by 1)"
_ROOTS = "select root, files, lines, row_number() over (order by case root when 'public' then 0 when 'local' then 1 when '_self' then 2 else 3 end, root) as place from (select split_part(path, '/', 1) as root, count(distinct path) as files, count(*) as lines from kb_lines where path is not null and {w} group by 1)"
_STEM = r"regexp_replace(regexp_replace(path, '\.[a-z]+$', ''), '-(?:\d+|legacy)$', '')"
_CUE = r"\b(latest|newest|current|since|version|build)\b"


def _merged(c: str) -> str:
    full = f"{c} is not null and trim({c}) <> ''"
    at = "coalesce(retrieved_at, timestamp '1900-01-01')"
    return f"arg_max({c}, ({at}, -doc_id)) filter (where {full}) as {c}, max({at}) filter (where {full}) as m_{c}"


def oracle_sql() -> dict[str, str]:
    return {
        "roots": _ROOTS.format(w="true"),
        "roots_served": _ROOTS.format(w="split_part(path, '/', 1) in ('public', '_self')"),
        "topic_files": f"select topic, string_agg(path, ';' order by path) as files, count(*) as n from (select distinct {_STEM} as topic, path from kb_lines where path is not null) group by 1",
        "corpus_units": "select part, count(*) as units, cast(sum(length(text)) as bigint) as chars from (select case when tag is not null then 0 else 1 end as part, body as text from kb_lines where path is not null and line_no is not null union all select 2, max(concat_ws(' ', title, goal)) from work_items where item_id is not null group by lower(trim(item_id))) group by 1",
        "source_rows": f"select * from {_SRC}",
        "source_lookup": f"select * from {_SRC} where source in (select source from documents where lang = 'de')",
        "keyed_merge": f"""with m as (select source, {_merged("lang")}, {_merged("title")}, {_merged("topic")}, count(*) as merged from documents where source is not null group by 1),
n as (select d.source, {", ".join(f"count(distinct d.{c}) filter (where trim(d.{c}) <> '' and coalesce(d.retrieved_at, timestamp '1900-01-01') = m.m_{c}) as n_{c}" for c in ("lang", "title", "topic"))} from documents d join m using (source) group by 1)
select source, lang, title, topic, merged, cast((n_lang > 1)::int + (n_title > 1)::int + (n_topic > 1)::int as bigint) as conflicts from m join n using (source)""",
        "context_refs": "select kind, count(*) as events, count(distinct value) as things from (select seq, case when key like '%:%' then split_part(key, ':', 1) else 'item' end as kind, case when key like '%:%' then substr(key, position(':' in key) + 1) else key end as value from (select seq, max(fields ->> '$.key') as key from coord_log where json_valid(fields) and json_type(fields) = 'OBJECT' and fields ->> '$.key' is not null group by 1)) group by 1",
        "code_pointers": r"select split_part(p, '#', 1) as path, split_part(p, '#', 2) as symbol, count(*) as docs from (select distinct doc_id, unnest(regexp_extract_all(text, 'CODE [^\];]*?([\w./\-]+\.\w+#\w+)', 1)) as p from documents) group by 1, 2",
        "fact_expansions": rf"with k as (select distinct path || ':' || line_no as line, substr(sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))), 1, 12) as fact_key from kb_lines where tag is not null and body is not null) select fact_key, count(distinct question) as questions, min(question) as first from k join {_CITED} using (line) where question is not null and trim(question) <> '' group by 1",
        "sources_per_line": f"select line, count(distinct entry_id) as entries, count(distinct tag) as tags from {_CITED} where line is not null group by 1",
        "citation_outcomes": _OUT + "select * from o",
        "anchor_breakdown": _OUT + "select split_part(line, '/', 1) as root, case when outcome = 'valid' then 'located' else 'lost' end as state, count(*) as anchors from o group by 1, 2",
        "glob_overlap": r"""with g as (select pattern, count(distinct i) as items from (select lower(trim(item_id)) as i, unnest(touches) as pattern from work_items where item_id is not null) where trim(pattern) <> '' group by 1),
p as (select distinct 'kb/' || path as path from kb_lines where path is not null)
select pattern, count(path) as files, any_value(items) as items from g left join p on regexp_full_match(path, replace(replace(replace(regexp_replace(pattern, '([.+()\[\]{}^$|])', '\\\1', 'g'), '**', chr(1)), '*', '[^/]*'), chr(1), '.*')) group by 1""",
        "feedback_flags": f"select * from {_FLAGS}",
        "audit_full": f"""select a.path, facts, tagged, ended, gaps, coalesce(c.conflicts, 0) as conflicts, coalesce(f.flags, 0) as flags from (select path, count(*) as facts, count(tag) as tagged, count(removed_on) as ended, count(*) filter (where tag is null and removed_on is null) as gaps from kb_lines group by 1) a
left join (select path, count(*) as conflicts from (select path, body from kb_lines where removed_on is null and body is not null group by 1, 2 having count(distinct tag) > 1) group by 1) c using (path) left join {_FLAGS} f using (path)""",
        "line_history": "select path, line_no, count(*) as versions, count(distinct body) as texts, min(added_on) as first, max(added_on) as last, bool_or(removed_on is null) as open from kb_lines where path is not null and line_no is not null group by 1, 2",
        "moved_lines": r"with k as (select substr(sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))), 1, 12) as fact_key, path, path || ':' || line_no as line, added_on, removed_on from kb_lines where path is not null and body is not null) select a.fact_key, a.line as old_line, arg_min(b.line, (b.added_on, b.line)) as new_line from k a join k b on a.fact_key = b.fact_key and a.path <> b.path and b.added_on >= a.removed_on group by 1, 2",
        "index_refresh": f"select coalesce(a.path, b.path) as path, case when a.fp is null then 'add' when b.fp is null then 'drop' when a.fp = b.fp then 'keep' else 'rebuild' end as todo from {_FP.format(d='2025-06-30')} a full outer join {_FP.format(d='2025-12-31')} b on a.path = b.path",
        "postings_arrays": _base() + "select term, string_agg(unit_id, ';' order by unit_id) as units, string_agg(cast(n as varchar), ';' order by unit_id) as tfs from wt where n > 0 group by 1",
        "facts_by_root": "select split_part(path, '/', 1) as root, tag, count(*) as facts, count(*) filter (where removed_on is null) as open from kb_lines where path is not null group by 1, 2",
        "facts_by_prefix": "select path, line_no, added_on, tag, body from kb_lines where path like 'public/devices/%' and tag in ('DOC', 'CODE')",
        "line_range": "select path, line_no, added_on, body from kb_lines where line_no between 10 and 20",
        "topics_by_domain": f"select domain, count(*) as topics, string_agg(topic, ';' order by topic) as names from (select distinct array_to_string(string_split(path, '/')[1:2], '/') as domain, {_STEM} as topic from kb_lines where path is not null) group by 1",
        "opening_lines": "select path, section, arg_min(struct_pack(b := body), (line_no, added_on)).b as body, min(line_no) as line_no from kb_lines where path is not null and removed_on is null group by 1, 2",
        "coverage_table": rf"select path, lines, coalesce(used_in, 0) as used_in from (select path, count(distinct line_no) as lines from kb_lines where path is not null group by 1) left join (select regexp_replace(line, ':\d+$', '') as path, count(distinct entry_id) as used_in from {_CITED} where line is not null group by 1) using (path)",
        "stale_by_domain": "select split_part(topic, '/', 1) as domain, count(*) as docs, count(*) filter (where retrieved_at < timestamp '2026-01-01') as stale from documents where retrieved_at is not null group by 1",
        "source_delta": "select strftime(first, '%Y-%m') as month, count(*) as new_sources from (select source, min(retrieved_at) as first from documents where source is not null and retrieved_at is not null group by 1) group by 1",
        "reading_queue": "select source, cast(sum(coalesce(n_chars, 0)) as bigint) as chars, count(*) as docs from documents group by 1",
        "host_share": "select root, source, docs, round(docs / sum(docs) over (partition by root), 6) as share from (select coalesce(split_part(topic, '/', 1), '?') as root, source, count(*) as docs from documents where source is not null group by 1, 2)",
        "language_by_source": "select source, lang, count(*) as n from (select source, lower(lang) as lang from documents where source is not null and lang is not null) group by 1, 2 qualify row_number() over (partition by source order by n desc, lang) = 1",
        "json_strings": "select f ->> '$.state' as value, count(distinct seq) as events from (select seq, case when json_type(fields) = 'VARCHAR' then fields ->> '$' else fields end as f from coord_log where json_valid(fields)) where json_valid(f) and json_type(f) = 'OBJECT' and json_type(f, '$.state') = 'VARCHAR' group by 1",
        "retained_runs": "select store, run, row_number() over (partition by store order by run desc) as place from (select distinct store, run from run_headers where run is not null and store is not null) qualify place <= 3",
        "result_handles": r"select substr(sha256(trim(regexp_replace(lower(question), '\s+', ' ', 'g')) || '|' || coalesce(route, '')), 1, 12) as handle, count(distinct entry_id) as entries from run_entries where question is not null group by 1",
        "freshness_cues": rf"select regexp_extract(lower(question), '{_CUE}', 1) as cue, count(distinct entry_id) as entries from run_entries where regexp_matches(lower(question), '{_CUE}') group by 1",
    }
