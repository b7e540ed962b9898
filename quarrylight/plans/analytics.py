"""Ledger, event, sequence, sampling, set and graph queries of the reference's operators, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.operators import events as E
from quarrylight.operators import ledger as L
from quarrylight.session import table as t


def _tags(s, d):
    return L.tag_rows(t(s, d, "documents"))


def _states(s, d):
    """Item states of the coordination log, each event once."""
    c = t(s, d, "coord_log").where("fields is not null").select("seq", F.lower("kind").alias("kind"), "at_ts", F.get_json_object("fields", "$.item").alias("item"), F.get_json_object("fields", "$.state").alias("state"), F.get_json_object("fields", "$.key").alias("key"), F.get_json_object("fields", "$.holder").alias("holder"))
    return c.dropDuplicates(["seq"])


_C = """(select distinct seq, lower(kind) as kind, at_ts, case when json_valid(fields) and json_type(fields) = 'OBJECT' then fields ->> '$.item' end as item, case when json_valid(fields) and json_type(fields) = 'OBJECT' then fields ->> '$.state' end as state, case when json_valid(fields) and json_type(fields) = 'OBJECT' then fields ->> '$.key' end as key, case when json_valid(fields) and json_type(fields) = 'OBJECT' then fields ->> '$.holder' end as holder from coord_log where fields is not null)"""
_TAGS = f"""(select doc_id, source, kind, ids from (select doc_id, source, regexp_extract(p, '^({"|".join(X.TAG_KINDS)})', 1) as kind, p from (select doc_id, source, unnest(regexp_split_to_array(tag, ';\\s*')) as p from (select doc_id, source, unnest(regexp_extract_all(text, '\\[((?:{"|".join(X.TAG_KINDS)})\\b[^\\]]*)\\]', 1)) as tag from documents)) where regexp_matches(p, '^({"|".join(X.TAG_KINDS)})\\b')) x, lateral (select regexp_extract_all(regexp_extract(trim(substr(p, length(kind) + 1)), '^([^:]*)', 1), '[A-Z]+-?[a-z0-9]+') as ids) y)"""


def queries() -> dict:
    ev = lambda s, d: t(s, d, "events")
    return {
        # scalars and projections
        "fact_key": lambda s, d: t(s, d, "kb_lines").select("path", "line_no", "added_on", X.fact_key(F.col("body")).alias("fact_key")),
        "token_counts": lambda s, d: t(s, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("bigint").alias("words"), F.size(F.array_distinct(X.words(F.col("text")))).cast("bigint").alias("distinct_words")),
        "size_classes": lambda s, d: t(s, d, "documents").groupBy(X.size_class(F.col("n_chars")).alias("size_class")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")),
        "entropy_lines": lambda s, d: t(s, d, "kb_lines").select(F.col("path"), F.col("line_no"), F.col("added_on"), X.entropy(F.col("body")).alias("entropy")),
        "url_normalize": lambda s, d: t(s, d, "kb_lines").select(X.url_normal(F.concat(F.lit("HTTPS://Docs.Example:443/"), "path", F.lit("/?#l"), F.col("line_no").cast("string"))).alias("url")).groupBy("url").agg(F.count("*").alias("lines")),
        "number_extraction": lambda s, d: t(s, d, "kb_lines").select(F.explode(X.numbers(F.col("body"))).alias("number")).groupBy("number").agg(F.count("*").alias("lines")),
        "version_maximum": lambda s, d: L.newest_versions(t(s, d, "run_entries")),
        "leak_scan": lambda s, d: t(s, d, "run_entries").select(F.explode(X.leaks(F.col("question"))).alias("l")).groupBy("l.kind").agg(F.count("*").alias("found"), F.countDistinct("l.value").alias("distinct_found")),
        "redact_questions": lambda s, d: t(s, d, "run_entries").where("question is not null").select(X.redact(F.col("question")).alias("redacted")).groupBy("redacted").agg(F.count("*").alias("entries")),
        "split_lists": lambda s, d: _states(s, d).where("item is not null").select("seq", F.explode(X.split_list(F.col("item"))).alias("part")).groupBy("part").agg(F.countDistinct("seq").alias("events")),
        "iso_week_counts": lambda s, d: t(s, d, "run_entries").dropDuplicates(["entry_id"]).groupBy(X.iso_week(F.to_timestamp("day")).alias("week")).agg(F.count("*").alias("entries")),
        "front_matter": lambda s, d: L.front_matter(t(s, d, "documents")).groupBy("priority", "status").agg(F.count("*").alias("docs")),
        "snapshot_jaccard": lambda s, d: L.line_similarity(t(s, d, "kb_lines")),
        # ledger
        "tag_kinds": lambda s, d: _tags(s, d).groupBy("kind").agg(F.count("*").alias("tags"), F.countDistinct("doc_id").alias("docs")),
        "reverse_index": lambda s, d: L.reverse_index(_tags(s, d)),
        "citation_semi": lambda s, d: _tags(s, d).select("doc_id", F.explode("ids").alias("id")).distinct().join(t(s, d, "documents").select(F.col("source").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("docs")),
        "citation_orphans": lambda s, d: _tags(s, d).select("doc_id", F.explode("ids").alias("id")).distinct().join(t(s, d, "documents").select(F.col("source").alias("id")).distinct(), "id", "left_anti").groupBy("id").agg(F.count("*").alias("docs")),
        "audit_rollup": lambda s, d: L.audit(t(s, d, "kb_lines")),
        "status_rollup": lambda s, d: t(s, d, "work_items").select("item_id", "kind", "status").distinct().rollup("kind", "status").agg(F.count("*").alias("items"), F.grouping_id().cast("bigint").alias("level")),
        "lang_topic_cube": lambda s, d: t(s, d, "documents").select(F.lower("lang").alias("lang"), F.split("topic", "/")[0].alias("domain")).cube("lang", "domain").agg(F.count("*").alias("docs"), F.grouping_id().cast("bigint").alias("level")),
        "usual_tag": lambda s, d: L.usual(t(s, d, "kb_lines").where("tag is not null"), "path", "tag"),
        "shared_context": lambda s, d: t(s, d, "work_items").select("item_id", F.explode("touches").alias("ref")).distinct().groupBy("ref").agg(F.count("*").alias("items")).where("items > 1"),
        "keyed_compare": lambda s, d: L.compare(t(s, d, "run_entries").where("day < '2026-02-01'"), t(s, d, "run_entries").where("day >= '2026-02-01'"), "article"),
        "golden_compare": lambda s, d: t(s, d, "kb_lines").select("path", "section").exceptAll(t(s, d, "kb_lines").where("tag is not null").select("path", "section")).groupBy("path").agg(F.count("*").alias("extra")),
        "article_sets": lambda s, d: t(s, d, "run_entries").select("article").intersect(t(s, d, "kb_lines").select(F.col("path").alias("article"))),
        "even_share": lambda s, d: E.even_share(t(s, d, "run_entries"), "articles", "chars"),
        "freshness": lambda s, d: L.freshness(t(s, d, "documents")),
        "change_interval": lambda s, d: L.change_interval(t(s, d, "run_headers")),
        "group_owner": lambda s, d: L.usual(t(s, d, "run_entries").dropDuplicates(["entry_id"]).where("item is not null").select("item", F.split("article", "/")[0].alias("domain")).where("domain is not null"), "item", "domain"),
        # events
        "sessionize_gap": lambda s, d: E.sessions(ev(s, d), 86_400),
        "prompt_windows": lambda s, d: E.windows(ev(s, d), "view"),
        "interval_assign": lambda s, d: E.assign(E.windows(ev(s, d), "view"), ev(s, d).where("event_type = 'purchase'")),
        "interval_leftovers": lambda s, d: E.leftovers(E.windows(ev(s, d), "view"), ev(s, d).where("event_type = 'purchase'")),
        "work_windows": lambda s, d: E.open_spans(_states(s, d).where("key is not null"), "key", "kind", ["claim"], ["release"]),
        "rework_windows": lambda s, d: E.open_spans(_states(s, d).where("item is not null"), "item", "state", ["returned"], ["landed", "released"]),
        "latest_state": lambda s, d: _states(s, d).where("item is not null and state is not null").groupBy("item").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("moves")),
        "state_moves": lambda s, d: E.moves(_states(s, d).where("item is not null and state is not null"), "item", "state", "seq"),
        "blocked_seconds": lambda s, d: E.held_seconds(_states(s, d).where("item is not null and state is not null"), "item", "state", "at_ts", "seq", "returned"),
        "lease_fold": lambda s, d: E.leases(_states(s, d).where("key is not null"), 7 * 86_400),
        "type_runs": lambda s, d: E.runs(ev(s, d), "user_id", "event_type", ["ts", "event_id"]),
        "request_growth": lambda s, d: E.growth(ev(s, d), "user_id", "value", ["ts", "event_id"]),
        "weekly_digest": lambda s, d: ev(s, d).groupBy(X.iso_week(F.col("ts")).alias("week"), "event_type").agg(F.count("*").alias("events"), F.count_if(F.col("value") > 100).alias("large"), F.expr("percentile_disc(0.5) within group (order by value)").alias("median")),
        "inclusive_quartiles": lambda s, d: ev(s, d).where("value is not null").groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.25)"), 6).alias("p25"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(value, 0.75)"), 6).alias("p75")),
        "outlier_trim": lambda s, d: E.trimmed(ev(s, d).where("value is not null"), "event_type", "value").groupBy("event_type").agg(F.count("*").alias("kept"), F.round(F.max("value"), 6).alias("most")),
        "repeat_detector": lambda s, d: E.repeats(ev(s, d), "user_id", "event_type", 3),
        "lag_change": lambda s, d: L.month_change(t(s, d, "orders")),
        "tiered_pricing": lambda s, d: L.priced(t(s, d, "lineitem"), [(0, 1.0), (10, 0.95), (25, 0.9), (40, 0.8)]),
        "usage_grouping_sets": lambda s, d: t(s, d, "run_entries").dropDuplicates(["entry_id"]).rollup("surface", "route").agg(F.count("*").alias("entries"), F.sum("chars").alias("chars"), F.grouping_id().cast("bigint").alias("level")),
        "once_per_request": lambda s, d: t(s, d, "run_entries").groupBy("entry_id").agg(F.max("chars").alias("chars"), F.max("surface").alias("surface")).groupBy("surface").agg(F.count("*").alias("requests"), F.sum("chars").alias("chars")),
        "error_groups": lambda s, d: t(s, d, "run_entries").select("entry_id", F.explode(F.regexp_extract_all("question", F.lit(r"\b(0x[0-9A-F]{8}|E\d{4})\b"), F.lit(1))).alias("code")).distinct().groupBy("code").agg(F.count("*").alias("entries")),
        # sampling, order
        "stratified_round_robin": lambda s, d: L.round_robin(t(s, d, "documents").select("doc_id", F.coalesce(F.lower("lang"), F.lit("?")).alias("lang")), "lang", "doc_id", 100),
        "half_split": lambda s, d: t(s, d, "documents").select("doc_id", (F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2), 16, 10).cast("int") % 2).cast("bigint").alias("half")),
        "per_kind_sample": lambda s, d: L.per_kind(t(s, d, "work_items").select("item_id", "kind").distinct(), "kind", "item_id", 5),
        "rotation_order": lambda s, d: L.rotated(t(s, d, "supplier").select("s_suppkey"), "s_suppkey", 40),
        "first_wins": lambda s, d: L.first_wins(t(s, d, "kb_lines").select("body", "path", "line_no", "added_on"), "body", ["path", "line_no", "added_on"]).select("body", "path", "line_no"),
        "best_cut": lambda s, d: L.best_cut(ev(s, d).where("value is not null"), F.col("event_type") == "purchase", "value", [float(x) for x in range(0, 200, 5)]),
        "confusion": lambda s, d: t(s, d, "run_entries").dropDuplicates(["entry_id"]).groupBy("intent", "verdict").agg(F.count("*").alias("entries")),
        "phrase_runs": lambda s, d: L.phrase_runs(t(s, d, "kb_lines")),
        # relational
        "pricing_summary": lambda s, d: t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines")),
        "nation_revenue": lambda s, d: t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")),
        "customers_without_orders": lambda s, d: t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name"),
        "as_of_order": lambda s, d: E.as_of(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts")), t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status")), ["l_orderkey"], "ts", ["status"]),
        "vector_neighbours": lambda s, d: L.neighbours(t(s, d, "embeddings"), 5),
    }


_ONE = "(select distinct on (entry_id) * from run_entries order by entry_id, loaded_at, run)"
_WIN = "(select user_id, event_id as wid, ts as start_ts, coalesce(lead(ts) over (partition by user_id order by ts, event_id), timestamp '9999-01-01') as end_ts from events where event_type = 'view')"
_HIT = f"(select p.event_id, p.user_id, w.wid, w.start_ts from (select * from events where event_type = 'purchase') p join {_WIN} w on w.user_id = p.user_id and w.start_ts <= p.ts and p.ts <= w.end_ts qualify row_number() over (partition by p.event_id order by w.start_ts desc, w.wid desc) = 1)"


def _spans(src: str, key: str, col: str, opens: str, closes: str) -> str:
    return f"""with e as (select {key} as k, seq, at_ts, case when {col} in ({opens}) then 1 when {col} in ({closes}) then -1 end as m from {src} where {key} is not null and {col} in ({opens}, {closes})),
l as (select *, lag(m) over (partition by k order by seq) as pm from e),
o as (select k, seq, at_ts, m, sum(case when m = 1 and coalesce(pm, -1) = -1 then 1 else 0 end) over (partition by k order by seq) as span from l)
select k as key, span, min(case when m = 1 then at_ts end) as opened, max(case when m = -1 then at_ts end) as closed, count(*) as events from o where span > 0 group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    W_ = X.WORD
    return {
        "fact_key": r"select path, line_no, added_on, substr(sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))), 1, 12) as fact_key from kb_lines",
        "token_counts": f"select doc_id, coalesce(len(regexp_extract_all(lower(text), '{W_}')), 0) as words, coalesce(len(list_distinct(regexp_extract_all(lower(text), '{W_}'))), 0) as distinct_words from documents",
        "size_classes": "select case when n_chars is null or n_chars <= 0 then 'empty' when n_chars < 1000 then 'lt1k' when n_chars < 10000 then 'lt10k' when n_chars < 100000 then 'lt100k' else 'ge100k' end as size_class, count(*) as docs, cast(sum(n_chars) as bigint) as chars from documents group by 1",
        "number_extraction": r"select number, count(*) as lines from (select unnest(list_distinct(list_transform(regexp_extract_all(body, '\d+(?:[.,]\d+)*'), lambda n: replace(n, ',', '')))) as number from kb_lines) group by 1",
        "split_lists": f"select part, count(distinct seq) as events from (select seq, trim(unnest(regexp_split_to_array(regexp_replace(regexp_replace(item, '^\\s*\\[', ''), '\\]\\s*$', ''), '[,;]'))) as part from {_C} where item is not null) where part <> '' group by 1",
        "iso_week_counts": f"select cast(isoyear(day::date) as varchar) || '-W' || lpad(cast(week(day::date) as varchar), 2, '0') as week, count(*) as entries from {_ONE} group by 1",
        "tag_kinds": f"select kind, count(*) as tags, count(distinct doc_id) as docs from {_TAGS} group by 1",
        "reverse_index": f"select id, string_agg(cast(doc_id as varchar), ';' order by doc_id) as used_in, count(*) as docs from (select distinct doc_id, unnest(ids) as id from {_TAGS}) group by 1",
        "citation_semi": f"select id, count(*) as docs from (select distinct doc_id, unnest(ids) as id from {_TAGS}) where id in (select source from documents) group by 1",
        "citation_orphans": f"select id, count(*) as docs from (select distinct doc_id, unnest(ids) as id from {_TAGS}) where not exists (select 1 from documents where source = id) group by 1",
        "audit_rollup": "select path, count(*) as facts, count(tag) as tagged, count(*) filter (where tag = 'DOC') as doc, count(*) filter (where tag = 'CODE') as code, count(*) filter (where tag = 'DER') as der, count(*) filter (where tag = 'COMMUNITY') as community, count(*) filter (where tag = 'UNK') as unk, count(*) filter (where removed_on is not null) as ended from kb_lines group by 1",
        "status_rollup": "select kind, status, count(*) as items, cast(grouping(kind, status) as bigint) as level from (select distinct item_id, kind, status from work_items) group by rollup (kind, status)",
        "lang_topic_cube": "select lang, domain, count(*) as docs, cast(grouping(lang, domain) as bigint) as level from (select lower(lang) as lang, split_part(topic, '/', 1) as domain from documents) group by cube (lang, domain)",
        "usual_tag": "select path, tag, n from (select path, tag, count(*) as n from kb_lines where tag is not null group by 1, 2) qualify row_number() over (partition by path order by n desc, tag) = 1",
        "shared_context": "select ref, count(*) as items from (select distinct item_id, unnest(touches) as ref from work_items) group by 1 having count(*) > 1",
        "keyed_compare": "with a as (select article, count(distinct entry_id) as n from run_entries where day < '2026-02-01' and article is not null group by 1), b as (select article, count(distinct entry_id) as n from run_entries where day >= '2026-02-01' and article is not null group by 1) select coalesce(a.article, b.article) as key, a.n as old, b.n as new, case when a.n is null then 'added' when b.n is null then 'removed' when a.n = b.n then 'same' else 'changed' end as state from a full outer join b on a.article = b.article",
        "golden_compare": "select path, count(*) as extra from (select path, section from kb_lines except all select path, section from kb_lines where tag is not null) group by 1",
        "article_sets": "select article from run_entries intersect select path from kb_lines",
        "even_share": "select part, round(sum(chars / n), 6) as share, count(*) as entries from (select entry_id, chars, len(list_distinct(articles)) as n, unnest(list_distinct(articles)) as part from (select entry_id, any_value(articles) as articles, max(chars) as chars from run_entries group by 1)) where part is not null group by 1",
        "freshness": "select source, count(*) as docs, max(retrieved_at) as newest, date_diff('day', max(cast(retrieved_at as date)), date '2026-06-30') as age_days, date_diff('day', max(cast(retrieved_at as date)), date '2026-06-30') > 180 as stale from documents where retrieved_at is not null group by 1",
        "group_owner": f"select item, domain, n from (select item, split_part(article, '/', 1) as domain, count(*) as n from {_ONE} where item is not null and article is not null group by 1, 2) qualify row_number() over (partition by item order by n desc, domain) = 1",
        "sessionize_gap": "with g as (select *, case when date_diff('second', lag(ts) over (partition by user_id order by ts, event_id), ts) > 86400 or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g) select user_id, cast(session as bigint) as session, min(ts) as started, max(ts) as ended, count(*) as events from s group by 1, 2",
        "prompt_windows": f"select user_id, wid, start_ts, end_ts from {_WIN}",
        "interval_assign": f"select event_id, user_id, wid, start_ts from {_HIT}",
        "interval_leftovers": f"select event_id, user_id from events where event_type = 'purchase' and event_id not in (select event_id from {_HIT})",
        "work_windows": _spans(_C, "key", "kind", "'claim'", "'release'"),
        "rework_windows": _spans(_C, "item", "state", "'returned'", "'landed', 'released'"),
        "latest_state": f"select item, arg_max(state, seq) as state, count(*) as moves from {_C} where item is not null and state is not null group by 1",
        "state_moves": f"select before, state, count(*) as moves from (select item, state, lag(state) over (partition by item order by seq) as before from {_C} where item is not null and state is not null) group by 1, 2",
        "blocked_seconds": f"select item as key, cast(sum(date_diff('second', at_ts, nxt)) as bigint) as seconds, count(*) as times from (select item, state, date_trunc('second', at_ts) as at_ts, date_trunc('second', lead(at_ts) over (partition by item order by seq)) as nxt from {_C} where item is not null and state is not null) where state = 'returned' and nxt is not null group by 1",
        "entropy_lines": "select path, line_no, added_on, case when body is not null then round(coalesce(list_aggregate(list_transform(list_distinct(ch), lambda c: -(len(list_filter(ch, lambda y: y = c))::double / len(ch)) * log2(len(list_filter(ch, lambda y: y = c))::double / len(ch))), 'sum'), 0.0) + 0.0, 6) end as entropy from (select *, regexp_extract_all(body, '(?s).') as ch from kb_lines)",
        "version_maximum": r"select product, arg_max(version, (list_transform(string_split(version, '.'), lambda x: x::int), version)) as version from (select distinct lower(regexp_extract(question, '(?i)why does (\w+) ignore', 1)) as product, regexp_extract(question, '(?i)on build (\d+(?:\.\d+)+)', 1) as version from run_entries) where product <> '' and version <> '' group by 1",
        "url_normalize": r"select regexp_replace(regexp_replace(head, '^(http://[^/]*?):80$', '\1'), '^(https://[^/]*?):443$', '\1') || regexp_replace(substr(x, length(head) + 1), '/(\?|$)', '\1', 'g') as url, count(*) as lines from (select x, lower(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*')) as head from (select regexp_replace(regexp_replace('HTTPS://Docs.Example:443/' || path || '/?#l' || line_no, '#.*$', ''), '\?$', '') as x from kb_lines)) group by 1",
        "lease_fold": f"with l as (select * from {_C} where key is not null), b as (select key, arg_max(struct_pack(k := kind, h := holder, a := at_ts), seq) as e from l where kind in ('claim', 'release') group by 1) select key, e.h as holder, e.a as since, e.a + interval 7 days as lapses from b where e.k = 'claim' and e.a + interval 7 days > (select max(at_ts) from l)",
        "change_interval": """with o as (select store, run, max(case when json_valid(header) and json_type(header) = 'OBJECT' then coalesce(header ->> '$.kb_commit', header ->> '$.kbCommit', header ->> '$.commit', header ->> '$.kb_sha') end) as c from run_headers where store is not null and run is not null group by 1, 2),
m as (select store, try_strptime(substr(run, 1, 15), '%Y%m%dT%H%M%S') as at_, case when lag(c) over (partition by store order by run) is null then null when c <> lag(c) over (partition by store order by run) then 1 else 0 end as moved from o where c is not null),
g as (select store, count(*) as checks, coalesce(cast(sum(moved) as bigint), 0) as changes, date_diff('second', min(at_), max(at_)) / 86400.0::double as days from m group by 1)
select store, checks, changes, case when checks >= 2 and changes >= 2 then round((days / (checks - 1)) / -ln((checks - 1 - least(changes, checks - 1) + 0.5::double) / (checks - 1 + 0.5::double)), 6) end as mean_days from g""",
        "type_runs": "with c as (select *, case when event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id) then 1 else 0 end as fresh from events), r as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from c) select user_id, cast(run as bigint) as run, any_value(event_type) as event_type, count(*) as length from r group by 1, 2",
        "request_growth": "select user_id, round(sum(case when nxt >= value then nxt - value else 0 end), 6) as growth, count(case when nxt >= value then 1 end) as steps from (select user_id, value, lead(value) over (partition by user_id order by ts, event_id) as nxt from events) group by 1",
        "weekly_digest": "select cast(isoyear(ts) as varchar) || '-W' || lpad(cast(week(ts) as varchar), 2, '0') as week, event_type, count(*) as events, count(*) filter (where value > 100) as large, quantile_disc(value, 0.5) as median from events group by 1, 2",
        "inclusive_quartiles": "select event_type, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75 from events where value is not null group by 1",
        "outlier_trim": "with q as (select event_type, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, count(*) as n from events where value is not null group by 1) select e.event_type, count(*) as kept, round(max(value), 6) as most from events e join q using (event_type) where value is not null and (n < 4 or value <= b + 3 * (b - a)) group by 1",
        "repeat_detector": "with w as (select *, cast(isoyear(ts) as varchar) || '-W' || lpad(cast(week(ts) as varchar), 2, '0') as week from events), l as (select max(week) as last from w) select user_id, event_type, count(*) as times from w, l where week = (select max(week) from w where week < last) group by 1, 2 having count(*) >= 3",
        "lag_change": "with m as (select strftime(o_orderdate, '%Y-%m') as month, round(sum(o_totalprice), 2) as total from orders group by 1) select month, total, round(100 * (total - lag(total) over (order by month)) / lag(total) over (order by month), 4) as change from m",
        "tiered_pricing": "select tier, count(*) as lines, round(sum(l_extendedprice * factor), 2) as price from (select l_extendedprice, case when l_quantity >= 40 then 40 when l_quantity >= 25 then 25 when l_quantity >= 10 then 10 else 0 end as tier, case when l_quantity >= 40 then 0.8::double when l_quantity >= 25 then 0.9::double when l_quantity >= 10 then 0.95::double else 1.0::double end as factor from lineitem) group by 1",
        "usage_grouping_sets": "select surface, route, count(*) as entries, cast(sum(chars) as bigint) as chars, cast(grouping(surface, route) as bigint) as level from (select distinct on (entry_id) * from run_entries order by entry_id) group by rollup (surface, route)",
        "once_per_request": "select surface, count(*) as requests, cast(sum(chars) as bigint) as chars from (select entry_id, max(chars) as chars, max(surface) as surface from run_entries group by 1) group by 1",
        "error_groups": r"select code, count(*) as entries from (select distinct entry_id, unnest(regexp_extract_all(question, '\b(0x[0-9A-F]{8}|E\d{4})\b', 1)) as code from run_entries) group by 1",
        "stratified_round_robin": "with r as (select doc_id, lang, row_number() over (partition by lang order by sha256(cast(doc_id as varchar)), doc_id) as turn from (select doc_id, coalesce(lower(lang), '?') as lang from documents)) select doc_id, lang, turn from r order by turn, lang limit 100",
        "half_split": "select doc_id, cast(('0x' || substr(sha256(cast(doc_id as varchar)), 1, 2))::int % 2 as bigint) as half from documents",
        "per_kind_sample": "select item_id, kind from (select distinct item_id, kind from work_items) qualify row_number() over (partition by kind order by sha256(item_id), item_id) <= 5",
        "rotation_order": "select s_suppkey, row_number() over (order by s_suppkey <= 40, s_suppkey) as pos from supplier",
        "first_wins": "select body, path, line_no from kb_lines where body is not null qualify row_number() over (partition by body order by path, line_no, added_on) = 1",
        "best_cut": "with g as (select cast(range as double) as cut from range(0, 200, 5)), s as (select cut, sum(case when event_type = 'purchase' and value >= cut then 1 else 0 end)::double / sum(case when event_type = 'purchase' then 1 else 0 end) as hit, sum(case when event_type <> 'purchase' and value < cut then 1 else 0 end)::double / sum(case when event_type <> 'purchase' then 1 else 0 end) as rejected from events, g where value is not null group by 1) select cut, round((hit + rejected) / 2, 6) as balanced from s order by 2 desc, 1 limit 1",
        "confusion": f"select intent, verdict, count(*) as entries from {_ONE} group by 1, 2",
        "pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from lineitem group by 1, 2",
        "nation_revenue": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
        "customers_without_orders": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)",
        "as_of_order": "select l.l_orderkey, l.l_linenumber, l.l_shipdate as ts, o.o_orderstatus as status from lineitem l left join orders o on o.o_orderkey = l.l_orderkey and o.o_orderdate <= l.l_shipdate",
        "vector_neighbours": "select a.vec_id, b.vec_id as neighbour, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as similarity, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) desc, b.vec_id) as pos from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id qualify pos <= 5",
    }
