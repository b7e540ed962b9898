"""Queries of usage, cost, lifecycles and the coordination log, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import events as E
from quarrylight.operators import usage as U
from quarrylight.session import table as t


def queries() -> dict:
    ent = lambda s, d: t(s, d, "run_entries")
    log = lambda s, d: U.events_once(t(s, d, "coord_log"))
    return {
        "usage_rollup": lambda s, d: U.rollup(ent(s, d)),
        "tool_tree": lambda s, d: U.tool_tree(ent(s, d)),
        "failure_lines": lambda s, d: U.failures(ent(s, d)),
        "run_summary": lambda s, d: U.run_summary(ent(s, d)),
        "declared_counts": lambda s, d: U.declared(t(s, d, "run_headers"), ent(s, d)),
        "daily_usage": lambda s, d: U.daily(ent(s, d)),
        "expensive_articles": lambda s, d: U.expensive(ent(s, d)),
        "spend_table": lambda s, d: U.spend(ent(s, d)),
        "history_chain": lambda s, d: U.history(ent(s, d)),
        "claim_pairs": lambda s, d: U.pairs(log(s, d), "key", "kind", "claim", "release"),
        "lifecycle_durations": lambda s, d: U.lifecycles(log(s, d), t(s, d, "work_items"), "claimed", "released"),
        "state_as_of": lambda s, d: U.state_at(log(s, d), "2026-01-01"),
        "reopened_items": lambda s, d: U.reopened(log(s, d)),
        "open_questions": lambda s, d: U.open_questions(log(s, d)),
        "answer_join": lambda s, d: U.answered(log(s, d)),
        "operator_rollup": lambda s, d: U.operators(log(s, d)),
        "shape_problems": lambda s, d: U.shape_problems(log(s, d)),
        "breaker_windows": lambda s, d: U.breaker(t(s, d, "events"), "user_id", F.col("event_type") == "error", 2),
        "growth_ticks": lambda s, d: U.ticks(t(s, d, "events"), "user_id", "value"),
        "work_rework_split": lambda s, d: U.work_split(log(s, d), ent(s, d)),
        "stored_reuse": lambda s, d: U.reuse(ent(s, d)),
        "count_maps": lambda s, d: U.count_maps(t(s, d, "run_headers")),
        "agreement_scores": lambda s, d: U.agreement(ent(s, d)),
        "refused_moves": lambda s, d: _refused(s, log(s, d)),
        "oldest_unmet": lambda s, d: _oldest(log(s, d)),
        "stale_claims": lambda s, d: _stale(log(s, d)),
        "tick_of_kind": lambda s, d: log(s, d).groupBy("kind").agg(F.count("*").alias("events"), F.min("at_ts").alias("first"), F.max("at_ts").alias("last")),
        "log_after_cursor": lambda s, d: log(s, d).where("seq > 1000 and kind in ('progress', 'job')").select("seq", "kind", "item", "state"),
        "spool_kept": lambda s, d: _kept(log(s, d)),
        "owned_records": lambda s, d: E.windows(t(s, d, "events"), "view").select("user_id", "wid", "start_ts", "end_ts").join(E.assign(E.windows(t(s, d, "events"), "view"), t(s, d, "events").where("event_type <> 'view'")).groupBy("wid").agg(F.count("*").alias("owned")), "wid", "left").select("user_id", "wid", F.coalesce("owned", F.lit(0)).cast("bigint").alias("owned")),
        "surface_counts": lambda s, d: U.once(ent(s, d), "surface").groupBy("surface").agg(F.count("*").alias("entries")),
        "quantile_table": lambda s, d: U.once(ent(s, d), "verdict", "chars").where("chars is not null").groupBy("verdict").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by chars)").cast("bigint").alias("median"), F.expr("percentile_disc(0.95) within group (order by chars)").cast("bigint").alias("p95")),
        "arm_compare": lambda s, d: _arms(ent(s, d)),
        "item_spans": lambda s, d: E.runs(log(s, d).where("item is not null and state is not null").select("item", "state", "seq"), "item", "state", ["seq"]),
        "sidecar_months": lambda s, d: U.once(ent(s, d), "day", "surface").where("day is not null").groupBy(F.substring("day", 1, 7).alias("month"), "surface").agg(F.count("*").alias("records")),
        "judged_misses": lambda s, d: U.once(ent(s, d), "question", "citations").where("question is not null and size(citations) > 0").where(F.exists("citations", lambda c: c["verdict"].isin("missed", "partly"))).where(F.size(F.split(F.trim("question"), r"\s+")) <= 30).select("entry_id", "question"),
        "eval_totals": lambda s, d: _totals(ent(s, d)),
    }


def _refused(s, rows):
    allowed = s.createDataFrame([("claimed", "working"), ("claimed", "released"), ("working", "landing"), ("landing", "landed"), ("landing", "refused"), ("refused", "claimed"), ("returned", "claimed"), ("released", "claimed"), ("landed", "claimed")], "before string, state string")
    return E.refused(rows.where("item is not null and state is not null").select("item", "state", "seq"), "item", "state", "seq", allowed).select("item", "seq", "before", "state")


def _oldest(rows):
    """on, waiting, oldest: sessions whose last 'blocked' event is not 'cleared', and the age of the oldest in seconds."""
    now = rows.agg(F.max("at_ts").alias("now"))  # one row
    last = rows.where("kind = 'blocked' and session is not null").groupBy("session").agg(F.max_by(F.struct("state", "at_ts"), "seq").alias("e"))
    sec = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    return last.where("e.state is null or e.state <> 'cleared'").crossJoin(F.broadcast(now)).groupBy(F.coalesce("e.state", F.lit("?")).alias("state")).agg(F.count("*").alias("waiting"), F.max(sec("now") - sec("e.at_ts")).alias("oldest"))


def _stale(rows, hours=48):
    """key, holder, at_ts of the claims without a release that are older than so many hours at the log's end."""
    now = rows.agg(F.max("at_ts").alias("now"))  # one row
    last = rows.where("key is not null and kind in ('claim', 'release')").groupBy("key").agg(F.max_by(F.struct("kind", "holder", "at_ts"), "seq").alias("e"))
    return last.where("e.kind = 'claim'").crossJoin(F.broadcast(now)).where(F.expr(f"e.at_ts < now - interval {hours} hours")).select("key", "e.holder", "e.at_ts")


def _kept(rows, days=30):
    """kind, kept, dropped: rows that are too old, or whose job is done, leave the spool."""
    now = rows.agg(F.max("at_ts").alias("now"))  # one row
    done = rows.where("kind = 'job' and state = 'done'").select("job").distinct().withColumn("done", F.lit(True))
    j = rows.join(done, "job", "left").crossJoin(F.broadcast(now))
    keep = F.expr(f"at_ts >= now - interval {days} days") & F.col("done").isNull()
    return j.groupBy("kind").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def _arms(entries):
    """arm, route, n, hit, good, weak, none: the entries of two halves by hash, by route; hit: a citation answered."""
    e = U.once(entries, "route", "verdict", "citations")
    arm = F.when(F.conv(F.substring(F.sha2("entry_id", 256), 1, 2), 16, 10).cast("int") % 2 == 0, "off").otherwise("on")
    hit = F.coalesce(F.exists("citations", lambda c: F.coalesce(c["verdict"] == "answered", F.lit(False))), F.lit(False))
    return e.groupBy(arm.alias("arm"), "route").agg(F.count("*").alias("n"), F.count_if(hit).alias("hit"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("good", "weak", "none")])


def _totals(entries):
    """intent, n, verdict_ok, found_ok, passed, mean_chars: entries are expected good, with their article cited."""
    e = U.once(entries, "intent", "verdict", "article", "citations", "chars")
    ok = F.coalesce(F.col("verdict") == "good", F.lit(False))
    found = F.coalesce(F.exists("citations", lambda c: F.coalesce(F.regexp_replace(c["line"], r":\d+$", "") == F.col("article"), F.lit(False))), F.lit(False))
    return e.groupBy("intent").agg(F.count("*").alias("n"), F.count_if(ok).alias("verdict_ok"), F.count_if(found).alias("found_ok"), F.count_if(ok & found).alias("passed"), F.round(F.avg("chars"), 6).alias("mean_chars"))


def _f(k: str) -> str:
    return f"case when json_valid(fields) and json_type(fields) = 'OBJECT' then fields ->> '$.{k}' end as {'ref_to' if k == 'to' else k}"


_LOG = "(select distinct on (seq) seq, lower(kind) as kind, at_ts, " + ", ".join(_f(k) for k in ("item", "state", "key", "holder", "operator", "id", "ref", "to", "session", "job", "op", "target")) + " from coord_log where fields is not null order by seq, loaded_at)"


def _once(*cols: str) -> str:
    packed = ", ".join(f"{c} := {c}" for c in cols)
    return f"(select entry_id, {', '.join(f'e.{c} as {c}' for c in cols)} from (select entry_id, arg_min(struct_pack({packed}), (loaded_at, run)) as e from run_entries where entry_id is not null group by 1))"


_SEC = "date_diff('second', date_trunc('second', {a}), date_trunc('second', {b}))"
_SIZE = "case when chars is null or chars <= 0 then 'empty' when chars < 1000 then 'lt1k' when chars < 10000 then 'lt10k' when chars < 100000 then 'lt100k' else 'ge100k' end"
_ERR = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(question, '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S*', '<time>', 'g'), '0x[0-9a-fA-F]+|\b[0-9a-f]{8,}\b', '<id>', 'g'), '(?:/[\w.\-]+){2,}', '<path>', 'g'), '\d+', '<n>', 'g'), '\s+', ' ', 'g'))"
_SPANS = "(with e as (select item as k, seq, at_ts, case when state = 'refused' then 1 else -1 end as m from {log} where item is not null and state in ('refused', 'landed', 'released')), l as (select *, lag(m) over (partition by k order by seq) as pm from e), o as (select *, sum(case when m = 1 and coalesce(pm, -1) = -1 then 1 else 0 end) over (partition by k order by seq) as span from l) select lower(trim(k)) as k, cast(min(case when m = 1 then at_ts end) as date) as a, coalesce(cast(max(case when m = -1 then at_ts end) as date), date '9999-01-01') as b from o where span > 0 group by o.k, span)"


def oracle_sql() -> dict[str, str]:
    lacks = " union all ".join(f"select seq, kind, 'no {f}' as problem from l where kind = '{k}' and {'ref_to' if f == 'to' else f} is null" for k, fs in U.SHAPES.items() for f in fs)
    kinds = ", ".join(f"'{k}'" for k in U.SHAPES)
    tree = f"(select coalesce(surface, '?') as surface, coalesce(route, '?') as route, {_SIZE} as size_class, chars, coalesce(verdict = 'none', false) as bad from {_once('surface', 'route', 'chars', 'verdict')})"
    return {
        "usage_rollup": "select surface, case when item is null then 'main' else 'item' end as part, count(*) as entries, cast(sum(chars) as bigint) as chars from (select entry_id, max(chars) as chars, max(surface) as surface, max(item) as item from run_entries where entry_id is not null group by 1) group by 1, 2",
        "tool_tree": f"""with g as (select surface, route, size_class, count(*) as entries, count(*) filter (where bad) as bad, cast(sum(chars) as bigint) as chars, cast(grouping(surface, route, size_class) as bigint) as level from {tree} group by rollup (surface, route, size_class))
select g.*, case level when 1 then (select sum(entries) from g x where x.level = 0 and x.surface = g.surface and x.route = g.route) when 3 then (select sum(entries) from g x where x.level = 1 and x.surface = g.surface) when 7 then (select sum(entries) from g x where x.level = 3) end::bigint as parts from g""",
        "failure_lines": rf"select substr(sha256(line), 1, 12) as print, line, count(*) as entries, min(entry_id) as first from (select entry_id, {_ERR} as line from {_once('question')} where regexp_matches(lower(question), '\b(error|warning|fails?|failed)\b')) group by 1, 2",
        "run_summary": "select run, count(*) as entries, case min(case verdict when 'none' then 0 when 'weak' then 1 when 'good' then 2 end) when 0 then 'none' when 1 then 'weak' when 2 then 'good' end as worst, coalesce(string_agg(distinct surface, ';' order by surface), '') as surfaces, array_to_string(coalesce(list_sort(list(distinct article) filter (where article is not null)), [])[1:20], ';') as articles from (select run, entry_id, max(verdict) as verdict, max(surface) as surface, max(article) as article from run_entries where run is not null and entry_id is not null group by 1, 2) group by 1",
        "declared_counts": "select coalesce(h.run, e.run) as run, declared, found, case when declared is null then 'not declared' when found is null then 'no entries' when found > declared then 'more than declared' when found = declared then 'as declared' else 'fewer' end as state from (select run, try_cast(max(case when json_valid(header) then header ->> '$.counts.entries' end) as bigint) as declared from run_headers where run is not null group by 1) h full outer join (select run, count(distinct entry_id) as found from run_entries where run is not null and entry_id is not null group by 1) e on h.run = e.run",
        "daily_usage": f"select day, surface, count(*) as entries, cast(sum(chars) as bigint) as chars, count(distinct item) as items from {_once('day', 'surface', 'chars', 'item')} where day is not null group by 1, 2",
        "expensive_articles": f"select row_number() over (order by chars desc, article) as place, * from (select article, round(sum(share), 4) as chars, count(*) as entries from (select unnest(a) as article, chars / len(a) as share from (select list_distinct(articles) as a, chars from {_once('articles', 'chars')})) where article is not null group by 1 order by 2 desc, 1 limit 25)",
        "spend_table": f"select month, intent, count(*) as entries, cast(sum(chars) as bigint) as chars from (select coalesce(substr(day, 1, 7), '?') as month, coalesce(intent, '?') as intent, chars from {_once('day', 'intent', 'chars')}) group by rollup (month, intent)",
        "history_chain": f"select surface, array_to_string(list(n order by month), ' -> ') as chain, round(100.0 * (list(n order by month)[-1] - list(n order by month)[-2]) / list(n order by month)[-2], 4) as change from (select surface, substr(day, 1, 7) as month, count(*) as n from {_once('day', 'surface')} where day is not null and surface is not null group by 1, 2) group by 1",
        "claim_pairs": f"select key, started, at_ts as stopped, {_SEC.format(a='started', b='at_ts')} as seconds from (select key, kind, at_ts, lag(kind) over w as before, lag(at_ts) over w as started from {_LOG} where key is not null and kind in ('claim', 'release') window w as (partition by key order by seq)) where kind = 'release' and before = 'claim'",
        "lifecycle_durations": f"""with e as (select * from {_LOG} where item is not null and state in ('claimed', 'released')),
n as (select item, max(seq) as fin, arg_max(at_ts, seq) as end_ts from e where state = 'released' group by 1),
b as (select e.item, arg_max(at_ts, seq) as start_ts, max(fin) as fin, max(end_ts) as end_ts from e join n using (item) where state = 'claimed' and seq < fin group by 1),
d as (select kind, fin, b.item, {_SEC.format(a='start_ts', b='end_ts')} as s from b join (select lower(trim(item_id)) as k, max(kind) as kind from work_items where item_id is not null group by 1) on k = lower(trim(b.item))),
r as (select * from d where s >= 0 qualify row_number() over (partition by kind order by fin desc, item) <= 30),
q as (select kind, quantile_cont(s, 0.25) as a, quantile_cont(s, 0.75) as z, count(*) as m from r group by 1)
select kind, count(*) as n, round(quantile_cont(s, 0.25), 4) as p25, round(quantile_cont(s, 0.5), 4) as p50, round(quantile_cont(s, 0.75), 4) as p75 from r join q using (kind) where m < 4 or s <= z + 3 * (z - a) group by 1""",
        "state_as_of": f"select state, count(*) as items from (select item, arg_max(state, seq) as state from {_LOG} where item is not null and state is not null and at_ts <= timestamp '2026-01-01' group by 1) group by 1",
        "reopened_items": f"with e as (select * from {_LOG} where item is not null and state is not null), c as (select item, min(seq) as closed_seq from e where state in ('landed', 'completed') group by 1) select item, max(closed_seq) as closed_seq, min(seq) as reopened_seq from e join c using (item) where seq > closed_seq and state not in ('landed', 'completed') group by 1",
        "open_questions": f"select id, min(at_ts) as asked, arg_min(struct_pack(r := ref), seq).r as ref from {_LOG} where kind = 'ask' and id is not null and id not in (select id from {_LOG} where kind = 'answer' and id is not null) group by 1",
        "answer_join": f"""with l as (select * from {_LOG}), x as (select a.seq, a.id, (select min(seq) from l q where q.kind = 'ask' and q.id = a.id) as by_id, (select max(seq) from l q where q.kind = 'ask' and q.ref = a.ref and q.seq <= a.seq) as by_ref from l a where a.kind = 'answer')
select seq, id, coalesce(by_id, by_ref) as ask_seq, case when by_id is not null then 'id' when by_ref is not null then 'ref' else 'none' end as how from x""",
        "operator_rollup": f"select operator, count(*) as events, count(distinct kind) as kinds, count(distinct item) as items, max(at_ts) as last from {_LOG} where operator is not null group by 1",
        "shape_problems": f"with l as (select * from {_LOG}) {lacks} union all select seq, kind, 'unknown kind' from l where kind not in ({kinds})",
        "breaker_windows": "with g as (select *, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) as run from events), b as (select *, row_number() over (partition by user_id, run order by ts, event_id) as n from g where event_type = 'error') select user_id, cast(run as bigint) as run, max(case when n = 2 then ts end) as opened, count(*) as failures from b group by 1, 2 having count(*) >= 2",
        "growth_ticks": "select user_id, cast(ts as date) as day, count(*) as requests, count(*) filter (where value < 0.5 * pv) as compactions, count(*) filter (where event_type = pt) as repeats from (select *, lag(value) over w as pv, lag(event_type) over w as pt from events window w as (partition by user_id order by ts, event_id)) group by 1, 2",
        "work_rework_split": f"with e as (select entry_id, lower(trim(item)) as k, try_cast(day as date) as day, coalesce(chars, 0) as chars from {_once('item', 'day', 'chars')} where item is not null), s as {_SPANS.format(log=_LOG)} select k as item, cast(sum(chars) as bigint) as chars, cast(sum(case when exists (select 1 from s where s.k = e.k and e.day between s.a and s.b) then chars else 0 end) as bigint) as rework_chars, count(*) as entries from e group by 1",
        "stored_reuse": f"with p as (select lower(trim(question)) as question, try_cast(day as date) as day, count(*) as n from {_once('day', 'question')} where try_cast(day as date) is not null and lower(trim(question)) <> '' group by 1, 2), g as (select *, date_diff('day', lag(day) over (partition by question order by day), day) as gap from p) select question, cast(sum(n) as bigint) as asked, count(*) filter (where gap is null or gap > 7) as stored, cast(sum(n) as bigint) - count(*) filter (where gap is null or gap > 7) as reused from g group by 1 having sum(n) > 1",
        "count_maps": "with o as (select store, run, max(case when json_valid(header) and json_type(header) = 'OBJECT' and json_type(header, '$.counts') = 'OBJECT' then header ->> '$.counts' end) as c from run_headers where store is not null and run is not null group by 1, 2), m as (select store, name, try_cast(c ->> ('$.\"' || name || '\"') as bigint) as n from (select store, c, unnest(json_keys(c)) as name from o where c is not null)) select store, name, cast(sum(n) as bigint) as total, count(*) as files from m where n is not null group by 1, 2",
        "agreement_scores": f"with x as (select verdict = 'good' as p, len(list_filter(citations, lambda c: c.verdict = 'answered')) > 0 as t from {_once('verdict', 'citations')} where verdict is not null and len(citations) > 0), m as (select count(*) as n, count(*) filter (where p and t)::double as tp, count(*) filter (where p and not t)::double as fp, count(*) filter (where not p and t)::double as fn, count(*) filter (where not p and not t)::double as tn from x), a as (select *, (tp + tn) / n as acc, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) as pe from m) select n, round(acc, 6) as accuracy, round(tp / (tp + fp), 6) as \"precision\", round(tp / (tp + fn), 6) as recall, round((acc - pe) / (1 - pe), 6) as kappa from a",
        "refused_moves": f"select item, seq, before, state from (select item, seq, state, lag(state) over (partition by item order by seq) as before from {_LOG} where item is not null and state is not null) where before is not null and (before, state) not in (('claimed', 'working'), ('claimed', 'released'), ('working', 'landing'), ('landing', 'landed'), ('landing', 'refused'), ('refused', 'claimed'), ('returned', 'claimed'), ('released', 'claimed'), ('landed', 'claimed'))",
        "oldest_unmet": f"with l as (select * from {_LOG}), b as (select session, arg_max(struct_pack(s := state, a := at_ts), seq) as e from l where kind = 'blocked' and session is not null group by 1) select coalesce(e.s, '?') as state, count(*) as waiting, max({_SEC.format(a='e.a', b='(select max(at_ts) from l)')}) as oldest from b where e.s is null or e.s <> 'cleared' group by 1",
        "stale_claims": f"with l as (select * from {_LOG}), b as (select key, arg_max(struct_pack(k := kind, h := holder, a := at_ts), seq) as e from l where key is not null and kind in ('claim', 'release') group by 1) select key, e.h as holder, e.a as at_ts from b where e.k = 'claim' and e.a < (select max(at_ts) from l) - interval 48 hours",
        "tick_of_kind": f"select kind, count(*) as events, min(at_ts) as first, max(at_ts) as last from {_LOG} group by 1",
        "log_after_cursor": f"select seq, kind, item, state from {_LOG} where seq > 1000 and kind in ('progress', 'job')",
        "spool_kept": f"with l as (select *, at_ts >= (select max(at_ts) from {_LOG}) - interval 30 days and (job is null or job not in (select job from {_LOG} where kind = 'job' and state = 'done' and job is not null)) as keep from {_LOG}) select kind, count(*) filter (where keep) as kept, count(*) filter (where not keep) as dropped from l group by 1",
        "owned_records": "with w as (select user_id, event_id as wid, ts, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events where event_type = 'view') select w.user_id, wid, count(e.event_id) as owned from w left join events e on e.user_id = w.user_id and e.event_type <> 'view' and e.ts >= w.ts and (w.nxt is null or e.ts < w.nxt) group by 1, 2",
        "surface_counts": f"select surface, count(*) as entries from {_once('surface')} group by 1",
        "quantile_table": f"select verdict, count(*) as n, cast(quantile_disc(chars, 0.5) as bigint) as median, cast(quantile_disc(chars, 0.95) as bigint) as p95 from {_once('verdict', 'chars')} where chars is not null group by 1",
        "arm_compare": f"select case when ('0x' || substr(sha256(entry_id), 1, 2))::int % 2 = 0 then 'off' else 'on' end as arm, route, count(*) as n, count(*) filter (where len(list_filter(citations, lambda c: c.verdict = 'answered')) > 0) as hit, count(*) filter (where verdict = 'good') as good, count(*) filter (where verdict = 'weak') as weak, count(*) filter (where verdict = 'none') as none from {_once('route', 'verdict', 'citations')} group by 1, 2",
        "item_spans": f"with c as (select item, state, seq, case when state is distinct from lag(state) over (partition by item order by seq) then 1 else 0 end as fresh from {_LOG} where item is not null and state is not null), r as (select *, sum(fresh) over (partition by item order by seq rows unbounded preceding) as run from c) select item, cast(run as bigint) as run, any_value(state) as state, count(*) as length from r group by 1, 2",
        "sidecar_months": f"select substr(day, 1, 7) as month, surface, count(*) as records from {_once('day', 'surface')} where day is not null group by 1, 2",
        "judged_misses": rf"select entry_id, question from {_once('question', 'citations')} where question is not null and len(list_filter(citations, lambda c: c.verdict in ('missed', 'partly'))) > 0 and len(regexp_split_to_array(trim(question), '\s+')) <= 30",
        "eval_totals": rf"select intent, count(*) as n, count(*) filter (where ok) as verdict_ok, count(*) filter (where found) as found_ok, count(*) filter (where ok and found) as passed, round(avg(chars), 6) as mean_chars from (select intent, chars, coalesce(verdict = 'good', false) as ok, coalesce(len(list_filter(citations, lambda c: regexp_replace(c.line, ':\d+$', '') = article)) > 0, false) as found from {_once('intent', 'verdict', 'article', 'citations', 'chars')}) group by 1",
    }
