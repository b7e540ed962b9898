"""Retrieval queries over the kb lines, with the titles of the documents as questions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.operators import search as S
from quarrylight.session import table


def units(s, d, where=None):
    k = table(s, d, "kb_lines").where("path is not null and line_no is not null")
    if where:
        k = k.where(where)
    uid = F.concat("path", F.lit(":"), F.lpad(F.col("line_no").cast("string"), 6, "0"), F.lit(":"), F.col("added_on").cast("string")).alias("unit_id")
    return k.select(uid, "path", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("body", F.lit("")).alias("body"), F.col("tag").isNotNull().alias("tagged")).distinct()


def questions(s, d):
    return table(s, d, "documents").where("title is not null and trim(title) <> ''").select(F.col("title").alias("qid"), F.col("title").alias("question")).distinct()


# the words that are left out, written out once more for the SQL
_STOP = ", ".join(f"'{w}'" for w in """a an the and or of for to in on with is are be can how what which when where why does do it its by from as at
we our should about after all any also been but did has have into kb much long more not only same than that their then there these they this
those was were will would you your who whom whose doing get set use used using via per say says answer answers cite citation citations please
explain tell give describe briefly safely help need want know""".split())
_WORD = r"[\p{L}\p{N}\p{M}_]+(?:[.\-][\p{L}\p{N}\p{M}_]+)*"


def stemmed_sql(inner: str, keep: str) -> str:
    """A subquery with the column term, the stem of the column w of inner; keep: its other columns."""
    once = "case when length(w) > 6 and suffix(w, 'ies') then left(w, length(w) - 3) || 'y' when length(w) > 6 and suffix(w, 'ing') then left(w, length(w) - 3) when length(w) > 5 and suffix(w, 'ed') then left(w, length(w) - 2) when length(w) > 5 and suffix(w, 'es') then left(w, length(w) - 2) when length(w) > 4 and suffix(w, 's') and right(w, 2) not in ('ss', 'us', 'is') then left(w, length(w) - 1) else w end"
    for step in (once, once, "case when length(w) > 4 and right(w, 1) = 'e' then left(w, length(w) - 1) else w end", "case when length(w) > 3 and right(w, 1) = left(right(w, 2), 1) and regexp_matches(w, '[b-df-hjkmnp-rtv-z]$') then left(w, length(w) - 1) else w end"):
        inner = f"select {keep}, {step} as w from ({inner})"
    return f"(select {keep}, w as term from ({inner}))"


def _parts(src: str, keys: str, text: str) -> str:
    """keys, term, weight, whole, named of the parts of all words."""
    words = f"select {keys}, unnest(regexp_extract_all({text}, '{_WORD}')) as w from {src}"
    t = f"select {keys}, w, case when regexp_matches(lower(w), '^v\\d+\\.\\d') then substr(lower(w), 2) else lower(w) end as t from ({words})"
    a = f"select {keys}, w, t, list_distinct(list_concat([t], case when regexp_matches(t, '[.\\-]') then regexp_split_to_array(t, '[.\\-]') else [] end, case when contains(t, '-') then list_filter(string_split(t, '-'), lambda x: regexp_full_match(x, '\\d+(\\.\\d+)+')) else [] end)) as a, case when contains(w, '_') or regexp_matches(w, '[a-z][A-Z]') then list_distinct(list_transform(regexp_split_to_array(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[_.\\-]'), lambda x: lower(x))) else [] end as c from ({t})"
    p = f"select {keys}, w as word, t, unnest(list_concat(list_transform(a, lambda x: struct_pack(p := x, g := 1.0::double)), list_transform(list_filter(c, lambda x: not list_contains(a, x)), lambda x: struct_pack(p := x, g := 0.2::double)))) as x from ({a})"
    return stemmed_sql(f"select {keys}, x.p as w, x.g as weight, x.p = t as whole, x.p = t and regexp_matches(word, '[\\p{{Lu}}\\p{{N}}]') as named from ({p}) where x.p not in ({_STOP}) and length(x.p) > 1", f"{keys}, weight, whole, named")


def _base(where: str = "true") -> str:
    return f"""
with u as (select distinct path || ':' || lpad(cast(line_no as varchar), 6, '0') || ':' || cast(added_on as varchar) as unit_id, path, coalesce(section, '') as section, coalesce(body, '') as body, tag is not null as tagged, regexp_replace(path, '\\.[a-z]+$', '') as file from kb_lines where path is not null and line_no is not null and {where}),
q as (select distinct title as qid, title as question from documents where title is not null and trim(title) <> ''),
ow as (select unit_id, term from {_parts("u", "unit_id", "regexp_extract(file, '([^/]*)$', 1) || ' ' || section || ' ' || body")}),
fw as (select unit_id, term from {_parts("u", "unit_id", "regexp_replace(file, '[^/]*$', '')")}),
sm as (select path, term, count(*) * 0.1::double as more from {_parts("(select * from u where section like 'Summary%')", "path", "body")} group by 1, 2),
n0 as (select unit_id, term, count(*) as n, max(own) as own from (select unit_id, term, 1 as own from ow union all select unit_id, term, 0 from fw) group by 1, 2),
wt as (select coalesce(n0.unit_id, m.unit_id) as unit_id, coalesce(n0.term, m.term) as term, round(coalesce(n, 0) + coalesce(more, 0), 6) as tf, coalesce(n, 0) as n, coalesce(own, 0) = 1 as own from n0 full outer join (select u.unit_id, sm.term, more from u join sm using (path) where section not like 'Summary%') m on n0.unit_id = m.unit_id and n0.term = m.term),
t as (select unit_id, term from wt where own),
l as (select unit_id, cast(sum(n) as bigint) as len from wt group by 1),
f as (select term, count(*) as df from t group by 1),
st as (select (select avg(len) from l) as avg, (select count(*) from u) as n),
qt as (select qid, term, max(weight) as weight, bool_or(whole) as whole, bool_or(named) as named from {_parts("q", "qid", "question")} group by 1, 2),
p as (select wt.unit_id, wt.term, ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg)) as part from wt join l using (unit_id) join f using (term), st),
s as (select qid, unit_id, sum(weight * part) as s, count(*) as hits from qt join p using (term) group by 1, 2),
r as (select qid, unit_id, path, round(s * (case when section like 'Summary%' then 1.15 else 1.0 end) * (case when tagged then 1.0 else 0.8 end), 6) as score, hits from s join u using (unit_id))
"""


_TOP10 = "select qid, unit_id, path, score, hits, row_number() over (partition by qid order by score desc, unit_id) as pos from r qualify pos <= 10"
_CAP = "select qid, unit_id, path, score, hits, row_number() over (partition by qid order by score desc, unit_id) as pos from (select *, row_number() over (partition by qid, path order by score desc, unit_id) as ip from r qualify ip <= 2) qualify pos <= 10"
_INFO = ", info as (select qid, qt.term, coalesce(df, 0) as df, named from qt left join f using (term), st where whole and coalesce(df, 0) < greatest(0.2 * n, 2.0))"


def _fused(s, d):
    r = S.rank(units(s, d), questions(s, d))
    a = S.top(r, 20).select("qid", F.lit("score").alias("ranking"), F.col("unit_id").alias("item"), "pos")
    by_hits = r.withColumn("score", F.col("hits").cast("double"))
    b = S.top(by_hits, 20).select("qid", F.lit("hits").alias("ranking"), F.col("unit_id").alias("item"), "pos")
    return S.fuse(a.unionByName(b))


def _variants(s, d):
    w = table(s, d, "work_items").where("title is not null").select(F.col("kind").alias("key"), F.col("title").alias("variant"), F.explode(X.words(F.col("title"))).alias("word")).distinct()
    return S.stemmed(w).select("key", "variant", "term").distinct()


def queries() -> dict:
    return {
        "bm25_topk": lambda s, d: S.top(S.rank(units(s, d), questions(s, d)), 10),
        "bm25_topk_per_path_cap": lambda s, d: S.top(S.rank(units(s, d), questions(s, d)), 10, per_path=2),
        "bm25_domain_view": lambda s, d: S.top(S.rank(units(s, d, "path like 'public/%'"), questions(s, d)), 10),
        "bm25_as_of": lambda s, d: S.top(S.rank(units(s, d, "added_on <= date'2025-06-30' and (removed_on is null or removed_on > date'2025-06-30')"), questions(s, d)), 10),
        "lines_near_best": lambda s, d: S.lines_near_best(S.rank(units(s, d), questions(s, d))),
        "rrf_fusion": _fused,
        "postings_index": lambda s, d: S.postings(units(s, d)).select("unit_id", "term", "tf", "len", "df"),
        "vocabulary_df": lambda s, d: S.term_df(units(s, d)).select("term", "df"),
        "informative_words": lambda s, d: S.informative(units(s, d), questions(s, d)),
        "missing_words": lambda s, d: S.informative(units(s, d), questions(s, d)).where("df = 0").select("qid", "term"),
        "verdict_batch": lambda s, d: S.verdicts(units(s, d), questions(s, d)),
        "holders_division": lambda s, d: S.holders(units(s, d), _variants(s, d)),
        "budgeted_take": lambda s, d: S.take_within(S.top(S.rank(units(s, d), questions(s, d)), 40).join(units(s, d).select("unit_id", F.length("body").alias("cost")), "unit_id"), "cost", 800).select("qid", "unit_id", "score", "spent"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "bm25_topk": _base() + _TOP10,
        "bm25_topk_per_path_cap": _base() + _CAP,
        "bm25_domain_view": _base("path like 'public/%'") + _TOP10,
        "bm25_as_of": _base("added_on <= date '2025-06-30' and (removed_on is null or removed_on > date '2025-06-30')") + _TOP10,
        "lines_near_best": _base() + ", b as (select *, max(score) over (partition by qid) as best from r) select qid, unit_id, path, score, hits from b where score >= 0.4 * best qualify row_number() over (partition by qid, path order by score desc, unit_id) <= 6",
        "rrf_fusion": _base() + """, a as (select qid, 'score' as ranking, unit_id as item, row_number() over (partition by qid order by score desc, unit_id) as pos from r qualify pos <= 20
union all select qid, 'hits', unit_id, row_number() over (partition by qid order by hits desc, unit_id) as pos from r qualify pos <= 20)
select qid, item, round(sum(1.0::double / (60 + pos)), 9) as score, min(pos) as best from a group by 1, 2""",
        "postings_index": _base() + "select wt.unit_id, wt.term, tf, len, df from wt join l using (unit_id) join f using (term)",
        "vocabulary_df": _base() + "select term, df from f",
        "informative_words": _base() + _INFO + "select qid, term, df, named from info",
        "missing_words": _base() + _INFO + "select qid, term from info where df = 0",
        "verdict_batch": _base() + _INFO + """, ask as (select qid, count(*) as asked, count(*) filter (where df = 0) as missing, count(*) filter (where named) as names, count(*) filter (where named and df = 0) as lost, max(case when named then length(term) end) as longest from info group by 1),
best as (select qid, unit_id, path from r qualify row_number() over (partition by qid order by score desc, unit_id) <= 40),
h as (select best.qid, best.path, best.unit_id, info.term, info.named, u.tagged from best join info on info.qid = best.qid and info.df > 0 join t on t.unit_id = best.unit_id and t.term = info.term join u on u.unit_id = best.unit_id),
m as (select qid, max(hit) as hit, max(fact) as fact from (select qid, path, count(distinct term) as hit, count(distinct case when tagged then term end) as fact from h group by 1, 2) group by 1),
o as (select qid, max(one) as one from (select qid, unit_id, count(distinct term) as one from h where tagged group by 1, 2) group by 1),
w as (select qid, count(distinct term) as told from h where tagged and named group by 1),
j as (select q.qid, coalesce(asked, 0) as asked, coalesce(missing, 0) as missing, coalesce(names, 0) as names, coalesce(lost, 0) as lost, coalesce(longest, 0) as longest, coalesce(hit, 0) as hit, coalesce(fact, 0) as fact, coalesce(one, 0) as one, coalesce(told, 0) as told from q left join ask using (qid) left join m using (qid) left join o using (qid) left join w using (qid)),
k as (select *, hit / greatest(asked, 1) as share, fact / greatest(asked, 1) as fshare from j)
select qid, case when hit = 0 or (lost > 0 and lost * 3 >= names and not (names = 1 and longest <= 3 and share >= 0.75)) or missing * 2 >= asked or share < 0.34 then 'none' when fshare >= (case when missing > 0 then 0.8 else 0.6 end) and lost = 0 and told = names and one = asked - missing then 'good' else 'weak' end as verdict, round(share, 6) as share, cast(asked as bigint) as asked, cast(missing as bigint) as missing from k""",
        "holders_division": _base() + f""", v0 as (select distinct kind as key, title as variant from work_items where title is not null),
v as (select distinct key, variant, term from {stemmed_sql(f"select key, variant, w from (select key, variant, unnest(regexp_extract_all(lower(variant), '{_WORD}')) as w from v0) where w not in ({_STOP}) and length(w) > 1", "key, variant")}),
z as (select key, variant, count(distinct term) as size from v group by 1, 2),
h as (select key, variant, unit_id, count(distinct v.term) as hit from v join t using (term) group by 1, 2, 3)
select key, count(distinct unit_id) as units from h join z using (key, variant) where hit = size group by 1""",
        "budgeted_take": _base().replace("with u as", "with recursive u as", 1) + """, b as (select r.qid, r.unit_id, r.path, r.score, length(u.body) as cost, row_number() over (partition by r.qid order by r.score desc, r.unit_id) as pos from r join u using (unit_id) qualify pos <= 40),
o as (select *, row_number() over (partition by qid order by lead_pos, pos) as n from (select *, min(pos) over (partition by qid, path) as lead_pos from b)),
w as (select qid, unit_id, path, score, cost, n, case when cost <= 800 then cost else 0 end as spent, cost <= 800 as kept, case when cost <= 800 then '' else path end as shut from o where n = 1
union all select o.qid, o.unit_id, o.path, o.score, o.cost, o.n, case when w.shut <> o.path and w.spent + o.cost <= 800 then w.spent + o.cost else w.spent end, w.shut <> o.path and w.spent + o.cost <= 800, case when w.shut <> o.path and w.spent + o.cost <= 800 then w.shut else o.path end from w join o on o.qid = w.qid and o.n = w.n + 1)
select qid, unit_id, score, spent from w where kept""",
    }
