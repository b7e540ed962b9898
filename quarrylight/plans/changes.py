"""Queries of document change analysis and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.operators import diff as D
from quarrylight.session import table as t


def queries() -> dict:
    return {
        "section_hash": lambda s, d: D.sections(t(s, d, "documents")),
        "exact_copies": lambda s, d: D.copies(t(s, d, "documents")),
        "title_located": lambda s, d: D.located(t(s, d, "documents"), t(s, d, "documents").where("title is not null").select("doc_id", F.col("title").alias("fact"))),
        "bootstrap_means": lambda s, d: D.bootstrap(t(s, d, "events").where("value is not null"), "event_type", "user_id", "value"),
    }


_LINES = r"""with raw as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) - 1 as pos from documents where text is not null),
l as (select doc_id, pos, line, coalesce(last_value(case when regexp_matches(line, '^#{1,6} ') then trim(regexp_replace(line, '^#+ ', '')) end ignore nulls) over (partition by doc_id order by pos), '') as heading from raw),
b as (select * from l where trim(line) <> '')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "section_hash": _LINES + "select doc_id, heading, count(*) as lines, substr(sha256(string_agg(trim(line), chr(10) order by pos)), 1, 16) as hash from b where not regexp_matches(line, '^#{1,6} ') group by 1, 2",
        "exact_copies": "select doc_id, min(doc_id) over (partition by text) as class_id, count(*) over (partition by text) as size from documents where text is not null",
        "title_located": _LINES + f""", n as (select doc_id, line, row_number() over (partition by doc_id order by pos) as n from b),
z as (select doc_id, count(*) as total from n group by 1),
a as (select distinct doc_id, w from (select doc_id, unnest(regexp_extract_all(lower(title), '{X.WORD}')) as w from documents where title is not null) where length(w) > 2 and not regexp_matches(w, '^\\d+$')),
lw as (select distinct doc_id, n, w from (select doc_id, n, unnest(regexp_extract_all(lower(line), '{X.WORD}')) as w from n)),
h as (select doc_id, n, w from lw join a using (doc_id, w)),
df as (select doc_id, w, ln((total + 1) / (count(*) + 0.5)) as weight from h join z using (doc_id) group by doc_id, w, total),
need as (select doc_id, sw + 0.5 * (asked - hit) as need from (select doc_id, count(*) as asked from a group by 1) join (select doc_id, sum(weight) as sw, count(*) as hit from df group by 1) using (doc_id)),
k as (select k, back from (values (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)) v(k, back)),
iw as (select distinct doc_id, n - back as start, k as lines, w from h, k),
g as (select iw.doc_id, start, lines, sum(weight) as got from iw join df using (doc_id, w) join z on z.doc_id = iw.doc_id where start >= 1 and start + lines - 1 <= total group by 1, 2, 3),
c as (select doc_id, start, lines, round(got / need - 0.05 * (lines - 1), 6) as cover from g join need using (doc_id))
select doc_id, start, lines, cover from c qualify row_number() over (partition by doc_id order by cover desc, start, lines) = 1 and cover >= 0.4""",
    }
