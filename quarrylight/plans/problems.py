"""Queries of the general training-data problems (p1 to p4) and their SQL."""

from __future__ import annotations

from quarrylight.operators import drift, hierarchy, nested, orphans
from quarrylight.session import table


def queries() -> dict:
    t = table
    return {
        "p1_found": lambda s, d: nested.child_records(t(s, d, "work_items"), t(s, d, "coord_log")),
        "p1_tables": lambda s, d: nested.relations(t(s, d, "work_items"), t(s, d, "coord_log")),
        "p2_found": lambda s, d: orphans.found(t(s, d, "work_items"), t(s, d, "run_entries"), t(s, d, "kb_lines")),
        "p2_counts": lambda s, d: orphans.snapshots(t(s, d, "work_items"), t(s, d, "run_entries"), t(s, d, "kb_lines")),
        "p3_found": lambda s, d: hierarchy.found(t(s, d, "work_items")),
        "p3_tree": lambda s, d: hierarchy.tree(t(s, d, "work_items")),
        "dependency_levels": lambda s, d: hierarchy.levels(t(s, d, "work_items")),
        "dependency_causes": lambda s, d: hierarchy.causes(t(s, d, "work_items")),
        "p4_found": lambda s, d: drift.changes(t(s, d, "run_headers")),
        "p4_alternatives": lambda s, d: drift.alternatives(t(s, d, "run_headers")),
        "p4_appearing": lambda s, d: drift.appearing(t(s, d, "run_headers")),
        "p4_table": lambda s, d: drift.table_of(t(s, d, "run_headers")),
        "p4_paths": lambda s, d: drift.path_alternatives(t(s, d, "run_headers")),
        "p4_unified": lambda s, d: drift.unified(t(s, d, "run_headers")),
    }


_DANGLING = """
with w as (select lower(trim(item_id)) as k, any_value(item_id) as item_id, min(filed_at) as filed_at, max(dropped_at) as dropped_at from work_items where item_id is not null group by 1),
r as (select item_id as s, filed_at as t, unnest(depends_on) as ref from work_items),
c as (select entry_id as s, try_cast(day as date) as t, unnest(citations).line as ref from run_entries),
found as (
select distinct 'work_items' as src_table, s as src_id, ref as ref_id, strftime(t, '%Y-%m') as period from r
where trim(ref) <> '' and s is not null and not exists (select 1 from w where k = lower(trim(ref)) and filed_at <= t and (dropped_at is null or dropped_at > t))
union all
select distinct 'run_entries', s, ref, strftime(t, '%Y-%m') from c
where trim(ref) <> '' and s is not null and not exists (select 1 from kb_lines k where k.path || ':' || k.line_no = ref and k.added_on <= t and (k.removed_on is null or k.removed_on > t)))
"""

_SNAPSHOTS = """
with span as (select min(loaded_at) as a, max(loaded_at) as b from work_items),
ends as (select 0 as epoch, a + to_microseconds(cast(floor(epoch_us(b) - epoch_us(a)) / 3 as bigint)) as till from span union all select 1, a + to_microseconds(cast(floor((epoch_us(b) - epoch_us(a)) * 2 / 3) as bigint)) from span union all select 2, timestamp '9999-01-01'),
ev as (select 'i' || k as key, filed_at as t, 1 as delta, arrived from (select lower(trim(item_id)) as k, min(filed_at) as filed_at, min(loaded_at) as arrived from work_items where item_id is not null group by 1) where filed_at is not null
union all select 'i' || k, dropped_at, -1, arrived from (select lower(trim(item_id)) as k, max(dropped_at) as dropped_at, min(loaded_at) as arrived from work_items where item_id is not null group by 1) where dropped_at is not null
union all select 'l' || path || ':' || line_no, cast(added_on as timestamp), 1, cast(added_on as timestamp) from (select distinct path, line_no, added_on, removed_on from kb_lines) where added_on is not null
union all select 'l' || path || ':' || line_no, cast(removed_on as timestamp), -1, cast(removed_on as timestamp) from (select distinct path, line_no, added_on, removed_on from kb_lines) where removed_on is not null),
rf as (select 'work_items' as src_table, item_id as s, ref, 'i' || lower(trim(ref)) as key, filed_at as t, loaded_at as arrived from (select item_id, filed_at, loaded_at, unnest(depends_on) as ref from work_items) where trim(ref) <> '' and item_id is not null
union all select 'run_entries', entry_id, ref, 'l' || ref, try_cast(day as timestamp), loaded_at from (select entry_id, day, loaded_at, unnest(citations).line as ref from run_entries) where trim(ref) <> '' and entry_id is not null),
r as (select epoch, src_table, s, ref, key, t, till from rf join ends on coalesce(arrived < till, true) group by all),
b as (select r.epoch, src_table, s, ref, r.t, coalesce(sum(delta), 0) as balance from r left join ev on ev.key = r.key and ev.t <= r.t and coalesce(ev.arrived < r.till, true) group by all)
select epoch, src_table, period, count(*) as orphans from (select distinct epoch, src_table, s, ref, strftime(t, '%Y-%m') as period from b where t is null or balance <= 0) group by all
"""

_TYPES = """
with f as (select store, run, max(cast(header as json)) as h from run_headers where json_valid(header) and json_type(header) = 'OBJECT' and store is not null and run is not null group by 1, 2),
k as (select store, run, h, unnest(json_keys(h)) as field from f),
v as (select store, run, h, field, case t when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'DOUBLE' then 'number' else 'integer' end as type
from (select *, json_type(h, '$."' || field || '"') as t from k) where t <> 'NULL')
"""

_CLOSURE = """
with recursive w as (select lower(trim(item_id)) as k, max(item_id) as v from work_items where trim(item_id) <> '' group by 1),
raw as (select 'parent' as link, lower(trim(item_id)) as a, lower(trim(parent)) as b from work_items
union select 'depends_on', lower(trim(item_id)), lower(trim(x)) from (select item_id, unnest(depends_on) as x from work_items)),
e as (select distinct link, s.v as u, d.v as v from raw join w s on s.k = a join w d on d.k = b),
r as (select link, u, v from e union select r.link, r.u, e.v from r join e on e.link = r.link and e.u = r.v)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _DANGLING + "select src_table, src_id, ref_id, period from found",
        "p2_counts": _SNAPSHOTS,
        "p3_found": _CLOSURE + "select link, u as item_id, v as reached_id from r",
        "p3_tree": _CLOSURE + """, pr as (select u, v from r where link = 'parent'), circ as (select distinct u from pr where u = v), tied as (select distinct u from pr where v in (select u from circ) union select u from circ),
d as (select w.v as item, (select count(*) from pr where pr.u = w.v) as depth, (select count(*) from pr where pr.v = w.v and pr.u <> w.v) as descendants from w),
up as (select pr.u, string_agg(pr.v, '/' order by d.depth) as above, arg_min(pr.v, d.depth) as root from pr join d on d.item = pr.v where pr.u not in (select u from tied) group by 1)
select item as item_id, case when item in (select u from tied) then null else coalesce(up.root, item) end as root_id, case when item in (select u from tied) then null else cast(depth as int) end as depth, case when item in (select u from tied) then null else concat_ws('/', up.above, item) end as path, descendants, case when item in (select u from circ) then 'circle' when item in (select u from tied) then 'below circle' else 'tree' end as state from d left join up on up.u = d.item""",
        "dependency_causes": _CLOSURE + """, c as (select w.v as item_id from work_items i join w on w.k = lower(trim(i.item_id)) where i.status in ('draft', 'dropped') group by 1),
b as (select distinct r.u as item_id, r.v as cause from r join c on c.item_id = r.v where link = 'depends_on')
select item_id, count(*) as causes, min(cause) as first_cause from b group by 1""",
        "dependency_levels": _CLOSURE + """, circle as (select distinct u from r where link = 'depends_on' and u = v), bad as (select u from circle union select u from r where link = 'depends_on' and v in (select u from circle)),
d as (select v as item, 0 as depth from w where v not in (select u from bad)
union select e.u, d.depth + 1 from d join e on e.link = 'depends_on' and e.v = d.item where e.u not in (select u from bad)),
m as (select item, max(depth) as depth from d group by 1)
select depth, count(*) as items from m group by 1""",
        "p4_alternatives": _TYPES + "select field, type, count(*) as files, min(run) as first_run from v group by 1, 2",
        "p4_appearing": _TYPES + "select *, row_number() over (partition by store, field order by first_run, type) as alternative from (select store, field, type, min(run) as first_run, count(*) as files from v group by 1, 2, 3)",
        "p4_table": _TYPES + "pivot (select store, run, 'h_' || field as field, regexp_replace(h ->> ('$.\"' || field || '\"'), '^(-?\\d+)\\.0+$', '\\1') as canonical from v) on field using max(canonical) group by store, run",
    }
