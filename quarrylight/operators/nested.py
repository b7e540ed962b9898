"""Deeply nested JSON records into related flat tables, by shared inlining.

1. ``schema_graph`` reads every record and fuses what it sees into a graph of elements: which label holds which
   label, and whether it ever stands in a list.
2. ``inline_plan`` decides on the relations: the root, and each element that is repeated, shared by several parents
   or recursive, get a table; every other element (a singleton descendant) is inlined into its table ancestor.
3. ``shred`` writes the rows of all relations with their foreign keys: record, parent relation, parent row and the
   positions from the root down.

Conventions (defined results for dirty input): what stands alone where a list may stand is a list of one; JSON text
inside a JSON string counts as what it holds; null, blank and empty values give no row but keep their position;
an object whose values are all objects, under a label named in ``keyed``, is the list of its values; text that is no
JSON is a plain string. Duplicate deliveries are the caller's business (``latest``).
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "relation string, parent string, record_id string, row_id string, parent_id string, pos array<int>, fields map<string,string>"


_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def deep_loads(text: str) -> object:
    """json.loads with a stack of its own, for texts nested deeper than Python's."""
    at, n = 0, len(text)
    stack: list = []  # (container, key that waits for its value)
    atoms = {"true": True, "false": False, "null": None}

    def blank(i: int) -> int:
        return _BLANK.match(text, i).end()

    while True:
        at = blank(at)
        c = text[at : at + 1]
        if c in ("{", "["):
            box: dict | list = {} if c == "{" else []
            at = blank(at + 1)
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
                value: object = box
            else:
                key = None
                if c == "{":
                    if text[at : at + 1] != '"':
                        raise ValueError(f"no key at {at}")
                    key, at = scanstring(text, at + 1)
                    at = blank(at)
                    if text[at : at + 1] != ":":
                        raise ValueError(f"no colon at {at}")
                    at += 1
                stack.append((box, key))
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1)
        else:
            m = _ATOM.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            at = m.end()
            value = atoms[m[0]] if m[0] in atoms else json.loads(m[0])
        # the value goes into what waits for it, and closes it where it was the last
        while stack:
            box, key = stack.pop()
            if key is None:
                box.append(value)
            else:
                box[key] = value
            at = blank(at)
            c = text[at : at + 1]
            at += 1
            if c == ",":
                at = blank(at)
                if key is not None:
                    if text[at : at + 1] != '"':
                        raise ValueError(f"no key at {at}")
                    key, at = scanstring(text, at + 1)
                    at = blank(at)
                    if text[at : at + 1] != ":":
                        raise ValueError(f"no colon at {at}")
                    at += 1
                stack.append((box, key))
                break
            if c != ("]" if key is None else "}"):
                raise ValueError(f"not closed at {at}")
            value = box
        else:
            if blank(at) != n:
                raise ValueError(f"more than one value at {at}")
            return value


def deep_dumps(v: object) -> str:
    """json.dumps (sorted keys) with a stack of its own."""
    out: list[str] = []
    todo: list = [(v, None)]
    while todo:
        x, raw = todo.pop()
        if raw is not None:
            out.append(raw)
        elif isinstance(x, dict) and x:
            todo.append((None, "}"))
            for i, k in enumerate(sorted(x, reverse=True)):
                todo += [(x[k], None), (None, ("" if i == len(x) - 1 else ", ") + json.dumps(k, ensure_ascii=False) + ": ")]
            out.append("{")
        elif isinstance(x, list) and x:
            todo.append((None, "]"))
            for i in range(len(x) - 1, -1, -1):
                todo.append((x[i], None))
                if i:
                    todo.append((None, ", "))
            out.append("[")
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return deep_loads(text)


def dumps(v: object) -> str:
    try:
        return json.dumps(v, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        return deep_dumps(v)


def opened(v: object) -> object:
    """The value, with JSON text in strings opened (only containers and quoted text count as JSON text)."""
    while isinstance(v, str):
        s = v.strip()
        if not s or s[0] not in '[{"':
            return None if not s else v
        try:
            v = loads(s)
        except ValueError:
            return v
    return v


def void(v: object) -> bool:
    return v is None or v == [] or v == {} or (isinstance(v, str) and not v.strip())


def parsed(text: str | None) -> object:
    """A column's JSON text; a text that is no JSON stays a string, 'null' and blanks are None."""
    if text is None or not text.strip():
        return None
    try:
        return opened(loads(text))
    except ValueError:
        return text


def listed(v: object, label: str, keyed: frozenset[str]) -> list:
    """What stands at a label, as the list of its occurrences."""
    v = opened(v)
    if isinstance(v, list):
        return [opened(x) for x in v]
    if isinstance(v, dict) and label in keyed and v and all(isinstance(opened(x), dict) for x in v.values()):
        return [opened(x) for x in v.values()]
    return [v]


def comma_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


@dataclass(frozen=True)
class Plan:
    """tables: labels with a relation of their own; keyed: labels whose all-object objects are lists.

    split: labels right below a column that may hold their list as comma-separated text; roots: columns whose object is
    the record itself, also where an element of the column's name has a relation.
    """

    tables: frozenset[str]
    keyed: frozenset[str] = frozenset()
    split: frozenset[str] = frozenset()
    roots: frozenset[str] = frozenset()


@dataclass
class _Edges:
    many: dict[tuple[str, str], bool] = field(default_factory=dict)

    def see(self, column: str, value: object, keyed: frozenset[str]) -> None:
        # an explicit stack: records may be nested deeper than Python's own
        todo = [("", column, value)]
        while todo:
            parent, label, v = todo.pop()
            v = opened(v)
            if void(v):
                continue
            repeated = isinstance(v, list) or (isinstance(v, dict) and label in keyed and all(isinstance(opened(x), dict) for x in v.values()))
            self.many[parent, label] = self.many.get((parent, label), False) or repeated
            for x in listed(v, label, keyed):
                if isinstance(x, dict):
                    todo += [(label, k, y) for k, y in x.items()]


def schema_graph(df: DataFrame, columns: list[str], keyed: frozenset[str] = frozenset()) -> DataFrame:
    """parent, label, many: the fused graph of all records. The root's label is ''.

    Each task fuses its own rows first, so what is shuffled is bounded by the number of distinct labels.
    """

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _Edges()
        for b in batches:
            for c in columns:
                for text in b.column(b.schema.get_field_index(c)).to_pylist():
                    v = parsed(text)
                    if not void(v):
                        e.see(c, v, keyed)
        yield pa.RecordBatch.from_pydict({"parent": [p for p, _ in e.many], "label": [x for _, x in e.many], "many": list(e.many.values())}, schema=pa.schema([("parent", pa.string()), ("label", pa.string()), ("many", pa.bool_())]))

    return df.select(*columns).mapInArrow(fuse, "parent string, label string, many boolean").groupBy("parent", "label").agg(F.max("many").alias("many"))


def inline_plan(edges: list[tuple[str, str, bool]], keyed: frozenset[str] = frozenset()) -> Plan:
    """Relations for repeated, shared or recursive elements; the rest is inlined."""
    parents: dict[str, set[str]] = defaultdict(set)
    children: dict[str, set[str]] = defaultdict(set)
    tables = set()
    for p, c, many in edges:
        parents[c].add(p)
        children[p].add(c)
        if many:
            tables.add(c)
    tables |= {c for c, ps in parents.items() if len(ps) > 1}
    # recursive: reaches itself
    for start in list(children):
        seen, todo = set(), list(children[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += children.get(x, ())
        if start in seen:
            tables.add(start)
    return Plan(frozenset(tables), keyed)


def shred(df: DataFrame, key: str, columns: list[str], plan: Plan, values: bool = True) -> DataFrame:
    """The rows of every relation (ROW): parent names the element that holds the row, pos the positions from the root.

    With values=False the inlined columns are left out (keys and positions only).
    """

    def scalar(v: object) -> str:
        return v if isinstance(v, str) else dumps(v)

    def inline(v: dict, prefix: str, fields: dict, pending: list, label: str) -> None:
        todo = [(v, prefix, label)]
        while todo:
            v, prefix, label = todo.pop()
            for k, y in v.items():
                y = opened(y)
                if void(y):
                    continue
                if k in plan.tables or isinstance(y, list):
                    pending.append((label, k, y))
                elif isinstance(y, dict):
                    todo.append((y, f"{prefix}{k}.", k))
                elif values:
                    fields[prefix + k] = scalar(y)

    def rows(rid: str, out: list) -> None:
        # an explicit stack: records may be nested deeper than Python's own
        stack = [(rid, "", (), col, v) for col, v in current]
        while stack:
            parent_id, parent, pos, label, v = stack.pop()
            if label in plan.tables and not (label in plan.roots and parent == "" and isinstance(v, dict)):
                top = label in plan.split and parent_id == rid and parent in columns
                for i, x in enumerate(comma_list(v) if top and isinstance(v, str) else listed(v, label, plan.keyed)):
                    if void(x):
                        continue
                    at = (*pos, i)
                    row_id = f"{parent_id}/{label}:{i}"
                    fields: dict = {}
                    pending: list = []
                    if isinstance(x, dict):
                        inline(x, "", fields, pending, label)
                    elif values:
                        fields["value"] = scalar(x)
                    out.append((label, parent, rid, row_id, parent_id, at, fields))
                    stack += [(row_id, p, at, k, y) for p, k, y in pending]
            else:
                fields, pending = {}, []
                if isinstance(v, dict):
                    inline(v, f"{label}.", fields, pending, label)
                elif values and not void(v):
                    fields[label] = scalar(v)
                if fields:
                    roots.append((label, parent, rid, rid, None, (), fields))
                stack += [(parent_id, p, pos, k, y) for p, k, y in pending]

    roots: list = []
    current: list = []
    schema = pa.schema([("relation", pa.string()), ("parent", pa.string()), ("record_id", pa.string()), ("row_id", pa.string()), ("parent_id", pa.string()), ("pos", pa.list_(pa.int32())), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            cols = [b.column(1 + i).to_pylist() for i in range(len(columns))]
            out: list = []
            for n, rid in enumerate(ids):
                current[:] = [(c, v) for c, text in zip(columns, (x[n] for x in cols)) if not void(v := parsed(text))]
                roots.clear()
                rows(rid, out)
                if roots:
                    merged: dict = {}
                    for r in roots:
                        merged |= r[6]
                    out.append(("", None, rid, rid, None, (), merged))
            for at in range(0, len(out), 20_000):
                part = out[at : at + 20_000]
                a = list(zip(*part))
                yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.string()), pa.array(a[1], pa.string()), pa.array(a[2], pa.string()), pa.array(a[3], pa.string()), pa.array(a[4], pa.string()), pa.array(a[5], pa.list_(pa.int32())), pa.array([list(x.items()) for x in a[6]], pa.map_(pa.string(), pa.string()))], schema=schema)

    return df.select(F.col(key).cast("string").alias("record_id"), *columns).mapInArrow(run, ROW)


def latest(df: DataFrame, key: F.Column | str, columns: list[str], order: str) -> DataFrame:
    """One row for each key, its newest delivery; rows without a key are left out. The map side combines first."""
    k = F.col(key) if isinstance(key, str) else key
    picked = F.max_by(F.struct(*columns), F.coalesce(F.col(order), F.lit("1900-01-01").cast("timestamp"))).alias("r")
    return df.where(k.isNotNull()).groupBy(k.alias("_k")).agg(picked).select("r.*")


GATE_KEYED = frozenset({"gates"})
WORK_PARTS = ["checks", "repro", "gates"]
COMMA_KEYS = frozenset({"item", "topic", "touch", "gates"})
_CHILD = {("checks", ""): "check", ("run", "checks"): "run", ("run", "repro"): "repro_run", ("gates", ""): "gate", ("options", "gates"): "option", ("run", "host_check"): "host_run"}


def work_relations(items: DataFrame, values: bool = True) -> DataFrame:
    """All relations of the work items' nested parts (ROW), each item once."""
    one = latest(items, F.lower(F.trim("item_id")), ["item_id", *WORK_PARTS], "loaded_at")
    edges = [tuple(r) for r in schema_graph(items, WORK_PARTS, GATE_KEYED).collect()]  # bounded by the number of labels
    plan = inline_plan(edges, GATE_KEYED)
    # what the shape rules name as lists are relations even where no list was seen
    plan = Plan(plan.tables | {"checks", "gates", "run", "options"}, GATE_KEYED)
    return shred(one, "item_id", WORK_PARTS, plan, values)


def log_relations(log: DataFrame, values: bool = True) -> DataFrame:
    """All relations of the log's fields (ROW), each seq once.

    Every top-level key is a child record with a position, so each has a relation, lists or not; below them the graph
    decides. Rows of the top level have parent 'fields' and one position.
    """
    one = latest(log, "seq", ["seq", "fields"], "loaded_at")
    edges = [tuple(r) for r in schema_graph(log, ["fields"], GATE_KEYED).collect()]  # bounded by the number of labels
    top = {c for p, c, _ in edges if p == "fields"}
    plan = Plan(inline_plan(edges, GATE_KEYED).tables | top, GATE_KEYED, COMMA_KEYS, frozenset({"fields"}))
    return shred(one, "seq", ["fields"], plan, values)


def relations(items: DataFrame, log: DataFrame) -> DataFrame:
    """p1_tables: the rows of all relations of the work items and the log, named by tbl."""
    cols = ["relation", "parent", "record_id", "row_id", "parent_id", F.to_json("fields").alias("columns")]
    work = work_relations(items).select(F.lit("work_items").alias("tbl"), *cols)
    return work.unionByName(log_relations(log).select(F.lit("coord_log").alias("tbl"), *cols))


def child_records(items: DataFrame, log: DataFrame) -> DataFrame:
    """p1_found: tbl, record_id, child, pos, subpos of every child record of the work items and the log."""
    r = work_relations(items, values=False)
    pairs = F.create_map(*[x for (rel, parent), child in _CHILD.items() for x in (F.lit(f"{rel}<{parent}"), F.lit(child))])
    child = pairs[F.concat_ws("<", "relation", "parent")]
    n = F.size("pos")
    last = F.element_at("pos", -1)
    nested = child.isin("run", "option", "host_run")
    work = r.where(F.col("relation") != "").withColumn("child", child).where("child is not null").select(
        F.lit("work_items").alias("tbl"), "record_id", "child",
        F.when(F.col("child") == "repro_run", 0).when(nested & (n > 1), F.element_at("pos", 1)).otherwise(F.when(nested, 0).otherwise(last)).cast("int").alias("pos"),
        F.when(nested | (F.col("child") == "repro_run"), last).otherwise(-1).cast("int").alias("subpos"),
    )
    top = log_relations(log, values=False).where("parent = 'fields' and size(pos) = 1 and parent_id = record_id")
    events = top.select(F.lit("coord_log").alias("tbl"), "record_id", F.col("relation").alias("child"), F.element_at("pos", 1).alias("pos"), F.lit(-1).alias("subpos"))
    return work.unionByName(events)
