"""Schemas that drift between files: tagged-union inference over the files of a store, in order.

Every file contributes its fields, each tagged with its JSON type. Schemas are fused in parallel: the files are
range-partitioned by (store, order) into chunks of about CHUNK files, each chunk folds its own files as they stream by,
with a symbolic incoming state ("whatever type field f had before this chunk"), and the chunks' summaries (first and
last schema, state) are fused in order per store. So no store, however hot, is read by one task, and no task holds a
chunk; what one task sees of a store is one short summary per chunk.

Reported changes (see ``changes``, top-level fields): added, removed, renamed, type. ``appearing`` says where in each
store an alternative type appears first; ``path_alternatives`` retains the types of every path at every depth;
``unified`` keeps every path in one table, with a branch per type (the tagged union) and the canonical text; ``table_of``
has a row per file and a column per top-level field.

Defined results: a null value has no type and changes nothing; torn headers and non-objects are passed over;
deliveries of the same file count once; two fields are of like name when their letters are equal, one contains the
other, they match to LIKE, or a word of one (no word for "version") begins a word of the other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.operators.nested import dumps, loads
from quarrylight.session import materialise

#: Least ratio of matching letters of two field names that are like each other.
LIKE = 0.75


def json_type(v: object) -> str | None:
    """integer and number (a fraction) are two types; None for null."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


#: Files of one chunk, about; there are at least as many chunks as the cluster runs tasks at once.
CHUNK = 20_000


def typed_headers(df: DataFrame, store: str = "store", run: str = "run", header: str = "header", texts: bool = True) -> DataFrame:
    """store, run, fields, header: one row for each file with a header that is whole; fields is JSON {name: type}.

    With texts=False the header itself is left out.
    """
    names = ["store", "run", "fields", "header"][: 3 + texts]
    schema = pa.schema([(n, pa.string()) for n in names])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, r, h in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    v = loads(h) if h is not None else None
                    if isinstance(v, str):
                        v = loads(v)
                except ValueError:
                    continue
                if isinstance(v, dict):
                    out.append((s, r, json.dumps({k: json_type(x) for k, x in v.items()}, sort_keys=True), h)[: 3 + texts])
            a = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in a], schema=schema)

    tagged = df.select(store, run, header).where(f"{store} is not null and {run} is not null").mapInArrow(tag, ", ".join(f"{n} string" for n in names))
    if not texts:
        return tagged.groupBy("store", "run").agg(F.min("fields").alias("fields"))
    return tagged.groupBy("store", "run").agg(F.min(F.struct("fields", "header")).alias("f")).select("store", "run", "f.fields", "f.header")


#: Words that say nothing about which field it is.
COMMON = frozenset({"version", "vers", "revision"})


def words(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])", name)
    return {w.lower() for w in parts if len(w) >= 4} - COMMON


def letters(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def alike(a: str, b: str) -> bool:
    x, y = letters(a), letters(b)
    if not (x and y):
        return False
    if x == y or x in y or y in x or SequenceMatcher(None, x, y).ratio() >= LIKE:
        return True
    return any(v.startswith(w) or w.startswith(v) for v in words(a) for w in words(b))


def step(before: dict, after: dict) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """added, removed and renamed (old, new) between two files' {field: type}."""
    gone = sorted(set(before) - set(after))
    come = sorted(set(after) - set(before))
    pairs: list[tuple[str, str]] = []
    for test in (lambda g, c: alike(g, c) and before[g] == after[c], alike, lambda g, c: before[g] is not None and before[g] == after[c]):
        for g in list(gone):
            c = next((c for c in come if test(g, c)), None)
            if c is not None:
                pairs.append((g, c))
                gone.remove(g)
                come.remove(c)
    return come, gone, pairs


class Fold:
    """The files of one store in one chunk, taken in order.

    events: (run, field, change). pending: (run, field, type, field at entry): a type change if the field had another
    type before the chunk. state: a field to its last type seen, or to [name] where that is whatever type the field
    name had at entry.
    """

    def __init__(self) -> None:
        self.events: list[tuple] = []
        self.pending: list[tuple] = []
        self.state: dict = {}
        self.first: tuple[str, str] | None = None
        self.last = ""

    def take(self, run: str, fields: str) -> None:
        if self.first is None:
            self.first = (run, fields)
        elif fields == self.last:
            return  # the same fields and types as the file before
        else:
            before, now = json.loads(self.last), json.loads(fields)
            come, gone, pairs = step(before, now)
            self.events += [(run, f, "added") for f in come] + [(run, f, "removed") for f in gone] + [(run, new, "renamed") for _, new in pairs]
            self.state |= {new: self.state.get(old, [old]) for old, new in pairs}
        for f, t in json.loads(fields).items():
            if t is None:
                continue
            had = self.state.get(f, [f])
            if isinstance(had, list):
                self.pending.append((run, f, t, had[0]))
            elif had != t:
                self.events.append((run, f, "type"))
            self.state[f] = t
        self.last = fields


_PARTS = "store string, chunk int, run string, field string, change string, t string, entry string, first string, last string"


def folded(files: DataFrame) -> DataFrame:
    """What every chunk says of every store in it (_PARTS); a row with the change 'state' has its summary."""
    spark = files.sparkSession
    chunks = max(spark.sparkContext.defaultParallelism, -(-files.count() // CHUNK))
    schema = pa.schema([(n, pa.int32() if n == "chunk" else pa.string()) for n in (c.split()[0] for c in _PARTS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        here, fold = None, Fold()

        def said() -> pa.RecordBatch:
            rows = [(here, chunk, r, f, c, None, None, None, None) for r, f, c in fold.events]
            rows += [(here, chunk, r, f, "pending", t, n, None, None) for r, f, t, n in fold.pending]
            rows.append((here, chunk, fold.first[0], None, "state", json.dumps(fold.state), None, fold.first[1], fold.last))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for s, r, f in zip(*(c.to_pylist() for c in b.columns)):
                if s != here:
                    if here is not None:
                        yield said()
                    here, fold = s, Fold()
                fold.take(r, f)
        if here is not None:
            yield said()

    return files.select("store", "run", "fields").repartitionByRange(chunks, "store", "run").sortWithinPartitions("store", "run").mapInArrow(run, _PARTS)


def changes(df: DataFrame) -> DataFrame:
    """store, run, field, change (p4_found)."""
    parts = materialise(folded(materialise(typed_headers(df, texts=False), "headers")), "drift-parts")
    states = parts.where("change = 'state'").select("store", "chunk", "run", "t", "first", "last")

    def fuse(g: pd.DataFrame) -> pd.DataFrame:
        known: dict = {}
        out = []
        before = None
        for s, chunk, r, t, first, last in g.sort_values("chunk").itertuples(index=False):
            if before is not None:
                come, gone, pairs = step(json.loads(before), json.loads(first))
                out += [(s, chunk, r, f, c, None, None) for c, fs in (("added", come), ("removed", gone), ("renamed", [new for _, new in pairs])) for f in fs]
                known |= {new: known.get(old) for old, new in pairs}
            out += [(s, chunk, None, None, "entry", n, x) for n, x in known.items() if x is not None]
            known = known | {f: x if isinstance(x, str) else known.get(x[0]) for f, x in json.loads(t).items()}
            before = last
        return pd.DataFrame(out, columns=["store", "chunk", "run", "field", "change", "entry", "had"])

    # a store has one row for each chunk here
    fused = materialise(states.groupBy("store").applyInPandas(fuse, "store string, chunk int, run string, field string, change string, entry string, had string"), "drift-fused")
    entry = fused.where("change = 'entry'").select("store", "chunk", "entry", "had")
    late = parts.where("change = 'pending'").join(entry, ["store", "chunk", "entry"]).where("had != t").withColumn("change", F.lit("type"))
    sure = parts.where("change not in ('pending', 'state')").unionByName(fused.where("change != 'entry'"), allowMissingColumns=True)
    return sure.select("store", "run", "field", "change").unionByName(late.select("store", "run", "field", "change"))


def alternatives(df: DataFrame) -> DataFrame:
    """field, type, files, first_run: the tagged union of every top-level field over all files."""
    files = typed_headers(df, texts=False).select("run", F.explode(F.from_json("fields", "map<string,string>")).alias("field", "type"))
    return files.where("type is not null").groupBy("field", "type").agg(F.count("*").alias("files"), F.min("run").alias("first_run"))


def appearing(df: DataFrame) -> DataFrame:
    """store, field, type, first_run, files, alternative: where each type of a field appears in a store, in order from 1."""
    files = typed_headers(df, texts=False).select("store", "run", F.explode(F.from_json("fields", "map<string,string>")).alias("field", "type"))
    g = files.where("type is not null").groupBy("store", "field", "type").agg(F.min("run").alias("first_run"), F.count("*").alias("files"))
    # a field has a row for each type here, of which there are seven
    nth = F.row_number().over(W.partitionBy("store", "field").orderBy("first_run", "type"))
    return g.withColumn("alternative", nth.cast("bigint"))


def step_name(key: str) -> str:
    """A key as it stands in a path: the signs that paths are made of are escaped."""
    return re.sub(r"([\\.\[\]])", r"\\\1", key)


def branches(header: dict) -> Iterator[tuple[str, tuple[int, ...], object]]:
    """(path, positions, value) of every value at every depth: ``retrieval.major``, ``lanes[]``."""
    # an explicit stack: headers may be nested deeper than Python's own
    stack = [(step_name(k), (), x) for k, x in reversed(header.items())]
    while stack:
        path, pos, v = stack.pop()
        yield path, pos, v
        if isinstance(v, dict):
            stack += [(f"{path}.{step_name(k)}", pos, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{path}[]", (*pos, i), x) for i, x in reversed(list(enumerate(v)))]


class _Fraction(float):
    """A fraction with its text as written."""

    def __new__(cls, text: str) -> _Fraction:
        f = super().__new__(cls, text)
        f.text = text
        return f


def typed_paths(df: DataFrame, once: bool = False) -> DataFrame:
    """store, run, field, pos, type, text: one row for each value at each path of each file, null values with no type.

    With once=True a path and type is given once for each file, without pos and text.
    """
    schema = pa.schema([("store", pa.string()), ("run", pa.string()), ("field", pa.string()), ("pos", pa.list_(pa.int32())), ("type", pa.string()), ("text", pa.string())])

    def written(v: object) -> str | None:
        if v is None or isinstance(v, str):
            return v
        if isinstance(v, _Fraction):
            return v.text
        try:
            return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        except RecursionError:
            return dumps(v)

    def exact(text: str) -> object:
        try:
            return json.loads(text, parse_float=_Fraction)
        except RecursionError:
            return loads(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = []
            for s, r, h in zip(*(c.to_pylist() for c in b.columns)):
                v = exact(h)
                if isinstance(v, str):
                    v = exact(v)
                if once:
                    out += [(s, r, p, None, t, None) for p, t in {(p, json_type(x)) for p, _, x in branches(v)}]
                else:
                    out += [(s, r, p, pos, json_type(x), written(x)) for p, pos, x in branches(v)]
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 20_000]), schema)], schema=schema)

    return typed_headers(df).select("store", "run", "header").mapInArrow(run, "store string, run string, field string, pos array<int>, type string, text string")


def path_alternatives(df: DataFrame) -> DataFrame:
    """field, type, files, first_run: as ``alternatives``, for the paths of every depth."""
    files = typed_paths(df, once=True).where("type is not null")
    return files.groupBy("field", "type").agg(F.count("*").alias("files"), F.min("run").alias("first_run"))


def unified(df: DataFrame) -> DataFrame:
    """One consistent table of all headers: a row per file and path, its type's branch and the canonical text.

    store, run, field, type, as_boolean, as_integer, as_number, as_text, as_json, canonical, pos. field is the path (see
    ``branches``), pos the positions in the lists on the way. A typed branch is null unless the value has that type;
    canonical holds every value as text (numbers without a needless fraction).
    """
    is_ = lambda *t: F.col("type").isin(*t)
    return typed_paths(df).select(
        "store", "run", "field", "type",
        F.when(is_("boolean"), F.col("text") == "true").alias("as_boolean"),
        F.when(is_("integer"), F.expr("try_cast(text as bigint)")).alias("as_integer"),
        F.when(is_("number"), F.expr("try_cast(text as double)")).alias("as_number"),
        F.when(is_("string"), F.col("text")).alias("as_text"),
        F.when(is_("object", "array"), F.col("text")).alias("as_json"),
        F.when(F.col("type").isNotNull(), F.regexp_replace("text", r"^(-?\d+)\.0+$", "$1")).alias("canonical"),
        "pos",
    )


def table_of(df: DataFrame) -> DataFrame:
    """One row for each file: store, run, and for each top-level field a column h_<field> with its canonical text.

    The columns are the fields of the fused schema: null where a file has no such field or a null. Of fields that differ
    in case alone, the later in text order have their number added to their names.
    """
    fields = sorted(r["field"] for r in alternatives(df).select("field").distinct().collect())  # as many as the table has columns
    top = unified(df).where("pos = array() and type is not null").join(F.broadcast(df.sparkSession.createDataFrame([(step_name(f), f) for f in fields], "field string, name string")), "field")
    wide = top.groupBy("store", "run").pivot("name", fields).agg(F.max("canonical"))
    seen: dict[str, int] = {}
    names = []
    for f in fields:
        n = seen[f.lower()] = seen.get(f.lower(), 0) + 1
        names.append(f"h_{f}" + f"_{n}" * (n > 1))
    return wide.toDF("store", "run", *names)
