"""Near duplicates, order, batching, sampling and set operators."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.session import materialise

#: Least share of a text's words that another has, rounded to two places, and least number of them, to be like it.
SIMILAR, WORDS = 0.6, 2
#: Words, of those that other texts have too, up to which a text is counted by its subsets; one of more is paired.
SUBSETS = 8
#: Texts whose subsets one task makes.
TEXTS = 20_000


def similar(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, class_id, likes, first: how many other distinct texts hold SIMILAR of a text's words, and the first of them.

    Words are lower-case runs of letters and digits, of two at least, no stop words; a text is its set of words, and equal
    sets are one class, named by its least key, which is compared once. Likes grow as the square of the texts, so they are
    counted and not listed: a class counts as a holder of each subset of its words, and the number of those that share k
    words or more with a class is, by inclusion and exclusion, the sum over its subsets of j >= k words of their holders
    times (-1)^(j - k) (j - 1 over k - 1). The first is the least holder of any of these subsets, if that is not the class
    itself. Classes of many words, and those that come before all that are like them, are compared by ``paired``.
    """
    w = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) > 1) & ~x.isin(*X.STOP))))
    sets = texts.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("key"), w.alias("ws"))
    sets = materialise(sets, "word-sets")
    # classes are numbered in the order of their names, words in that of their frequency; a word of one class is shared by none
    classes = sets.where("size(ws) > 0").groupBy("ws").agg(F.min("key").alias("class_id")).orderBy("class_id")
    classes = materialise(classes.select("ws", "class_id", F.monotonically_increasing_id().alias("id")), "classes")
    words = classes.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df")).where("df > 1").orderBy("df", "w")
    words = materialise(words.select("w", F.monotonically_increasing_id().alias("i")), "words")
    need = F.greatest(F.expr(f"({round(1000 * SIMILAR) - 5} * n + 999) div 1000"), F.lit(WORDS)).cast("int")
    coded = classes.select("id", F.size("ws").alias("n"), F.explode("ws").alias("w")).join(words, "w").groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("i")).alias("e"))
    coded = materialise(coded.select("id", need.alias("need"), "e").where("size(e) >= 2"), "class-words")
    few = coded.where(F.size("e") <= SUBSETS)
    short = few.repartitionByRange(few.count() // TEXTS + 1, F.reverse("e"))  # like ones together, so that they combine
    subset = lambda least: F.explode(F.expr(f"transform(filter(sequence(1, shiftleft(1, size(e)) - 1), k -> bit_count(k) >= {least}), k -> filter(e, (x, i) -> (k & shiftleft(1, i)) != 0))")).alias("part")
    held = short.select("id", subset(WORDS)).groupBy("part").agg(F.count("*").alias("holders"), F.min("id").alias("first")).where("holders > 1")
    over = F.array(*[F.lit((-1) ** (j - k) * comb(j - 1, k - 1) if 1 <= k <= j else 0) for j in range(SUBSETS + 1) for k in range(SUBSETS + 1)])
    term = F.get(over, F.size("part") * (SUBSETS + 1) + F.col("need")) * (F.col("holders") - 1)
    counted = few.repartition(few.count() // TEXTS + 1).select("id", "need", subset("need")).join(held, "part").groupBy("id").agg(F.sum(term).alias("likes"), F.min("first").alias("first"))
    counted = materialise(counted, "counted")
    before = counted.where("first = id").select("id")
    more = coded.where(F.size("e") > SUBSETS)
    alone = more.unionByName(few.join(before, "id", "left_semi"))
    likes = counted.where("first < id").unionByName(paired(alone, coded))
    if not more.isEmpty():
        likes = likes.unionByName(paired(few.join(before, "id", "left_anti"), more))
    likes = likes.groupBy("id").agg(F.sum("likes").alias("likes"), F.min("first").alias("first"))
    names = classes.select(F.col("id").alias("first"), F.col("class_id").alias("name"))
    likes = likes.join(names, "first").select("id", "likes", F.col("name").alias("first"))
    member = sets.join(classes, "ws", "left").select("key", "class_id", "id")
    return member.join(likes, "id", "left").select("key", "class_id", F.coalesce("likes", F.lit(0)).cast("bigint").alias("likes"), "first")


def paired(some: DataFrame, all_: DataFrame) -> DataFrame:
    """id, likes, first: of the sets of all_ (id, need, e) how many others hold ``need`` of the words e of one of some, and the first.

    By a prefix filter: who shares ``need`` of n words has one of the n - need + 1 rarest, so only these are looked up. A
    pair is compared as it comes by, at the first word that both have, and only its count is kept.
    """
    probe = some.where("size(e) >= need").select("id", "need", "e", F.explode(F.expr("slice(e, 1, size(e) - need + 1)")).alias("w"))
    have = all_.select(F.col("id").alias("other"), F.col("e").alias("of"), F.explode("e").alias("w"))
    both = F.array_intersect("e", "of")  # in the order of e
    hit = probe.join(have, "w").where("id != other").withColumn("both", both).where((F.size("both") >= F.col("need")) & (F.get("both", F.lit(0)) == F.col("w")))
    return hit.groupBy("id").agg(F.count("*").alias("likes"), F.min("other").alias("first"))


def work_order(items: DataFrame) -> DataFrame:
    """item_id, place: items that are ready (their dependencies done) by priority, filing time and id."""
    norm = F.lower(F.trim("item_id"))
    one = items.where("item_id is not null").groupBy(norm.alias("k")).agg(F.max("item_id").alias("item_id"), F.max("status").alias("status"), F.min("priority").alias("priority"), F.min("filed_at").alias("filed_at"), F.flatten(F.collect_set("depends_on")).alias("deps"))
    need = one.select("k", F.explode("deps").alias("d")).where("trim(d) != ''").select("k", F.lower(F.trim("d")).alias("d")).distinct()
    waits = need.join(one.where("status in ('done', 'dropped')").select(F.col("k").alias("d")), "d", "left_anti").select("k").distinct()
    from quarrylight.operators.ledger import positions

    ready = one.where("status = 'todo'").join(waits, "k", "left_anti").select("item_id", F.coalesce("priority", F.lit("P9")).alias("priority"), "filed_at")
    return positions(ready, [F.col("priority"), F.col("filed_at").asc_nulls_first(), F.col("item_id")], "place").select("item_id", "priority", "place")


def natural_key(c: Column) -> Column:
    """A text's order by its letters and then its first number, so that 9 comes before 10."""
    return F.struct(F.regexp_extract(c, r"^(\D*)", 1).alias("head"), F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint"), F.lit(-1)).alias("number"), c.alias("all"))


def batches(rows: DataFrame, group: str, order: list[str], chars: str, size: int, room: int) -> DataFrame:
    """rows with batch: in order, at most ``size`` rows and ``room`` characters in each; a longer row stands alone.

    Greedy in order, so each group is folded as it streams by in its order; only the batch at hand is state.
    """
    import pyarrow as pa

    cols = rows.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", batch bigint"
    g, c = cols.index(group), cols.index(chars)

    def fold(parts):
        here, batch, n, used = object(), 0, 0, 0
        for b in parts:
            out = []
            for who, k in zip(b.column(g).to_pylist(), b.column(c).to_pylist()):
                k = k or 0
                if who != here:
                    here, batch, n, used = who, 0, 0, 0
                elif n >= size or used + k > room:
                    batch, n, used = batch + 1, 0, 0
                n, used = n + 1, used + k
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*cols, "batch"])

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(fold, schema)


def first_fit(rows: DataFrame, group: str, order: list[str], chars: str, room: int) -> DataFrame:
    """The rows of each group that fit in its room, taken in order; one that does not fit is passed over, none is cut."""
    import pyarrow as pa

    cols = rows.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    g, c = cols.index(group), cols.index(chars)

    def fold(parts):
        here, used = object(), 0
        for b in parts:
            keep = []
            for i, (who, k) in enumerate(zip(b.column(g).to_pylist(), b.column(c).to_pylist())):
                if who != here:
                    here, used = who, 0
                if used + (k or 0) <= room:
                    used += k or 0
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(fold, schema)


def merged_pieces(lines: DataFrame, room: int) -> DataFrame:
    """path, section, piece, lines, chars: neighbouring lines of a section merged up to a size."""
    from_lines = lines.where("path is not null and body is not null and removed_on is null").select("path", F.coalesce("section", F.lit("")).alias("section"), "line_no", "added_on", F.length("body").alias("chars"))
    one = from_lines.select(F.concat_ws("\u0001", "path", "section").alias("g"), "path", "section", "line_no", "added_on", "chars")
    b = batches(one, "g", ["line_no", "added_on"], "chars", 1_000_000_000, room)
    return b.groupBy("path", "section", F.col("batch").alias("piece")).agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"))


def arms(rows: DataFrame, group: str, key: str, share: float = 0.5, seed: str = "7") -> DataFrame:
    """rows with arm: each group is dealt by hashes of its own, so that one group never moves another."""
    n, r = F.count("*").over(W.partitionBy(group)), F.row_number().over(W.partitionBy(group).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(group), F.col(key)), 256), key))
    return rows.withColumn("arm", F.when(r <= F.floor(n * share), "on").otherwise("off"))


def phase_sample(rows: DataFrame, whole: Column, key: str, one_in: int) -> DataFrame:
    """All rows of one kind, and one in so many of the others, by a hash of their key."""
    return rows.where(whole | (F.conv(F.substring(F.sha2(F.col(key), 256), 1, 4), 16, 10).cast("bigint") % one_in == 0))


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """text, left, right: what stands in both lists, the same but for case, blanks and closing signs, with its counts."""
    norm = F.regexp_replace(F.trim(F.regexp_replace(F.lower(column), r"\s+", " ")), r"[?.!]+$", "")
    one = lambda df, name: df.where(F.col(column).isNotNull()).groupBy(norm.alias("text")).agg(F.count("*").alias(name)).where("text != ''")
    return one(a, "left").join(one(b, "right"), "text")


def uncovered(asked: DataFrame, covered: DataFrame) -> DataFrame:
    """key, word: the words a key asks for that nothing of it covers (both with key and word)."""
    return asked.distinct().join(covered.distinct(), ["key", "word"], "left_anti")
