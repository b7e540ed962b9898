"""Lexical evidence retrieval: units, postings, BM25 ranking, caps, fusion and coverage verdicts, for many questions.

A unit is a row with unit_id, path, section, body, tagged. Statistics are those of the units given: filter first, then
rank. Questions come as a table; one plan ranks all of them. Scores are rounded to 6 places before they are compared,
and ties go to the smaller unit_id, so results do not hang on the order in which floats are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.session import BROADCAST_ROWS, materialise

K1, B = 1.2, 0.75
SUMMARY_BOOST, UNTAGGED = 1.15, 0.8
RRF_K = 60
POOL = 40


def stemmed(tokens: DataFrame, column: str = "word") -> DataFrame:
    """tokens with term, the stem of each word; stop words and single letters are left out.

    Stems are made once for each distinct word.
    """
    words = tokens.select(column).distinct().where(~F.col(column).isin(*X.STOP) & (F.length(column) > 1))
    return tokens.join(words.withColumn("term", X.stem(column)), column)


def parts_of(words: DataFrame) -> DataFrame:
    """words (a column word, as written) with term, weight, whole: the stems of each word's parts, each part once.

    Parts and stems are made once for each distinct word; stop words and single letters are left out.
    """
    each = words.select("word").distinct().select("word", F.inline(X.word_parts(F.col("word"))))
    each = each.where(~F.col("part").isin(*X.STOP) & (F.length("part") > 1))
    return words.join(each.select("word", X.stem("part").alias("term"), "weight", "whole"), "word")


#: Weight of a term that stands in the article's summary, and the sections that are summaries.
SUMMARY_TERM = 0.1


def unit_terms(units: DataFrame) -> DataFrame:
    """unit_id, term, tf, n, own: the terms of each unit.

    A unit is indexed by its path, section and text; n counts a term in these. tf adds a tenth of the count in the
    article's summary, unless the unit is of it. own: the term stands in the file's name, the section or the text, not
    in a folder's name alone.
    """
    file = F.regexp_replace("path", r"\.[a-z]+$", "")
    body = F.concat_ws(" ", F.regexp_extract(file, r"([^/]*)$", 1), "section", "body")
    folders = F.regexp_replace(file, r"[^/]*$", "")
    both = F.concat(F.transform(X.raw_words(body), lambda x: F.struct(x.alias("word"), F.lit(True).alias("own"))), F.transform(X.raw_words(folders), lambda x: F.struct(x.alias("word"), F.lit(False).alias("own"))))
    words = units.select("unit_id", F.inline(both))
    t = parts_of(words).groupBy("unit_id", "term").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    said = parts_of(units.where(F.col("section").startswith("Summary")).select("path", F.explode(X.raw_words(F.col("body"))).alias("word"))).groupBy("path", "term").agg((F.count("*") * SUMMARY_TERM).alias("more"))
    plus = units.where(~F.col("section").startswith("Summary")).select("unit_id", "path").join(said, "path").select("unit_id", "term", "more")
    j = t.join(plus, ["unit_id", "term"], "full_outer")
    return j.select("unit_id", "term", F.round(F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0.0)), 6).alias("tf"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("own", F.lit(False)).alias("own"))


def postings(units: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """unit_id, term, tf, len, df, n, avg: all that ranking needs; write it bucketed by term to keep an index.

    len counts all terms, unweighted; df the units that have a term of their own.
    """
    t = materialise(unit_terms(units), "unit-terms") if terms is None else terms
    length = t.groupBy("unit_id").agg(F.sum("n").alias("len"))
    df = t.where("own").groupBy("term").agg(F.count("*").alias("df"))
    stats = length.agg(F.avg("len").alias("avg")).crossJoin(units.agg(F.count("*").alias("n")))  # one row
    return t.select("unit_id", "term", "tf").join(length, "unit_id").join(df, "term").crossJoin(F.broadcast(stats))


def question_terms(questions: DataFrame) -> DataFrame:
    """qid, term, weight, whole, named: the stems of each question (columns qid, question), at their greatest weight.

    whole: the stem of a whole word, a key word; named: of a word with a capital or a digit in it.
    """
    words = questions.select("qid", F.explode(X.raw_words(F.col("question"))).alias("word"))
    named = F.col("word").rlike(r"[\p{Lu}\p{N}]") & F.col("whole")
    return parts_of(words).groupBy("qid", "term").agg(F.max("weight").alias("weight"), F.max("whole").alias("whole"), F.max(named).alias("named"))


def rank(units: DataFrame, questions: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """qid, unit_id, path, score, hits of every unit that shares a term with a question; terms: unit_terms, if at hand."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    boost = F.when(F.col("section").startswith("Summary"), SUMMARY_BOOST).otherwise(1.0) * F.when(F.col("tagged"), 1.0).otherwise(UNTAGGED)
    p = postings(units, terms).select("unit_id", "term", part.alias("part")).join(units.select("unit_id", "path", boost.alias("boost")), "unit_id")
    p = materialise(p, "postings")
    terms = question_terms(questions).select("qid", "term", "weight")
    if p.count() <= BROADCAST_ROWS:
        # questions are cut by qid once; neither the sums nor the windows over a question move a row again
        # (a stated number of parts, as few bytes of questions make many hits)
        spark = units.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2
        hit = terms.repartition(parts, "qid").join(F.broadcast(p), "term")
    else:
        hit = terms.join(p, "term")
    s = hit.groupBy("qid", "unit_id").agg(F.sum(F.col("weight") * F.col("part")).alias("s"), F.count("*").alias("hits"), F.first("path").alias("path"), F.first("boost").alias("boost"))
    return s.select("qid", "unit_id", "path", F.round(F.col("s") * F.col("boost"), 6).alias("score"), "hits")


def _best() -> list[Column]:
    return [F.desc("score"), F.asc("unit_id")]


def top(ranked: DataFrame, k: int, per_path: int | None = None) -> DataFrame:
    """The k best units of each question, with pos; at most per_path of one path where that is given."""
    r = ranked
    if per_path:
        r = r.withColumn("in_path", F.row_number().over(W.partitionBy("qid", "path").orderBy(*_best()))).where(F.col("in_path") <= per_path).drop("in_path")
    return r.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(*_best()))).where(F.col("pos") <= k)


def lines_near_best(ranked: DataFrame, share: float = 0.4, per_path: int = 6) -> DataFrame:
    """The units of each path that score at least share of the question's best, at most per_path of a path."""
    best = F.max("score").over(W.partitionBy("qid"))
    n = F.row_number().over(W.partitionBy("qid", "path").orderBy(*_best()))
    return ranked.withColumn("best", best).where(F.col("score") >= share * F.col("best")).withColumn("n", n).where(F.col("n") <= per_path).drop("best", "n")


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """qid, item, score, best: reciprocal rank fusion of rankings (qid, ranking, item, pos).

    An item counts once in each ranking, at its best place; ties go to the best place, then to the item.
    """
    once = rankings.groupBy("qid", "ranking", "item").agg(F.min("pos").alias("pos"))
    dense = once.withColumn("r", F.row_number().over(W.partitionBy("qid", "ranking").orderBy("pos", "item")))
    return dense.groupBy("qid", "item").agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score"), F.min("r").alias("best"))


def term_df(units: DataFrame) -> DataFrame:
    """term, df, n: how many units have each term of their own, of how many."""
    return unit_terms(units).where("own").groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(units.agg(F.count("*").alias("n"))))


def informative(units: DataFrame, questions: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """qid, term, df, named: the key words of each question that fewer than a fifth (at least 2) of the units have; df 0: missing."""
    n = units.agg(F.count("*").alias("n"))
    df = (unit_terms(units) if terms is None else terms).where("own").groupBy("term").agg(F.count("*").alias("df"))
    q = question_terms(questions).where("whole").join(df, "term", "left").fillna({"df": 0}).crossJoin(F.broadcast(n))
    return q.where(F.col("df") < F.greatest(0.2 * F.col("n"), F.lit(2.0))).select("qid", "term", "df", "named")


def verdicts(units: DataFrame, questions: DataFrame, pool: int = POOL) -> DataFrame:
    """qid, verdict, share, asked, missing: how well the units cover each question.

    Of the pool best units, the path whose units have most of the known informative words gives the share, the same over
    tagged units the fact share. none: nothing found, a third of the named words unknown (but for a single name of three
    letters at most with a share of .75), half of the words unknown, or a share below .34. good: a fact share of .6 (.8
    where a word is unknown), no name unknown, every informative name in a tagged unit, and one tagged unit with all known
    words. Else weak. A question without informative words is none.
    """
    terms = materialise(unit_terms(units), "unit-terms")
    info = materialise(informative(units, questions, terms), "informative")
    unknown = F.col("df") == 0
    asked = info.groupBy("qid").agg(F.count("*").alias("asked"), F.count_if(unknown).alias("missing"), F.count_if("named").alias("names"), F.count_if(F.col("named") & unknown).alias("lost"), F.max(F.when(F.col("named"), F.length("term"))).alias("longest"))
    best = top(rank(units, questions, terms), pool).select("qid", "unit_id", "path")
    held = materialise(best.join(info.where("df > 0").select("qid", "term", "named"), "qid").join(terms.where("own").select("unit_id", "term"), ["unit_id", "term"]).join(units.select("unit_id", "tagged"), "unit_id"), "held")
    per = held.groupBy("qid", "path").agg(F.countDistinct("term").alias("hit"), F.countDistinct(F.when(F.col("tagged"), F.col("term"))).alias("fact"))
    most = per.groupBy("qid").agg(F.max("hit").alias("hit"), F.max("fact").alias("fact"))
    single = held.where("tagged").groupBy("qid", "unit_id").agg(F.countDistinct("term").alias("one")).groupBy("qid").agg(F.max("one").alias("one"))
    told = held.where("tagged and named").groupBy("qid").agg(F.countDistinct("term").alias("told"))
    zero = {c: 0 for c in ("asked", "missing", "names", "lost", "longest", "hit", "fact", "one", "told")}
    j = questions.select("qid").distinct().join(asked, "qid", "left").join(most, "qid", "left").join(single, "qid", "left").join(told, "qid", "left").fillna(zero)
    share, fact = F.col("hit") / F.greatest("asked", F.lit(1)), F.col("fact") / F.greatest("asked", F.lit(1))
    lone = (F.col("names") == 1) & (F.col("longest") <= 3) & (share >= 0.75)
    nothing = (F.col("hit") == 0) | ((F.col("lost") > 0) & (F.col("lost") * 3 >= F.col("names")) & ~lone) | (F.col("missing") * 2 >= F.col("asked")) | (share < 0.34)
    good = (fact >= F.when(F.col("missing") > 0, 0.8).otherwise(0.6)) & (F.col("lost") == 0) & (F.col("told") == F.col("names")) & (F.col("one") == F.col("asked") - F.col("missing"))
    verdict = F.when(nothing, "none").when(good, "good").otherwise("weak")
    return j.select("qid", verdict.alias("verdict"), F.round(share, 6).alias("share"), F.col("asked").cast("bigint").alias("asked"), F.col("missing").cast("bigint").alias("missing"))


def holders(units: DataFrame, variants: DataFrame) -> DataFrame:
    """key, units: how many units hold a key: all terms of one of its variants (columns key, variant, term).

    Relational division: a unit holds a variant when as many of its terms match as the variant has.
    """
    size = variants.groupBy("key", "variant").agg(F.countDistinct("term").alias("size"))
    hit = variants.distinct().join(unit_terms(units).where("own").select("unit_id", "term"), "term").groupBy("key", "variant", "unit_id").agg(F.countDistinct("term").alias("hit"))
    return hit.join(size, ["key", "variant"]).where("hit = size").groupBy("key").agg(F.countDistinct("unit_id").alias("units"))


def expand(questions: DataFrame, aliases: DataFrame, weight: float = 0.5) -> DataFrame:
    """qid, term, weight: the words of aliases (term, canonical) whose term a question holds as whole words.

    Questions and aliases are joined by the alias's first word, and by its place the rest is compared.
    """
    padded = lambda c: F.concat(F.lit(" "), F.array_join(X.words(c), " "), F.lit(" "))
    a = aliases.select(padded(F.col("term")).alias("alias"), F.try_element_at(X.words(F.col("term")), F.lit(1)).alias("w"), X.words(F.col("canonical")).alias("cw")).where("w is not null")
    q = questions.select("qid", padded(F.col("question")).alias("padded"), F.explode(F.array_distinct(X.words(F.col("question")))).alias("w"))
    hit = q.join(a, "w").where(F.col("padded").contains(F.col("alias")))
    return hit.select("qid", F.explode("cw").alias("word"), (F.lit(weight) / F.size("cw")).alias("weight")).withColumn("term", X.stem("word")).groupBy("qid", "term").agg(F.max("weight").alias("weight"))


def take_within(ranked: DataFrame, cost: str, budget: int) -> DataFrame:
    """qid, unit_id, score, cost, spent: the lines of each question within a budget, by path as they stand.

    Paths go by their best unit; the first line that goes over what is left ends its own path only. Sequential by its
    nature, over the few candidates of a question (a pool).
    """
    import pandas as pd

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "unit_id"], ascending=[False, True])
        first = {p: i for i, p in reversed(list(enumerate(g["path"])))}
        spent, rows, shut = 0, [], set()
        for r in sorted(g.itertuples(index=False), key=lambda r: first[r.path]):
            if r.path in shut:
                continue
            if spent + r.cost > budget:
                shut.add(r.path)
                continue
            spent += r.cost
            rows.append((r.qid, r.unit_id, r.score, r.cost, spent))
        return pd.DataFrame(rows, columns=["qid", "unit_id", "score", "cost", "spent"])

    return ranked.select("qid", "unit_id", "path", "score", F.coalesce(F.col(cost), F.lit(0)).cast("bigint").alias("cost")).groupBy("qid").applyInPandas(one, "qid string, unit_id string, score double, cost bigint, spent bigint")


def registered(rankers: dict, name: str, candidates: DataFrame) -> DataFrame:
    """qid, item, pos by a ranker of the caller: a function from a question's candidates (pandas) to ordered items.

    A ranker that fails leaves a question's candidates in the order they have.
    """
    import pandas as pd

    f = rankers[name]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        try:
            items = list(f(g))
        except Exception:
            items = list(g["item"])
        return pd.DataFrame({"qid": g["qid"].iloc[0], "item": items, "pos": range(1, len(items) + 1)})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy("qid").applyInPandas(one, f"qid {kinds['qid']}, item {kinds['item']}, pos int")
