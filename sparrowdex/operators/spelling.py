"""Spelling: symmetric deletes as a table, lookups as an equi-join on variants, a policy that keeps, corrects or suggests. Query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.words import analyse, osa_udf

MIN_DF, MAX_LEN, MAX_EDIT = 2, 24, 2
KEEP_ABOVE, MARGIN = 2, 10


def deletes(word: Column, distance: int = MAX_EDIT) -> Column:
    """The word and what is left of it without up to so many characters; one character at least stays."""
    every = F.array(word)
    for _ in range(distance):
        shorter = F.flatten(F.transform(every, lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))))
        every = F.array_distinct(F.concat(every, shorter))
    return every


def dictionary(vocabulary: DataFrame) -> DataFrame:
    """(term, df) of a vocabulary that spelling takes; of a repeated term the larger df holds."""
    return vocabulary.groupBy("term").agg(F.max("df").alias("df")).where((F.col("df") >= MIN_DF) & (F.length("term") <= MAX_LEN))


def variants(words: DataFrame, distance: int = MAX_EDIT) -> DataFrame:
    """(variant, term, df)."""
    return words.select(F.explode(deletes(F.col("term"), distance)).alias("variant"), "term", "df")


def candidates(queries: DataFrame, words: DataFrame, distance: int = MAX_EDIT) -> DataFrame:
    """(query, term, df, dist) of all terms within the distance of the queries (query)."""
    q = queries.select("query").distinct()
    pairs = q.select("query", F.explode(deletes(F.col("query"), distance)).alias("variant")).join(variants(words, distance), "variant").select("query", "term", "df").distinct()
    return pairs.withColumn("dist", osa_udf("query", "term", distance)).where("dist >= 0")


def _best(found: DataFrame) -> DataFrame:
    """(query, term, df, dist): the nearest other term of each query, of equals the most frequent, then the first."""
    x = found.where("dist > 0").groupBy("query").agg(F.min(F.struct("dist", (-F.col("df")).alias("less"), "term")).alias("x"))
    return x.select("query", "x.term", (-F.col("x.less")).alias("df"), "x.dist")


def corrections(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(query, action, term, dist): keep, correct, suggest or none.

    A known word is kept whatever is near it, so it isn't looked up; and only those without a word at distance 1 meet the far
    more variants of larger distances.
    """
    # words, and queries that are looked up, have many variants each: they are spread over all tasks
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = cut(words.repartition(tasks, "term"))
    q = queries.select("query").distinct().join(words.select(F.col("term").alias("query"), F.col("df").alias("own")), "query", "left")
    q = cut(q)
    known = F.coalesce(F.col("own"), F.lit(0)) > KEEP_ABOVE
    open_, best = q.where(~known).select("query").repartition(tasks, "query"), None
    for distance in range(1, MAX_EDIT + 1):
        near = cut(_best(candidates(open_, words, distance)))
        best = near if best is None else best.union(near)
        open_ = open_.join(near.select("query"), "query", "left_anti").repartition(tasks, "query")
    out = q.join(best, "query", "left")
    sure = (F.col("dist") <= 1) & (F.col("own").isNull() | (F.col("df") >= MARGIN * F.col("own")))
    action = F.when(known, "keep").when(F.col("term").isNull(), F.when(F.col("own").isNotNull(), "keep").otherwise("none")).when(sure, "correct").otherwise("suggest")
    changed = action.isin("correct", "suggest")
    return out.select("query", action.alias("action"), F.when(changed, F.col("term")).alias("term"), F.when(changed, F.col("dist")).alias("dist"))


#: Forms that stand for each other: short forms of names and trades, two spellings of a word, names of programs.
GROUPS = tuple(
    tuple(x.strip() for x in g.split("="))
    for g in (
        "nyc=new york city|usa=united states of america|uk=united kingdom|eu=european union|"
        "ml=machine learning|ai=artificial intelligence|nlp=natural language processing|api=application programming interface|"
        "cpu=central processing unit|gpu=graphics processing unit|db=database|os=operating system|oss=open source software|"
        "color=colour|gray=grey|center=centre|catalog=catalogue|organize=organise|analyze=analyse|license=licence|"
        "js=javascript|ts=typescript|k8s=kubernetes|postgres=postgresql"
    ).split("|")
)


def expansion(groups=GROUPS, analyzer=analyse, split: bool = True) -> dict[str, list[str]]:
    """Other forms of every form of one word. A form of several words is its words, each a term that postings can hold; with split=False it
    is one term, which none equals."""
    out: dict[str, set[str]] = {}
    for g in groups:
        forms = [tuple(analyzer(x)) for x in g]
        for key in forms:
            if len(key) == 1:
                others = (x for x in forms if x != key)
                out.setdefault(key[0], set()).update(w for x in others for w in (x if split else (" ".join(x),)) if w != key[0])
    return {k: sorted(v) for k, v in sorted(out.items())}


def expanded(terms: DataFrame, groups=GROUPS) -> DataFrame:
    """(query_id, term, base): the terms of queries and their other forms."""
    pairs = [(k, x) for k, v in expansion(groups).items() for x in v]
    table = terms.sparkSession.createDataFrame(pairs, "base string, alt string")
    more = terms.select("query_id", F.col("term").alias("base")).join(F.broadcast(table), "base").select("query_id", F.col("alt").alias("term"), "base")
    return terms.select("query_id", "term", F.col("term").alias("base")).union(more).distinct()
