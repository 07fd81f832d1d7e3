"""Evaluation of runs (query_id, doc_id, score) against judgements (query_id, doc_id, grade)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRIALS, TRUSTWORTHY = 10_000, 0.87


def ordered(run: DataFrame) -> DataFrame:
    """run with rank: score down, then doc_id down."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))).cast("long"))


def by_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, ap, rr, recall) of every judged query with something relevant; a query that the run lacks has zeros."""
    judged = qrels.where("grade is not null")
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    ideal = judged.where("grade > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("idcg"), F.count("*").alias("relevant"))
    found = ordered(run).join(judged, ["query_id", "doc_id"]).where("grade > 0")
    found = found.withColumn("hits", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    found = found.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.col("hits") / F.col("rank")).alias("precisions"),
        F.max(1.0 / F.col("rank")).alias("rr"),
        F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("at_k"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(found, "query_id", "left").select("query_id", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("precisions") / F.col("relevant")).alias("ap"), zero(F.col("rr")).alias("rr"), zero(F.col("at_k") / F.col("relevant")).alias("recall"))


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: the means over queries with something relevant, their number, and the number of skipped ones."""
    each = by_query(run, qrels, k)
    means = each.agg(*[F.avg(c).alias(c) for c in ("ndcg", "ap", "rr", "recall")], F.count("*").alias("queries"))
    return means.crossJoin(qrels.agg(F.countDistinct("query_id").alias("judged"))).withColumn("skipped", F.col("judged") - F.col("queries")).drop("judged")


def confusion(gold: DataFrame, judge: DataFrame) -> DataFrame:
    """(gold, judge, n) of the grades of the pairs that gold has; judge is null where it lacks one."""
    j = judge.withColumnRenamed("grade", "judge")
    return gold.withColumnRenamed("grade", "gold").join(j, ["query_id", "doc_id"], "left").groupBy("gold", "judge").agg(F.count("*").alias("n"))


def kendall(gold: DataFrame, judge: DataFrame) -> DataFrame:
    """One row (tau_b, trusted) of the pairs judged by both, from the confusion counts: its cost doesn't grow with the pairs."""
    c = confusion(gold, judge).where("judge is not null")
    o = c.withColumnsRenamed({"gold": "g2", "judge": "j2", "n": "n2"})
    s = F.signum(F.col("gold") - F.col("g2")) * F.signum(F.col("judge") - F.col("j2"))
    w = (F.col("n") * F.col("n2")).cast("double")
    both = c.crossJoin(o).agg(F.sum(s * w).alias("s"), F.sum(F.when(F.col("gold") != F.col("g2"), w)).alias("a"), F.sum(F.when(F.col("judge") != F.col("j2"), w)).alias("b"))
    tau = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("s") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0)
    return both.select(tau.alias("tau_b"), (tau >= TRUSTWORTHY).alias("trusted"))


def pooled(*runs: DataFrame, depth: int = 100) -> DataFrame:
    """(query_id, doc_id): the union of the first depth of every run."""
    out = None
    for r in runs:
        one = ordered(r).where(F.col("rank") <= depth).select("query_id", "doc_id")
        out = one if out is None else out.unionAll(one)
    return out.distinct()


def overlaid(base: DataFrame, gold: DataFrame) -> DataFrame:
    """Judgements of both; gold's grade holds where both have one."""
    return base.withColumnRenamed("grade", "b").join(gold.withColumnRenamed("grade", "g"), ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.coalesce("g", "b").alias("grade"))


def randomisation(differences: np.ndarray, trials: int = TRIALS, seed: int = 1) -> float:
    """p of the mean of paired differences under random signs."""
    if not len(differences):
        return 1.0
    rng, seen, hits = np.random.default_rng(seed), abs(differences.mean()) - 1e-12, 0
    for a in range(0, trials, 1000):
        sign = rng.choice([-1.0, 1.0], (min(1000, trials - a), len(differences)))
        hits += int((np.abs(sign @ differences) / len(differences) >= seen).sum())
    return (hits + 1) / (trials + 1)
