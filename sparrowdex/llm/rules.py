"""Quality rules: a decision list learned by sequential covering, emitted as an ordered Spark conditional expression.

Rules are conjunctions of thresholds on document statistics. Each is grown on two thirds of the labelled documents by FOIL gain, pruned
on the rest by (p - n) / (p + n), and kept if it is precise enough there; the documents it covers are set aside and the next rule is
learned, until no rule is precise enough. Cuts are the midpoints between all neighbouring values that occur, and neither rules nor
conditions are limited in number. The fit sees at most MAX_LABELLED documents (those with the smallest hashes of doc_id), the only bound
here: statistics and decisions cover all documents.

Cases: a null or empty text has all statistics 0 and is judged by the rules like any other; null doc_id is judged but never labelled;
repeated labels of a document count once, and contradicting ones as good; without labels, or without bad ones, the list is empty and
every document stays; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most labelled documents that a fit takes.
MAX_LABELLED = 20_000
#: Least precision of a rule on the pruning third.
MIN_PRECISION = 0.9

STATS = ("chars", "words", "upper", "digit", "symbol", "pipe", "bang", "word_len", "line_len", "repeated", "echo")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name, of built-in expressions."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    share = lambda x: F.round(F.when(chars > 0, x / chars).otherwise(0.0), 6)
    words, lines = count(r"\S+"), F.split(t, "\n")
    n_lines = F.size(lines).cast("double")
    return {
        "chars": chars,
        "words": words,
        "upper": share(count(r"\p{Lu}")),
        "digit": share(count("[0-9]")),
        "symbol": share(count(r"[#$%&*@^~<>{}\[\]\\=_+]")),
        "pipe": share(count(r"\|")),
        "bang": share(count("!")),
        "word_len": F.round(F.when(words > 0, chars / words).otherwise(0.0), 6),
        "line_len": F.round(chars / n_lines, 6),
        "repeated": F.round(1.0 - F.size(F.array_distinct(lines)) / n_lines, 6),
        "echo": F.round(F.when(words > 0, count(r"(?<!\S)(\S+)(?= \1(?!\S))") / words).otherwise(0.0), 6),
    }


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, STATS.index(self.stat)]
        return v > self.cut if self.above else v <= self.cut

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.stat] > self.cut if self.above else stats[self.stat] <= self.cut

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _cuts(v: np.ndarray) -> np.ndarray:
    u = np.unique(v)
    return (u[1:] + u[:-1]) / 2


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while True:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for k, s in enumerate(STATS):
            v = x[inside, k]
            cuts = _cuts(v)
            if not len(cuts):
                continue
            order = np.argsort(v, kind="stable")
            cum = np.concatenate([[0], np.cumsum(bad[inside][order])])
            at = np.searchsorted(v[order], cuts, "right")
            for above in (True, False):
                p = p0 - cum[at] if above else cum[at]
                n = (len(v) - at if above else at) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
                j = int(np.argmax(g))
                if g[j] > gain:
                    gain, best = float(g[j]), Condition(s, above, float(np.round(cuts[j], 6)))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    c = covers(rule, x)
    p, n = int((c & bad).sum()), int((c & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, held: np.ndarray) -> list[Rule]:
    """The ordered rules for bad documents. held: rows of the pruning third."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while (left & bad & ~held).any():
        grown = left & ~held
        rule = _grow(x[grown], bad[grown])
        if not rule:
            break
        tried, trial = x[left & held], bad[left & held]
        best = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, tried, trial))
        c = covers(best, tried)
        p, n = int((c & trial).sum()), int((c & ~trial).sum())
        if not p or p / (p + n) < MIN_PRECISION:
            # too few held rows to prune on, or an imprecise rule: judge the unpruned one on all rows that are left
            c, best = covers(rule, x[left]), rule
            p, n = int((c & bad[left]).sum()), int((c & ~bad[left]).sum())
            if p < 3 or p / (p + n) < max(MIN_PRECISION, 0.95):
                break
        rules.append(best)
        left &= ~covers(best, x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules learned from the documents that labels cover."""
    few = labels.select(labels["doc_id"].alias("__id"), labels["quality"].alias("__q")).where("__id is not null and __q is not null")
    few = few.groupBy("__id").agg(F.max("__q").alias("__q")).withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").limit(max_labelled)
    stats = statistics(F.col("__text"))
    rows = docs.select(docs["doc_id"].alias("__doc"), docs["text"].alias("__text")).join(F.broadcast(few), F.col("__doc") == F.col("__id"))
    rows = rows.select("__id", "__q", "__h", *[c.alias(f"__s_{k}") for k, c in stats.items()]).toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values(list(rows.columns), kind="stable").drop_duplicates("__id")
    return learn(rows[[f"__s_{k}" for k in STATS]].to_numpy(float), rows["__q"].to_numpy() == 0, rows["__h"].to_numpy() % 3 == 0)


def decision(rules: list[Rule], stats: dict[str, Column]) -> Column:
    """Number of the first rule that holds, from 1; null where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column(stats)
        for c in rule[1:]:
            holds = holds & c.column(stats)
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the pipeline: the documents that no rule rejects."""
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not rules:
        return docs
    used = {c.stat for r in rules for c in r}
    stats = F.struct(*[v.alias(k) for k, v in statistics(docs["text"]).items() if k in used])
    # a generator of one row: the optimizer can't copy a statistic into each condition that reads it
    once = docs.select(*[docs[c] for c in docs.columns], F.explode(F.array(stats)).alias("__stats"))
    return once.where(decision(rules, {k: F.col(f"__stats.{k}") for k in used}).isNull()).drop("__stats")


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Of every document its statistics, the number and text of the rule that rejects it, and whether it stays."""
    rules = fit(docs, labels, max_labelled)
    stats = statistics(docs["text"])
    rows = docs.select(docs["doc_id"], *[v.alias(k) for k, v in stats.items()])
    rows = rows.withColumn("rule", decision(rules, {k: F.col(k) for k in STATS}))
    said = F.lit(None).cast("string")
    for k, r in enumerate(rules, 1):
        said = F.when(F.col("rule") == k, F.lit(" and ".join(map(str, r)))).otherwise(said)
    return rows.select("doc_id", *STATS, "rule", said.alias("reason"), F.col("rule").isNull().alias("keep"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
