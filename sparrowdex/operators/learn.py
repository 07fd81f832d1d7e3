"""Learning to rank: online features, lexical judge, data sets, LambdaMART and its application to tables."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import randomisation

#: Characters of a body that the online features look at; grades and the index read all.
BODY_CHARS = 10_000
WEIGHT = {"title": 3.0, "body": 1.0, "url": 1.0, "anchor": 2.0}
B = {"title": 0.4, "body": 0.75, "url": 0.4, "anchor": 0.5}
ONLINE = (
    "bm25f_total", "bm25_title", "bm25_body", "bm25_url", "dense_cosine", "term_coverage", "term_coverage_title", "exact_match", "exact_match_title", "ordered_proximity", "unordered_proximity",
    "min_pair_distance", "first_occurrence", "field_hit_title", "field_hit_body", "url_term_match", "url_exact_host", "query_length", "idf_sum", "idf_max", "bm25_anchor",
)


def _has_run(tokens: list[str], words: list[str]) -> bool:
    n = len(words)
    return n > 0 and any(tokens[i : i + n] == words for i in range(len(tokens) - n + 1))


def _smallest_window(hits: list[tuple[int, str]], want: int) -> int:
    """Width of the smallest window with all want terms."""
    seen: dict[str, int] = {}
    best = 0
    for at, t in hits:
        seen[t] = at
        if len(seen) == want:
            width = at - min(seen.values()) + 1
            best = min(best, width) if best else width
    return best


def _ordered_span(tokens: list[str], words: list[str]) -> int:
    """Width of the smallest window with the words in order: forward to an end, back to the latest start."""
    best, at = 0, 0
    while True:
        k, j = 0, at
        while j < len(tokens) and k < len(words):
            k += tokens[j] == words[k]
            j += 1
        if k < len(words):
            return best
        end, k, i = j - 1, len(words) - 1, j - 1
        while True:
            if tokens[i] == words[k]:
                if not k:
                    break
                k -= 1
            i -= 1
        width = end - i + 1
        best = min(best, width) if best else width
        at = i + 1


def online_row(query: list[str], fields: dict[str, list[str]], host: str, idf: dict[str, float], averages: dict[str, float], cosine: float | None, k1: float = 0.9, b: dict[str, float] = B, w: dict[str, float] = WEIGHT) -> list[float]:
    """The features of ONLINE for one query and document. fields: tokens by field, as far as they are looked at; a term without idf weighs 1."""
    terms = list(dict.fromkeys(query))
    counts = {f: {t: fields[f].count(t) for t in terms} for f in fields}
    norm = {f: 1 - b[f] + b[f] * len(fields[f]) / averages[f] if averages[f] > 0 else 1.0 for f in fields}

    def single(f: str) -> float:
        return sum(idf.get(t, 1.0) * n * (k1 + 1) / (n + k1 * norm[f]) for t, n in counts[f].items() if n)

    weighted = {t: sum(w[f] * counts[f][t] / norm[f] for f in fields) for t in terms}
    total = sum(idf.get(t, 1.0) * x / (k1 + x) for t, x in weighted.items() if x)

    body, title = fields["body"], fields["title"]
    wanted = set(terms)
    hits = [(i, t) for i, t in enumerate(body) if t in wanted]
    gaps = [y[0] - x[0] for x, y in zip(hits, hits[1:]) if x[1] != y[1]]
    there = {t for _, t in hits}
    window = _smallest_window(hits, len(there)) if len(hits) >= 2 else 0
    span = _ordered_span(body, terms) if len(terms) > 1 and len(there) == len(terms) else 0
    n = len(terms) or 1
    weights = [idf.get(t, 1.0) for t in terms]
    labels = set(host.lower().split("."))
    return [
        total, single("title"), single("body"), single("url"), -1.0 if cosine is None else cosine,
        sum(any(counts[f][t] for f in ("title", "body", "url")) for t in terms) / n, sum(counts["title"][t] > 0 for t in terms) / n,
        float(_has_run(body, query)), float(_has_run(title, query)), 1 / (1 + span) if span else 0.0, 1 / (1 + window) if window else 0.0,
        1 / (1 + min(gaps)) if gaps else 0.0, 1 / (1 + hits[0][0]) if hits else 0.0, float(sum(counts["title"][t] > 0 for t in terms)), float(sum(counts["body"][t] > 0 for t in terms)),
        float(sum(counts["url"][t] > 0 for t in terms)), float(any(t in labels for t in terms)), float(len(terms)), sum(weights), max(weights, default=0.0), single("anchor"),
    ]


def grade(query: Column, body: Column, title: Column) -> Column:
    """Lexical grade 0 to 3 of token arrays: none, less than half, a part or all of the query's terms; 3 if all are in the title."""
    q = F.array_distinct(query)
    n = F.size(q)
    seen = F.size(F.array_intersect(q, F.array_union(body, title)))
    return F.when((n == 0) | (seen == 0), 0).when(2 * seen < n, 1).when((seen == n) & (F.size(F.array_intersect(q, title)) == n), 3).otherwise(2)


@dataclass
class Tree:
    """Arrays by node: feature (-1 for leaves), threshold, children, value. A row at most the threshold goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            at[inner] = np.where(x[inner, f[inner]] <= self.threshold[node], self.left[node], self.right[node])


def bounds(v: np.ndarray, most: int = 255) -> np.ndarray:
    """Upper bounds of bins of equal frequency; one for each value where they are few."""
    u = np.unique(v)
    if len(u) <= most:
        return u
    s = np.sort(v)
    return np.unique(s[[k * len(s) // most - 1 for k in range(1, most + 1)]])


def lambdas(score: np.ndarray, label: np.ndarray, groups: np.ndarray, cutoff: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of all pairs of each group. groups: their sizes."""
    g, h, at = np.zeros(len(score)), np.zeros(len(score)), 0
    for n in groups:
        s, y = score[at : at + n], label[at : at + n]
        gain = 2.0**y - 1
        ideal = float((np.sort(gain)[::-1][:cutoff] / np.log2(np.arange(2, min(n, cutoff) + 2))).sum())
        if n > 1 and ideal > 0:
            rank = np.empty(n)
            rank[np.lexsort((np.arange(n), -s))] = np.arange(n)
            disc = 1 / np.log2(rank + 2)
            a, b = np.nonzero(y[:, None] > y[None, :])
            d = np.abs((gain[a] - gain[b]) * (disc[a] - disc[b])) / ideal
            rho = 1 / (1 + np.exp(np.clip(s[a] - s[b], -500, 500)))
            np.add.at(g, at + a, d * rho)
            np.subtract.at(g, at + b, d * rho)
            for x in (a, b):
                np.add.at(h, at + x, d * rho * (1 - rho))
        at += n
    return g, h


def _tree(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, leaves: int, least: int, l2: float, rate: float) -> Tree:
    feature, threshold, left, right, value = [-1], [0.0], [0], [0], [0.0]
    width = max(len(c) for c in cuts)

    def best(rows: np.ndarray) -> tuple[float, int, int]:
        key = (bins[rows] + np.arange(bins.shape[1]) * width).ravel()
        sums = [np.bincount(key, w, bins.shape[1] * width).reshape(-1, width).cumsum(axis=1) for w in (np.repeat(g[rows], bins.shape[1]), np.repeat(h[rows], bins.shape[1]), np.ones(len(key)))]
        gl, hl, nl = sums
        gt, ht, nt = g[rows].sum(), h[rows].sum(), len(rows)
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain[(nl < least) | (nt - nl < least)] = -np.inf
        k = int(np.argmax(gain))
        return float(gain.flat[k]), k // width, k % width

    rows = {0: np.arange(len(bins))}
    open_ = {0: best(rows[0])}
    while len(rows) < leaves and open_:
        node = max(open_, key=lambda k: (open_[k][0], -k))
        gain, f, cut = open_.pop(node)
        if gain <= 1e-12:
            break
        go = bins[rows[node], f] <= cut
        feature[node], threshold[node] = f, float(cuts[f][cut])
        for side, part in ((left, rows[node][go]), (right, rows[node][~go])):
            new = len(feature)
            side[node] = new
            for x, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
                x.append(v)
            rows[new] = part
            if len(part) >= 2 * least:
                open_[new] = best(part)
        del rows[node]
    for node, r in rows.items():
        value[node] = rate * g[r].sum() / (h[r].sum() + l2)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def lambdamart(x: np.ndarray, label: np.ndarray, groups: np.ndarray, rounds: int = 300, rate: float = 0.1, leaves: int = 32, least: int = 5, l2: float = 1.0, cutoff: int = 10) -> list[Tree]:
    """Trees fitted one after the other to the lambdas of the groups. Judged sets are small beside the corpus and are fitted on the driver."""
    cuts = [bounds(x[:, k]) for k in range(x.shape[1])]
    bins = np.stack([np.minimum(np.searchsorted(c, x[:, k]), len(c) - 1) for k, c in enumerate(cuts)], 1)
    score, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        g, h = lambdas(score, label, groups, cutoff)
        if not g.any():
            break
        trees.append(_tree(bins, cuts, g, h, leaves, least, l2, rate))
        score += trees[-1].predict(x)
    return trees


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        out += t.predict(x)
    return out


def scored(rows: DataFrame, trees: list[Tree], features: list[str], name: str = "score") -> DataFrame:
    """rows with the ensemble's score of their feature columns; batches of numbers only go to Python."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(predict(trees, np.stack(b.to_numpy()).astype(np.float64)) if len(b) else np.zeros(0))

    return rows.withColumn(name, run(F.array(*[F.col(f).cast("double") for f in features])))


def model_table(spark, trees: list[Tree]) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value): a model as rows, to be written and read like any table."""
    rows = [(k, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), float(t.value[n])) for k, t in enumerate(trees) for n in range(len(t.feature))]
    return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value double")


def model_of(table: DataFrame) -> list[Tree]:
    p = table.orderBy("tree", "node").toPandas()
    return [Tree(*(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value"))) for _, t in p.groupby("tree")]


def split_queries(ids: list[str], share: float = 0.2) -> tuple[list[str], list[str]]:
    """Training and evaluation queries, in the order of a 64-bit hash."""

    def fnv(text: str) -> int:
        h = 1469598103934665603
        for byte in text.encode():
            h = ((h ^ byte) * 1099511628211) & (2**64 - 1)
        return h

    order = sorted(ids, key=lambda q: (fnv(q), q))
    n = math.floor(share * len(order) + 0.5)
    n = min(max(n, 1), len(order) - 1) if len(order) > 1 else n
    return order[n:], order[:n]


def grouped(rows: DataFrame, size: int = 16) -> DataFrame:
    """Cold-start groups: rows (doc_id, ...) in the order of doc_id, so many in a group.

    doc_id is a dense number, so that no total order has to be made by one task.
    """
    return rows.withColumn("query_id", F.floor(F.col("doc_id") / size))


def query_file(text: str) -> list[tuple[str, str]]:
    """(query_id, text) of the lines of a file of queries: an id, a tab and the text, or the text alone, which is numbered by its line. Empty
    lines and those that begin with # don't count."""
    out = []
    for k, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, tab, rest = line.partition("\t")
        out.append((name.strip(), rest.strip()) if tab else (f"q{k:04d}", line))
    return out


def grade_prompt(query: str, title: str, body: str, most: int = 3) -> str:
    """What a language model that judges is asked."""
    return (
        f"How well does the page answer the query? Reply with one whole number from 0 to {most}: 0 not at all, 1 touches the topic, "
        f"2 answers in part, {most} answers in full.\n\nQuery: {query}\nTitle: {title}\nText: {body}\nGrade:"
    )


def grade_reply(reply: str, most: int = 3) -> int:
    """The last whole number of a reply, within 0 and most; a reply without one is an error."""
    found = re.findall(r"-?\d+", reply)
    if not found:
        raise ValueError(f"no grade in {reply!r}")
    return min(max(int(found[-1]), 0), most)


def judged_by(pairs: DataFrame, judge, most: int = 3) -> DataFrame:
    """(query_id, doc_id, grade) of pairs (query_id, doc_id, query, title, body) by a callable of one's own, as a client of a language model:
    prompt -> reply. It runs where the pairs are; a reply without a grade ends the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            grades = [grade_reply(judge(grade_prompt(q, t, b, most)), most) for q, t, b in zip(f["query"], f["title"], f["body"], strict=True)]
            yield pd.DataFrame({"query_id": f["query_id"], "doc_id": f["doc_id"], "grade": grades})

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    return pairs.select("query_id", "doc_id", "query", "title", "body").mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, grade int")


@dataclass
class Outcome:
    """What training gained over the order before it on queries that it hasn't seen."""

    trees: list[Tree]
    trained: float
    untrained: float
    p: float

    @property
    def improved(self) -> bool:
        return self.trained > self.untrained


def ndcg(label: np.ndarray, score: np.ndarray, k: int = 10) -> float:
    """NDCG of one query's rows; 0 without anything relevant."""
    gain, disc = 2.0**label - 1, 1 / np.log2(np.arange(2, k + 2))
    top, best = gain[np.lexsort((np.arange(len(score)), -score))][:k], np.sort(gain)[::-1][:k]
    ideal = float((best * disc[: len(best)]).sum())
    return float((top * disc[: len(top)]).sum()) / ideal if ideal else 0.0


def bootstrap(x: np.ndarray, label: np.ndarray, query: np.ndarray, before: np.ndarray, share: float = 0.2, **options) -> Outcome:
    """Trains on some queries' judged rows and compares with the order before on the others. Rows of a query are together; queries are split
    by a hash, so a query is on one side whole."""
    train, held = split_queries(list(dict.fromkeys(map(str, query))), share)
    name = np.array([str(q) for q in query])
    fit = np.isin(name, train)
    groups = np.unique(name[fit], return_counts=True)[1] if fit.any() else np.zeros(0, int)
    order = np.argsort(name[fit], kind="stable")
    trees = lambdamart(x[fit][order], label[fit][order], groups, **options) if fit.any() else []
    after = predict(trees, x)
    scored_ = [(ndcg(label[name == q], after[name == q]), ndcg(label[name == q], before[name == q])) for q in held if (label[name == q] > 0).any()]
    a, b = (np.array(v) for v in zip(*scored_)) if scored_ else (np.zeros(0), np.zeros(0))
    return Outcome(trees, float(a.mean()) if len(a) else 0.0, float(b.mean()) if len(b) else 0.0, randomisation(a - b))
