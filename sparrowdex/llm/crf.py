"""Quality classifier: a linear-chain conditional random field labels each line good or bad.

A line's features are statistics of its bytes and words and those of its neighbours. The field is fitted on documents whose label all
their lines carry; its forward-backward marginals, weighted by the lines' lengths, sum to a document's quality. Forward and backward
messages are prefix products of 2 x 2 matrices, made for all lines of a chunk at once by doubling, so a document of a million lines costs
no more for each than a short one.

The fit takes at most MAX_LABELLED documents (those with the smallest hashes of doc_id) of at most MAX_LINES lines in all; statistics and
marginals cover all lines of all documents.

Cases: a null or empty text has no lines with words and quality 1; empty lines have no length, so they only pass messages on; repeated
labels count once, and contradicting ones as good; without labels of both kinds every document has quality 1; a null doc_id is judged like
any other; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import bounded_batches, chunks, mix, released, utf8, words

#: Most labelled documents, and lines, that a fit takes.
MAX_LABELLED, MAX_LINES = 3_000, 200_000
STEPS, RATE, RIDGE = 150, 0.15, 1e-3
#: Documents of at least this quality are good.
GOOD = 0.5

_UPPER, _DIGIT, _SYMBOL, _PIPE, _BANG, _SPACE, _STOP = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]\\=_+"]] = True
_PIPE[ord("|")] = True
_BANG[ord("!")] = True
_SPACE[[9, 32]] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
OWN = 12


@dataclass
class Lines:
    """Lines of a chunk: features (lines x columns), length in characters' bytes, document, and whether each starts one."""

    x: np.ndarray
    length: np.ndarray
    row: np.ndarray
    first: np.ndarray


def lines_of(data: np.ndarray, off: np.ndarray) -> Lines:
    """All lines of the texts; a text without bytes has one empty line."""
    n_rows = len(off) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([off[:-1], breaks + 1]))
    row = np.sort(np.concatenate([np.arange(n_rows), np.searchsorted(off, breaks, "right") - 1]))
    first = np.concatenate([[True], row[1:] != row[:-1]]) if n_rows else np.zeros(0, bool)
    end = np.append(start[1:], len(data))
    ends_in_break = np.append(~first[1:], False) if n_rows else first
    length = end - start - ends_in_break
    n = len(start)
    safe = np.append(data, np.uint8(0))

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[end] - total[start]).astype(np.float64)

    size = np.maximum(length, 1).astype(np.float64)
    hashed, owner, w_start, w_end = words(data, off)
    line = np.searchsorted(start, w_start, "right") - 1
    n_words = np.bincount(line, minlength=n).astype(np.float64)
    same = np.zeros(len(hashed))
    if len(hashed):
        same[1:] = (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])
    echo = np.bincount(line, weights=same, minlength=n) / np.maximum(n_words, 1)
    key = np.zeros(n, np.uint64)
    if len(hashed):
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        key[line[begin]] = np.add.reduceat(mix(hashed), begin)
    # lines that occur again in their document
    again = np.zeros(n)
    whole = mix(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(whole, kind="stable")
    twin = whole[order][1:] == whole[order][:-1]
    again[order[1:][twin]] = again[order[:-1][twin]] = 1
    again *= n_words > 3
    upper = per_line(_UPPER[data])
    if len(data) > 1:
        wide = np.zeros(len(data), bool)
        wide[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        upper += per_line(wide)
    last = safe[np.maximum(start, start + length - 1)]
    x = np.stack(
        [
            upper / size,
            per_line(_DIGIT[data]) / size,
            np.minimum(per_line(_SYMBOL[data]) / size, 0.3),
            per_line(_PIPE[data]) / size,
            per_line(_BANG[data]) / size,
            per_line(_STOP[data]) / size,
            np.minimum(size / np.maximum(n_words, 1), 20),
            np.log1p(length),
            np.minimum(echo, 0.5),
            again,
            _STOP[last].astype(float),
            (length == 0).astype(float),
        ],
        1,
    )
    back, ahead = np.zeros_like(x), np.zeros_like(x)
    back[1:], ahead[:-1] = x[:-1], x[1:]
    back[first] = 0
    lasts = np.append(first[1:], True) if n else first
    ahead[lasts] = 0
    return Lines(np.hstack([x, back, ahead, first[:, None].astype(float), lasts[:, None].astype(float)]), length, row, first)


@dataclass
class Field:
    """Weights of a fitted field: standardisation, state weights of good against bad, and transitions."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    bias: float
    t: np.ndarray


def _scan(m: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix products of the matrices of each chain by doubling, scaled to a largest entry of 1, and the logs of the scales."""
    m, log = m.copy(), np.zeros(len(m))
    d, n = 1, len(m)
    place = np.arange(n)
    while True:
        at = np.flatnonzero(place - d >= start)
        if not len(at):
            return m, log
        a, b = m[at - d], m[at]
        c = np.empty_like(a)
        for i in range(2):
            for j in range(2):
                c[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
        top = c.max(axis=(1, 2))
        new_log = log[at - d] + log[at] + np.log(top)
        m[at], log[at] = c / top[:, None, None], new_log
        d *= 2


def forward_backward(score: np.ndarray, t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (lines x 2), pair marginals (lines x 2 x 2, of a line and the one before) and the log partition of all chains.

    score: lines x 2; t: 2 x 2 log transitions; first: starts of chains.
    """
    n = len(score)
    begins = np.flatnonzero(first)
    size = np.diff(np.append(begins, n))
    start, stop = np.repeat(begins, size), np.repeat(begins + size - 1, size)
    peak = score.max(axis=1, keepdims=True)
    state = np.exp(score - peak)
    m = np.exp(t)[None] * state[:, None, :]
    m[first] = state[first][:, None, :]  # both rows alike: no line before
    prefix, log = _scan(m, start)
    alpha = prefix[:, 0, :]
    # backward: suffix products of the matrices after a line, on the reversed order with transposed matrices
    after = np.empty_like(m)
    after[:-1] = m[1:]
    lasts = np.arange(n) == stop
    after[lasts] = np.eye(2)
    back, _ = _scan(after[::-1].transpose(0, 2, 1), n - 1 - stop[::-1])
    beta = back[::-1].transpose(0, 2, 1).sum(axis=2)
    both = alpha * beta
    marginal = both / both.sum(axis=1, keepdims=True)
    pair = np.zeros((n, 2, 2))
    inner = np.flatnonzero(~first)
    p = alpha[inner - 1][:, :, None] * m[inner] * beta[inner][:, None, :]
    pair[inner] = p / p.sum(axis=(1, 2), keepdims=True)
    return marginal, pair, float((np.log(alpha.sum(axis=1)) + log)[lasts].sum() + peak.sum())


def fit_field(x: np.ndarray, good: np.ndarray, first: np.ndarray) -> Field:
    """Maximises the conditional likelihood of the lines' labels by Adam on the exact gradient."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    y = good.astype(np.int64)
    w = np.zeros(z.shape[1] + 5)
    seen = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, STEPS + 1):
        score = np.zeros((len(z), 2))
        score[:, 1] = z @ w[:-5] + w[-5]
        marginal, pair, _ = forward_backward(score, w[-4:].reshape(2, 2), first)
        miss = marginal[:, 1] - y
        g = np.concatenate([z.T @ miss, [miss.sum()], (pair.sum(axis=0) - seen).ravel()]) / len(z) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(mean, scale, w[:-5], float(w[-5]), w[-4:].reshape(2, 2).copy())


def qualities(field: Field | None, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality, number of lines and number of bad lines of the texts."""
    n = len(off) - 1
    quality, lines, bad = np.ones(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a, b in chunks(np.diff(off), 2 << 20):
        own = lines_of(data[off[a] : off[b]], off[a : b + 1] - off[a])
        real = own.length > 0
        lines[a:b] = np.bincount(own.row[real], minlength=b - a)
        if field is None:
            continue
        score = np.zeros((len(own.x), 2))
        score[:, 1] = np.clip((own.x - field.mean) / field.scale, -8, 8) @ field.w + field.bias
        marginal = forward_backward(score, field.t, own.first)[0][:, 1]
        weight = np.bincount(own.row, weights=own.length, minlength=b - a)
        mass = np.bincount(own.row, weights=own.length * marginal, minlength=b - a)
        quality[a:b] = np.where(weight > 0, mass / np.maximum(weight, 1), 1.0)
        bad[a:b] = np.bincount(own.row[real & (marginal < 0.5)], minlength=b - a)
    return quality, lines, bad


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES) -> Field | None:
    """A field fitted on labelled documents; None without both labels."""
    few = labels.select(labels["doc_id"].alias("__id"), labels["quality"].alias("__q")).where("__id is not null and __q is not null")
    few = few.groupBy("__id").agg(F.max("__q").alias("__q")).withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").limit(max_labelled)
    rows = docs.select(docs["doc_id"].alias("__doc"), docs["text"].cast("string").alias("__text")).where("__text is not null").join(F.broadcast(few), F.col("__doc") == F.col("__id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = lines_of(*utf8(batch.column(2)))
            take = pa.array(own.row)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(own.x.astype(np.float32).ravel()), own.x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take), pa.array(own.first), flat], ["id", "q", "h", "first", "x"])

    rows = rows.select(F.col("__id").cast("long"), F.col("__q").cast("long"), "__text", "__h")
    sized = rows.select("__h", (F.length(F.regexp_replace("__text", "[^\n]", "")) + 1).alias("__n"))
    # whole documents in the order of their hashes, as long as their lines fit
    total, least = 0, None
    for h, k in sized.orderBy("__h", "__n").toPandas().itertuples(index=False):
        if total + k > max_lines and total:
            break
        total, least = total + k, h
    if least is None:
        return None
    table = rows.where(F.col("__h") <= F.lit(least)).mapInArrow(released(features), "id long, q long, h long, first boolean, x array<float>").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).astype(np.float64)
    good = table.column("q").to_numpy() != 0
    if good.all() or not good.any():
        return None
    # the chains in an order that doesn't depend on the partitions
    first = table.column("first").to_numpy()
    h = table.column("h").to_numpy()
    chain = np.cumsum(first)
    order = np.lexsort((np.arange(len(h)), chain, h))
    return fit_field(x[order], good[order], first[order])


def _judge(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality, lines, bad = qualities(field, *utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(quality, 4)), pa.array(lines), pa.array(bad), pa.array(quality >= GOOD)], ["doc_id", "quality", "n_lines", "bad_lines", "keep"])

    return run


def line_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES) -> DataFrame:
    """(doc_id, quality, n_lines, bad_lines, keep) of every document."""
    bounded_batches(docs.sparkSession)
    field = train(docs, labels, max_labelled, max_lines)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(released(_judge(field)), "doc_id long, quality double, n_lines long, bad_lines long, keep boolean")


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
