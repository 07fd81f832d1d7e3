"""Approximate nearest vectors: cells fitted on a bounded sample, short codes with an estimator, exact reranking.

Every vector is indexed: it lies in the cell of its nearest centre and has a code of a few bits for each coordinate of its rotated unit
vector. A query asks the nearest cells, scores codes there, and the best by estimate are compared exactly. Queries and vectors meet in a
join on the cell, of which a hot one is cut into blocks of either side, so neither is collected, and the cost follows the vectors in the cells
asked. There are at most a quarter as many cells as vectors in the sample; only their centres and sizes are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import _unit, rotated, top

#: Vectors that the cells are fitted on; the smallest hashes of their ids. All vectors are indexed.
SAMPLE = 50_000
#: Vectors of a block of a cell.
BLOCK = 20_000
BITS, DEPTH, PROBES, CELL = 5, 100, 12, 64
#: The recall that the number of cells aims at, and the vectors of the sample that it is measured on.
TARGET, ASKED = 0.95, 256


def centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centres of the cells, by spherical k-means over a sample. cells: by default one for each CELL vectors, as many as the sample allows."""
    n = vectors.count()
    few = vectors.select("vec_id", "embedding").withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(sample).toPandas()
    if not len(few):
        return np.zeros((1, 1))
    x = _unit(np.stack(few["embedding"].to_numpy()).astype(np.float64))
    k = min(cells or max(1, n // CELL), max(1, len(x) // 4))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        full = np.bincount(at, minlength=k) > 0
        c[full] = _unit(total[full])
    return c


def probes(vectors: DataFrame, centre: np.ndarray, k: int = 10, share: float = TARGET, sample: int = SAMPLE) -> int:
    """The cells that a query has to ask, PROBES at least, so that they hold this share of the k nearest: measured by brute force for
    ASKED vectors of the bounded sample, among the sample. Of all vectors the nearest are nearer, so they need no more cells."""
    few = vectors.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).select("embedding").toArrow()
    if not len(few):
        return PROBES
    x = _unit(np.stack(few["embedding"].to_numpy()).astype(np.float64))
    cell, needed = np.argmax(x @ centre.T, axis=1), []
    for a in range(0, min(ASKED, len(x)), 64):
        q = x[a : min(a + 64, ASKED)]
        best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-(q @ centre.T), axis=1, kind="stable"), axis=1)
        needed.append(np.take_along_axis(place, cell[best], axis=1).ravel())
    return max(PROBES, int(np.quantile(np.concatenate(needed), share, method="higher")) + 1)


def codes(x: np.ndarray, bits: int = BITS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rotated unit rows, odd numbers on 2 ** bits levels, and the product of each with its row. A row's step is the one of some
    that keeps its direction best."""
    r = rotated(_unit(x), seed)
    most = np.abs(r).max(axis=1)
    best, close = np.zeros(r.shape, np.int8), np.full(len(r), -2.0)
    for share in np.linspace(0.4, 1.0, 13):
        step = np.where(most > 0, most, 1.0) * share / (1 << (bits - 1))
        level = np.clip(2 * np.floor(r / step[:, None]) + 1, 1 - (1 << bits), (1 << bits) - 1)
        cosine = (r * level).sum(axis=1) / np.linalg.norm(level, axis=1)
        better = cosine > close
        best[better], close[better] = level[better], cosine[better]
    return best, (r * best).sum(axis=1)


def estimates(queries: np.ndarray, levels: np.ndarray, own: np.ndarray, seed: int = 7) -> np.ndarray:
    """Estimated cosines of queries with coded rows: the query's product with the code over the row's own, which has no bias."""
    return rotated(_unit(queries), seed) @ levels.T.astype(np.float64) / np.where(own > 0, own, 1.0)


def hamming_estimates(queries: np.ndarray, signs: np.ndarray, dims: int, seed: int = 7) -> np.ndarray:
    """Estimated cosines from one bit a coordinate: the share of differing bits is an angle."""
    q = np.packbits(rotated(_unit(queries), seed) > 0, axis=1)
    far = np.unpackbits(q[:, None, :] ^ signs[None, :, :], axis=2).sum(axis=2)
    return np.cos(np.pi * far / dims)


def indexed(vectors: DataFrame, centre: np.ndarray, bits: int = BITS) -> DataFrame:
    """(vec_id, cell, levels, own, embedding): all vectors. A table of it, written by cell, is the stored index."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["embedding"].to_numpy()).astype(np.float64)
                levels, own = codes(x, bits)
                yield pd.DataFrame({"vec_id": f["vec_id"], "cell": np.argmax(_unit(x) @ centre.T, axis=1), "levels": [v.tobytes() for v in levels], "own": own, "embedding": f["embedding"]})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id long, cell long, levels binary, own double, embedding array<float>")


def nearest(queries: DataFrame, index: DataFrame, centre: np.ndarray, k: int = 10, probes: int = PROBES, depth: int = DEPTH) -> DataFrame:
    """(query_id, vec_id, score, rank): about the k nearest of the indexed vectors by cosine; the scores are exact."""
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    held = index.join(F.broadcast(sizes), "cell").withColumn("block", block).drop("blocks")

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _unit(np.stack(f["embedding"].to_numpy()).astype(np.float64))
                near = np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": np.repeat(f["query_id"].to_numpy(), near.shape[1]), "cell": near.ravel(), "q": np.repeat(f["embedding"].to_numpy(), near.shape[1])})

    wanted = queries.select("query_id", "embedding").mapInPandas(asked, "query_id long, cell long, q array<float>")
    # a cell that many queries ask is cut on that side, too
    crowds = wanted.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("crowds"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    wanted = wanted.join(F.broadcast(crowds), "cell").join(F.broadcast(sizes), "cell").select("query_id", "cell", F.pmod(F.xxhash64("query_id"), F.col("crowds")).alias("crowd"), every("blocks").alias("block"), "q")
    held = held.join(F.broadcast(crowds), "cell").select("vec_id", "cell", every("crowds").alias("crowd"), "block", "levels", "own", "embedding")

    def scored(_key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        x, y = np.stack(q["q"].to_numpy()).astype(np.float64), np.stack(v["embedding"].to_numpy()).astype(np.float64)
        levels = np.stack([np.frombuffer(b, np.int8) for b in v["levels"]])
        ids, out = v["vec_id"].to_numpy(), []
        for a in range(0, len(x), 256):  # queries of a block at a time
            guess = estimates(x[a : a + 256], levels, v["own"].to_numpy())
            at = np.argsort(-guess, axis=1, kind="stable")[:, :depth]
            exact = np.einsum("qd,qcd->qc", _unit(x[a : a + 256]), _unit(y)[at])
            out.append(pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy()[a : a + 256], at.shape[1]), "vec_id": ids[at].ravel(), "score": np.round(exact, 9).ravel()}))
        return pd.concat(out)

    found = wanted.groupBy("cell", "crowd", "block").cogroup(held.groupBy("cell", "crowd", "block")).applyInPandas(scored, "query_id long, vec_id long, score double")
    return top(found, k, item="vec_id")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows (query_id, vec_id) that were found."""
    n = exact.count()
    return exact.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
