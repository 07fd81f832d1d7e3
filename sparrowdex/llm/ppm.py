"""Language-model scores by prediction by partial matching over bytes.

The pretrained model is a trie of byte contexts up to ORDER, counted over all documents, with packed paths (a context's bytes and the
next one). Half of the documents, by a hash of doc_id, is scored with counts of the other half, so no document
is predicted from itself. A byte is coded at the longest known context; what that hasn't seen escapes (method C: a context of total C
with q different bytes escapes with q / (C + q)) to the next shorter one, where the bytes that the longer one has seen are excluded.
Contexts of a static trie nest, so totals after exclusion depend on the longer context alone and are stored with it. Bytes unseen
everywhere are coded evenly among those that are left.

A byte's code length depends on its path alone, so it is computed once for each distinct path. Counting makes partial sums beside the
scan and adds them by shuffle. All paths whose contexts end in the same two bytes meet in one task with the first two levels, which have
65,792 paths at most; that is all a path's code length needs. Workers hold the code lengths of the CACHED most frequent paths; bytes
of other paths join theirs by shuffle. No path is dropped: CACHED only decides where a code length is looked up.

Adaptive scores, where a document's own trie grows with every byte, are made by adaptive_bits.

Cases: before a text stand zero bytes, which a NUL byte in a text can't be told from; null and empty texts have 0 bytes, 0 bits and a null rate; a null doc_id belongs to half 0; repeated rows give repeated rows and count
each time; an empty table gives no rows; a half without documents predicts evenly; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import HashIndex, bounded_batches, checkpointed, chunks, mix, ragged, released, shared_dir, utf8

ORDER = 4
#: Paths whose code lengths each worker holds; the others are joined.
CACHED = 600_000
#: Paths whose code lengths are computed at once; contexts that end in the same two bytes stay together.
_BUNDLE = 1 << 19
_CHUNK = 1 << 20
_FLUSH = 750_000


def _half(doc_id: pa.Array) -> np.ndarray:
    x = pc.fill_null(doc_id.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    return (mix(x.astype(np.uint64) + np.uint64(1)) & np.uint64(1)).astype(np.int64)


def _paths(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """Packed paths of all bytes: the order bytes before each (0 before a text) and itself."""
    size = np.diff(off)
    n = len(data)
    place = np.arange(n) + np.repeat(np.arange(1, len(size) + 1) * order, size)
    padded = np.zeros(n + len(size) * order, np.int64)
    padded[place] = data
    out = data.astype(np.int64)
    for k in range(1, order + 1):
        out |= padded[place - k] << (8 * k)
    return out


def _runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], n


def _counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _runs(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys >> 48), pa.array(keys & ((1 << 48) - 1)), pa.array(counts.astype(np.int64))], ["half", "path", "n"])

        for batch in batches:
            half = _half(batch.column(0))
            data, off = utf8(batch.column(1))
            for a, b in chunks(np.diff(off), _CHUNK):
                paths = _paths(data[off[a] : off[b]], off[a : b + 1] - off[a], order)
                held.append(_runs(paths | (np.repeat(half[a:b], np.diff(off[a : b + 1])) << 48)))
                if sum(len(k) for k, _ in held) > _FLUSH:
                    held = [merged()]
                    if len(held[0][0]) > _FLUSH // 2:
                        yield out(*held[0])
                        held = []
        if held:
            yield out(*merged())

    return run


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(half, path, n) of the longest paths of all documents."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return checkpointed(rows.mapInArrow(released(_counter(order)), "half long, path long, n long").groupBy("half", "path").agg(F.sum("n").alias("n")))


def _suffixes(top: DataFrame, level: int) -> DataFrame:
    mask = (1 << (8 * (level + 1))) - 1
    return top.groupBy("half", F.col("path").bitwiseAND(F.lit(mask)).alias("path")).agg(F.sum("n").alias("n"))


def _least(rows: DataFrame, most: int, *by: str) -> int | None:
    """The least count such that no group has more than most rows of at least that count."""
    kept = F.sum("count").over(Window.partitionBy(*by).orderBy(F.desc("n")))
    return rows.groupBy(*by, "n").count().withColumn("kept", kept).where(F.col("kept") <= most).groupBy(*by).agg(F.min("n").alias("n")).agg(F.max("n")).first()[0]


def train(docs: DataFrame, order: int = ORDER, max_nodes: int | None = None) -> str:
    """The model as a table for other programs: a folder with (level, half, path, n). max_nodes: a bound for each level, if one is wanted."""
    top = counted(docs, order)
    folder, cutoff = shared_dir(docs.sparkSession, "ppm"), 1
    for level in range(order, -1, -1):
        rows = _suffixes(top, level)
        if max_nodes is not None:
            least = _least(rows, max_nodes, "half") or 1
            cutoff = min(cutoff, least) if level < order else least  # a shorter path is never rarer, so it stays if its extension does
        rows.where(F.col("n") >= cutoff).withColumn("level", F.lit(level)).write.mode("append").parquet(folder)
    return folder


class Level:
    """Paths of one length: their counts, and contexts with total, number of bytes and what a longer context excludes."""

    def __init__(self, path: np.ndarray, n: np.ndarray):
        self.path, self.n = path, n.astype(np.float64)
        context = path >> 8
        self.first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(path) else np.zeros(0, np.int64)
        self.context = context[self.first]
        self.total = np.add.reduceat(self.n, self.first) if len(path) else np.zeros(0)
        self.kinds = np.diff(np.append(self.first, len(path))).astype(np.float64)
        self.of_path = np.repeat(np.arange(len(self.first)), self.kinds.astype(np.int64))
        self.paths, self.contexts = HashIndex(path.astype(np.uint64)), HashIndex(self.context.astype(np.uint64))


class Model:
    """Levels of one half, with the code lengths that scoring looks up."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = [Level(*x) for x in levels]
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, at in enumerate(self.levels):
                at.log_n = np.log2(at.n)
                at.log_all = np.log2(at.total + at.kinds)
                at.cost = at.log_all[at.of_path] - at.log_n  # coded at the first context
                at.escape = at.log_all - np.log2(at.kinds)
                if not k:
                    continue
                low = self.levels[k - 1]
                mask = (1 << (8 * k)) - 1
                j = low.paths.find((at.path & mask).astype(np.uint64))
                c = low.contexts.find((at.context & (mask >> 8)).astype(np.uint64))
                gone = np.add.reduceat(low.n[j], at.first) if len(at.path) else np.zeros(0)
                total, kinds = low.total[c] - gone, low.kinds[c] - at.kinds
                at.below_all = np.log2(total + kinds)  # of the shorter context without what this one has seen
                at.below_escape = np.where(kinds > 0, at.below_all - np.log2(kinds), 0.0)
        kinds = len(self.levels[0].path)
        self.even = math.log2(256 - kinds) if kinds < 256 else 0.0

    def bits(self, paths: np.ndarray) -> np.ndarray:
        """Code length of each path's last byte."""
        out = np.zeros(len(paths))
        left, above = np.arange(len(paths)), np.full(len(paths), -1, np.int64)  # above: the context that was escaped from
        for k in range(len(self.levels) - 1, -1, -1):
            at = self.levels[k]
            key = paths[left] & ((1 << (8 * (k + 1))) - 1)
            hit = at.paths.find(key.astype(np.uint64))
            fresh, found = above < 0, hit >= 0
            one = found & fresh
            out[left[one]] += at.cost[hit[one]]
            two = found & ~fresh
            if two.any():
                out[left[two]] += self.levels[k + 1].below_all[above[two]] - at.log_n[hit[two]]
            left, above, key, fresh = left[~found], above[~found], key[~found], fresh[~found]
            if not len(left):
                return out
            context = at.contexts.find((key >> 8).astype(np.uint64)).astype(np.int64)
            known = context >= 0
            one = fresh & known
            out[left[one]] += at.escape[context[one]]
            two = ~fresh
            if two.any():
                out[left[two]] += self.levels[k + 1].below_escape[above[two]]
            above = context
        out[left] += self.even
        return out


def _coster(low: list[list[tuple[np.ndarray, np.ndarray]]], order: int):
    """Code lengths of (context, half, path, n), which come sorted by context. low: the first two levels of either half."""

    def costs(half: np.ndarray, path: np.ndarray, n: np.ndarray) -> np.ndarray:
        bits = np.zeros(len(path))
        for h in (0, 1):
            mine, other = half == h, half != h
            if mine.any():
                own = [_runs(path[other] & ((1 << (8 * (k + 1))) - 1), n[other]) for k in range(2, order + 1)]
                bits[mine] = Model(low[1 - h] + own).bits(path[mine])
        return bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            _, half, path, n = rows
            return pa.RecordBatch.from_arrays([pa.array(path | (half << 48)), pa.array(n), pa.array(costs(half, path, n))], ["key", "n", "bits"])

        size, next_at = 0, _BUNDLE
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= next_at:
                rows = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last context may go on
                if cut:
                    yield out([c[:cut] for c in rows])
                held, size = [[c[cut:] for c in rows]], size - cut
                next_at = max(_BUNDLE, 2 * size)
        if size:
            yield out([np.concatenate(c) for c in zip(*held)])

    return run


def path_costs(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n, bits) of all paths: half << 48 | path, how often it is in that half, and its code length under counts of the other half."""
    top = counted(docs, order)
    low = [[], []]
    for level in range(min(order, 1) + 1):
        t = _suffixes(top, level).toArrow()
        half, path, n = (t.column(c).to_numpy() for c in ("half", "path", "n"))
        for h in (0, 1):
            low[h].append(_runs(path[half == h], n[half == h]))
    context = F.shiftright("path", 8).bitwiseAND(F.lit(0xFFFF)).alias("context")
    rows = top.select(context, "half", "path", "n").repartition("context").sortWithinPartitions("context")
    return checkpointed(rows.mapInArrow(released(_coster(low, order)), "key long, n long, bits double"))


@lru_cache(1)
def load(folder: str) -> tuple[HashIndex, np.ndarray]:
    """The paths of a folder, and their code lengths with a 0 at the end for those that aren't there."""
    import pyarrow.dataset as ds
    import pyarrow.fs as fs

    where, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    table = ds.dataset(path, filesystem=where, format="parquet").to_table()
    return HashIndex(table.column("key").to_numpy()), np.append(table.column("bits").to_numpy(), 0.0)


def _scorer(folder: str, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cost = load(folder)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            half = _half(batch.column(0))
            data, off = utf8(batch.column(1))
            bits = np.zeros(batch.num_rows)
            rare, count = [np.zeros(0, np.int64)], np.zeros(batch.num_rows, np.int64)
            for a, b in chunks(np.diff(off), _CHUNK):
                row = np.repeat(np.arange(a, b), np.diff(off[a : b + 1]))
                key = _paths(data[off[a] : off[b]], off[a : b + 1] - off[a], order) | (half[row] << 48)
                at = index.find(key.astype(np.uint64))
                bits += np.bincount(row, weights=cost[at], minlength=len(bits))
                left = at < 0
                rare.append(key[left])
                count += np.bincount(row[left], minlength=len(bits))
            ids = pa.array(first + np.arange(batch.num_rows))
            first += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), pa.array(np.diff(off)), pa.array(bits), ragged(np.concatenate(rare), count, pa.int64())], ["row", "doc_id", "n_bytes", "bits", "rare"])

    return run


def score(docs: DataFrame, order: int = ORDER, cached: int = CACHED) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every document under counts of the half it isn't in."""
    spark = docs.sparkSession
    costs = path_costs(docs, order)
    least = _least(costs, cached)
    folder = shared_dir(spark, "ppm-frequent")
    frequent = F.lit(False) if least is None else F.col("n") >= least
    costs.where(frequent).select("key", "bits").coalesce(1).write.parquet(folder)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = rows.mapInArrow(released(_scorer(folder, order)), "row long, doc_id long, n_bytes long, bits double, rare array<long>")
    others = costs.where(~frequent).select("key", F.col("bits").alias("more"))
    if not others.isEmpty():
        at = shared_dir(spark, "ppm-rows")
        out.write.parquet(at)  # row numbers are those of one run
        out = spark.read.parquet(at)
        added = out.select("row", F.explode("rare").alias("key")).join(others, "key").groupBy("row").agg(F.sum("more").alias("more"))
        out = out.drop("rare").join(added, "row", "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_bytes", F.round("bits", 2).alias("bits"), F.when(F.col("n_bytes") > 0, F.round(F.col("bits") / F.col("n_bytes"), 4)).alias("bits_per_byte"))


class Trie:
    """A context trie on dictionaries: method C with exclusion, for adaptive scores and as the plain form of the model."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.nodes: dict[bytes, dict[int, int]] = {}

    def add(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            node = self.nodes.setdefault(context[len(context) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def bits(self, context: bytes, symbol: int) -> float:
        total, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            node = self.nodes.get(context[len(context) - k :])
            if not node:
                continue
            seen = {s: c for s, c in node.items() if s not in excluded}
            whole = sum(seen.values()) + len(seen)
            if symbol in seen:
                return total + math.log2(whole / seen[symbol])
            if seen:
                total += math.log2(whole / len(seen))
            excluded |= node.keys()
        return total + (math.log2(256 - len(excluded)) if len(excluded) < 256 else 0.0)


def adaptive_bits(text: bytes, order: int = ORDER) -> float:
    """Code length of a text under a trie that grows with it."""
    trie, padded, total = Trie(order), bytes(order) + text, 0.0
    for k in range(len(text)):
        context = padded[k : k + order]
        total += trie.bits(context, text[k])
        trie.add(context, text[k])
    return total


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_bytes, bits) of every document under its own growing trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([round(adaptive_bits(t, order), 2) for t in texts], pa.float64())], ["doc_id", "n_bytes", "bits"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n_bytes long, bits double")


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
