"""Benchmark decontamination: every passage of every document is a query to a BM25 inverted index of the benchmark's items.

Passages are windows of words that overlap by half; the window is the longest item's length, so that one holds at least three quarters
of any item. A passage's score for an item is its BM25 over the passage's distinct words, as a share of the item's score for itself;
all items of at least SHARE are retrieved. Retrieval is block-max WAND: a passage whose words' upper bounds don't reach the threshold
is dropped before any posting is read (for all passages of a batch at once), the rest walk their cursors with pivots, skip by block
maxima, and score what is left. A hit counts if enough of the question's and of the answer's word n-grams occur around the passage. The answer
is an item's last sentence; if it has only one, its last quarter of words.

The index is built on the driver from at most SHARD_WORDS words of items at a time, which take about 100 bytes each, so that a worker holds
100 MB at most; a larger benchmark makes several passes, with the document frequencies and lengths of all items in each.

Items of fewer than MIN_WORDS words say too little for shares of a score: they count where all their words stand in a row, with a share and
overlaps of 1.

Cases: null or empty texts match nothing; rows with a null doc_id are scanned and reported with a null doc_id, and their rows stay in
the pipeline only if they don't match; items without an item_id or without words match nothing; items with the same
text are all reported; a repeated doc_id is reported once with its best match; an empty benchmark or an empty table gives no rows; other
columns pass through the stage untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import HashIndex, bounded_batches, chunks, released, rolled, spans, utf8, words

K1, B = 1.2, 0.75
#: Least share of an item's own score that retrieves it, and least overlaps that confirm it.
SHARE, QUESTION, ANSWER = 0.5, 0.5, 0.5
MIN_WORDS = 4
BLOCK = 8
#: Most words of items in one index.
SHARD_WORDS = 1_000_000
_NO_ITEM = 1 << 60


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    hashed, row, _, _ = words(*utf8(pa.array(texts, pa.large_string())))
    return hashed, row


def split_item(text: str) -> int:
    """Number of words of the answer at an item's end."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if len(_words_of([s])[0])]
    if len(sentences) > 1:
        return len(_words_of([sentences[-1]])[0])
    return max(1, len(_words_of([text])[0]) // 4)


def _grams(hashed: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(hashed))
    return np.unique(rolled(hashed, np.zeros(len(hashed), np.int64), k)[0]) if k else hashed[:0]


def _item(cursor: list) -> int:
    return cursor[0]


class Index:
    """Postings with block maxima. Weights are shares of the threshold: items whose weights sum to 1 are retrieved."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_words: float, frequency: dict[int, int] | None = None, share: float = SHARE):
        """n_items and mean_words: of all items of at least MIN_WORDS words. frequency: of the hashed words, if items are only some of them."""
        self.short: list[tuple[int, HashIndex, list[list[int]]]] = []
        runs: dict[int, dict[int, list[int]]] = {}
        hashed, row = _words_of([t for _, t in items])
        count = np.bincount(row, minlength=len(items))
        begin = np.cumsum(count) - count
        for k in np.flatnonzero((count > 0) & (count < MIN_WORDS)).tolist():
            own = hashed[begin[k] : begin[k] + count[k]]
            runs.setdefault(len(own), {}).setdefault(int(rolled(own, np.zeros(len(own), np.int64), len(own))[0][0]), []).append(items[k][0])
        for k, found in sorted(runs.items()):
            self.short.append((k, HashIndex(np.array(list(found), np.uint64)), list(found.values())))
        items = [x for x, c in zip(items, count, strict=True) if c >= MIN_WORDS]
        hashed, row = _words_of([t for _, t in items])
        size = np.bincount(row, minlength=len(items))
        self.item_id = np.array([i for i, _ in items], np.int64)
        order = np.argsort(size, kind="stable")  # items of like length, hence like weights, share blocks
        place = np.empty(len(items), np.int64)
        place[order] = np.arange(len(items))
        self.item_id, row, size = self.item_id[order], place[row], size[order]
        term, of = np.unique(hashed, return_inverse=True)
        pair, tf = np.unique(of * len(items) + row, return_counts=True)
        self.post_term, self.post_item = pair // len(items), pair % len(items)
        df = np.bincount(self.post_term, minlength=len(term))
        if frequency is not None:
            df = np.array([frequency[int(t)] for t in term.view(np.int64)])
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        raw = idf[self.post_term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.post_item] / mean_words))
        own = np.bincount(self.post_item, weights=raw, minlength=len(items))
        self.weight = raw / (share * own[self.post_item])
        self.start = np.searchsorted(self.post_term, np.arange(len(term) + 1))
        self.most = np.maximum.reduceat(self.weight, self.start[:-1]) if len(term) else np.zeros(0)
        key = self.post_term * (len(items) // BLOCK + 1) + self.post_item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block_max = np.repeat(np.maximum.reduceat(self.weight, first), np.diff(np.append(first, len(key)))) if len(key) else self.weight
        self.block_end = (self.post_item // BLOCK + 1) * BLOCK
        # the block maxima by term: the block of each and where a term's begin
        self.blocks = len(items) // BLOCK + 1
        self.term_block, self.term_block_max = self.post_item[first] // BLOCK, self.block_max[first]
        self.term_block_start = np.searchsorted(self.post_term[first], np.arange(len(term) + 1))
        self.terms = HashIndex(term)
        self.share = share
        sequence = [hashed[row == k] for k in range(len(items))] if len(items) < 2000 else np.split(hashed[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=len(items)))[:-1])
        self.parts = []
        for k, (_, text) in enumerate(items[j] for j in order):
            m = split_item(text)
            q, a = sequence[k][:-m], sequence[k][-m:]
            self.parts.append(((min(3, len(q)), _grams(q, 3)), (min(2, len(a)), _grams(a, 2))))
        self.window = max(16, int(size.max(initial=0)))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items whose weights over the terms sum to at least 1: block-max WAND with a fixed threshold."""
        at, end = self.start[terms].tolist(), self.start[terms + 1].tolist()
        most = self.most[terms].tolist()
        # a cursor: its item, its place, the number of its postings, the term's bound, and items, weights, block maxima and ends
        cursors = [[0, 0, e - a, m, *(x[a:e].tolist() for x in (self.post_item, self.weight, self.block_max, self.block_end))] for a, e, m in zip(at, end, most, strict=True)]
        for c in cursors:
            c[0] = c[4][0]
        out = []

        def advance(c: list, to: int) -> None:
            a, e, item = c[1], c[2], c[4]
            while a < e and item[a] < to:
                a += 1
            c[1] = a
            c[0] = item[a] if a < e else _NO_ITEM

        while True:
            cursors.sort(key=_item)
            bound = 0.0
            pivot = -1
            for k, c in enumerate(cursors):
                if c[0] == _NO_ITEM:
                    break
                bound += c[3]
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return out
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            bound, skip = 0.0, _NO_ITEM
            for c in cursors[: pivot + 1]:
                advance_to = c[1]
                while advance_to < c[2] and c[7][advance_to] <= target:  # shallow move to the block of the target
                    advance_to += 1
                if advance_to < c[2] and c[4][advance_to] // BLOCK == target // BLOCK:
                    bound += c[6][advance_to]
            skip = (target // BLOCK + 1) * BLOCK
            if bound < 1 - 1e-9:
                # no item of this block can be among the first cursors alone; others may join at the next cursor's item
                if pivot + 1 < len(cursors):
                    skip = min(skip, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    advance(c, max(skip, target + 1))
                continue
            total = 0.0
            for c in cursors[: pivot + 1]:
                advance(c, target)
                if c[0] == target:
                    total += c[5][c[1]]
                    advance(c, target + 1)
            if total >= 1 - 1e-9:
                out.append((target, total))

    def passages(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and end of the passages of rows with the given numbers of words."""
        step = max(1, self.window // 2)
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - self.window) // step)), 0)
        row = np.repeat(np.arange(len(size)), count)
        base = (np.cumsum(size) - size)[row]
        first = base + spans(np.zeros(len(size), np.int64), count) * step
        return row, first, np.minimum(first + self.window, base + size[row])

    def matches(self, hashed: np.ndarray, row: np.ndarray, rows: int) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item_id, share, question overlap, answer overlap) of the confirmed hits, once for each row and item."""
        for k, runs, ids in self.short:
            gram, at = rolled(hashed, row, k)
            which = runs.find(gram)
            hit = np.flatnonzero(which >= 0)
            for r, g in sorted(set(zip(row[at[hit]].tolist(), which[hit].tolist(), strict=True))):
                for item_id in ids[g]:
                    yield r, item_id, 1.0, 1.0, 1.0
        if not len(self.most):
            return
        term = self.terms.find(hashed)
        bound = np.where(term >= 0, self.most[np.maximum(term, 0)], 0.0)
        total = np.concatenate([[0.0], np.cumsum(bound)])
        size = np.bincount(row, minlength=rows)
        owner, first, end = self.passages(size)
        may = np.flatnonzero(total[end] - total[first] >= 1 - 1e-6)
        if not len(may):
            return
        # upper bounds over distinct words
        at = spans(first[may], end[may] - first[may])
        which = np.repeat(np.arange(len(may)), end[may] - first[may])
        known = term[at] >= 0
        pair = np.sort(which[known] * np.int64(len(self.most)) + term[at][known])
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        which, terms = pair // len(self.most), pair % len(self.most)
        enough = np.bincount(which, weights=self.most[terms], minlength=len(may)) >= 1 - 1e-6
        begin = np.searchsorted(which, np.arange(len(may) + 1))
        # block maxima over distinct words: some block must reach the threshold
        step = max(1, 8_000_000 // self.blocks)
        for a in range(0, len(may), step):
            b = min(a + step, len(may))
            t = terms[begin[a] : begin[b]]
            count = self.term_block_start[t + 1] - self.term_block_start[t]
            at = spans(self.term_block_start[t], count)
            cell = np.repeat(which[begin[a] : begin[b]] - a, count) * self.blocks + self.term_block[at]
            reach = np.bincount(cell, weights=self.term_block_max[at], minlength=(b - a) * self.blocks).reshape(-1, self.blocks)
            enough[a:b] &= reach.max(axis=1) >= 1 - 1e-6
        best: dict[tuple[int, int], list[float]] = {}
        offset = np.concatenate([[0], np.cumsum(size)])
        for k in np.flatnonzero(enough).tolist():
            for item, score in self.search(terms[begin[k] : begin[k + 1]]):
                r = int(owner[may[k]])
                a, b = max(offset[r], first[may[k]] - self.window), min(offset[r + 1], end[may[k]] + self.window)
                q, s = self._overlaps(item, hashed[a:b])
                if q >= QUESTION and s >= ANSWER:
                    old = best.setdefault((r, item), [0.0, 0.0, 0.0])
                    best[r, item] = [max(x, y) for x, y in zip(old, (score * self.share, q, s), strict=True)]
        for (r, item), (score, q, s) in best.items():
            yield r, int(self.item_id[item]), score, q, s

    def _overlaps(self, item: int, around: np.ndarray) -> tuple[float, float]:
        out = []
        for k, grams in self.parts[item]:
            if not len(grams):
                out.append(1.0)
                continue
            there = rolled(around, np.zeros(len(around), np.int64), k)[0]
            out.append(float(np.isin(grams, there).mean()))
        return out[0], out[1]


def _finder(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            rows, found = [], []
            for a, b in chunks(np.diff(off)):
                hashed, row, _, _ = words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                for r, *rest in index.matches(hashed, row, b - a):
                    rows.append(a + r)
                    found.append(rest)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(columns[0], pa.int64()), *(pa.array(np.round(np.array(c, float), 6), pa.float64()) for c in columns[1:])],
                ["doc_id", "item_id", "share", "question_overlap", "answer_overlap"],
            )

    return run


_MATCH = "doc_id long, item_id long, share double, question_overlap double, answer_overlap double"


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashed, row, _, _ = words(*utf8(batch.column(1)))
        size = np.bincount(row, minlength=batch.num_rows)
        if len(hashed):
            row, hashed = np.unique(np.stack([row.astype(np.uint64), hashed]), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row.astype(np.int64))), pa.array(hashed.view(np.int64)), pa.array(size[row.astype(np.int64)])], ["item_id", "term", "size"])


def indexes(benchmark: DataFrame, shard_words: int = SHARD_WORDS, share: float = SHARE) -> Iterator[Index]:
    """Indexes of the benchmark's items, one at a time."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    worded = items.mapInArrow(released(_item_words), "item_id long, term long, size long")
    sized = worded.where(F.col("size") >= MIN_WORDS)
    every, whole, n, total = worded.select("item_id", "size").distinct().agg(F.count("*"), F.sum("size"), F.count_if(F.col("size") >= MIN_WORDS), F.sum(F.when(F.col("size") >= MIN_WORDS, F.col("size")))).first()
    if not every:
        return
    shards = -(-whole // shard_words)
    for k in range(shards):
        mine = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        few = [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()]
        frequency = None
        if shards > 1:
            terms = sized.join(mine.select("item_id"), "item_id", "left_semi").select("term").distinct()
            frequency = dict(sized.join(terms, "term").groupBy("term").count().collect())
        if few:
            yield Index(few, n, (total or 0) / max(n, 1), frequency, share)


def leaks(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share, question_overlap, answer_overlap) of the documents that hold an item."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = None
    for index in indexes(benchmark, shard_words, share):
        one = rows.mapInArrow(released(_finder(index)), _MATCH)
        found = one if found is None else found.union(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], _MATCH)
    best = [F.max(c).alias(c) for c in ("share", "question_overlap", "answer_overlap")]
    return found.groupBy("doc_id", "item_id").agg(*best)


def _cleaner(held: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(batch.schema.names.index("text")))
            clean = np.ones(batch.num_rows, bool)
            for a, b in chunks(np.diff(off)):
                hashed, row, _, _ = words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                for index in held:
                    for r, *_ in index.matches(hashed, row, b - a):
                        clean[a + r] = False
            yield batch.filter(pa.array(clean))

    return run


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the pipeline: the documents that hold no item of the benchmark."""
    bounded_batches(spark)
    for index in indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        docs = docs.mapInArrow(released(_cleaner([index])), docs.schema)
    return docs


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
