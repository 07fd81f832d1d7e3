"""Columnar text helpers shared by the operators of this subpackage.

Texts reach Python as Arrow buffers and are processed as flat byte arrays, so the cost is a few numpy passes over the bytes
rather than a Python object for each document or word.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch sent to Python; bounds a worker's memory when documents are long.
BATCH_ROWS = 2000
#: Bytes of text that one pass of numpy works on; longer texts form a chunk of their own.
CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one where it is unset, which only a local master may use."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return (root or "/tmp/checkpoints").rstrip("/")


_made: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the shared folder of the cluster; remove() or remove_all() deletes it when its results are no longer read."""
    _made.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_dir() named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made[:] = [x for x in _made if x != path]


def remove_all(spark: SparkSession) -> None:
    """Deletes what this session's operators have left in the shared folder: for the end of a job, when all results are written."""
    for path in list(_made):
        remove(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the rows per Arrow batch from Spark's default, unless a smaller number is set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def released(run):
    """run, after which a Python worker, which stays for the next tasks, gives the memory that it no longer uses back to the machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return wrapped


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1, from 0) of a string array; nulls have length 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(array.buffers()[1], np.int64, n + 1, array.offset * 8)
    data = array.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to at most limit; a longer row stands alone."""
    ends, start, n = np.cumsum(lengths), 0, len(lengths)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# Bytes of words: ASCII letters and digits and every byte of a multi-byte character.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, p in enumerate((_P, _PINV)):
            step = np.full(size, p, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin-1 capitals."""
    low = _LOWER[data]
    if len(low) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        if len(after):
            second = data[after]
            low[after] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 0x20, second)
    return low


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: a 64-bit hash of the lower-cased bytes, row, first byte and byte after the last."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    is_word = _WORD[data]
    edge = np.empty(n + 1, np.int8)
    edge[0], edge[n] = is_word[0], is_word[-1]
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:n].view(bool))
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    both = inner[is_word[inner] & is_word[inner - 1]]  # a word on either side of a border between texts
    cuts = np.flatnonzero(edge)
    if len(both):
        cuts = np.sort(np.concatenate([cuts, np.unique(both).repeat(2)]))
    start, end = cuts[0::2], cuts[1::2]
    power, inverse = _pow(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((lower_bytes(data).astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(off, start, "right") - 1
    return hashed, row, start, end


def hash_word(word: str) -> int:
    """The hash that words() gives to one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]))[0][0])


def rolled(hashed: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and the index of each run's first word."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = hashed[:n].copy()
        for j in range(1, k):
            out = mix(out * np.uint64(_P) + hashed[j : n + j])
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return out[at], at


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of rows with the given counts."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given counts."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class HashIndex:
    """Positions of distinct 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        bits = max(4, int(3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        # a table of keys beside the slots saves one indirection; key 0 stands for an empty slot and is looked up by slot
        self.table = np.zeros(1 << bits, np.uint64)
        left = np.arange(len(keys))
        at = self._first(self.keys)
        while len(left):
            free = self.slots[at[left]] < 0
            now, where = np.unique(at[left[free]], return_index=True)
            chosen = left[free][where]
            self.slots[now], self.table[now] = chosen, self.keys[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 for those that aren't there."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        at = self._first(keys)
        slot, same = self.slots[at], self.table[at] == keys
        np.copyto(out, slot, where=same & (slot >= 0))
        left = np.flatnonzero(~same & (slot >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            slot, same = self.slots[at], self.table[at] == keys[left]
            hit = same & (slot >= 0)
            out[left[hit]] = slot[hit]
            more = ~same & (slot >= 0)
            left, at = left[more], at[more]
        return out
