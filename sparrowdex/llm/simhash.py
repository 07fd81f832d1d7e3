"""SimHash near-deduplication with bit-sliced comparison.

A document's fingerprint has 128 bits: each of its distinct words votes on every bit. Equal fingerprints collapse to one first, so
groups of thousands of copies cost no comparisons. The rest meet in bands (samples of the bits); within a band's bucket all pairs are
compared bit-sliced: the block's bits are stored as vertical planes, a plane is compared with itself moved down by d rows, the
differences of 64 pairs at a time go through carry-save adders into vertical counters, and words whose pairs all exceed the radius are
abandoned between groups of planes. A bucket yields the edges of a spanning forest of its close pairs, connected components make the
groups, and the document with the least doc_id of a group stays.

The width of a band follows the logarithm of the number of distinct fingerprints, which keeps buckets at some hundreds at most on average;
the number of bands follows from the width, so that a pair at exactly the radius is found with probability RECALL.

A bucket of more than HOT rows is cut into blocks of half of that, and every pair of blocks is a bucket of its own, so that no task holds a
hot bucket whole and none of its pairs is lost. Rows that are linked already are joined after every shift, so a bucket of copies costs
comparisons but no list of its pairs.

The stage works on rows: of each group the row with the least doc_id stays (of several the one with the least hash of its text). A row is
known by doc_id and a hash of its text, so texts that share a doc_id are judged each for itself.

Cases: documents without words (null and empty texts) and rows with a null doc_id are in no group and stay, each of them; texts of fewer
than MIN_WORDS words only match texts with the same words in the same order; in the query a repeated doc_id is one document, which goes only
if each of its texts is a copy of a document with a lesser doc_id; of rows that are equal in doc_id and text the stage keeps one; an empty
table gives no rows; other columns pass through untouched, whatever their names. A band takes at most MAX_WIDTH bits, which is reached at
2 ** 48 distinct fingerprints; buckets grow only beyond that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import bounded_batches, checkpointed, chunks, mix, released, utf8, words

BITS = 128
#: Most differing bits of near copies.
RADIUS = 20
#: Chance that a pair at the radius shares a bucket.
RECALL = 0.99
MIN_WORDS = 8
#: Most rows of a bucket that one task compares with each other.
HOT = 8192
MAX_WIDTH = 40
#: Planes between two checks for abandoned words.
GROUP = 32
#: Bits of a word's hash that vote, below the row's number in a sort key; chunks have fewer than 2 ** 24 rows.
_HASH = np.uint64(40)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def fingerprints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows x 2 of uint64) and number of words of the texts."""
    n = len(off) - 1
    out, count = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64)
    for a, b in chunks(np.diff(off) + 1):
        hashed, row, _, _ = words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        if not len(hashed):
            continue
        count[a:b] = np.bincount(row, minlength=b - a)
        shift = _HASH  # the same for every chunk, or copies in chunks of other sizes would differ
        key = np.sort((row.astype(np.uint64) << shift) | (hashed >> (np.uint64(64) - shift)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        at = (key >> shift).astype(np.int64)
        first = mix((key & ((np.uint64(1) << shift) - np.uint64(1))) + np.uint64(0x9E3779B97F4A7C15))
        both = np.stack([first, mix(first ^ _SECOND)], 1)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sizes = np.diff(np.append(starts, len(at)))
        votes = np.add.reduceat(np.unpackbits(both.view(np.uint8), axis=1), starts, axis=0, dtype=np.int32)
        out[a + at[starts]] = np.packbits(votes * 2 > sizes[:, None], axis=1).view(np.uint64)
        for r in np.flatnonzero((count[a:b] > 0) & (count[a:b] < MIN_WORDS)):
            h = np.uint64(count[a + r])
            with np.errstate(over="ignore"):
                for x in hashed[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]:
                    h = mix(np.array([h * np.uint64(31) + x]))[0]
            out[a + r] = mix(np.array([h, h ^ _SECOND]))
    return out, count


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, count = fingerprints(*utf8(batch.column(2)))
        has = pa.array(count > 0)
        sig = sig.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sig[:, 0]), pa.array(sig[:, 1])], ["doc_id", "text_hash", "a", "b"]).filter(has)


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, a, b) of the rows that have words and a doc_id."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _text_hash(docs).alias("text_hash"), docs["text"].cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(released(_sign), "doc_id long, text_hash long, a long, b long")


def plan_bands(n: int, radius: int = RADIUS, recall: float = RECALL) -> np.ndarray:
    """Bit positions of each band for n distinct fingerprints (bands x width)."""
    width = min(MAX_WIDTH, max(12, math.ceil(math.log2(max(2, n))) - 8))
    hit = math.comb(BITS - radius, width) / math.comb(BITS, width)  # the bits of a band are drawn without replacement
    bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(BITS)[:width] for _ in range(bands)])


def _bits(ab: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(ab).view(np.uint8).reshape(len(ab), 16), axis=1)


def _planes(bits: np.ndarray) -> np.ndarray:
    """Vertical planes (BITS x words of 64 rows) with a spare word at the end."""
    wide = -(-len(bits) // 64) + 1
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out = np.zeros((bits.shape[1], wide * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _moved(planes: np.ndarray, d: int) -> np.ndarray:
    """Planes whose row i is row i + d."""
    w, b = divmod(d, 64)
    out = np.zeros_like(planes)
    keep = planes.shape[1] - w
    if keep <= 0:
        return out
    out[:, :keep] = planes[:, w:] >> np.uint64(b)
    if b and keep > 1:
        out[:, : keep - 1] |= planes[:, w + 1 :] << np.uint64(64 - b)
    return out


def _counted(x: np.ndarray) -> list[np.ndarray]:
    """Carry-save sum of the planes of x: the vertical number, least bit first."""
    out: list[np.ndarray] = []
    while len(x):
        carries = []
        while len(x) > 2:
            k = len(x) // 3
            p, q, r = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            u = p ^ q
            carries.append((p & q) | (u & r))
            x = np.concatenate([u ^ r, x[3 * k :]])
        if len(x) == 2:
            carries.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        out.append(x[0])
        x = np.concatenate(carries) if carries else x[:0]
    return out


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Ripple-carry sum of two vertical numbers."""
    zero = np.zeros_like((a or b)[0])
    out, carry = [], zero
    for k in range(max(len(a), len(b))):
        p, q = a[k] if k < len(a) else zero, b[k] if k < len(b) else zero
        u = p ^ q
        out.append(u ^ carry)
        carry = (p & q) | (u & carry)
    return [*out, carry]


def _within(number: list[np.ndarray], most: int) -> np.ndarray:
    """Bits of the lanes whose number is at most `most`."""
    below, equal = np.zeros_like(number[0]), ~np.zeros_like(number[0])
    for k in range(max(len(number), most.bit_length()) - 1, -1, -1):
        bit = number[k] if k < len(number) else np.zeros_like(below)
        if most >> k & 1:
            below |= equal & ~bit
            equal &= bit
        else:
            equal &= ~bit
    return below | equal


def close_pairs(ab: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows in the same bucket within the radius, as row numbers, shift by shift. Rows are sorted by bucket."""
    n = len(ab)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, n)).repeat(np.diff(np.append(starts, n)))
    place = np.arange(n) - starts.repeat(np.diff(np.append(starts, n)))
    ids = np.arange(n)
    keep = size > 1
    ids, size, place = ids[keep], size[keep], place[keep]
    planes = _planes(_bits(ab[ids])) if len(ids) else None
    d = 1
    while len(ids):
        alive = size > d
        if alive.sum() * 2 <= len(ids):
            ids, size, place = ids[alive], size[alive], place[alive]
            if not len(ids):
                break
            planes, alive = _planes(_bits(ab[ids])), np.ones(len(ids), bool)
        valid = _planes((place + d < size)[:, None].astype(np.uint8))[0]
        at = np.flatnonzero(valid)  # words that hold a pair
        far = _moved(planes, d)
        number: list[np.ndarray] = []
        for g in range(0, BITS, GROUP):
            diff = planes[g : g + GROUP, at] ^ far[g : g + GROUP, at]
            number = _added(number, _counted(diff)) if number else _counted(diff)
            near = _within(number, radius) & valid[at]
            live = near != 0
            if not live.all():  # abandon the words whose pairs all exceed the radius
                at, near, number = at[live], near[live], [x[live] for x in number]
            if not len(at):
                break
        if len(at):
            lanes = np.unpackbits(near.view(np.uint8), bitorder="little").reshape(-1, 64)
            w, b = np.nonzero(lanes)
            i = at[w] * 64 + b
            yield ids[i], ids[i + d]
        d += 1


def _joined(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """root, the least row of each row's component, after the pairs are joined."""
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            return root


def forest(ab: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The least row that each row is connected with by close pairs within its bucket."""
    root = np.arange(len(ab))
    for left, right in close_pairs(ab, bucket, radius):
        apart = root[left] != root[right]
        if apart.any():
            root = _joined(root, left[apart], right[apart])
    return root


def _band_rows(bands: np.ndarray):
    power = (1 << np.arange(bands.shape[1], dtype=np.int64))[::-1].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            bits = _bits(np.stack([a, b], 1))
            keys = [bits[:, p].astype(np.int64) @ power + (k << bands.shape[1]) for k, p in enumerate(bands)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(np.tile(x, len(bands))) for x in (batch.column(0).to_numpy(zero_copy_only=False), a, b))], ["key", "id", "a", "b"])

    return run


def _edges(radius: int):
    def of(table: pa.Table) -> pa.RecordBatch:
        key, ids, a, b = (table.column(k).to_numpy() for k in range(4))
        root = forest(np.stack([a, b], 1), key, radius)
        other = np.flatnonzero(root != np.arange(len(root)))
        x, y = ids[other], ids[root[other]]
        apart = x != y
        return pa.RecordBatch.from_arrays([pa.array(x[apart]), pa.array(y[apart])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 1 << 16:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut:
                yield of(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield of(pa.Table.from_batches(held))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node of the edges (u, v): root is the least node of its component. Alternating large and small stars."""
    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        e = small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select("u", F.col("v").alias("root"))
        state = now


def _cooled(bands: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, id, a, b) of buckets of at most hot rows: a larger one becomes a bucket for each pair of its blocks."""
    crowded = bands.groupBy("key").count().where(F.col("count") > hot).select(F.col("key").alias("hot_key"), F.ceil(F.col("count") / (hot // 2)).cast("long").alias("blocks"))
    crowded = checkpointed(crowded)
    if crowded.isEmpty():
        return bands
    marked = bands.join(crowded, F.col("key") == F.col("hot_key"), "left")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    # a row of block i belongs to the pairs (i, j) and (j, i) of blocks; a lone key is the bucket's own
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(mine, j), F.greatest(mine, j)))
    own = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)
    return marked.select(F.explode(own).alias("key"), "id", "a", "b")


def grouped(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows with words as (doc_id, text_hash, a, b), and (a, b, top, root): the group of each fingerprint, and the row of it that stays,
    which is the one with the least (doc_id, text_hash)."""
    sig = checkpointed(signatures(docs))
    # a node is a number of the fingerprint, not a doc_id, for a doc_id may have several
    one = checkpointed(sig.groupBy("a", "b").agg(F.min(F.struct("doc_id", "text_hash")).alias("root")).withColumn("node", F.monotonically_increasing_id()))
    bands = one.select(F.col("node").alias("id"), "a", "b").mapInArrow(released(_band_rows(plan_bands(one.count(), radius, recall))), "key long, id long, a long, b long")
    edges = _cooled(bands, hot).repartition("key").sortWithinPartitions("key").mapInArrow(released(_edges(radius)), "u long, v long")
    tops = components(edges).withColumnsRenamed({"u": "node", "root": "top"})
    joined = one.join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    least = joined.groupBy("top").agg(F.min("root").alias("root"))
    return sig, joined.drop("root").join(least, "top").select("a", "b", "top", "root")


def near_copies(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, hot: int = HOT) -> DataFrame:
    """(doc_id, duplicate_of, group_size) of the documents that go: duplicate_of is the one of their group that stays."""
    sig, groups = grouped(docs, radius, recall, hot)
    rows = sig.select("doc_id", "a", "b").distinct().join(groups.select("a", "b", "top", F.col("root.doc_id").alias("first")), ["a", "b"])
    rows = rows.select("doc_id", "top", "first").distinct()
    sizes = rows.groupBy("top").agg(F.count("*").alias("group_size")).where("group_size > 1")
    # a document goes if each of its texts is a copy of a document with a lesser doc_id
    gone = rows.join(sizes, "top", "left").groupBy("doc_id").agg(F.max("first").alias("duplicate_of"), F.max("group_size").alias("group_size"))
    return gone.where(F.col("duplicate_of") < F.col("doc_id")).select("doc_id", "duplicate_of", "group_size")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the pipeline: one row of each group stays."""
    sig, groups = grouped(docs)
    rows = sig.join(groups.select("a", "b", "root"), ["a", "b"]).groupBy("doc_id", "text_hash").agg(F.first("root").alias("root"), F.count("*").alias("times"))
    rows = checkpointed(rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), (F.struct("doc_id", "text_hash") == F.col("root")).alias("stays"), "times"))
    same = (docs["doc_id"] == F.col("__id")) & (_text_hash(docs) == F.col("__hash"))
    again = rows.where("stays and times > 1").select("__id", "__hash")
    if again.isEmpty():
        return docs.join(rows.where("not stays").select("__id", "__hash"), same, "left_anti")
    # of rows that are equal in doc_id and text one stays; each task keeps one of them before the shuffle
    kept = docs.join(rows.where("not stays or times > 1").select("__id", "__hash"), same, "left_anti")
    whole = F.struct(*[docs[c] for c in docs.columns])
    once = docs.join(again, same, "left_semi").groupBy(docs["doc_id"].alias("__id"), _text_hash(docs).alias("__hash")).agg(F.first(whole).alias("__whole"))
    return kept.unionByName(once.select("__whole.*"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
