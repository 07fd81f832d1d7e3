"""Token counts through a cache keyed by the digests of normalised content and of the tokenizer's version.

Digests are made beside the scan; only they, not the texts, meet the cache. A digest that the cache lacks and that occurs once is encoded
where its text is read; only texts of digests that occur again are shuffled, after each task has kept one of each, so every distinct miss is
encoded once. (If more than BROADCAST_DIGESTS digests are known or occur again, all misses are shuffled: the result is the same.) Counts are
appended to the cache as one more set of Parquet files, which a lost executor or a second writer can't spoil: a digest that is stored twice
has the same count, and reading takes one of them.

Counts are of the normalised text: line ends become \\n and white space at the end goes.

Cases: a null text has a null count and no digest, an empty one 0; repeated rows give repeated rows with the same count; a null doc_id
is counted like any other; special tokens in a text are ordinary text; an empty table gives no rows and leaves the cache as it was; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import bounded_batches, checkpointed, released, shared_dir

VOCABULARY = os.environ.get("TOKEN_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most digests to broadcast to the scan; more of them are joined by shuffle.
BROADCAST_DIGESTS = 200_000


def tokenizer_version(path: str = VOCABULARY, pattern: str = PATTERN) -> str:
    """Digest of the vocabulary, the pattern and the library's version."""
    import tiktoken

    with open(path, "rb") as f:
        said = hashlib.file_digest(f, "sha256")
    said.update(f"|{pattern}|{tiktoken.__version__}".encode())
    return said.hexdigest()[:32]


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_text(text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> int:
    """Tokens of a normalised text."""
    return len(_encoding(path, pattern).encode_ordinary(text))


def _counter(path: str, pattern: str):
    """(digest, n_tokens, text) of (digest, n_tokens, text, later): texts are counted, but those for later kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            digest, known, text, later = batch.columns
            counts = [n if t is None or wait else len(encode(t)) for n, t, wait in zip(known.to_pylist(), text.to_pylist(), later.to_pylist(), strict=True)]
            kept = pc.if_else(later, text, pa.scalar(None, text.type))
            yield pa.RecordBatch.from_arrays([digest, pa.array(counts, pa.int64()), kept], ["digest", "n_tokens", "text"])

    return run


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\s+\z", "")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer."""
    if not _exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema("digest binary, n_tokens long, version string").parquet(cache)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, digest, n_tokens) of every document; encodes what the cache lacks and appends it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    version = tokenizer_version(path, pattern)
    text = normalised(docs["text"].cast("string"))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    keyed = checkpointed(docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest.alias("digest")))
    wanted = keyed.where("digest is not null").groupBy("digest").agg((F.count("*") > 1).alias("later"))
    held = stored(spark, cache, version).select("digest", F.lit(True).alias("known"))
    # digests that aren't encoded where they are read: known ones, and those that occur again
    special = checkpointed(wanted.join(held, "digest", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    n, n_special = special.agg(F.count_if(~F.col("known")), F.count_if(F.col("known") | F.col("later"))).first()
    if n:
        texts = docs.select(digest.alias("digest"), F.lit(None).cast("long").alias("n_tokens"), text.alias("text")).where("digest is not null")
        encode, kinds = released(_counter(path, pattern)), "digest binary, n_tokens long, text string"
        if n_special <= BROADCAST_DIGESTS:
            few = F.broadcast(special.where("known or later"))
            one = texts.join(few, "digest", "left").where(~F.coalesce("known", F.lit(False)))
            one = one.select("digest", "n_tokens", "text", F.coalesce("later", F.lit(False)).alias("later")).mapInArrow(encode, kinds)
        else:
            few = special.where("not known").select("digest")
            one = texts.join(F.broadcast(few) if n <= BROADCAST_DIGESTS else few, "digest", "left_semi")
        once = one.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"), F.first("text", ignorenulls=True).alias("text"))
        new = once.withColumn("later", F.lit(False)).mapInArrow(encode, kinds).select("digest", "n_tokens")
        new.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    return keyed.join(stored(spark, cache, version), "digest", "left").select("doc_id", F.hex("digest").alias("digest"), "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents through a cache that starts empty, so that every distinct text is encoded."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "token-counts"))
