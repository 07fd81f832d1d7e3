"""The corpus pipeline: quality rules, near-deduplication, decontamination, pseudonyms, encoding, each over all that the one before kept.

A stage is written as Parquet in the shared folder and read again as the next one's documents, so lost executors cost at most a stage's tasks.
What a stage has written is deleted when the next one has read it all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowdex.llm._text import remove, shared_dir
from sparrowdex.llm.decontaminate import drop_leaks
from sparrowdex.llm.pieces import encode_stage
from sparrowdex.llm.pseudonyms import mask_documents
from sparrowdex.llm.rules import keep_good
from sparrowdex.llm.simhash import drop_near_copies

STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii_pseudonyms", mask_documents),
    ("sentencepiece_encoding", encode_stage),
]

#: Learned rules, fingerprints and encodings can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
