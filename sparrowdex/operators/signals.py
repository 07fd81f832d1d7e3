"""Content and site signals: identity dedup, near-duplicates, host language, anchors, static rank, features, global ids."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.text import tokens
from .graph import components
from .numbering import numbered

NEAR, LEAST_TOKENS = 3, 8
CAP = 16


def unique_documents(docs: DataFrame, key: str, date: str, order: str) -> DataFrame:
    """docs with one row for each key: the latest date, and of equals the first in order; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(F.desc(date), F.asc(order))
    keyed = docs.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return keyed.unionByName(docs.where(F.col(key).isNull()))


#: Tokens whose votes are added at once.
_VOTES = 1 << 17


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        raw = b"".join(hashlib.md5(t.encode(), usedforsecurity=False).digest()[:8] for t in coded.dictionary.to_pylist())
        signs = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
        at, row = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), size)
        votes = np.zeros((batch.num_rows, 64), np.int64)
        for a in range(0, len(at), _VOTES):
            mine = row[a : a + _VOTES]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            votes[mine[first]] += np.add.reduceat(signs[at[a : a + _VOTES]], first, axis=0, dtype=np.int64)
        sim = np.packbits(votes > 0, axis=1).view(">i8").astype(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sim, pa.int64())], ["doc_id", "sim"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sim): 64 signed votes of all tokens (the first 8 bytes of their MD5), for documents of at least LEAST_TOKENS tokens.
    One pass beside the scan: no shuffle."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(docs["body"]).alias("t")).where(F.size("t") >= LEAST_TOKENS)
    return t.mapInArrow(_voted, "doc_id long, sim long")


def band_masks(n: int, near: int = NEAR) -> list[int]:
    """Masks of the bits that two of n fingerprints may share: fingerprints within near bits agree on at least one of them.

    The bits are cut into blocks, of which near at most can differ, so some choice of the others agrees as a whole. More blocks make longer
    keys; their number grows until a key has about as many values as there are fingerprints, so that buckets stay small at any size.
    """
    blocks = near + 1
    while 64 * (blocks - near) // blocks + 4 < math.log2(max(n, 2)) and blocks < near + 5:
        blocks += 1
    edge = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in itertools.combinations(block, blocks - near))]


def near_pairs(one: DataFrame, near: int = NEAR) -> DataFrame:
    """(src, dst): ids of fingerprints (sim, id) that differ in at most near bits, all of them."""
    masks = band_masks(one.count(), near)
    bands = one.select("id", "sim", F.posexplode(F.array(*[F.col("sim").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "value"))
    other = bands.withColumnsRenamed({"id": "id2", "sim": "sim2"})
    return bands.join(other, ["band", "value"]).where((F.col("id") < F.col("id2")) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("sim2"))) <= near)).select(F.col("id").alias("src"), F.col("id2").alias("dst")).distinct()


def near_clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, root, size) of the documents that have near-duplicates. Equal fingerprints are one node, so copies make no pairs."""
    sims = cut(fingerprints(docs))
    one = cut(sims.groupBy("sim").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    tops = components(near_pairs(one.select("sim", "id")))
    of = one.join(tops, "id", "left").select("sim", "n", F.coalesce("root", "id").alias("root"))
    sizes = of.groupBy("root").agg(F.sum("n").alias("size")).where("size > 1")
    return sims.join(of.drop("n"), "sim").join(sizes, "root").select("doc_id", "root", "size")


def near_penalty(clusters: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, representative, near_dup): ranked has (doc_id, rank, crawl_date, url). The best-ranked, earliest, shortest stands for a
    cluster and has no penalty; the others' grows with the cluster and with what they lack to its rank."""
    c = clusters.join(ranked, "doc_id").withColumn("undated", (F.coalesce("crawl_date", F.lit("")) == "").cast("int"))
    w = Window.partitionBy("root").orderBy(F.desc("rank"), "undated", "crawl_date", F.length("url"), "doc_id")
    c = c.withColumn("representative", F.first("doc_id").over(w)).withColumn("best", F.first("rank").over(w))
    gap = F.when(F.col("best") > 0, F.least(F.greatest(1 - F.col("rank") / F.col("best"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return c.select("doc_id", "representative", F.when(F.col("doc_id") == F.col("representative"), 0.0).otherwise((1 - 1.0 / F.col("size")) * (0.5 + 0.5 * gap)).alias("near_dup"))


def host_language(docs: DataFrame) -> DataFrame:
    """(doc_id, host, host_lang, consistency): a host's most frequent language, and whether a document has it: 1, 0, or 1/2 if unknown."""
    n = docs.where("lang is not null and lang <> ''").groupBy("host", "lang").count()
    first = n.groupBy("host").agg(F.min_by("lang", F.struct(-F.col("count"), F.col("lang"))).alias("host_lang"))
    known = F.when(F.coalesce(F.col("lang"), F.lit("")) == "", 0.5).when(F.col("lang") == F.col("host_lang"), 1.0).otherwise(0.0)
    return docs.select("doc_id", "host", "lang").join(first, "host", "left").select("doc_id", "host", "host_lang", known.alias("consistency"))


def anchor_field(anchors: DataFrame) -> DataFrame:
    """(target, anchor): anchors has (target, phrase, domain, own_domain). A phrase is repeated for each distinct linking domain, twice if
    any is another than the target's, CAP times at most; phrases are sorted."""
    w = anchors.where("phrase <> ''").groupBy("target", "phrase").agg(F.countDistinct("domain").alias("n"), F.max((F.col("domain") != F.col("own_domain")).cast("int")).alias("off"))
    w = w.select("target", "phrase", F.least(F.col("n") * (1 + F.col("off")), F.lit(CAP)).cast("int").alias("times"))
    lists = w.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("phrase", "times"))).alias("x"))
    return lists.select("target", F.array_join(F.flatten(F.transform("x", lambda p: F.array_repeat(p["phrase"], p["times"]))), " ").alias("anchor"))


def spread(column: str) -> tuple[Column, Column]:
    return F.min(column).alias(f"{column}_low"), F.max(column).alias(f"{column}_high")


def scaled(column: str) -> Column:
    """Min-max within the bounds that spread() gives; 0 where they are equal."""
    low, high = F.col(f"{column}_low"), F.col(f"{column}_high")
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)


LOGGED = ("page_rank", "host_rank", "domain_rank", "trust", "linking_domains")


def static_rank(signals: DataFrame) -> DataFrame:
    """(id, static_rank): the weighted sum of normalised signals; signals has LOGGED, boilerplate, language, spam, near_dup, freshness."""
    s = signals.withColumns({c: F.log1p(c) for c in LOGGED})
    s = s.crossJoin(s.agg(*[x for c in LOGGED for x in spread(c)]))
    score = 0.10 * scaled("page_rank") + 0.20 * scaled("host_rank") + 0.20 * scaled("domain_rank") + 0.15 * scaled("trust") + 0.15 * scaled("linking_domains")
    score = score + 0.10 * F.col("freshness") + 0.10 * (0.7 * (1 - F.col("boilerplate")) + 0.3 * F.col("language")) - 0.30 * F.col("spam") - 0.20 * F.col("near_dup")
    return s.select("id", score.alias("static_rank"))


def impact_bytes(ranked: DataFrame) -> DataFrame:
    """(id, shard_id, impact): the rank (id, shard_id, static_rank) on 256 levels within its shard; 255 where a shard is flat."""
    ends = ranked.groupBy("shard_id").agg(*spread("static_rank"))
    level = F.when(F.col("static_rank_high") > F.col("static_rank_low"), F.round(255 * (F.col("static_rank") - F.col("static_rank_low")) / (F.col("static_rank_high") - F.col("static_rank_low")))).otherwise(255)
    return ranked.join(ends, "shard_id").select("id", "shard_id", level.cast("long").alias("impact"))


def global_ids(docs: DataFrame, domain: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, host_rank, seq, global_id): hosts in the order of their reversed registered domains (domain gives a host's),
    documents by url within them.

    Hosts are far fewer than documents, so their ranks are made from host rows alone; documents are numbered within their host.
    """
    hosts = docs.groupBy("host").agg(F.count("*").alias("n"))
    hosts = hosts.withColumn("key", F.array_join(F.reverse(F.split(domain(F.col("host")), r"\.")), "."))
    hosts = numbered(hosts, "key", "host", name="host_rank")
    bits = hosts.agg(F.ceil(F.log2(F.greatest(F.max("n"), F.lit(1)).cast("double"))).cast("int").alias("bits"))
    placed = docs.select("doc_id", "host", "url").withColumn("seq", F.row_number().over(Window.partitionBy("host").orderBy("url", "doc_id")).cast("long") - 1)
    return placed.join(hosts.select("host", "host_rank"), "host").crossJoin(bits).select("doc_id", "host_rank", "seq", (F.col("host_rank") * F.pow(F.lit(2.0), F.col("bits")).cast("long") + F.col("seq")).alias("global_id"))


#: The matrix's columns in the order that models rely on, with their quantiser.
FEATURES = {
    "static_rank": "linear", "page_rank": "log", "host_rank": "log", "domain_rank": "log", "trust": "log", "spam_mass": "linear", "in_degree": "log2", "linking_domains": "log", "freshness": "linear",
    "change_rate": "linear", "content_quality": "linear", "boilerplate": "linear", "near_dup": "linear", "doc_len": "log", "title_len": "linear", "body_len": "log", "url_field_len": "linear", "anchor_field_len": "linear",
    "language": "category", "url_depth": "linear", "url_len": "linear", "https": "linear", "host_error_rate": "linear", "linking_hosts": "log", "reciprocity": "linear", "host_link_div": "linear", "outbound_spam": "linear",
}


def quantised_features(rows: DataFrame, columns: dict[str, str], shard: str = "shard_id") -> DataFrame:
    """rows with each column on its levels within a shard and, as <column>_back, what the level stands for."""
    value = {c: F.log1p(c) if kind.startswith("log") else F.col(c).cast("double") for c, kind in columns.items()}
    ends = rows.groupBy(shard).agg(*[x for c, kind in columns.items() for x in ((F.max(F.abs(value[c])).alias(f"{c}_high"), F.lit(0.0).alias(f"{c}_low")) if kind == "signed" else (F.min(value[c]).alias(f"{c}_low"), F.max(value[c]).alias(f"{c}_high")))])
    out = rows.join(ends, shard)
    new = {}
    for c, kind in columns.items():
        if kind == "category":
            new[c], new[f"{c}_back"] = F.col(c).cast("long"), F.col(c).cast("double")
            continue
        levels = 65535 if kind.endswith("2") else 255
        span = 2 * F.col(f"{c}_high") if kind == "signed" else F.col(f"{c}_high") - F.col(f"{c}_low")
        scale = (F.when(span > 0, span / levels).otherwise(1.0)).cast("float").cast("double")
        low = F.lit(0.0) if kind == "signed" else F.col(f"{c}_low").cast("float").cast("double")
        zero = round(levels / 2) if kind == "signed" else 0
        level = F.least(F.greatest(F.round((value[c] - low) / scale) + zero, F.lit(0)), F.lit(levels)).cast("long")
        back = low + (level - zero) * scale
        new[c], new[f"{c}_back"] = level, F.expm1(back) if kind.startswith("log") else back
    return out.select(*[x for x in rows.columns if x not in columns], *[v.alias(k) for k, v in new.items()])


def feature_bounds(rows: DataFrame, columns: dict[str, str], shard: str = "shard_id") -> DataFrame:
    """(shard, column, low, scale, zero, logged): what dequantised() needs to know of each column of each shard, to be stored with the levels."""
    value = {c: F.log1p(c) if k.startswith("log") else F.col(c).cast("double") for c, k in columns.items() if k != "category"}
    wide = rows.groupBy(shard).agg(*[x for c, v in value.items() for x in (F.min(v).alias(f"{c}_low"), F.max(v).alias(f"{c}_high"), F.max(F.abs(v)).alias(f"{c}_most"))])
    each = []
    for c in value:
        kind = columns[c]
        levels = 65535 if kind.endswith("2") else 255
        span = 2 * F.col(f"{c}_most") if kind == "signed" else F.col(f"{c}_high") - F.col(f"{c}_low")
        scale = F.when(span > 0, span / levels).otherwise(1.0).cast("float").cast("double")
        low = F.lit(0.0) if kind == "signed" else F.col(f"{c}_low").cast("float").cast("double")
        each.append(F.struct(F.lit(c).alias("column"), low.alias("low"), scale.alias("scale"), F.lit(round(levels / 2) if kind == "signed" else 0).cast("long").alias("zero"), F.lit(kind.startswith("log")).alias("logged")))
    return wide.select(shard, F.explode(F.array(*each)).alias("b")).select(shard, "b.*")


def dequantised(levels: DataFrame, bounds: DataFrame, columns: dict[str, str], key: str = "doc_id", shard: str = "shard_id") -> DataFrame:
    """(key, shard, <columns>) that the levels stand for."""
    names = [c for c, k in columns.items() if k != "category"]
    packed = bounds.groupBy(shard).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "scale", "zero")))).alias("__b"))
    out = levels.join(packed, shard)

    def back(c: str) -> Column:
        b = F.col("__b")[c]
        x = b["low"] + (F.col(c) - b["zero"]) * b["scale"]
        return F.expm1(x) if columns[c].startswith("log") else x

    return out.select(key, shard, *[back(c).alias(c) if c in names else F.col(c).cast("double").alias(c) for c in columns])
