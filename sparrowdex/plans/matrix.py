"""All query-independent signals of a collection as the matrix that ranking models read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language, text, urls
from ..functions.shared import cut
from ..operators import graph, index, signals
from .engine import MATRIX


def content(docs: DataFrame) -> DataFrame:
    """(doc_id, ...): what a document's own row says: quality, boilerplate, lengths, address."""
    u = F.coalesce("canonical", "url")
    own = docs.select(
        "doc_id",
        text.content_quality(F.col("body")).alias("content_quality"),
        text.boilerplate(F.col("body")).alias("boilerplate"),
        F.size(urls.path_segments(u)).cast("double").alias("url_depth"),
        F.octet_length(u).cast("double").alias("url_len"),
        F.lower(u).startswith("https://").cast("double").alias("https"),
    )
    sizes = index.lengths(docs).select("doc_id", (F.col("len_title") + F.col("len_body")).alias("doc_len"), F.col("len_title").alias("title_len"), F.col("len_body").alias("body_len"), F.col("len_url").alias("url_field_len"), F.col("len_anchor").alias("anchor_field_len"))
    return own.join(sizes, "doc_id")


def counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, in_degree, linking_domains, linking_hosts, reciprocity, host_link_div)."""
    parts = (graph.degrees(edges, nodes).select("id", "in_degree"), graph.linking_groups(edges, nodes), graph.reciprocity(edges, nodes), graph.host_diversity(edges, nodes))
    return reduce(lambda a, b: a.join(b, "id"), parts).withColumnRenamed("id", "doc_id")


def ranks(edges: DataFrame, nodes: DataFrame, curated: DataFrame | None = None, spam_seeds: DataFrame | None = None, **options) -> DataFrame:
    """(doc_id, page_rank, host_rank, domain_rank, trust, spam_mass, outbound_spam). Without spam seeds anti-trust is inverse rank, so hubs are
    no trust seeds."""
    none = nodes.select("id").limit(0)
    page = cut(graph.pagerank(edges, nodes, **options))
    inverse = graph.inverse_pagerank(edges, nodes, **options)
    anti = graph.anti_trust_rank(edges, nodes, spam_seeds if spam_seeds is not None else none, **options)
    seeds = cut(graph.trust_seeds(inverse, anti, curated))
    trust = cut(graph.trust_rank(edges, nodes, seeds, **options))
    spam = cut(graph.spam_mass(trust, page, seeds))
    out = nodes.join(page.withColumnRenamed("rank", "page_rank"), "id").join(trust.withColumnRenamed("rank", "trust"), "id").join(spam.withColumnRenamed("spam", "spam_mass"), "id").join(graph.outbound_spam(edges, spam), "id")
    for by in ("host", "domain"):
        out = out.join(graph.group_rank(edges, nodes, by, **options).withColumnsRenamed({"id": by, "rank": f"{by}_rank"}), by)
    return out.select(F.col("id").alias("doc_id"), "page_rank", "host_rank", "domain_rank", "trust", "spam_mass", "outbound_spam")


def matrix(docs: DataFrame, edges: DataFrame, profile: DataFrame | None = None, **options) -> DataFrame:
    """(doc_id, <MATRIX>) of documents (doc_id, url, canonical, host, domain, crawl_date, title, body, anchor) and links (src, dst).

    profile: of the languages (lang, gram, r) that texts are told apart by; without it none has a language. Change and error rates of hosts
    aren't observed by a crawl and are 0, as is freshness; the blend counts every document as fresh.
    """
    edges, nodes = cut(edges), docs.select(F.col("doc_id").alias("id"), "host", "domain")
    found = cut(content(docs).join(counts(edges, nodes), "doc_id").join(ranks(edges, nodes, **options), "doc_id"))
    sure = language.detect(docs.select("doc_id", F.col("body").alias("text")), profile).where("confident").select("doc_id", "lang") if profile is not None else docs.select("doc_id", F.lit("").alias("lang")).limit(0)
    langs = cut(docs.select("doc_id", "host").join(sure, "doc_id", "left").withColumn("lang", F.coalesce("lang", F.lit(""))))
    agree = signals.host_language(langs).select("doc_id", "consistency")
    near = signals.near_penalty(signals.near_clusters(docs), found.select("doc_id", F.col("page_rank").alias("rank")).join(docs.select("doc_id", "crawl_date", "url"), "doc_id")).select("doc_id", "near_dup")
    found = found.join(langs.select("doc_id", language.code(F.col("lang")).alias("language")), "doc_id").join(agree, "doc_id").join(near, "doc_id", "left").withColumn("near_dup", F.coalesce("near_dup", F.lit(0.0)))
    found = cut(found)
    blend = found.select(F.col("doc_id").alias("id"), "page_rank", "host_rank", "domain_rank", "trust", "linking_domains", "boilerplate", F.col("consistency").alias("language"), F.col("spam_mass").alias("spam"), "near_dup", F.lit(1.0).alias("freshness"))
    static = signals.static_rank(blend).withColumnRenamed("id", "doc_id")
    zero = {c: F.lit(0.0) for c in ("freshness", "change_rate", "host_error_rate")}
    return found.join(static, "doc_id").withColumns(zero).select("doc_id", *[F.col(c).cast("double").alias(c) for c in MATRIX])
