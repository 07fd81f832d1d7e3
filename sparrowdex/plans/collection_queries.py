"""Queries over the stored collection: the documents as a crawl, then the pages and all documents again as a later one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language, urls
from ..functions.text import tokens
from ..operators import signals
from ..registry import query
from ..sources.tables import documents, table
from . import stored
from .corpus_queries import _HOST, _canonical_sql
from .sql import DOCS, ranks, tok

_NEXT = "chr(10) || chr(10) || '[next page](/d/' || (doc_id + 20) || '?utm_source=crawl)'"
_HELD = f"""{DOCS}, w AS (SELECT url, url AS canonical, host, doc_id AS key, body || {_NEXT} AS body FROM d),
a AS (SELECT row_number() OVER (ORDER BY host, url) - 1 AS doc_id, url, canonical, host, body FROM w),
pc AS (SELECT url, {_canonical_sql('url')} AS canonical, page_id, html AS body FROM pages WHERE html <> ''),
pu AS (SELECT *, {_HOST.format('canonical')} AS host FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS k FROM pc) WHERE k = 1 AND canonical NOT IN (SELECT canonical FROM a)),
e AS (SELECT row_number() OVER (ORDER BY host, url) - 1 + (SELECT count(*) FROM a) AS doc_id, url, canonical, host, body FROM pu),
h AS MATERIALIZED (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(doc_id // {stored.SHARD} AS BIGINT) AS shard_id, url, canonical, host, body, part FROM (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM e)),
lk AS MATERIALIZED (SELECT x.doc_id AS src, y.doc_id AS dst FROM h x JOIN w ON w.url = x.url JOIN h y ON y.canonical = 'https://' || w.host || '/d/' || (w.key + 20))"""


@query(f"WITH {_HELD} SELECT h.doc_id, shard_id, url, canonical, host, CASE WHEN dst IS NULL THEN '' ELSE 'next page' END AS anchor FROM h LEFT JOIN (SELECT DISTINCT dst FROM lk) l ON l.dst = h.doc_id")
def collection_documents(spark, sf_dir):
    """What two crawls make: ids in host and address order, going on in the later part, and anchors from the links."""
    return stored.collection(spark, sf_dir).table("docs").select("doc_id", "shard_id", "url", "canonical", "host", "anchor")


@query(f"WITH {_HELD} SELECT src, dst FROM lk")
def collection_edges(spark, sf_dir):
    return stored.collection(spark, sf_dir).edges()


@query(f"WITH {_HELD} SELECT shard_id, min(doc_id) AS base, count(*) AS n FROM h GROUP BY shard_id")
def collection_shards(spark, sf_dir):
    return stored.collection(spark, sf_dir).shards().select("shard_id", "base", "n")


@query(f"WITH {_HELD} SELECT count(*) AS documents, count(DISTINCT host) AS hosts, count(DISTINCT shard_id) AS shards FROM h")
def collection_summary(spark, sf_dir):
    return stored.collection(spark, sf_dir).summary()


@query(f"WITH {_HELD}, s AS (SELECT shard_id, min(doc_id) AS base, count(*) AS n FROM h GROUP BY shard_id), i AS (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) SELECT i.doc_id, shard_id, i.doc_id - base AS row FROM i JOIN s ON i.doc_id >= base AND i.doc_id < base + n")
def collection_locations(spark, sf_dir):
    """Where the numbers of documents lie as ids of the collection."""
    return stored.collection(spark, sf_dir).locate(table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id"))


_ROUTED = " UNION ".join(f"SELECT shard_id, unnest({tok(c)}) AS term FROM h" for c in ("body", "url"))


@query(f"WITH {_HELD}, b AS (SELECT item_id AS query_id, {tok('text')} AS q FROM benchmark WHERE item_id IS NOT NULL), t AS (SELECT DISTINCT query_id, unnest(q) AS term FROM b), s AS ({_ROUTED} UNION SELECT h.shard_id, unnest(['next', 'page']) FROM h JOIN lk ON dst = doc_id) SELECT query_id, shard_id, count(*) AS terms FROM t JOIN s USING (term) GROUP BY ALL UNION ALL SELECT -1, shard_id, 0 FROM (SELECT DISTINCT shard_id FROM h)")
def collection_routes(spark, sf_dir):
    """The shards that each query asks by the stored routing; the query -1 has no terms and asks all."""
    words = F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")
    terms = table(spark, sf_dir, "benchmark").where("item_id is not null").select(F.col("item_id").alias("query_id"), words)
    return stored.collection(spark, sf_dir).routes(terms.unionByName(spark.createDataFrame([(-1, None)], "query_id long, term string")))


_NODES = "nodes AS (SELECT doc_id AS id, host, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM h)"


@query(
    f"""WITH RECURSIVE {_HELD}, {_NODES}, ew AS (SELECT src, dst, 1e0 AS w FROM lk), er AS (SELECT dst AS src, src AS dst, 1e0 AS w FROM lk), {ranks('pr', 'ew', 'nodes', None)}, {ranks('ir', 'er', 'nodes', None)},
sd AS MATERIALIZED (SELECT id FROM (SELECT id FROM ir ORDER BY rank DESC, id LIMIT 2000) JOIN ir USING (id) WHERE ir.rank <= 2e0 / (SELECT count(*) FROM ir)), tp AS (SELECT id, 1e0 / (SELECT count(*) FROM sd) AS p FROM sd), {ranks('tr', 'ew', 'nodes', 'tp')},
q AS (SELECT id, CASE WHEN pr.rank > 0 THEN tr.rank / pr.rank ELSE 0e0 END AS ratio FROM pr JOIN tr USING (id)), o AS (SELECT ratio, row_number() OVER (ORDER BY ratio) AS k, count(*) OVER () AS n FROM q WHERE ratio > 0 AND id IN (SELECT id FROM sd)), m AS (SELECT max(ratio) AS m FROM o WHERE k = n // 2 + 1),
sm AS (SELECT id, CASE WHEN m IS NULL THEN 0e0 ELSE least(greatest(1 - ratio / m, 0e0), 1e0) END AS spam FROM q, m), ln AS (SELECT doc_id, CAST(len({tok('body')}) AS DOUBLE) AS body_len, CAST(len({tok('url')}) AS DOUBLE) AS url_field_len, CAST(strlen(canonical) AS DOUBLE) AS url_len FROM h)
SELECT doc_id, round(pr.rank, 9) AS page_rank, round(tr.rank, 9) AS trust, round(spam, 6) AS spam_mass, CAST((SELECT count(*) FROM lk WHERE dst = doc_id) AS DOUBLE) AS in_degree, body_len, url_field_len, url_len FROM ln JOIN pr ON pr.id = doc_id JOIN tr ON tr.id = doc_id JOIN sm ON sm.id = doc_id"""
)
def matrix_columns(spark, sf_dir):
    """Columns of the signal matrix that other queries don't compare."""
    m = stored.matrix_of(spark, sf_dir)
    return m.select("doc_id", *[F.round(c, d).alias(c) for c, d in (("page_rank", 9), ("trust", 9), ("spam_mass", 6))], "in_degree", "body_len", "url_field_len", "url_len")


@query()
def feature_matrix(spark, sf_dir):
    """All 27 columns of the collection on their levels, and what the levels stand for."""
    m = stored.matrix_of(spark, sf_dir).withColumn("shard_id", F.floor(F.col("doc_id") / stored.SHARD))
    return signals.quantised_features(m, signals.FEATURES)


@query()
def collection_inspection(spark, sf_dir):
    """Rows, bytes and bytes a document of each stored table."""
    return stored.collection(spark, sf_dir).inspect()


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 WHEN 'de' THEN 4 ELSE 0 END AS code FROM documents WHERE doc_id IS NOT NULL")
def language_codes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", language.code(F.col("lang")).alias("code"))


@query(r"SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS authority FROM pages")
def page_authorities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.authority(F.col("url")).alias("authority"))
