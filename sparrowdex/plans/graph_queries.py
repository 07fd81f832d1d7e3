"""Queries over the link graph of customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, signals
from ..registry import query
from ..sources.tables import edges, nodes
from .sql import EDGES, NODES, ranks

_BASE = f"{NODES}, {EDGES}, ew AS (SELECT src, dst, 1e0 AS w FROM edges), er AS (SELECT dst AS src, src AS dst, 1e0 AS w FROM edges)"
_SEEDS = "seeds AS (SELECT id FROM nodes WHERE domain = 'EUROPE'), tp AS (SELECT id, 1e0 / (SELECT count(*) FROM seeds) AS p FROM seeds)"
_GROUP = "{g} AS (SELECT a.{by} AS src, b.{by} AS dst, CAST(count(*) AS DOUBLE) AS w FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.{by} <> b.{by} GROUP BY ALL)"


def _graph(spark, sf_dir):
    return graph.cut(edges(spark, sf_dir)), nodes(spark, sf_dir)


def _seeds(n):
    return n.where("domain = 'EUROPE'").select("id")


def _rounded(df, column="rank", digits=9):
    return df.withColumn(column, F.round(column, digits))


@query(f"WITH RECURSIVE {_BASE} SELECT src, dst FROM edges")
def link_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH RECURSIVE {_BASE}, {ranks('pr', 'ew', 'nodes', None)} SELECT id, round(rank, 9) AS rank FROM pr")
def page_rank(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(graph.pagerank(e, n))


@query(f"WITH RECURSIVE {_BASE}, {ranks('ir', 'er', 'nodes', None)} SELECT id, round(rank, 9) AS rank FROM ir")
def inverse_page_rank(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(graph.inverse_pagerank(e, n))


@query(f"WITH RECURSIVE {_BASE}, {_SEEDS}, {ranks('tr', 'ew', 'nodes', 'tp')} SELECT id, round(rank, 9) AS rank FROM tr")
def trust_rank(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(graph.trust_rank(e, n, _seeds(n)))


@query(f"WITH RECURSIVE {_BASE}, {_SEEDS}, {ranks('tr', 'er', 'nodes', 'tp')} SELECT id, round(rank, 9) AS rank FROM tr")
def anti_trust_rank(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(graph.anti_trust_rank(e, n, _seeds(n)))


@query(
    f"WITH RECURSIVE {_BASE}, {_SEEDS}, {ranks('ir', 'er', 'nodes', None)}, {ranks('atr', 'er', 'nodes', 'tp')}, b AS (SELECT id FROM ir ORDER BY rank DESC, id LIMIT 2000) SELECT id FROM b JOIN atr USING (id) WHERE atr.rank <= 2e0 / (SELECT count(*) FROM atr)"
)
def trust_seed_selection(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return graph.trust_seeds(graph.inverse_pagerank(e, n), graph.anti_trust_rank(e, n, _seeds(n)))


@query(f"WITH RECURSIVE {_BASE}, {_GROUP.format(g='hg', by='host')}, hn AS (SELECT DISTINCT host AS id FROM nodes), {ranks('hr', 'hg', 'hn', None)} SELECT id, round(rank, 9) AS rank FROM hr")
def host_rank(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(graph.group_rank(e, n, "host"))


@query(f"WITH RECURSIVE {_BASE}, {_GROUP.format(g='hg', by='domain')}, hn AS (SELECT DISTINCT domain AS id FROM nodes), {ranks('hr', 'hg', 'hn', None)} SELECT id, round(rank, 9) AS rank FROM hr")
def domain_rank(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(graph.group_rank(e, n, "domain"))


@query(f"WITH RECURSIVE {_BASE} SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree, (SELECT count(*) FROM edges WHERE src = id) AS out_degree FROM nodes")
def link_degrees(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir), nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {_BASE}, s AS (SELECT dst AS id, count(DISTINCT host) AS h, count(DISTINCT domain) AS m FROM edges JOIN nodes ON id = src GROUP BY dst) SELECT n.id, coalesce(h, 0) AS linking_hosts, coalesce(m, 0) AS linking_domains FROM nodes n LEFT JOIN s USING (id)")
def linking_groups(spark, sf_dir):
    return graph.linking_groups(edges(spark, sf_dir), nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {_BASE}, s AS (SELECT a.src AS id, count(b.src) / count(*) AS r FROM edges a LEFT JOIN edges b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT n.id, round(coalesce(r, 0e0), 9) AS reciprocity FROM nodes n LEFT JOIN s USING (id)")
def link_reciprocity(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return _rounded(graph.reciprocity(e, n), "reciprocity")


@query(
    f"WITH RECURSIVE {_BASE}, {_GROUP.format(g='hg', by='host')}, t AS (SELECT dst, sum(w) AS a, count(*) AS k FROM hg GROUP BY dst), v AS (SELECT dst AS host, CASE WHEN k > 1 THEN -sum(w / a * ln(w / a)) / ln(k) ELSE 0e0 END AS v FROM hg JOIN t USING (dst) GROUP BY dst, k) SELECT id, round(coalesce(v, 0e0), 9) AS host_link_div FROM nodes LEFT JOIN v USING (host)"
)
def host_link_diversity(spark, sf_dir):
    return _rounded(graph.host_diversity(edges(spark, sf_dir), nodes(spark, sf_dir)), "host_link_div")


_SPAM = f"""{ranks('pr', 'ew', 'nodes', None)}, {ranks('tr', 'ew', 'nodes', 'tp')}, q AS (SELECT id, CASE WHEN pr.rank > 0 THEN tr.rank / pr.rank ELSE 0e0 END AS ratio FROM pr JOIN tr USING (id)),
o AS (SELECT ratio, row_number() OVER (ORDER BY ratio) AS k, count(*) OVER () AS n FROM q WHERE ratio > 0 AND id IN (SELECT id FROM seeds)), m AS (SELECT max(ratio) AS m FROM o WHERE k = n // 2 + 1),
sm AS (SELECT id, CASE WHEN m IS NULL THEN 0e0 ELSE least(greatest(1 - ratio / m, 0e0), 1e0) END AS spam FROM q, m)"""


@query(f"WITH RECURSIVE {_BASE}, {_SEEDS}, {_SPAM} SELECT id, round(spam, 6) AS spam FROM sm")
def spam_mass(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    s = _seeds(n)
    return _rounded(graph.spam_mass(graph.trust_rank(e, n, s), graph.pagerank(e, n), s), "spam", 6)


@query(f"WITH {NODES}, {EDGES}, sp AS (SELECT id, (id * 7919 % 1000) / 1000e0 AS spam FROM nodes), o AS (SELECT src AS id, avg(CASE WHEN spam > 0.5e0 THEN 1e0 ELSE 0e0 END) AS r FROM edges JOIN sp ON sp.id = dst GROUP BY src) SELECT sp.id, round(coalesce(r, 0e0), 9) AS outbound_spam FROM sp LEFT JOIN o USING (id)")
def outbound_spam_share(spark, sf_dir):
    spam = nodes(spark, sf_dir).select("id", (F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000.0).alias("spam"))
    return _rounded(graph.outbound_spam(edges(spark, sf_dir), spam), "outbound_spam")


@query(f"WITH RECURSIVE {_BASE}, {_GROUP.format(g='hg', by='host')} SELECT src, dst, w FROM hg")
def host_links(spark, sf_dir):
    return graph.groups(edges(spark, sf_dir), nodes(spark, sf_dir), "host")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, CAST(user_id + 7 AS BIGINT) AS b FROM events WHERE user_id IS NOT NULL), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS root FROM both_ UNION SELECT b.b, r.root FROM r JOIN both_ b ON b.a = r.id)
SELECT id, min(root) AS root FROM r GROUP BY id"""
)
def connected_components(spark, sf_dir):
    """Users whose numbers are seven apart are connected."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null").select(F.col("user_id").alias("src"), (F.col("user_id") + 7).cast("long").alias("dst")).distinct()
    return graph.components(e)


_STATIC_SQL = f"""WITH RECURSIVE {_BASE}, {_SEEDS}, {_SPAM}, {_GROUP.format(g='hg', by='host')}, hn AS (SELECT DISTINCT host AS id FROM nodes), {ranks('hr', 'hg', 'hn', None)}, {_GROUP.format(g='dg', by='domain')}, dn AS (SELECT DISTINCT domain AS id FROM nodes), {ranks('dr', 'dg', 'dn', None)},
lk AS (SELECT dst AS id, count(DISTINCT domain) AS m FROM edges JOIN nodes ON id = src GROUP BY dst),
x AS (SELECT n.id, ln(1 + pr.rank) AS a, ln(1 + hr.rank) AS b, ln(1 + dr.rank) AS c, ln(1 + tr.rank) AS d, ln(1e0 + coalesce(m, 0)) AS e, spam FROM nodes n JOIN pr USING (id) JOIN tr USING (id) JOIN sm USING (id) JOIN hr ON hr.id = host JOIN dr ON dr.id = domain LEFT JOIN lk ON lk.id = n.id),
z AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1, min(d) AS d0, max(d) AS d1, min(e) AS e0, max(e) AS e1 FROM x),
st AS (SELECT id, 0.1e0 * CASE WHEN a1 > a0 THEN (a - a0) / (a1 - a0) ELSE 0 END + 0.2e0 * CASE WHEN b1 > b0 THEN (b - b0) / (b1 - b0) ELSE 0 END + 0.2e0 * CASE WHEN c1 > c0 THEN (c - c0) / (c1 - c0) ELSE 0 END
  + 0.15e0 * CASE WHEN d1 > d0 THEN (d - d0) / (d1 - d0) ELSE 0 END + 0.15e0 * CASE WHEN e1 > e0 THEN (e - e0) / (e1 - e0) ELSE 0 END + 0.1e0 + 0.1e0 * (0.7e0 + 0.3e0 * 0.5e0) - 0.3e0 * spam AS s FROM x, z)
"""


def _static(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    s = _seeds(n)
    pr, tr = graph.cut(graph.pagerank(e, n)), graph.cut(graph.trust_rank(e, n, s))
    parts = n.join(pr.withColumnRenamed("rank", "page_rank"), "id").join(tr.withColumnRenamed("rank", "trust"), "id").join(graph.spam_mass(tr, pr, s), "id").join(graph.linking_groups(e, n).select("id", "linking_domains"), "id")
    parts = parts.join(graph.group_rank(e, n, "host").withColumnsRenamed({"id": "host", "rank": "host_rank"}), "host").join(graph.group_rank(e, n, "domain").withColumnsRenamed({"id": "domain", "rank": "domain_rank"}), "domain")
    return signals.static_rank(graph.cut(parts.withColumns({"freshness": F.lit(1.0), "language": F.lit(0.5), "boilerplate": F.lit(0.0), "near_dup": F.lit(0.0)})))


@query(_STATIC_SQL + "SELECT id, round(s, 5) AS static_rank FROM st")
def static_rank(spark, sf_dir):
    """All graph signals of every node, normalised and blended."""
    return _rounded(_static(spark, sf_dir), "static_rank", 5)


@query(
    """WITH x AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS shard_id, c_acctbal AS s FROM customer), z AS (SELECT shard_id, min(s) AS low, max(s) AS high FROM x GROUP BY shard_id)
SELECT id, shard_id, CAST(CASE WHEN high > low THEN round(255 * (s - low) / (high - low)) ELSE 255 END AS BIGINT) AS impact FROM x JOIN z USING (shard_id)"""
)
def shard_impacts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return signals.impact_bytes(c.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("shard_id"), F.col("c_acctbal").alias("static_rank")))
