"""Queries of judging, evaluation, feature quantisation and learning to rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import cut, fresh_path
from ..functions.text import tokens
from ..operators import evaluate, learn, retrieve, signals
from ..registry import query
from ..sources.tables import documents, queries_of, table
from . import stored
from .sql import BM25F, DOCS, tok

_TOP = BM25F + ", top_ AS (SELECT query_id, doc_id, score FROM bm WHERE rank <= 100)"
_GRADE = f"""g0 AS (SELECT t.query_id, t.doc_id, list_distinct({tok('b.text')}) AS q, {tok('d.body')} AS w, {tok('d.title')} AS h FROM top_ t JOIN benchmark b ON b.item_id = t.query_id JOIN d USING (doc_id)),
g1 AS (SELECT query_id, doc_id, len(q) AS n, len(list_filter(q, lambda x: list_contains(w, x) OR list_contains(h, x))) AS s, len(list_filter(q, lambda x: list_contains(h, x))) AS st FROM g0),
gr AS (SELECT query_id, doc_id, CASE WHEN n = 0 OR s = 0 THEN 0 WHEN 2 * s < n THEN 1 WHEN s = n AND st = n THEN 3 ELSE 2 END AS grade FROM g1)"""


def _run(spark, sf_dir, k=100):
    e = stored.engine(spark, sf_dir)
    return e.docs, cut(retrieve.bm25f(queries_of(spark, sf_dir), e.held, k=k, statistics=e.statistics).select("query_id", "doc_id", "score"))


def _graded(spark, sf_dir, d, run):
    q = queries_of(spark, sf_dir).select("query_id", tokens(F.col("text")).alias("q"))
    d = d.join(F.broadcast(run.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = run.select("query_id", "doc_id").join(d.select("doc_id", tokens(F.col("body")).alias("w"), tokens(F.col("title")).alias("h")), "doc_id").join(q, "query_id")
    return rows.select("query_id", "doc_id", learn.grade(F.col("q"), F.col("w"), F.col("h")).alias("grade"))


@query(_TOP + ", " + _GRADE + " SELECT query_id, doc_id, grade FROM gr")
def lexical_grades(spark, sf_dir):
    d, run = _run(spark, sf_dir)
    return _graded(spark, sf_dir, d, run)


@query(_TOP + " SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM top_")
def run_order(spark, sf_dir):
    return evaluate.ordered(_run(spark, sf_dir)[1]).select("query_id", "doc_id", "rank")


_METRICS = """, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM top_),
il AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS k FROM gr WHERE grade > 0), ic AS (SELECT query_id, sum(CASE WHEN k <= 10 THEN (pow(2, grade) - 1) / log2(k + 1) ELSE 0 END) AS idcg, count(*) AS rel FROM il GROUP BY query_id),
h AS (SELECT rk.query_id, rank, grade, row_number() OVER (PARTITION BY rk.query_id ORDER BY rank) AS hits FROM rk JOIN gr USING (query_id, doc_id) WHERE grade > 0),
f AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(hits / rank) AS pr, max(1e0 / rank) AS rr, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS atk FROM h GROUP BY query_id),
bq AS (SELECT query_id, coalesce(dcg / idcg, 0) AS ndcg, coalesce(pr / rel, 0) AS ap, coalesce(rr, 0) AS rr, coalesce(atk / rel, 0) AS recall FROM ic LEFT JOIN f USING (query_id))"""


@query(_TOP + ", " + _GRADE + _METRICS + " SELECT query_id, round(ndcg, 9) AS ndcg, round(ap, 9) AS ap, round(rr, 9) AS rr, round(recall, 9) AS recall FROM bq")
def metrics_by_query(spark, sf_dir):
    d, run = _run(spark, sf_dir)
    m = evaluate.by_query(run, _graded(spark, sf_dir, d, run))
    return m.select("query_id", *[F.round(c, 9).alias(c) for c in ("ndcg", "ap", "rr", "recall")])


@query(_TOP + ", " + _GRADE + _METRICS + " SELECT round(avg(ndcg), 9) AS ndcg, round(avg(ap), 9) AS ap, round(avg(rr), 9) AS rr, round(avg(recall), 9) AS recall, count(*) AS queries, (SELECT count(DISTINCT query_id) FROM gr) - count(*) AS skipped FROM bq")
def evaluation(spark, sf_dir):
    d, run = _run(spark, sf_dir)
    m = evaluate.evaluate(run, _graded(spark, sf_dir, d, run))
    return m.select(*[F.round(c, 9).alias(c) for c in ("ndcg", "ap", "rr", "recall")], "queries", "skipped")


_JUDGES = "j AS (SELECT 0 AS query_id, doc_id, quality AS gold, 1 - toxic AS judge FROM labels WHERE doc_id IS NOT NULL)"


def _judges(spark, sf_dir):
    x = table(spark, sf_dir, "labels").where("doc_id is not null")
    return x.select(F.lit(0).alias("query_id"), "doc_id", F.col("quality").alias("grade")), x.select(F.lit(0).alias("query_id"), "doc_id", (1 - F.col("toxic")).alias("grade"))


@query(f"WITH {_JUDGES} SELECT gold, judge, count(*) AS n FROM j GROUP BY gold, judge")
def judge_confusion(spark, sf_dir):
    return evaluate.confusion(*_judges(spark, sf_dir))


@query(
    f"""WITH {_JUDGES}, c AS (SELECT gold, judge, CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY gold, judge), s AS (SELECT sum(sign(a.gold - b.gold) * sign(a.judge - b.judge) * a.n * b.n) AS s, sum(CASE WHEN a.gold <> b.gold THEN a.n * b.n END) AS x, sum(CASE WHEN a.judge <> b.judge THEN a.n * b.n END) AS y FROM c a, c b)
SELECT round(CASE WHEN x > 0 AND y > 0 THEN s / sqrt(x * y) ELSE 0e0 END, 9) AS tau_b, CASE WHEN x > 0 AND y > 0 THEN s / sqrt(x * y) ELSE 0e0 END >= 0.87e0 AS trusted FROM s"""
)
def judge_agreement(spark, sf_dir):
    return evaluate.kendall(*_judges(spark, sf_dir)).withColumn("tau_b", F.round("tau_b", 9))


@query(_TOP + ", o2 AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, doc_id) AS k FROM top_) WHERE k <= 100) SELECT query_id, doc_id FROM (SELECT query_id, doc_id FROM top_ UNION SELECT query_id, doc_id FROM o2)")
def judgement_pool(spark, sf_dir):
    run = _run(spark, sf_dir)[1]
    return evaluate.pooled(run, run.withColumn("score", -F.col("doc_id")))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS grade FROM labels WHERE doc_id IS NOT NULL")
def judgement_overlay(spark, sf_dir):
    x = table(spark, sf_dir, "labels").where("doc_id is not null").withColumn("query_id", F.lit(0))
    gold = x.where("toxic = 1").select("query_id", "doc_id", F.lit(0).alias("grade"))
    return evaluate.overlaid(x.select("query_id", "doc_id", F.col("quality").alias("grade")), gold).select("doc_id", "grade")


def _columns(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.col("c_nationkey").cast("long").alias("shard_id"), F.col("c_acctbal").alias("linear"), F.col("c_custkey").cast("double").alias("logged"), F.col("c_acctbal").alias("signed"))


_QUANTISED = """WITH x AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(c_nationkey AS BIGINT) AS shard_id, c_acctbal AS a, CAST(c_custkey AS DOUBLE) AS b FROM customer),
z AS (SELECT shard_id, min(a) AS a0, max(a) AS a1, max(abs(a)) AS s, min(ln(1 + b)) AS b0, max(ln(1 + b)) AS b1 FROM x GROUP BY shard_id),
y AS (SELECT *, CAST(CAST(CASE WHEN a1 > a0 THEN (a1 - a0) / 255 ELSE 1e0 END AS FLOAT) AS DOUBLE) AS ka, CAST(CAST(a0 AS FLOAT) AS DOUBLE) AS la, CAST(CAST(CASE WHEN b1 > b0 THEN (b1 - b0) / 255 ELSE 1e0 END AS FLOAT) AS DOUBLE) AS kb, CAST(CAST(b0 AS FLOAT) AS DOUBLE) AS lb, CAST(CAST(CASE WHEN s > 0 THEN 2 * s / 255 ELSE 1e0 END AS FLOAT) AS DOUBLE) AS ks FROM x JOIN z USING (shard_id)),
l AS (SELECT *, least(greatest(round((a - la) / ka), 0), 255) AS linear, least(greatest(round((ln(1 + b) - lb) / kb), 0), 255) AS logged, least(greatest(round(a / ks) + 128, 0), 255) AS signed FROM y)
SELECT doc_id, shard_id, CAST(linear AS BIGINT) AS linear, round(la + linear * ka, 4) AS linear_back, CAST(logged AS BIGINT) AS logged, round(exp(lb + logged * kb) - 1, 4) AS logged_back, CAST(signed AS BIGINT) AS signed, round((signed - 128) * ks, 4) AS signed_back FROM l"""


@query(_QUANTISED)
def feature_quantisation(spark, sf_dir):
    out = signals.quantised_features(_columns(spark, sf_dir), _KINDS)
    return out.withColumns({k: F.round(k, 4) for k in ("linear_back", "logged_back", "signed_back")})


_KINDS = {"linear": "linear", "logged": "log", "signed": "signed"}


@query(f"SELECT doc_id, shard_id, linear_back AS linear, logged_back AS logged, signed_back AS signed FROM ({_QUANTISED})")
def feature_dequantisation(spark, sf_dir):
    """Levels and the stored bounds of their columns, back to values."""
    c = _columns(spark, sf_dir)
    bounds = fresh_path(spark, "bounds")
    signals.feature_bounds(c, _KINDS).write.parquet(bounds)
    back = signals.dequantised(signals.quantised_features(c, _KINDS), spark.read.parquet(bounds), _KINDS)
    return back.withColumns({k: F.round(k, 4) for k in _KINDS})


@query()
def online_features(spark, sf_dir):
    """The online features of the candidates of all queries."""
    e, q = stored.engine(spark, sf_dir), queries_of(spark, sf_dir)
    return e.features(q, e.candidates(q))


_LEN = lambda f, b: f"CASE WHEN avg_{f} > 0 THEN 1 - {b} + {b} * l_{f} / avg_{f} ELSE 1e0 END AS k_{f}"
_SINGLE = lambda f: f"round(sum(CASE WHEN n_{f} > 0 THEN w * n_{f} * 1.9e0 / (n_{f} + 0.9e0 * k_{f}) ELSE 0e0 END), 6)"
_HITS = lambda f: f"sum(CASE WHEN n_{f} > 0 THEN 1e0 ELSE 0e0 END)"
_RUN = lambda f: f"CASE WHEN contains(any_value(s_{f}), ' ' || array_to_string(any_value(q), '  ') || ' ') THEN 1e0 ELSE 0e0 END"
_FIELDS_OF = ("title", "body", "url", "anchor")
_ONLINE = (
    BM25F
    + f""", c AS MATERIALIZED (SELECT query_id, doc_id FROM bm WHERE rank <= {retrieve.L1}), b AS (SELECT item_id AS query_id, {tok('text')} AS q FROM benchmark WHERE item_id IS NOT NULL),
xd AS MATERIALIZED (SELECT doc_id, host, {tok('title')} AS title, {tok('left(body, 10000)')} AS body, {tok('url')} AS url, {tok('anchor')} AS anchor FROM d WHERE doc_id IN (SELECT doc_id FROM c)),
xs AS MATERIALIZED (SELECT doc_id, host, {', '.join(f"len({f}) AS l_{f}" for f in _FIELDS_OF)}, ' ' || array_to_string(title, '  ') || ' ' AS s_title, ' ' || array_to_string(body, '  ') || ' ' AS s_body FROM xd),
"""
    + ", ".join(f"t_{f} AS MATERIALIZED (SELECT doc_id, term, count(*) AS n_{f}, min(i) AS i_{f} FROM (SELECT doc_id, unnest({f}) AS term, generate_subscripts({f}, 1) AS i FROM xd) GROUP BY doc_id, term)" for f in _FIELDS_OF)
    + f""", y AS (SELECT c.query_id, c.doc_id, term, coalesce(ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0)), 1e0) AS w, coalesce(n_title, 0) AS n_title, coalesce(n_body, 0) AS n_body, coalesce(n_url, 0) AS n_url, coalesce(n_anchor, 0) AS n_anchor, i_body, xs.* EXCLUDE (doc_id),
  {_LEN('title', '0.4e0')}, {_LEN('body', '0.75e0')}, {_LEN('url', '0.4e0')}, {_LEN('anchor', '0.5e0')}
  FROM c JOIN qt USING (query_id) JOIN xs USING (doc_id) LEFT JOIN df USING (term) LEFT JOIN t_title USING (doc_id, term) LEFT JOIN t_body USING (doc_id, term) LEFT JOIN t_url USING (doc_id, term) LEFT JOIN t_anchor USING (doc_id, term), av),
v AS (SELECT y.*, q, 3e0 * n_title / k_title + n_body / k_body + n_url / k_url + 2e0 * n_anchor / k_anchor AS tf FROM y JOIN b USING (query_id))
SELECT query_id, doc_id, round(sum(CASE WHEN tf > 0 THEN w * tf / (0.9e0 + tf) ELSE 0e0 END), 6) AS bm25f_total, {_SINGLE('title')} AS bm25_title, {_SINGLE('body')} AS bm25_body, {_SINGLE('url')} AS bm25_url,
  round(avg(CASE WHEN n_title + n_body + n_url > 0 THEN 1e0 ELSE 0e0 END), 6) AS term_coverage, round(avg(CASE WHEN n_title > 0 THEN 1e0 ELSE 0e0 END), 6) AS term_coverage_title, {_RUN('body')} AS exact_match, {_RUN('title')} AS exact_match_title,
  round(coalesce(1e0 / min(i_body), 0e0), 6) AS first_occurrence, {_HITS('title')} AS field_hit_title, {_HITS('body')} AS field_hit_body, {_HITS('url')} AS url_term_match,
  max(CASE WHEN list_contains(string_split(lower(host), '.'), term) THEN 1e0 ELSE 0e0 END) AS url_exact_host, CAST(count(*) AS DOUBLE) AS query_length, round(sum(w), 6) AS idf_sum, round(max(w), 6) AS idf_max, {_SINGLE('anchor')} AS bm25_anchor FROM v GROUP BY query_id, doc_id"""
)
#: Online features that SQL can follow; the others are windows over positions.
IN_SQL = tuple(c for c in learn.ONLINE if c not in ("dense_cosine", "ordered_proximity", "unordered_proximity", "min_pair_distance"))


@query(_ONLINE)
def online_feature_values(spark, sf_dir):
    e, q = stored.engine(spark, sf_dir), queries_of(spark, sf_dir)
    rows = e.features(q, e.candidates(q))
    return rows.select("query_id", "doc_id", *[F.round(c, 6).alias(c) for c in IN_SQL])


@query()
def judged_bootstrap(spark, sf_dir):
    """A model trained on the lexical grades of some queries, and what it gains on the held-out ones over the order before it."""
    e = stored.engine(spark, sf_dir)
    out = e.train(queries_of(spark, sf_dir), share=0.2)
    return spark.createDataFrame([(out.trained, out.untrained, out.p, out.improved, len(out.trees))], "trained double, untrained double, p double, improved boolean, trees int")


@query(f"WITH {DOCS} SELECT doc_id, CAST(floor(doc_id / 16) AS BIGINT) AS query_id FROM d")
def cold_start_groups(spark, sf_dir):
    return learn.grouped(documents(spark, sf_dir).select("doc_id"))
