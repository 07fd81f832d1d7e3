"""Pieces of SQL that several queries share."""

from __future__ import annotations


def tok(column: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{Nd}}]+')"


_FIRST = r"rtrim(regexp_extract(coalesce(text, ''), '[^\s#*_`\[\]<>|][^\n]*', 0), '*_`[]<>| ' || chr(9) || chr(13))"
DOCS = f"""t0 AS (SELECT doc_id, lang, source || '.example.com' AS host, coalesce(text, '') AS body, {_FIRST} AS t FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, 'https://' || host || '/d/' || doc_id AS url, host, lang, body, '' AS anchor,
  CASE WHEN strlen(t) <= 160 THEN t ELSE left(t, list_filter(range(160, 39, -1), lambda n: strlen(left(t, n)) <= 160)[1]) END AS title FROM t0)"""
_FIELDS = ("title", "body", "url", "anchor")
LENGTHS = "ln AS (SELECT doc_id, " + ", ".join(f"CAST(len({tok(f)}) AS BIGINT) AS len_{f}" for f in _FIELDS) + " FROM d)"
POSTINGS = (
    "tk AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS f, unnest({tok(f)}) AS term FROM d" for f in _FIELDS)
    + "), p AS (SELECT term, doc_id, "
    + ", ".join(f"CAST(count(*) FILTER (f = '{f}') AS BIGINT) AS tf_{f}" for f in _FIELDS)
    + " FROM tk GROUP BY term, doc_id)"
)
AVERAGES = "av AS (SELECT count(*) AS n_docs, CAST(sum(len_title + len_body) AS BIGINT) AS token_count, sum(len_title + len_body) / count(*) AS avg_doc_len, " + ", ".join(f"avg(len_{f}) AS avg_{f}" for f in _FIELDS) + " FROM ln)"
TERMS = f"qt AS (SELECT DISTINCT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark WHERE item_id IS NOT NULL)"
_W, _B = {"title": "3e0", "body": "1e0", "url": "1e0", "anchor": "2e0"}, {"title": ("0.6e0", "0.4e0"), "body": ("0.25e0", "0.75e0"), "url": ("0.6e0", "0.4e0"), "anchor": ("0.5e0", "0.5e0")}
_TF = "0e0 + " + " + ".join(f"{_W[f]} * tf_{f} / CASE WHEN avg_{f} > 0 THEN {_B[f][0]} + {_B[f][1]} * len_{f} / avg_{f} ELSE 1e0 END" for f in _FIELDS)
BM25F_TF = _TF
BM25F = f"""WITH {DOCS}, {LENGTHS}, {POSTINGS}, {AVERAGES}, {TERMS},
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT p.term, p.doc_id, df, n_docs, {_TF} AS tf FROM p JOIN ln USING (doc_id) JOIN df USING (term), av),
s AS (SELECT query_id, doc_id, CAST(sum(CAST(round(ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * tf / (0.9e0 + tf) * 65536) AS BIGINT)) AS BIGINT) AS score FROM qt JOIN w USING (term) GROUP BY query_id, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""
NODES = """nodes AS (SELECT CAST(c_custkey AS BIGINT) AS id, n_name AS host, r_name AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT CAST(s_suppkey + 100000000 AS BIGINT), n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EDGES = """deals AS (SELECT CAST(o_custkey AS BIGINT) AS c, CAST(l_suppkey + 100000000 AS BIGINT) AS s, l_returnflag AS f FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
edges AS (SELECT c AS src, s AS dst FROM deals UNION SELECT s, c FROM deals WHERE f = 'R')"""


def ranks(name: str, edges: str, nodes: str, teleport: str | None, iterations: int = 100, tolerance: str = "1e-6") -> str:
    """CTEs that end in <name>(id, rank): the power iteration of graph.weighted_rank over edges (src, dst, w)."""
    p = f"SELECT id, 1e0 / (SELECT count(*) FROM {nodes}) AS p FROM {nodes}" if teleport is None else f"SELECT n.id, coalesce(t.p, 0e0) AS p FROM {nodes} n LEFT JOIN {teleport} t USING (id)"
    out = [f"{name}_o AS MATERIALIZED (SELECT src, sum(w) AS o FROM {edges} GROUP BY src)", f"{name}_l AS MATERIALIZED (SELECT e.src, e.dst, e.w / o AS share FROM {edges} e JOIN {name}_o USING (src))"]
    out.append(f"{name}_p AS MATERIALIZED ({p})")
    into = f"(SELECT l.dst AS id, sum(i.r * l.share) AS s FROM {name}_l l JOIN {name}_i i ON l.src = i.id GROUP BY l.dst)"
    step = f"SELECT i.k + 1 AS k, a.id, a.p * 0.15e0 + 0.85e0 * coalesce(s, 0e0) AS r, i.r AS old FROM {name}_i i JOIN {name}_p a ON a.id = i.id LEFT JOIN {into} n ON n.id = a.id WHERE i.k < {iterations} AND NOT (i.k > 0 AND i.k % 10 = 0 AND i.d < {tolerance})"
    out.append(f"{name}_i AS (SELECT 0 AS k, id, p AS r, 1e9 AS d FROM {name}_p UNION ALL SELECT k, id, r, sum(abs(r - old)) OVER () AS d FROM ({step}))")
    out.append(f"{name}_z AS MATERIALIZED (SELECT id, r FROM {name}_i WHERE k = (SELECT max(k) FROM {name}_i))")
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT id, r / (SELECT sum(r) FROM {name}_z) AS rank FROM {name}_z)"])
