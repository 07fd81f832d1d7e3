"""Queries over documents and pages: structure, links, vocabulary, languages, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language, text, urls, words
from ..operators import index, signals, spelling
from ..registry import query
from ..sources.tables import documents, queries_of, table
from .sql import DOCS, LENGTHS, POSTINGS, TERMS, tok


@query(f"WITH {DOCS} SELECT doc_id, title, url FROM d")
def document_titles(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "title", "url")


_ALNUM = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]'))"
_LINK = r"'\[([^\]]*)\]\([^)]*\)?'"


@query(
    rf"""WITH {DOCS}, b AS (SELECT doc_id, list_filter(regexp_split_to_array(body, '\n(?:[ \t\r]*\n)+'), lambda x: regexp_replace(x, '[ \t\r\n]', '', 'g') <> '') AS bs FROM d),
e AS (SELECT doc_id, unnest(bs) AS b FROM b),
v AS (SELECT doc_id, {_ALNUM.format(f"regexp_replace(b, {_LINK}, chr(92) || '1', 'g')")} AS visible, {_ALNUM.format(f"array_to_string(regexp_extract_all(b, {_LINK}, 1), '')")} AS anchor FROM e),
s AS (SELECT doc_id, sum(visible) AS whole, sum(visible) FILTER (visible > 0 AND anchor >= 0.5e0 * visible) AS linked FROM v GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN strlen(body) > 0 THEN 100e0 * {_ALNUM.format("body")} / strlen(body) ELSE 0e0 END, 6) AS content_quality,
  round(CASE WHEN whole > 0 THEN coalesce(linked, 0) / whole ELSE 0e0 END, 6) AS boilerplate,
  round(greatest(0e0, least(len({tok("body")}), 4000) / 40e0 - 3e0 * 2), 6) AS prior
FROM d LEFT JOIN s USING (doc_id)"""
)
def document_signals(spark, sf_dir):
    d = documents(spark, sf_dir)
    prior = text.prior(F.size(text.tokens(F.col("body"))), F.size(urls.path_segments(F.col("url"))))
    return d.select("doc_id", F.round(text.content_quality(F.col("body")), 6).alias("content_quality"), F.round(text.boilerplate(F.col("body")), 6).alias("boilerplate"), F.round(prior, 6).alias("prior"))


@query(
    r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host,
  CAST(len(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS BIGINT) AS depth,
  CAST(strlen(url) AS BIGINT) AS url_len, CASE WHEN starts_with(url, 'https://') THEN 1 ELSE 0 END AS https FROM pages"""
)
def url_features(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), F.size(urls.path_segments(u)).cast("long").alias("depth"), F.octet_length(u).cast("long").alias("url_len"), F.when(u.startswith("https://"), 1).otherwise(0).alias("https"))


#: The canonical form of the addresses of pages, which have no user, port, escape or dot segment; those are tested on examples.
def _canonical_sql(url: str) -> str:
    query = f"list_sort(list_filter(string_split(regexp_extract({url}, '^[^#?]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND NOT list_contains([{', '.join(repr(t) for t in sorted(urls.TRACKING))}], lower(split_part(p, '=', 1)))))"
    path = f"list_filter(string_split(regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s NOT IN ('', '.'))"
    path = f"list_transform({path}, lambda s: CASE WHEN regexp_full_match(s, '[ -~]*') THEN s ELSE replace(url_encode(s), '%2C', ',') END)"
    base = f"lower(regexp_extract({url}, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#]+)', 1)) || '/' || array_to_string({path}, '/')"
    return f"({base} || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END)"


_HOST = "lower(regexp_extract({}, '^[A-Za-z]+://([^/:?#]+)', 1))"


@query(
    f"""WITH c AS (SELECT page_id, url, CASE WHEN regexp_matches(url, '^(?i)https?://[^/?#]') THEN {_canonical_sql('url')} END AS canonical FROM pages)
SELECT *, sha256(canonical) AS doc_key, array_to_string(string_split({_HOST.format('canonical')}, '.')[-2:], '.') AS domain FROM c"""
)
def canonical_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.canonical_url("url").alias("canonical"))
    return p.withColumns({"doc_key": urls.doc_identity(F.col("canonical")), "domain": urls.domain_of(urls.host(F.col("canonical")))})


@query(
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n FROM h GROUP BY page_id, href"""
)
def page_hrefs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(
    rf"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(?:.|\n)*?</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a\s[^>]*?href=["''][^"'']*["''][^>]*>((?:.|\n)*?)</a>', 1)) AS label FROM pages),
a AS (SELECT page_id, url, CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href END AS target, trim(regexp_replace(regexp_replace(label, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS label FROM h)
SELECT DISTINCT page_id, {_canonical_sql('target')} AS target, rtrim(left(label, 120)) AS label FROM a WHERE {_canonical_sql('target')} <> {_canonical_sql('url')}"""
)
def page_outlinks(spark, sf_dir):
    """Distinct resolved links of pages with their labels; the pages' links are whole addresses or start at the root."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(urls.links_udf(True)("url", "html")).alias("x")).select("page_id", "x.target", "x.label").distinct()


@query(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id) AS k FROM events WHERE user_id IS NOT NULL)
SELECT event_id, user_id, event_type FROM c WHERE k = 1 UNION ALL SELECT event_id, user_id, event_type FROM events WHERE user_id IS NULL"""
)
def latest_by_identity(spark, sf_dir):
    """Identity dedup: the record of the latest date of each identity, the first seen among equals."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return signals.unique_documents(e, "user_id", "day", "event_id").select("event_id", "user_id", "event_type")


@query(f"WITH {DOCS}, {POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf_title + tf_body + tf_url + tf_anchor) AS BIGINT) AS cf FROM p GROUP BY term")
def vocabulary(spark, sf_dir):
    return index.postings(documents(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.col("tf_title") + F.col("tf_body") + F.col("tf_url") + F.col("tf_anchor")).alias("cf"))


@query(f"WITH {DOCS}, {LENGTHS} SELECT * FROM ln")
def document_lengths(spark, sf_dir):
    return index.lengths(documents(spark, sf_dir))


_TRI = r"""w AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '\p{{L}}+')) AS w FROM documents WHERE {key} IS NOT NULL),
{name} AS (SELECT {key}, gram, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, gram) - 1 AS r FROM (SELECT {key}, substr(' ' || w || ' ', i, 3) AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS i FROM w)) GROUP BY {key}, gram)"""


@query(f"WITH {_TRI.format(key='lang', text='text', name='g')} SELECT lang, gram, CAST(r AS BIGINT) AS r FROM g WHERE r < 300")
def language_profiles(spark, sf_dir):
    return language.profiles(table(spark, sf_dir, "documents"))


_DISTANCES = (
    "WITH "
    + _TRI.format(key="lang", text="text", name="g")
    + ", pr AS (SELECT lang, gram, r FROM g WHERE r < 300), "
    + _TRI.format(key="doc_id", text="text", name="o").replace("w AS (", "w2 AS (", 1).replace("FROM w))", "FROM w2))")
    + """, sz AS (SELECT doc_id, count(*) AS grams FROM o GROUP BY doc_id), mt AS (SELECT doc_id, lang, sum(abs(o.r - pr.r)) AS moved, count(*) AS met FROM o JOIN pr USING (gram) GROUP BY doc_id, lang)
SELECT doc_id, lang, round((coalesce(moved, 0) + (grams - coalesce(met, 0)) * 300) / (300e0 * grams), 9) AS distance, grams FROM sz CROSS JOIN (SELECT DISTINCT lang FROM pr) LEFT JOIN mt USING (doc_id, lang)"""
)


@query(_DISTANCES)
def language_distances(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return language.distances(d.where("doc_id is not null"), language.profiles(d)).withColumn("distance", F.round("distance", 9))


_SCRIPTS = {"ko": "Hangul", "zh": "Han", "ru": "Cyrillic", "el": "Greek", "ar": "Arabic", "he": "Hebrew", "th": "Thai", "hi": "Devanagari", "latin": "Latin"}
_COUNTED = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '\\p{{{n}}}')) AS {k}" for k, n in _SCRIPTS.items()) + ", len(regexp_extract_all(coalesce(text, ''), '[\\p{Hiragana}\\p{Katakana}]')) AS ja"
_ORDER = ("ko", "ja", "zh", "ru", "el", "ar", "he", "th", "hi")


@query(
    f"""WITH ds AS ({_DISTANCES}), k AS (SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS second FROM ds WINDOW w AS (PARTITION BY doc_id ORDER BY distance, lang)), f AS (SELECT * FROM k WHERE k = 1),
c AS (SELECT doc_id, {_COUNTED} FROM documents WHERE doc_id IS NOT NULL), m AS (SELECT *, greatest({', '.join((*_ORDER, 'latin'))}) AS most, {' + '.join((*_ORDER, 'latin'))} AS whole FROM c),
s AS (SELECT doc_id, CASE WHEN ja > 0 THEN 'ja' {' '.join(f"WHEN {x} = most AND most > 0 THEN '{x}'" for x in _ORDER)} ELSE 'latin' END AS script, CASE WHEN whole > 0 THEN CASE WHEN ja > 0 THEN ja + zh ELSE most END / whole ELSE 0e0 END AS share FROM m)
SELECT doc_id, CASE WHEN script <> 'latin' THEN script ELSE lang END AS lang, CASE WHEN script <> 'latin' THEN share >= 0.6e0 ELSE coalesce(distance <= 0.92e0 AND (second IS NULL OR distance < 0.97e0 * second) AND grams >= 3, false) END AS confident,
  CASE WHEN script = 'latin' THEN distance END AS distance FROM s LEFT JOIN f USING (doc_id) WHERE grams IS NOT NULL OR script <> 'latin'"""
)
def language_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return language.detect(d.where("doc_id is not null"), language.profiles(d)).withColumn("distance", F.round("distance", 9))


@query()
def spelling_corrections(spark, sf_dir):
    """Corrections of all words of the pages' texts against the words of the documents."""
    v = index.frequencies(index.by_document(documents(spark, sf_dir)))
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    seen = table(spark, sf_dir, "pages").select(F.explode(F.array_distinct(text.tokens(plain))).alias("query")).distinct()
    return spelling.corrections(seen, spelling.dictionary(v))


_PAIRS = [(k, x) for k, v in spelling.expansion().items() for x in v]


@query(f"WITH {TERMS}, x AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PAIRS)}) AS v(base, alt)) SELECT query_id, term, term AS base FROM qt UNION SELECT query_id, alt, base FROM qt JOIN x ON base = term")
def query_expansions(spark, sf_dir):
    terms = queries_of(spark, sf_dir).select("query_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return spelling.expanded(terms)


@query()
def vocabulary_stems(spark, sf_dir):
    """Stems of the distinct terms, which are far fewer than their occurrences."""
    return index.frequencies(index.by_document(documents(spark, sf_dir))).select("term", words.stem_udf("term").alias("stem"), "df")


@query()
def hash_embeddings(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", words.embed_udf(64)(text.tokens(F.col("body"))).alias("embedding"))


@query(
    """WITH n AS (SELECT source AS host, lang, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND lang <> '' GROUP BY source, lang),
f AS (SELECT host, lang AS host_lang FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, lang) AS k FROM n) WHERE k = 1)
SELECT doc_id, source || '.example.com' AS host, host_lang, CASE WHEN coalesce(lang, '') = '' THEN 0.5e0 WHEN lang = host_lang THEN 1e0 ELSE 0e0 END AS consistency FROM documents LEFT JOIN f ON host = source WHERE doc_id IS NOT NULL"""
)
def host_language(spark, sf_dir):
    return signals.host_language(documents(spark, sf_dir))


_VOTE = " + ".join(f"CASE WHEN 2 * sum(n * ((h >> {k}) & 1)) > sum(n) THEN {1 << k} ELSE 0 END" for k in range(32))
_HALF = lambda at: f"CAST('0x' || substr(md5(t), {at}, 8) AS BIGINT)"
_NEAR = f"""{DOCS}, tk AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS t FROM (SELECT doc_id, {tok('body')} AS ts FROM d) WHERE len(ts) >= 8) GROUP BY doc_id, t),
hi AS (SELECT doc_id, {_VOTE} AS hi FROM (SELECT doc_id, n, {_HALF(1)} AS h FROM tk) GROUP BY doc_id), lo AS (SELECT doc_id, {_VOTE} AS lo FROM (SELECT doc_id, n, {_HALF(9)} AS h FROM tk) GROUP BY doc_id),
sm AS (SELECT doc_id, CAST(hi AS BIGINT) AS hi, CAST(lo AS BIGINT) AS lo FROM hi JOIN lo USING (doc_id)), one AS MATERIALIZED (SELECT hi, lo, min(doc_id) AS id, count(*) AS n FROM sm GROUP BY hi, lo),
cl AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM one a JOIN one b ON a.id <> b.id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3),
rc AS (SELECT id, id AS root FROM one UNION SELECT cl.y, rc.root FROM rc JOIN cl ON cl.x = rc.id), rt AS (SELECT id, min(root) AS root FROM rc GROUP BY id),
sz AS (SELECT root, CAST(sum(n) AS BIGINT) AS size FROM one JOIN rt USING (id) GROUP BY root HAVING sum(n) > 1),
nc AS MATERIALIZED (SELECT doc_id, root, size FROM sm JOIN one USING (hi, lo) JOIN rt USING (id) JOIN sz USING (root))"""


@query(f"WITH RECURSIVE {_NEAR} SELECT doc_id, root, size FROM nc")
def near_duplicate_clusters(spark, sf_dir):
    return signals.near_clusters(documents(spark, sf_dir))


_PENALTY = f"""{_NEAR}, rk AS (SELECT doc_id, greatest(0e0, least(len({tok('body')}), 4000) / 40e0 - 3e0 * 2) AS rank, url FROM d),
cx AS (SELECT *, first_value(doc_id) OVER w AS representative, first_value(rank) OVER w AS best FROM nc JOIN rk USING (doc_id) WINDOW w AS (PARTITION BY root ORDER BY rank DESC, len(url), doc_id)),
pn AS (SELECT doc_id, representative, CASE WHEN doc_id = representative THEN 0e0 ELSE (1 - 1e0 / size) * (0.5e0 + 0.5e0 * CASE WHEN best > 0 THEN least(greatest(1 - rank / best, 0e0), 1e0) ELSE 0e0 END) END AS near_dup FROM cx)"""


def _near_penalty(spark, sf_dir):
    d = documents(spark, sf_dir)
    rank = text.prior(F.size(text.tokens(F.col("body"))), F.size(urls.path_segments(F.col("url"))))
    return signals.near_penalty(signals.near_clusters(d), d.select("doc_id", rank.alias("rank"), F.lit("").alias("crawl_date"), "url"))


@query(f"WITH RECURSIVE {_PENALTY} SELECT doc_id, representative, round(near_dup, 9) AS near_dup FROM pn")
def near_dup_penalty(spark, sf_dir):
    """What near-duplicates lose to the best of their cluster by prior rank."""
    return _near_penalty(spark, sf_dir).withColumn("near_dup", F.round("near_dup", 9))


@query(
    """WITH a AS (SELECT CAST(l_suppkey AS BIGINT) AS target, p_name AS phrase, c_nationkey AS domain, s_nationkey AS own FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
w AS (SELECT target, phrase, least(count(DISTINCT domain) * (1 + max(CASE WHEN domain <> own THEN 1 ELSE 0 END)), 16) AS times FROM a WHERE phrase <> '' GROUP BY target, phrase)
SELECT target, string_agg(rtrim(repeat(phrase || ' ', times)), ' ' ORDER BY phrase) AS anchor FROM w GROUP BY target"""
)
def anchor_fields(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    a = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return signals.anchor_field(a.select(F.col("l_suppkey").cast("long").alias("target"), F.col("p_name").alias("phrase"), F.col("c_nationkey").alias("domain"), F.col("s_nationkey").alias("own_domain")))


@query(
    f"""WITH {DOCS}, h AS (SELECT host, n, row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(host, '.')[-2:]), '.'), host) - 1 AS host_rank FROM (SELECT host, count(*) AS n FROM d GROUP BY host)),
b AS (SELECT CAST(ceil(log2(greatest(max(n), 1))) AS BIGINT) AS bits FROM h), s AS (SELECT doc_id, host, row_number() OVER (PARTITION BY host ORDER BY url, doc_id) - 1 AS seq FROM d)
SELECT doc_id, CAST(host_rank AS BIGINT) AS host_rank, CAST(seq AS BIGINT) AS seq, CAST(host_rank * pow(2, bits) + seq AS BIGINT) AS global_id FROM s JOIN h USING (host), b"""
)
def global_ids(spark, sf_dir):
    d = documents(spark, sf_dir)
    return signals.global_ids(d, urls.domain_of)
