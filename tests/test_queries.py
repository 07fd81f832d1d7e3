"""Queries of the package against their SQL, and operators over small tables."""

import glob
import io
import json
import os
import random
import threading
import tracemalloc
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparrowdex import registry
from sparrowdex.functions import language
from sparrowdex.functions import tables as tables_of
from sparrowdex.functions.words import osa
from sparrowdex.operators import ann, evaluate, graph, index, judge, learn, retrieve, signals, spelling
from sparrowdex.operators.numbering import numbered
from sparrowdex.plans.collection import Collection
from sparrowdex.plans.engine import ROW, Engine
from sparrowdex.plans.serve import Service, served
from sparrowdex.sources import tables
from sparrowdex.streaming import incremental

registry.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows):
    return sorted((tuple(0.0 if x == 0 else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*names).collect())
    want = plain(duck.sql(f"select {', '.join(names)} from ({registry.SQL[name]})").fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert list(map(str, g)) == list(map(str, w))


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"url":"u","host":"h","markdown":"m","crawl_date":"2024-01-01"}\n\n{"url":"v","host":"h","body":"b"}\n')
    assert [tuple(r) for r in tables.read_crawl(spark, str(tmp_path / "c.jsonl")).collect()] == [("u", "h", "2024-01-01", "m"), ("v", "h", "", "b")]
    with pytest.raises(ValueError):
        tables.read_crawl(spark, "x.csv")
    (tmp_path / "run").write_text("q1 Q0 d1 1 2.5 t\n\nq1 Q0 d2 2 1.5 t\n")
    (tmp_path / "qrels").write_text("q1 0 d1 0\nq1 0 d1 3\n")
    assert [r["doc_id"] for r in tables.read_run(spark, str(tmp_path / "run")).collect()] == ["d1", "d2"]
    assert [tuple(r) for r in tables.read_qrels(spark, str(tmp_path / "qrels")).collect()] == [("q1", "d1", 3)]
    got = evaluate.evaluate(tables.read_run(spark, str(tmp_path / "run")), tables.read_qrels(spark, str(tmp_path / "qrels"))).first()
    assert (got["ndcg"], got["rr"], got["queries"]) == (1.0, 1.0, 1)
    tables.write_run(spark.createDataFrame([("q", "d", 1, 0.5)], "query_id string, doc_id string, rank long, score double"), str(tmp_path / "out"))
    assert tables.read_run(spark, str(tmp_path / "out")).first()["score"] == 0.5


def test_near_clusters_against_brute_force(spark):
    base = [f"{w} tree house river stone light water field {w}x" for w in ("alpha", "beta", "gamma")]
    docs = spark.createDataFrame([(k, base[k % 3] + (" extra" if k == 7 else "")) for k in range(9)] + [(20, "short"), (21, None)], "doc_id long, body string")
    sims = {r["doc_id"]: r["sim"] & (2**64 - 1) for r in signals.fingerprints(docs).collect()}
    assert set(sims) == set(range(9))
    got = {r["doc_id"]: r["root"] for r in signals.near_clusters(docs).collect()}
    for a in sims:
        for b in sims:
            if bin(sims[a] ^ sims[b]).count("1") <= signals.NEAR and a != b:
                assert got[a] == got[b]


def test_components_here_and_there_are_the_same(spark):
    rng = random.Random(6)
    pairs = [(k, k + 1) for k in range(20)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(25)] + [(7, 7)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    here, there = (sorted(tuple(r) for r in graph.components(e, local=size).collect()) for size in (graph.LOCAL, 0))
    assert here == there and dict(here)[20] == 0
    assert graph.components(e.limit(0)).count() == 0


def test_penalty_spares_the_representative(spark):
    c = spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "doc_id long, root long, size long")
    r = spark.createDataFrame([(1, 0.2, "2024", "u"), (2, 0.4, "2024", "u")], "doc_id long, rank double, crawl_date string, url string")
    assert {x["doc_id"]: x["near_dup"] for x in signals.near_penalty(c, r).collect()} == {1: 0.5 * (0.5 + 0.5 * 0.5), 2: 0.0}


def test_rank_converges_and_sums_to_one(spark):
    n = spark.createDataFrame([(k, "h", "d") for k in range(6)], "id long, host string, domain string")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (4, 0)], "src long, dst long")
    r = {x["id"]: x["rank"] for x in graph.pagerank(e, n).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r[0] > r[1] > r[3] and abs(r[3] - r[5]) < 1e-9


def test_languages_and_spelling(spark):
    d = spark.createDataFrame([(1, "en", "the house and the river"), (2, "de", "das haus und der fluss"), (3, None, "это русский текст"), (4, None, "ひらがな 日本"), (5, None, "")], "doc_id long, lang string, text string")
    got = {r["doc_id"]: r["lang"] for r in language.detect(d, language.profiles(d)).collect()}
    assert got == {1: "en", 2: "de", 3: "ru", 4: "ja"}
    v = spelling.dictionary(spark.createDataFrame([("the", 90), ("house", 40), ("hous", 2), ("rare", 1)], "term string, df long"))
    q = spark.createDataFrame([("teh",), ("house",), ("hous",), ("zzzzzz",), ("hoxxse",)], "query string")
    assert {r["query"]: (r["action"], r["term"]) for r in spelling.corrections(q, v).collect()} == {"teh": ("correct", "the"), "house": ("keep", None), "hous": ("correct", "house"), "zzzzzz": ("none", None), "hoxxse": ("suggest", "house")}


def test_corrections_against_brute_force_look_up_what_is_open(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    vocabulary = {word(): rng.randrange(2, 40) for _ in range(60)}
    asked = sorted({word() for _ in range(60)} | {"zzzzzzzz"} | set(list(vocabulary)[:20]))

    def wanted(q):
        own, near = vocabulary.get(q), []
        for t, n in vocabulary.items():
            dist = osa(q, t, 2)
            if 0 < dist < max(len(q), len(t)):  # a character at least stays
                near.append((dist, -n, t))
        if (own or 0) > spelling.KEEP_ABOVE or (own and not near):
            return "keep", None, None
        if not near:
            return "none", None, None
        dist, n, t = min(near)
        return ("correct" if dist <= 1 and (own is None or -n >= spelling.MARGIN * own) else "suggest"), t, dist

    seen, candidates = [], spelling.candidates

    def spied(queries, words, distance):
        seen.append({r["query"] for r in queries.collect()})
        return candidates(queries, words, distance)

    monkeypatch.setattr(spelling, "candidates", spied)
    v = spelling.dictionary(spark.createDataFrame(list(vocabulary.items()), "term string, df long"))
    got = {r["query"]: (r["action"], r["term"], r["dist"]) for r in spelling.corrections(spark.createDataFrame([(q,) for q in asked], "query string"), v).collect()}
    assert got == {q: wanted(q) for q in asked}
    assert not seen[0] & {q for q in asked if vocabulary.get(q, 0) > spelling.KEEP_ABOVE} and not seen[1] & {q for q, x in got.items() if x[2] == 1}


def test_engine_life_cycle(spark, tmp_path):
    rows = [(k, f"https://h.org/{k}", "h.org", f"title {w}", f"{w} body text", "") for k, w in enumerate(["red", "green", "blue", "red blue"])]
    docs = spark.createDataFrame(rows, "doc_id long, url string, host string, title string, body string, anchor string")
    e = Engine(docs)
    found = lambda engine, text, **options: [d for d, _ in engine.ask(text, **options).hits]
    assert found(e, "red") == found(e, "RED") == [0, 3] and found(e, " ") == [] and e.ask("Red").cached
    assert found(e, "+red -blue", enforce=True) == [0] and found(e, "+red -blue") == [0, 3] and found(e, '"red blue" site:h.org', enforce=True) == [3]
    assert e.ask("blue", deadline=600.0).complete and found(e, "green", deadline=600.0) == [1]
    late = e.ask("text", deadline=0.0)
    assert not late.complete and not late.hits and not e.ask("text", deadline=0.0).cached
    assert found(e.published(docs.where("doc_id = 0").withColumn("doc_id", F.lit(9).cast("long"))), "red")[:2] == [0, 9]
    assert found(e.retired(docs.where("doc_id = 0")).compacted(), "red") == [3]
    assert found(Engine.open(spark, e.save(str(tmp_path / "c"))), "blue") == [2, 3]
    q = spark.createDataFrame([(1, "red blue"), (2, "green")], "query_id long, text string")
    model = e.train(q, rounds=3, least=1)
    assert {r["query_id"] for r in e.search(q, 2, model).collect()} == {1, 2}
    table = learn.model_table(spark, model)
    assert [len(t.feature) for t in learn.model_of(table)] == [len(t.feature) for t in model]


def test_grades_read_whole_bodies(spark):
    rows = [(0, "u", "h", "title", "filler " * 2000 + "late", ""), (1, "u", "h", "title", "late", "")]
    e = Engine(spark.createDataFrame(rows, "doc_id long, url string, host string, title string, body string, anchor string"))
    q = spark.createDataFrame([(1, "late")], "query_id long, text string")
    got = {r["doc_id"]: r for r in e.features(q, e.candidates(q)).collect()}
    assert got[0]["grade"] == got[1]["grade"] == 2
    assert (got[0]["field_hit_body"], got[1]["field_hit_body"]) == (0.0, 1.0)


def test_nearest_in_several_passes(spark, sf_dir, monkeypatch):
    v = tables.table(spark, sf_dir, "embeddings")
    q = v.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    want = retrieve.nearest(q, v, 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(retrieve, "QUERY_ROWS", 4)
    assert retrieve.nearest(q, v, 3).orderBy("query_id", "rank").collect() == want and all(r["vec_id"] == r["query_id"] for r in want if r["rank"] == 1)
    assert retrieve.nearest(q.limit(0), v).count() == 0


def test_scores_of_many_queries_are_held_in_part():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(6000, 8)), rng.normal(size=(3000, 8))
    run = retrieve._best(np.arange(len(q)), retrieve._unit(q), 3)
    frame = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)})
    tracemalloc.start()
    got = next(iter(run([frame])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = np.round(retrieve._unit(q) @ retrieve._unit(x).T, 9)
    assert (got["vec_id"].to_numpy().reshape(-1, 3) == np.argsort(-s, axis=1, kind="stable")[:, :3]).all() and most < s.nbytes / 2


def test_added_crawls_hold_each_key_once(spark, tmp_path):
    for k, ids in enumerate(([1, 2, 2, None], [2, 3, None])):
        spark.createDataFrame([(str(i) if i else None,) for i in ids], "url string").write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("url string").parquet(str(tmp_path / "in"))
        incremental.add_crawl(s, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(str(r["url"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3", "None", "None"]
    assert incremental.due(100, 16) and not incremental.due(10_000, 99)


def test_levels_drop_the_shards_of_the_least_static_rank(spark):
    rows = [(k, f"https://h.org/{k}", "h.org", "title", "same text", "") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, host string, title string, body string, anchor string")
    signals_ = spark.createDataFrame([(k, 1.0 / (1 + k)) for k in range(8)], "doc_id long, static_rank double")
    e = Engine(docs, signals_, shard=2)
    q = spark.createDataFrame([(1, "same")], "query_id long, text string")
    assert sorted(r["doc_id"] for r in e.search(q, level=2).collect()) == list(range(8))
    assert sorted(r["doc_id"] for r in e.search(q, level=3).collect()) == list(range(6))


def test_rows_hold_matrix_and_online_features(spark):
    docs = spark.createDataFrame([(1, "https://h.org/1", "h.org", "red", "red car", ""), (2, "https://h.org/2", "h.org", "x", "red", "")], "doc_id long, url string, host string, title string, body string, anchor string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "vec_id long, embedding array<double>")
    e = Engine(docs, spark.createDataFrame([(1, 0.25, 3.0)], "doc_id long, static_rank double, in_degree double"), vectors)
    q = spark.createDataFrame([(7, "red", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    got = {r["doc_id"]: r for r in e.rows(q, e.candidates(q)).collect()}
    assert e.rows(q, e.candidates(q)).columns == ["query_id", "doc_id", "grade", *ROW] and len(ROW) == 48
    assert (got[1]["static_rank"], got[1]["in_degree"], got[2]["static_rank"]) == (0.25, 3.0, 0.0)
    assert abs(got[1]["dense_cosine"] - 1) < 1e-9 and abs(got[2]["dense_cosine"] - 0.6) < 1e-9 and got[1]["bm25f_total"] > got[2]["bm25f_total"] > 0


def test_collection_is_built_added_to_compacted_and_reclaimed(spark, tmp_path):
    crawl = "url string, host string, crawl_date string, body string"
    first = [("http://b.org/x?utm_source=1", "b.org", "2024-01-01", "red [see a](http://a.org/1)"), ("http://b.org/x", "b.org", "2024-01-02", "newer red [see a](http://a.org/1)"), ("http://a.org/1", "a.org", "2024-01-01", "blue"), ("nonsense", "n", "", "odd"), ("http://c.org/", "c.org", "", "")]
    c = Collection.build(spark, spark.createDataFrame(first, crawl), str(tmp_path / "c"), shard=2)
    docs = {r["url"]: r for r in c.table("docs").collect()}
    assert [(r["doc_id"], r["url"]) for r in sorted(docs.values())] == [(0, "http://a.org/1"), (1, "http://b.org/x"), (2, "nonsense")]
    assert docs["http://a.org/1"]["anchor"] == "see a see a" and docs["http://b.org/x"]["crawl_date"] == "2024-01-02"
    assert c.next_base() == 3 and [tuple(r)[:3] for r in c.shards().collect()] == [(0, 0, 2), (1, 2, 1)] and [tuple(r) for r in c.edges().collect()] == [(1, 0)]
    more = c.add(spark.createDataFrame([("https://c.org/new", "c.org", "2024-02-01", "green <http://b.org/x>"), ("http://a.org/1#top", "a.org", "2024-02-01", "held")], crawl))
    assert c.next_base() == 3 and more.next_base() == 4 and sorted(tuple(r) for r in more.edges().collect()) == [(1, 0), (3, 1)]
    assert more.statistics().first()["n_docs"] == 4 and more.engine().ask("green").hits[0][0] == 3
    routes = more.routes(spark.createDataFrame([(1, "green"), (2, None)], "query_id long, term string")).collect()
    assert {(r["query_id"], r["shard_id"]) for r in routes} == {(1, 1), (2, 0), (2, 1)}
    new = more.compact()
    assert new.version == 1 and new.parts == 1 and [r["url"] for r in new.table("docs").orderBy("doc_id").collect()] == ["http://a.org/1", "http://b.org/x", "https://c.org/new", "nonsense"]
    assert more.table("docs").count() == 4 and new.reclaim() == 1 and new.versions() == [1]
    assert {r["name"]: r["rows"] for r in new.inspect().collect()}["docs"] == 4
    with pytest.raises(FileNotFoundError):
        Collection(spark, str(tmp_path / "none"))
    assert Collection.build(spark, spark.createDataFrame([], crawl), str(tmp_path / "empty")).statistics().first()["n_docs"] == 0


def test_vectors_without_clusters_are_found_too(spark):
    x = np.random.default_rng(5).normal(size=(4000, 32)).astype(np.float32)
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centre = ann.centres(v)
    exact, index_ = retrieve.nearest(q, v, 10), ann.indexed(v, centre)
    assert ann.recall(ann.nearest(q, index_, centre, 10), exact) < 0.9
    assert ann.PROBES < ann.probes(v, centre) < len(centre)
    assert ann.recall(ann.nearest(q, index_, centre, 10, ann.probes(v, centre)), exact) >= 0.9
    assert ann.probes(v.limit(0), centre) == ann.PROBES


def test_routes_know_whole_words_and_shards_their_lengths(spark, tmp_path):
    crawl = "url string, host string, crawl_date string, body string"
    rows = [(f"http://a.org/{k}", "a.org", "2024", ("x" * 5 + " ") * 26 + f"whole{k}") for k in range(6)] + [("http://b.org/", "b.org", "2024", "!")]
    c = Collection.build(spark, spark.createDataFrame(rows, crawl), str(tmp_path / "c"), shard=2)
    assert c.table("docs").where("doc_id = 0").first()["title"].endswith(" whol")
    assert c.table("postings").where("term = 'whol'").count() == 6 and not c.table("routing").where("term = 'whol'").count()
    routes = c.routes(spark.createDataFrame([(1, "whol"), (1, "whole3")], "query_id long, term string")).collect()
    assert [tuple(r) for r in routes] == [(1, 1, 1)]
    assert [tuple(r) for r in c.shards().select("n", "len_title", "len_body", "len_url", "len_anchor").collect()] == [(2, 54, 54, 8, 0), (2, 54, 54, 8, 0), (2, 54, 54, 8, 0), (1, 0, 0, 3, 0)]
    assert {r["doc_id"]: r["place"] for r in numbered(c.table("docs"), "url", name="place").collect()} == {k: k for k in range(7)}


def test_approximate_search_finds_nine_tenths(spark, sf_dir):
    v = tables.table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centre = ann.centres(v)
    index_ = ann.indexed(v, centre)
    assert index_.count() == v.count()
    exact = retrieve.nearest(q, v, 10)
    assert ann.recall(ann.nearest(q, index_, centre, 10), exact) >= 0.9
    assert ann.recall(ann.nearest(q, index_, centre, 10, probes=len(centre), depth=v.count()), exact) == 1.0
    assert ann.nearest(q.limit(0), index_, centre).count() == 0


def test_ranks_equal_a_power_iteration(spark, sf_dir):
    e, n = tables.edges(spark, sf_dir), tables.nodes(spark, sf_dir)
    ids = sorted(r["id"] for r in n.collect())
    at = {x: k for k, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in e.collect():
        m[at[r["dst"]], at[r["src"]]] = 1
    out = m.sum(axis=0)
    share = m / np.where(out > 0, out, 1)
    r = np.full(len(ids), 1 / len(ids))
    for _ in range(300):
        r = (0.15 + 0.85 * r[out == 0].sum()) / len(ids) + 0.85 * share @ r
    got = {x["id"]: x["rank"] for x in graph.pagerank(e, n).collect()}
    assert sum(abs(got[x] - r[at[x]]) for x in ids) < 1e-5
    few = {"iterations": 20, "tolerance": None}
    here, there = ({x["id"]: x["rank"] for x in graph.pagerank(e, n, local=size, **few).collect()} for size in (graph.LOCAL, 0))
    assert here.keys() == there.keys() and all(abs(here[x] - there[x]) < 1e-12 for x in here)


def test_ranks_are_the_same_three_ways_and_iterate_without_shuffles(spark, sf_dir):
    n = tables.nodes(spark, sf_dir)
    e = graph.cut(tables.edges(spark, sf_dir).withColumn("w", 1.0 + F.pmod("src", F.lit(3))))
    teleport = graph.seeded(n.where("domain = 'EUROPE'").select("id"))
    few = {"teleport": teleport, "tolerance": None}
    here, vector, joined = ({x["id"]: x["rank"] for x in graph.weighted_rank(e, n, iterations=20, **few, **ways).collect()} for ways in ({}, {"local": 0}, {"local": 0, "held": 0}))
    assert here.keys() == vector.keys() == joined.keys() and all(abs(here[x] - vector[x]) < 1e-12 and abs(here[x] - joined[x]) < 1e-12 for x in here)
    stages = []
    for k in (5, 25):
        spark.sparkContext.setJobGroup(f"ranks-{k}", "ranks")
        graph.weighted_rank(e, n, iterations=k, local=0, **few).count()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"ranks-{k}")
        stages.append(sum(len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) for j in jobs))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages[1] - stages[0] <= 20
    assert graph.weighted_rank(e.limit(0), n.limit(0), local=-1).count() == graph.weighted_rank(e.limit(0), n.limit(0)).count() == 0


def test_documents_are_scored_where_they_are_as_by_postings(spark, sf_dir, monkeypatch):
    d, q = tables.documents(spark, sf_dir), tables.queries_of(spark, sf_dir)
    p, rows = index.postings(d), graph.cut(index.by_document(d, "host"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(p) and "Exchange" not in plan(index.by_document(d))
    old = d.select("doc_id", F.explode(index.tokens(F.col("body"))).alias("term")).groupBy("term", "doc_id").count()
    assert p.where("tf_body > 0").join(old, ["term", "doc_id"]).where("tf_body = count").count() == old.count() == p.where("tf_body > 0").count()
    assert sorted(map(tuple, index.exploded(rows).collect())) == sorted(map(tuple, p.select(*index.exploded(rows).columns).collect()))
    impact = rows.select("doc_id", (F.col("len_body") % 7).alias("impact"))
    ways = lambda x, i: [retrieve.bm25f(q, x, k=7, statistics=index.averages(d)), retrieve.matching(q, x, False), retrieve.matching(q, x, True), retrieve.static_impact(q, x, i, 9)]
    want = [sorted(map(tuple, df.collect())) for df in ways(p, impact)]
    marked = rows.withColumn("impact", F.col("len_body") % 7)
    for most, cells, pool in ((retrieve.QUERY_TERMS, retrieve._CELLS, retrieve._POOL), (retrieve.QUERY_TERMS, 5000, 10), (0, 0, 0)):
        for name, value in (("QUERY_TERMS", most), ("_CELLS", cells), ("_POOL", pool)):
            monkeypatch.setattr(retrieve, name, value)
        got = ways(marked, "impact")
        assert [sorted(map(tuple, df.collect())) for df in got] == want
        # pairs of a query and a document stay where they are: only the best of each task are shuffled
        assert not most or "Exchange" not in plan(got[1]) and "HashAggregate" not in plan(got[0])
    assert retrieve.bm25f(q.limit(0), rows).count() == retrieve.bm25f(q, rows.limit(0), statistics=index.averages(d)).count() == 0


def test_service_answers_and_swaps_snapshots(spark, tmp_path):
    docs = spark.createDataFrame([(0, "https://h.org/0", "h.org", "t", "red", ""), (1, "https://h.org/1", "h.org", "t", "blue", "")], "doc_id long, url string, host string, title string, body string, anchor string")
    docs.withColumn("doc_id", F.col("doc_id") + 10).write.parquet(str(tmp_path / "more"))
    s = Service(lambda: Engine(docs), slots=1)
    server = served(s)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        got = json.load(urlopen(f"{at}/search?q=red&k=3"))
        assert [h["doc_id"] for h in got["hits"]] == [0] and got["complete"] and got["degrade"] == 0
        assert json.load(urlopen(f"{at}/healthz"))["documents"] == 2
        assert json.load(urlopen(Request(f"{at}/admin/publish", json.dumps({"path": str(tmp_path / "more")}).encode())))["documents"] == 4
        assert json.load(urlopen(Request(f"{at}/admin/retire", b'{"doc_ids": [0, 11]}')))["documents"] == 2
        assert json.load(urlopen(Request(f"{at}/admin/reload", b"")))["documents"] == 2
    finally:
        server.shutdown()
    assert s.handle("GET", "/search?q=x&k=0")[0] == s.handle("POST", "/admin/publish")[0] == 400 and s.handle("GET", "/none")[0] == 404
    s._slots.acquire()
    assert s.handle("GET", "/search?q=red")[0] == 503


def test_judges_of_ones_own(spark):
    pairs = spark.createDataFrame([(1, 2, "q", "t", "b")], "query_id long, doc_id long, query string, title string, body string")
    assert [tuple(r) for r in learn.judged_by(pairs, lambda prompt: f"Grade: {1 + prompt.count('Query: q')}").collect()] == [(1, 2, 2)]


@pytest.mark.parametrize("n", [2, 1 << 16, 1 << 21, 1 << 26, 1 << 34])
def test_close_fingerprints_share_a_band_at_any_size(n):
    rng = random.Random(n)
    masks = signals.band_masks(n)
    assert all(bin(m & (2**64 - 1)).count("1") >= 16 for m in masks)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), signals.NEAR))
        assert any(not flips & m & (2**64 - 1) for m in masks)


def test_functions_that_give_tables(spark):
    tables_of.register(spark)
    assert [tuple(r) for r in spark.sql("select * from tokens('Red, car')").collect()] == [(0, "red"), (1, "car")]
    assert [tuple(r) for r in spark.sql("select d.id, o.target from values (1, 'see [x](/b)') as d(id, body), lateral outlinks('http://h.org/', d.body) o").collect()] == [(1, "http://h.org/b")]
    assert [tuple(r) for r in spark.sql("select * from anchors('http://h.org/', '[x](/b) <http://c.org/>')").collect()] == [("http://h.org/b", "x")]


def test_a_chat_judge_asks_and_reads(monkeypatch):
    seen = []

    class Reply(io.BytesIO):
        pass

    def answer(request, timeout):
        seen.append((request.full_url, json.loads(request.data), request.get_header("Authorization")))
        return Reply(json.dumps({"choices": [{"message": {"content": "Grade: 2"}}]}).encode())

    monkeypatch.setattr(judge, "urlopen", answer)
    for name, value in (("JUDGE_URL", "http://j/v1"), ("JUDGE_MODEL", "m"), ("JUDGE_KEY", "k")):
        monkeypatch.setenv(name, value)
    assert learn.grade_reply(judge.ChatJudge.of_environment()("how good?")) == 2
    assert seen == [("http://j/v1", {"model": "m", "temperature": 0, "messages": [{"role": "user", "content": "how good?"}]}, "Bearer k")]
    monkeypatch.delenv("JUDGE_MODEL")
    with pytest.raises(ValueError):
        judge.ChatJudge.of_environment()
