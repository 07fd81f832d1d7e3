"""The engine: an immutable snapshot of documents with its index, the cascade from retrieval to reranking, and its life cycle."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import cut, exists, fresh_path
from ..functions.text import tokens
from ..operators import index, learn, retrieve
from ..operators.learn import ONLINE
from ..operators.signals import FEATURES
from .understand import Understanding, enforced

MATRIX = tuple(FEATURES)
#: Most queries that a model is fitted on.
TRAINING_QUERIES = 48
#: What a model sees of a candidate: the matrix, then the online features.
ROW = MATRIX + ONLINE


@dataclass(frozen=True)
class Level:
    """What is done under load: sizes of the first and second cut, whether vectors count, the share of shards that is left out."""

    l0: int = retrieve.L0
    l1: int = retrieve.L1
    dense: bool = True
    drop: float = 0.0


LADDER = (
    Level(),
    Level(l0=retrieve.L0 // 4),
    Level(l0=retrieve.L0 // 4, dense=False),
    Level(l0=retrieve.L0 // 4, dense=False, drop=0.25),
    Level(l0=retrieve.L0 // 4, dense=False, drop=0.25, l1=retrieve.L1 // 2),
)


def level_for(remaining: float, budget: float) -> int:
    """The rung of the ladder for what is left of a budget: full quality with four fifths of it, the last rung with less than one."""
    return next((k for k, share in enumerate((0.8, 0.6, 0.4, 0.2)) if remaining >= share * budget), len(LADDER) - 1)


@dataclass(frozen=True)
class Answer:
    """Hits (doc_id, score) of one query, and how they came about."""

    hits: tuple[tuple[int, float], ...] = ()
    complete: bool = True
    level: int = 0
    lang: str = ""
    correction: tuple = ()
    cached: bool = False


class Engine:
    """docs has (doc_id, url, host, title, body, anchor); signals, if any, doc_id and columns of MATRIX; vectors (vec_id, embedding).

    postings and statistics come from a stored collection or are made of docs. understanding parses single queries. rows: the postings by
    document (index.by_document), which batches of queries meet where they are.
    """

    def __init__(self, docs: DataFrame, signals: DataFrame | None = None, vectors: DataFrame | None = None, cached: int = 256, postings: DataFrame | None = None, statistics: DataFrame | None = None, understanding: Understanding | None = None, shard: int = 50_000, rows: DataFrame | None = None):
        self.docs, self.signals, self.vectors, self.shard = docs, signals, vectors, shard
        self.held = rows
        self.postings = postings if postings is not None else index.postings(docs) if rows is None else index.exploded(rows)
        self._statistics = statistics
        self.understanding = understanding or Understanding()
        self._cache: OrderedDict[tuple, Answer] = OrderedDict()
        self._cached = cached

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Engine:
        """An engine over a collection that save() wrote; nothing is analysed again."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        if exists(spark, f"{path}/rows"):
            return cls(read("docs"), rows=read("rows"), statistics=read("statistics"), **options)
        return cls(read("docs"), postings=read("postings"), statistics=read("statistics"), **options)

    def save(self, path: str, by_term: bool = True) -> str:
        """Writes documents, postings and statistics. Postings are laid out by term, so that a single query's filter on terms skips row groups,
        or by document, for batches of queries: then nothing is shuffled."""
        self.docs.write.mode("errorifexists").parquet(f"{path}/docs")
        if not by_term:
            index.by_document(self.docs, "host").write.mode("errorifexists").parquet(f"{path}/rows")
            rows = self.docs.sparkSession.read.parquet(f"{path}/rows")
            (index.averages(rows) if self._statistics is None else self._statistics).write.mode("errorifexists").parquet(f"{path}/statistics")
            return path
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("errorifexists").parquet(f"{path}/postings")
        self.statistics.write.mode("errorifexists").parquet(f"{path}/statistics")
        return path

    @property
    def statistics(self) -> DataFrame:
        """One row of averages, made once."""
        if self._statistics is None:
            made = index.averages(self.docs)
            self._statistics = self.docs.sparkSession.createDataFrame(made.collect(), made.schema)
        return self._statistics

    def _level(self, level: Level) -> tuple[DataFrame, DataFrame | None]:
        """Postings and vectors that a level asks: without the shards of the least best static rank, of which one stays at least."""
        postings = self.postings if self.held is None else self.held
        if not level.drop or self.signals is None or "static_rank" not in self.signals.columns:
            return postings, self.vectors
        best = self.signals.groupBy(F.floor(F.col("doc_id") / self.shard).alias("shard_id")).agg(F.max("static_rank").alias("best"))
        n = best.count()
        out = best.orderBy("best", F.desc("shard_id")).limit(min(int(n * level.drop), n - 1)).select("shard_id")
        part = lambda df, c: df.join(F.broadcast(out), F.floor(F.col(c) / self.shard) == F.col("shard_id"), "left_anti")
        return part(postings, "doc_id"), None if self.vectors is None else part(self.vectors, "vec_id")

    def lists(self, queries: DataFrame, level: Level = LADDER[0]) -> DataFrame:
        """(plane, query_id, doc_id, score, rank): the best by BM25F (plane 0), and by the vectors of queries that have one (plane 1)."""
        postings, vectors = self._level(level)
        out = retrieve.bm25f(queries, postings, k=level.l0, statistics=self.statistics).select(F.lit(0).alias("plane"), "query_id", "doc_id", F.col("score").cast("double"), "rank")
        if level.dense and vectors is not None and "embedding" in queries.columns:
            near = retrieve.nearest(queries.where("embedding is not null"), vectors, level.l0)
            out = out.unionByName(near.select(F.lit(1).alias("plane"), "query_id", F.col("vec_id").alias("doc_id"), "score", "rank"))
        return out

    def candidates(self, queries: DataFrame, level: Level = LADDER[0]) -> DataFrame:
        """(query_id, doc_id, score, rank): the planes' lists fused, cut to the level's second size."""
        return retrieve.fused(self.lists(queries, level), k=level.l1)

    def features(self, queries: DataFrame, candidates: DataFrame) -> DataFrame:
        """(query_id, doc_id, grade, <ONLINE>): the online features of candidates and their lexical grade.

        Only candidates' texts meet their queries. Idf and averages are global and arrive as columns.
        The grade reads whole bodies, the features their first BODY_CHARS characters.
        """
        q = queries.select("query_id", tokens(queries["text"]).alias("q"))
        terms = retrieve.query_terms(queries)
        asked, docs = retrieve.asked_terms(queries) if self.held is not None else None, self.docs
        if asked is not None:
            # few queries, so few candidates: their ids go to the documents, and they are found once
            candidates, n = cut(candidates), retrieve.asked_frequencies(self.held, asked[1])
            df = docs.sparkSession.createDataFrame(pa.table({"term": asked[1], "df": n})).where("df > 0") if len(n) else index.frequencies(self.held.limit(0))
            docs = docs.join(F.broadcast(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
        else:
            df = index.frequencies(self.postings.join(terms.select("term").distinct(), "term", "left_semi"))
        avg = self.statistics
        idf = terms.join(df, "term").crossJoin(avg.select("n_docs")).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", index.idf(F.col("n_docs"), F.col("df")).alias("i")))).alias("idf"))
        body = F.substring("body", 1, learn.BODY_CHARS)
        docs = docs.select("doc_id", "host", tokens(F.col("title")).alias("title"), tokens(body).alias("body"), tokens(F.col("url")).alias("url"), tokens(F.col("anchor")).alias("anchor"), tokens(F.col("body")).alias("whole"))
        rows = candidates.select("query_id", "doc_id").join(docs, "doc_id").join(q, "query_id").join(idf, "query_id", "left").crossJoin(avg.select(*[f"avg_{f}" for f in index.FIELDS]))
        rows = rows.withColumn("grade", learn.grade(F.col("q"), F.col("whole"), F.col("title"))).drop("whole").withColumn("cosine", F.lit(None).cast("double"))
        if self.vectors is not None and "embedding" in queries.columns:
            near = candidates.select("query_id", "doc_id").join(queries.select("query_id", F.col("embedding").alias("a")), "query_id").join(self.vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("b")), "doc_id")
            near = near.where("a is not null").select("query_id", "doc_id", retrieve.cosine(F.col("a"), F.col("b")).alias("cosine"))
            rows = rows.drop("cosine").join(near, ["query_id", "doc_id"], "left")

        def run(frames):
            import pandas as pd

            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    fields = {k: list(getattr(r, k)) for k in index.FIELDS}
                    averages = {k: getattr(r, f"avg_{k}") for k in index.FIELDS}
                    cosine = None if r.cosine is None or r.cosine != r.cosine else r.cosine
                    out.append([r.query_id, r.doc_id, r.grade, *learn.online_row(list(r.q), fields, r.host or "", dict(r.idf or {}), averages, cosine)])
                yield pd.DataFrame(out, columns=["query_id", "doc_id", "grade", *ONLINE])

        kinds = rows.schema["query_id"].dataType.simpleString()
        return rows.mapInPandas(run, f"query_id {kinds}, doc_id long, grade int, " + ", ".join(f"{c} double" for c in ONLINE))

    def rows(self, queries: DataFrame, candidates: DataFrame) -> DataFrame:
        """(query_id, doc_id, grade, <ROW>): the matrix columns of candidates, 0 where signals lack one, and their online features."""
        rows = self.features(queries, candidates)
        have = [c for c in MATRIX if self.signals is not None and c in self.signals.columns]
        if have:
            rows = rows.join(self.signals.select("doc_id", *have), "doc_id", "left")
        zero = F.lit(0.0)
        return rows.select("query_id", "doc_id", "grade", *[(F.coalesce(F.col(c).cast("double"), zero) if c in have else zero).alias(c) for c in MATRIX], *ONLINE)

    def train(self, queries: DataFrame, judged: DataFrame | None = None, share: float | None = None, most: int = TRAINING_QUERIES, **options) -> list[learn.Tree] | learn.Outcome:
        """A model for the queries' candidates by judged (query_id, doc_id, grade) or by lexical grades.

        share: hold out so many of the queries and return what training gained on them. The model is fitted on the driver, on the
        candidates (LADDER[0].l1 at most) of most queries, those with the least hashes of their text.
        """
        queries = queries.withColumn("__h", F.xxhash64("text")).orderBy("__h", "query_id").limit(most).drop("__h")
        found = self.candidates(queries)
        found = found if self.held is None else cut(found)
        rows = self.rows(queries, found).join(found.select("query_id", "doc_id", F.col("score").alias("__before")), ["query_id", "doc_id"])
        if judged is not None:
            rows = rows.drop("grade").join(judged, ["query_id", "doc_id"], "left").na.fill(0, ["grade"])
        p = rows.toPandas().sort_values(["query_id", "doc_id"], kind="stable")
        x, y = p[list(ROW)].to_numpy(float), p["grade"].to_numpy(float)
        if share is not None:
            return learn.bootstrap(x, y, p["query_id"].to_numpy(), p["__before"].to_numpy(float), share, **options)
        return learn.lambdamart(x, y, p.groupby("query_id", sort=True).size().to_numpy(), **options) if len(p) else []

    def search(self, queries: DataFrame, k: int = 10, model: list[learn.Tree] | None = None, level: int = 0) -> DataFrame:
        """(query_id, doc_id, score, rank): the cascade for a batch of queries (query_id, text[, embedding])."""
        found = self.candidates(queries, LADDER[level])
        if not model:
            return found.where(F.col("rank") <= k)
        rows = learn.scored(self.rows(queries, found), model, list(ROW))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")

    def search_parsed(self, pieces: DataFrame, k: int = 10, every: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank) of a table of parsed queries with all their conditions."""
        return enforced(pieces, self.postings, self.docs, k, every, self.statistics)

    def ask(self, text: str, k: int = 10, level: int | None = None, model: list[learn.Tree] | None = None, deadline: float | None = None, budget: float | None = None, enforce: bool = False) -> Answer:
        """The answer to one query string: from the cache if it was answered before whole and in full quality; nothing to ask gives nothing.

        deadline: seconds after which what there is counts: the shards are asked in turns, the best static ranks first, and the answer is
        incomplete if some were not reached. budget: seconds that an answer should take; with less left the level goes down the ladder.
        enforce: all conditions of the query have to hold; else its terms only score.
        """
        from ..functions.parse import pieces_of, vector_of

        began = time.monotonic()
        q = self.understanding(text)
        if q.empty() and not q.vector:
            return Answer(lang=q.lang)
        level = level if level is not None else level_for(deadline, budget) if deadline is not None and budget else 0
        key = (k, q.key(), enforce, id(model))
        if key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key]
        spark = self.docs.sparkSession
        left = lambda: None if deadline is None else deadline - (time.monotonic() - began)
        row = (0, " ".join(q.retrieval_terms()), vector_of(q.vector) if q.vector else None)
        one = spark.createDataFrame([row], "query_id long, text string, embedding array<double>")
        if deadline is None or enforce or model:
            pieces = pieces_of(spark.createDataFrame([(0, text)], "query_id long, text string"), lambda _: q) if enforce else None
            got = _within(spark, self.search_parsed(pieces, k, q.every) if enforce else self.search(one, k, model, level), left())
            hits, complete = [(r["doc_id"], float(r["score"])) for r in got or []], got is not None
        else:
            parts = [_within(spark, e.lists(one, LADDER[level]), left()) for e in self._turns()]
            complete = None not in parts
            hits = _merged([r for p in parts for r in p or []], LADDER[level])
        hits = tuple(sorted(hits, key=lambda h: (-h[1], h[0]))[:k])
        answer = Answer(hits, complete, level, q.lang, q.correction)
        if level == 0 and complete:
            self._cache[key] = Answer(hits, complete, level, q.lang, q.correction, True)
            while len(self._cache) > self._cached:
                self._cache.popitem(last=False)
        return answer

    def _turns(self, parts: int = 4) -> list[Engine]:
        """Engines over parts of the shards, with the statistics of all."""
        turn = lambda df, c, k: df.where(F.pmod(F.floor(F.col(c) / self.shard), F.lit(parts)) == k)
        return [
            Engine(turn(self.docs, "doc_id", k), self.signals, None if self.vectors is None else turn(self.vectors, "vec_id", k), 0, turn(self.postings, "doc_id", k), self.statistics, self.understanding, self.shard)
            for k in range(parts)
        ]

    def health(self) -> dict:
        r = self.statistics.first()
        return {"documents": r["n_docs"], "tokens": r["token_count"]}

    def _with(self, docs: DataFrame) -> Engine:
        return Engine(docs, self.signals, self.vectors, self._cached, understanding=self.understanding, shard=self.shard)

    def published(self, docs: DataFrame) -> Engine:
        """A new snapshot with more documents; this one stays as it is."""
        return self._with(self.docs.unionByName(docs))

    def retired(self, doc_ids: DataFrame) -> Engine:
        """A new snapshot without documents."""
        return self._with(self.docs.join(doc_ids.select("doc_id"), "doc_id", "left_anti"))

    def compacted(self) -> Engine:
        """A snapshot that is written anew, without the lineage of what was published and retired."""
        path = self.save(fresh_path(self.docs.sparkSession, "collection"))
        return Engine.open(self.docs.sparkSession, path, signals=self.signals, vectors=self.vectors, understanding=self.understanding, shard=self.shard)


def _merged(rows: list, level: Level) -> list[tuple[int, float]]:
    """Lists of several parts of the shards as one, fused by reciprocal ranks."""
    out: dict[int, float] = {}
    for plane in {r["plane"] for r in rows}:
        own = sorted(((-r["score"], r["doc_id"]) for r in rows if r["plane"] == plane))[: level.l0]
        for rank, (_, doc) in enumerate(own, 1):
            out[doc] = out.get(doc, 0.0) + 1.0 / (retrieve.RRF + rank)
    return [(d, round(x, 12)) for d, x in out.items()]


def _within(spark: SparkSession, plan: DataFrame, seconds: float | None) -> list | None:
    """The rows of a plan; None if they took longer, in which case its jobs are cancelled."""
    if seconds is None:
        return plan.collect()
    if seconds <= 0:
        return None
    tag, out = f"ask-{uuid.uuid4().hex}", []

    def run() -> None:
        spark.addTag(tag)
        try:
            out.append(plan.collect())
        except Exception as e:
            out.append(e)

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if t.is_alive():
        spark.interruptTag(tag)
        return None
    if isinstance(out[0], Exception):
        raise out[0]
    return out[0]
