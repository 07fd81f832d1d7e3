"""Readers: crawl exports, run and judgement files, and the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CRAWL = "url string, host string, crawl_date string, markdown string, body string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """(url, host, crawl_date, body) of a crawl export, by its extension; compressed lines are read as they are."""
    plain = path.removesuffix(".gz").rstrip("/*")
    if plain.endswith(".parquet"):
        rows = spark.read.parquet(path)
        body = F.col("markdown")
    elif plain.endswith((".jsonl", ".json")):
        rows = spark.read.schema(CRAWL).option("mode", "FAILFAST").json(path)
        body = F.when(F.coalesce(F.col("markdown"), F.lit("")) != "", F.col("markdown")).otherwise(F.col("body"))
    else:
        raise ValueError(f"a crawl is .parquet, .jsonl or .json, perhaps with .gz: {path}")
    return rows.select("url", "host", F.coalesce("crawl_date", F.lit("")).alias("crawl_date"), F.coalesce(body, F.lit("")).alias("body"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rank, score, tag) of a run of six columns; a row of another width is an error."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.when(F.size(p) == 6, p).otherwise(F.raise_error(F.concat(F.lit("not a run row: "), "value"))).alias("p"))
    return rows.select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("long").alias("rank"), F.col("p")[4].cast("double").alias("score"), F.col("p")[5].alias("tag"))


def write_run(run: DataFrame, path: str, tag: str = "sparrowdex") -> None:
    """Writes (query_id, doc_id, rank, score) as a run of six columns."""
    run.select(F.concat_ws(" ", "query_id", F.lit("Q0"), "doc_id", "rank", F.format_string("%.6f", "score"), F.lit(tag)).alias("value")).write.text(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) of judgements; of several for a pair the last one holds."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("at"), F.when(F.size(p) == 4, p).otherwise(F.raise_error(F.concat(F.lit("not a judgement row: "), "value"))).alias("p"))
    rows = rows.select("at", F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("int").alias("grade"))
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("grade", "at").alias("grade"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, url, host, lang, title, body, anchor) of the documents table; a host stands for a source."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    host = F.concat(F.col("source"), F.lit(".example.com"))
    return d.select("doc_id", F.concat(F.lit("https://"), host, F.lit("/d/"), "doc_id").alias("url"), host.alias("host"), "lang", T.title(F.col("text")).alias("title"), F.coalesce("text", F.lit("")).alias("body"), F.lit("").alias("anchor"))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text) of the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").where("query_id is not null")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, host, domain) of a graph: customers and suppliers with their nations and regions."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("host"), F.col("r_name").alias("domain"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").alias("n"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100_000_000).cast("long").alias("id"), F.col("s_nationkey").alias("n"))
    return c.union(s).join(n, F.col("n") == F.col("n_nationkey")).select("id", "host", "domain")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of the graph: a purchase links a customer to a supplier, a return links back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    pair = F.struct(F.col("o_custkey").cast("long").alias("src"), (F.col("l_suppkey") + 100_000_000).cast("long").alias("dst"))
    back = F.when(F.col("l_returnflag") == "R", F.struct(pair["dst"].alias("src"), pair["src"].alias("dst")))
    return o.select(F.explode(F.array_compact(F.array(pair, back))).alias("e")).select("e.src", "e.dst").distinct()
