"""Indexes of the driver's tables, made once for each state of a table and read by all queries of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, urls
from ..functions.shared import exists, fresh_path
from ..sources.tables import documents, table
from . import matrix
from .collection import Collection
from .engine import Engine

_made: dict[tuple, str] = {}
SHARD = 256


def _once(spark: SparkSession, kind: str, sf_dir: str, names: tuple[str, ...], make) -> str:
    """The path that make wrote for the tables as they are: another length or time of a file makes another one."""
    files = []
    for n in names:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.listStatus(at)
        files += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    key = (spark.sparkContext.applicationId, kind, tuple(files))
    if key not in _made or not exists(spark, _made[key]):
        path = fresh_path(spark, kind)
        make(path)
        _made[key] = path
    return _made[key]


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """The engine over all documents, with postings by document and statistics as they were saved."""
    path = _once(spark, "index", sf_dir, ("documents",), lambda p: Engine(documents(spark, sf_dir)).save(p, by_term=False))
    return Engine.open(spark, path, **options)


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, host, crawl_date, body): the documents as a crawl; each ends in a link to the one of its host that is twenty further."""
    d = documents(spark, sf_dir)
    after = F.concat(F.lit("\n\n[next page](/d/"), F.col("doc_id") + 20, F.lit("?utm_source=crawl)"))
    return d.select("url", "host", F.lit("2024-01-01").alias("crawl_date"), F.concat("body", after).alias("body"))


def later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later crawl: the pages, and all documents once more."""
    p = table(spark, sf_dir, "pages").select("url", urls.host(F.col("url")).alias("host"), F.lit("2024-01-02").alias("crawl_date"), F.col("html").alias("body"))
    return p.unionByName(crawl(spark, sf_dir).withColumn("crawl_date", F.lit("2024-01-02")))


def matrix_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal matrix of the collection, written once."""

    def make(path: str) -> None:
        c = collection(spark, sf_dir)
        matrix.matrix(c.table("docs"), c.edges(), language.profiles(table(spark, sf_dir, "documents"))).write.parquet(path)

    return spark.read.parquet(_once(spark, "matrix", sf_dir, ("documents", "pages"), make))


def collection(spark: SparkSession, sf_dir: str) -> Collection:
    """The collection of the documents, with the pages as a later part."""

    def make(path: str) -> None:
        Collection.build(spark, crawl(spark, sf_dir), path, shard=SHARD).add(later(spark, sf_dir))

    return Collection(spark, _once(spark, "collection", sf_dir, ("documents", "pages"), make))
