"""Incremental operators: later crawls added by a stream, statistics that fold, windows with late data, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import fresh_path
from ..registry import query


def add_crawl(stream: DataFrame, target: str, checkpoint: str, key: str = "url"):
    """Appends the rows of a stream whose key the table at target lacks, each key once; a null key is always new.

    A batch that is run again after a failure finds its own rows there and adds nothing.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keyed = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            keyed = keyed.join(spark.read.parquet(target).select(key), key, "left_anti").select(batch.columns)
        keyed.unionByName(batch.where(F.col(key).isNull())).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; what is later than the watermark is dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a longer gap."""
    s = events.where("user_id is not null").groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), "n")


def folded(base: DataFrame, more: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Sums of two tables of additive statistics."""
    return base.unionByName(more).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def due(base_rows: int, overlay_rows: int) -> bool:
    """Whether an overlay is to be folded into its base."""
    return overlay_rows >= max(16, base_rows**0.5)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    kind = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/{name}.parquet*")


def _written(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there into a table in the shared folder."""
    spark = df.sparkSession
    out = fresh_path(spark, "stream")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling windows of the event stream, kept as state and given whole at the end."""
    return _written(windowed(_stream(spark, sf_dir, "events")), "complete")


@query(
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, sf_dir):
    return sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def folded_statistics(spark, sf_dir):
    """Statistics of two halves of the documents, folded."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    part = lambda h: d.where(F.col("half") == h).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    return folded(part(0), part(1), ["lang"], ["n", "n_chars"])


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) GROUP BY user_id UNION ALL SELECT NULL, 2 * count(*) FROM events WHERE user_id IS NULL HAVING count(*) > 0")
def crawl_added_once(spark, sf_dir):
    """A stream of records whose identities are added once, also when it is read again; records without one are new each time."""
    target = fresh_path(spark, "crawl")
    for k in range(2):
        add_crawl(_stream(spark, sf_dir, "events").select("user_id"), target, f"{target}-state-{k}", "user_id").awaitTermination()
    return spark.read.parquet(target).groupBy("user_id").agg(F.count("*").alias("n"))
