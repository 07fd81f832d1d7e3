"""Times the headline queries; prints one line of JSON.

Beside single queries it measures what a user waits for: the index's build (documents a second), a batch of 1,000 lexical searches on the
stored index, 20 rank iterations, 100 vector searches, and the whole cascade for 100 queries.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("inverted_index", "bm25f_search", "fused_search", "sparse_search", "vector_search", "page_rank", "near_duplicate_clusters", "language_distances", "global_ids", "event_sessions")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from sparrowdex import registry
    from sparrowdex.operators import ann, graph, retrieve
    from sparrowdex.plans import stored
    from sparrowdex.sources import tables

    registry.load()
    took, more = {}, {}

    def run(name, make):
        at = time.time()
        df = make()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - at, 2)

    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()  # the first query pays for the start of the machine
    docs = tables.documents(spark, SF_DIR)
    run("index_build", lambda: stored.engine(spark, SF_DIR) and None)
    engine = stored.engine(spark, SF_DIR)
    for name in HEADLINE:
        run(name, lambda name=name: registry.QUERIES[name](spark, SF_DIR))
    words = docs.select("doc_id", F.array_join(F.slice(F.split("body", r"\s+"), 3, 4), " ").alias("text")).where("text <> ''")
    asked = words.orderBy("doc_id").limit(1000).select(F.col("doc_id").alias("query_id"), "text").cache()
    run("bm25f_1000_queries", lambda: retrieve.bm25f(asked, engine.postings, k=10, statistics=engine.statistics))
    run("page_rank_20_steps", lambda: graph.pagerank(tables.edges(spark, SF_DIR), tables.nodes(spark, SF_DIR), iterations=20, tolerance=None))
    vectors = tables.table(spark, SF_DIR, "embeddings")
    near = vectors.orderBy("vec_id").limit(100).select(F.col("vec_id").alias("query_id"), "embedding").cache()
    run("vectors_100_queries", lambda: retrieve.nearest(near, vectors, 10))
    centre = ann.centres(vectors)
    run("ann_100_queries", lambda: ann.nearest(near, ann.indexed(vectors, centre), centre, 10))
    few = asked.limit(100).cache()
    model = engine.train(few, rounds=50)
    run("cascade_100_queries", lambda: engine.search(few, 10, model))
    n = docs.count()
    more = {"index_docs_per_sec": round(n / took["index_build"], 1), "bm25f_queries_per_sec": round(1000 / took["bm25f_1000_queries"], 1), "documents": n}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took[q] for q in HEADLINE), 2), "unit": "sec", "queries": took, **more, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
