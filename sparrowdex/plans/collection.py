"""A stored collection: documents with dense ids in host and address order, postings, statistics, routing, link graph and directory.

A collection is a folder of versions. A version is whole tables, each with a part for what was built and one for each later crawl; it is
complete when its mark is written, so readers see all of it or nothing, and an open collection keeps reading the version that it opened.

Cases: rows without a body are left out; an address without a canonical form is kept and never a duplicate; of several rows of an address
the latest crawl date stays, of equals the first; an empty crawl makes an empty collection.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import text as T
from ..functions.shared import cut, exists, fresh_path, remove, rename
from ..operators import index, signals
from ..operators.numbering import numbered
from ..streaming.incremental import due

SHARD = 50_000
#: What decides which terms a text has; a collection made otherwise can't be searched with this one.
ANALYZER = int.from_bytes(hashlib.sha256(rb"lower|[\p{L}\p{Nd}]+|title,body,url,anchor").digest()[:8], "big", signed=True)
TABLES = ("docs", "links", "postings", "shards", "routing", "directory")
#: Bytes a document that a table may take.
CEILING = {"postings": 260, "docs": 400, "links": 40}


def prepared(crawl: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of a crawl (url, host, crawl_date, body) with their canonical address and their place (seen); limit: at most so many, as a
    parameter of a build."""
    rows = crawl.where("body is not null and body <> ''")
    rows = (rows.limit(limit) if limit is not None else rows).withColumn("seen", F.monotonically_increasing_id())
    return cut(rows.withColumn("canonical", urls.canonical_url("url")).select("seen", "url", "canonical", "host", "crawl_date", "body"))


def link_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(src, target, phrase, domain): all links of documents to other addresses; phrase is empty for an address alone. The links, not the
    texts, meet the documents' numbers (seen, doc_id, domain)."""
    each = rows.select("seen", F.explode(urls.links_udf(False)("url", "body")).alias("x")).join(keys.select("seen", "doc_id", "domain"), "seen")
    return each.select(F.col("doc_id").alias("src"), F.col("x.target").alias("target"), F.col("x.label").alias("phrase"), "domain")


def resolved(links: DataFrame, directory: DataFrame) -> DataFrame:
    """(src, dst): links to documents that the directory (canonical, doc_id) has, each once, without those to itself."""
    return links.join(directory, links["target"] == directory["canonical"]).select("src", F.col("doc_id").alias("dst")).where("src <> dst").distinct()


class Collection:
    """The newest complete version of the collection at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no collection in {path}")
        self.version = versions[-1]
        self.path = f"{self.root}/version-{self.version:06d}"
        self.parts = 0
        while exists(spark, f"{self.path}/part-{self.parts}/_DONE"):
            self.parts += 1

    def versions(self) -> list[int]:
        fs, at = self._fs(self.root)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[8:]) for n in names if n.startswith("version-") and n[8:].isdigit() and exists(self.spark, f"{self.root}/{n}/part-0/_DONE"))

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return self.spark.read.parquet(*[f"{self.path}/part-{k}/{name}" for k in range(self.parts)])

    @classmethod
    def build(cls, spark: SparkSession, crawl: DataFrame, path: str, shard: int = SHARD, limit: int | None = None) -> Collection:
        """Makes a new version of a crawl: ids by host and address, anchors from the links within it."""
        rows = prepared(crawl, limit)
        try:
            version = cls(spark, path).version + 1
        except FileNotFoundError:
            version = 0
        return cls._write(spark, rows, path, version, 0, 0, shard, None)

    @classmethod
    def _write(cls, spark, rows, path, version, part, base, shard, old: Collection | None) -> Collection:
        """Rows (seen, url, canonical, host, crawl_date, body) as a part. Which of them become documents, and their ids, is decided on rows
        without their texts; a text is moved once, to its id."""
        at = f"{path.rstrip('/')}/version-{version:06d}/part-{part}"
        remove(spark, at)
        keys = signals.unique_documents(rows.drop("body"), "canonical", "crawl_date", "seen")
        if old is not None:
            keys = keys.join(old.table("directory").select("canonical"), "canonical", "left_anti")
        keys = keys.withColumn("host", F.coalesce(urls.host(F.col("canonical")), F.lower("host"), F.lit("")))
        keys = numbered(keys.select("seen", "url", "canonical", "host"), "host", "url", name="doc_id").withColumn("doc_id", F.col("doc_id") + base)
        keys = cut(keys.withColumn("domain", urls.domain_of(F.col("host"))))
        keys.where("canonical is not null").select("canonical", "doc_id").write.parquet(f"{at}/directory")
        link_rows(rows, keys).write.parquet(f"{at}/links")
        links, own = spark.read.parquet(f"{at}/links"), spark.read.parquet(f"{at}/directory")
        links = links.unionByName(old.table("links")) if old is not None else links
        anchors = links.where("phrase <> ''").join(own, links["target"] == own["canonical"]).select(F.col("doc_id").alias("target"), "phrase", "domain")
        anchors = anchors.join(keys.select(F.col("doc_id").alias("target"), F.col("domain").alias("own_domain")), "target")
        field = signals.anchor_field(anchors).withColumnRenamed("target", "doc_id")
        keys = keys.join(field, "doc_id", "left").select("seen", "doc_id", "host", "domain", F.coalesce("anchor", F.lit("")).alias("anchor"))
        docs = rows.drop("host").join(keys, "seen")
        docs.select("doc_id", F.floor(F.col("doc_id") / shard).alias("shard_id"), "url", "canonical", "host", "domain", "crawl_date", T.title(F.col("body")).alias("title"), "body", "anchor").write.parquet(f"{at}/docs")
        docs = spark.read.parquet(f"{at}/docs")
        index.postings(docs).repartition("term").sortWithinPartitions("term", "doc_id").write.parquet(f"{at}/postings")
        held = spark.read.parquet(f"{at}/postings").withColumn("shard_id", F.floor(F.col("doc_id") / shard))
        # a word that only a title has is the start of one, which the title's end cut
        held.where("tf_body + tf_url + tf_anchor > 0").select("term", "shard_id").distinct().write.parquet(f"{at}/routing")
        # a document's length is the sum of its postings' counts
        sums = held.groupBy("shard_id").agg(*[F.sum(f"tf_{f}").alias(f"len_{f}") for f in index.FIELDS])
        sizes = docs.groupBy("shard_id").agg(F.min("doc_id").alias("base"), F.count("*").alias("n"))
        sizes.join(sums, "shard_id", "left").na.fill(0).withColumn("analyzer", F.lit(ANALYZER)).withColumn("shard", F.lit(shard)).write.parquet(f"{at}/shards")
        fs, mark = cls._fs_of(spark, f"{at}/_DONE")
        fs.create(mark).close()
        return cls(spark, path)

    @staticmethod
    def _fs_of(spark, path):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    def shards(self) -> DataFrame:
        """(shard_id, base, n, len_<field>) in the order of base; a shard that a later crawl went on with is one."""
        s = self.table("shards")
        sums = [F.sum(f"len_{f}").alias(f"len_{f}") for f in index.FIELDS]
        return s.groupBy("shard_id").agg(F.min("base").alias("base"), F.sum("n").alias("n"), *sums).orderBy("base")

    def locate(self, ids: DataFrame) -> DataFrame:
        """(doc_id, shard_id, row): the shard of each id (doc_id) by its base, and the row there; ids beyond all shards are left out.

        A shard's ids are a range, so an id's shard is the one whose number it divides into; the join checks that the shard has the row.
        """
        at = ids.select("doc_id", F.floor(F.col("doc_id") / self._shard_size()).alias("shard_id"))
        return at.join(self.shards(), "shard_id").where((F.col("doc_id") >= F.col("base")) & (F.col("doc_id") < F.col("base") + F.col("n"))).select("doc_id", "shard_id", (F.col("doc_id") - F.col("base")).alias("row"))

    def summary(self) -> DataFrame:
        """One row: the numbers of documents, of distinct hosts and of shards."""
        d = self.table("docs")
        return d.agg(F.count("*").alias("documents"), F.countDistinct("host").alias("hosts"), F.countDistinct("shard_id").alias("shards"))

    def next_base(self) -> int:
        """The id of the next document."""
        return self.table("shards").agg(F.coalesce(F.max(F.col("base") + F.col("n")), F.lit(0))).first()[0]

    def statistics(self) -> DataFrame:
        """One row: n_docs, token_count, avg_doc_len and avg_<field>, from the shards' sums. Parts made by another analyzer are an error."""
        s = self.table("shards")
        n, both = F.sum("n"), F.sum(F.col("len_title") + F.col("len_body"))
        safe = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
        same = F.when(F.max((F.col("analyzer") != ANALYZER).cast("int")) == 1, F.raise_error(F.lit("made by another analyzer")).cast("long"))
        return s.agg(F.coalesce(same, n, F.lit(0)).cast("long").alias("n_docs"), F.coalesce(both, F.lit(0)).cast("long").alias("token_count"), safe(both).alias("avg_doc_len"), *[safe(F.sum(f"len_{f}")).alias(f"avg_{f}") for f in index.FIELDS])

    def routes(self, terms: DataFrame) -> DataFrame:
        """(query_id, shard_id, terms): shards whose documents have any of the terms (query_id, term); a query whose term is null, which has none, asks all."""
        has = terms.where("term is not null").join(self.table("routing").distinct(), "term").groupBy("query_id", "shard_id").agg(F.count("*").alias("terms"))
        none = terms.groupBy("query_id").agg(F.count("term").alias("k")).where("k = 0").select("query_id")
        return has.unionByName(none.crossJoin(F.broadcast(self.shards().select("shard_id"))).withColumn("terms", F.lit(0).cast("long")))

    def edges(self) -> DataFrame:
        """(src, dst) of the links within the collection, whenever either document came."""
        return resolved(self.table("links"), self.table("directory"))

    def _shard_size(self) -> int:
        r = self.table("shards").agg(F.max("shard")).first()
        return r[0] or SHARD

    def add(self, crawl: DataFrame) -> Collection:
        """Adds a later crawl as one more part: addresses that are held are dropped, ids go on. Folds all parts when they are due."""
        new = self._write(self.spark, prepared(crawl), self.root, self.version, self.parts, self.next_base(), self._shard_size(), self)
        return new.compact() if due(new.table("shards").select("shard_id").distinct().count(), new.parts) else new

    def compact(self) -> Collection:
        """A new version with all documents in order and all anchors anew; the old one stays until reclaim()."""
        rows = self.table("docs").select(F.col("doc_id").alias("seen"), "url", "canonical", "host", "crawl_date", "body")
        return self._write(self.spark, rows, self.root, self.version + 1, 0, 0, self._shard_size(), None)

    def reclaim(self) -> int:
        """Deletes the versions before this one, which nobody may read any more; returns their number."""
        old = [v for v in self.versions() if v < self.version]
        for v in old:
            remove(self.spark, f"{self.root}/version-{v:06d}")
        return len(old)

    def moved(self, path: str) -> Collection:
        """The collection at another path."""
        rename(self.spark, self.root, path)
        return Collection(self.spark, path)

    def inspect(self) -> DataFrame:
        """(name, rows, bytes, bytes_per_doc, ceiling, within): what each table takes."""
        n, out = self.table("shards").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], []
        for name in TABLES:
            size = 0
            for k in range(self.parts):
                fs, at = self._fs(f"{self.path}/part-{k}/{name}")
                size += fs.getContentSummary(at).getLength()
            each = size / n if n else 0.0
            out.append((name, self.table(name).count(), size, each, CEILING.get(name), each <= CEILING[name] if name in CEILING else None))
        return self.spark.createDataFrame(out, "name string, rows long, bytes long, bytes_per_doc double, ceiling long, within boolean")

    def engine(self, **options):
        from .engine import Engine

        return Engine(self.table("docs"), postings=self.table("postings"), statistics=self.statistics(), **options)


def scratch(spark: SparkSession, crawl: DataFrame, **options) -> Collection:
    """A collection in a fresh folder."""
    return Collection.build(spark, crawl, fresh_path(spark, "collection"), **options)
