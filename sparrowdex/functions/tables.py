"""Functions that give tables, for SQL: tokens(text), outlinks(url, body) and anchors(url, body)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """Makes the functions known to spark.sql. They are made here, for a worker that imports this module needs none."""
    from . import urls, words

    @udtf(returnType="place int, term string")
    class Tokens:
        def eval(self, text: str):
            yield from enumerate(words.analyse(text or ""))

    @udtf(returnType="target string")
    class Outlinks:
        def eval(self, url: str, body: str):
            for target in urls.outlinks(url, body):
                yield (target,)

    @udtf(returnType="target string, label string")
    class Anchors:
        def eval(self, url: str, body: str):
            yield from urls.anchor_links(url, body)

    for name, f in (("tokens", Tokens), ("outlinks", Outlinks), ("anchors", Anchors)):
        spark.udtf.register(name, f)
