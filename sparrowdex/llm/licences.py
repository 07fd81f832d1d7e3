"""Licence scans by diagonal voting.

Every document's words give rolling hashes of K words; all of them meet the template positions in a Spark join. Matches of one template
vote for their diagonal (position in the document less position in the template), neighbouring diagonals are merged, which bridges inserted
or missing words, and a merged span is verified: the share of the template's words that its matches cover, and the share of the span's words
that are covered. Of overlapping spans the best covered stays.

The library of templates has a fixed size and is broadcast; a larger one than BROADCAST_GRAMS is joined by shuffle.

Cases: null and empty texts, and texts of fewer than K words, match nothing, as do templates of fewer; rows with a null doc_id are ignored; repeated rows count
once each if their texts differ, and as one if not; ties between templates go to the first by name; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import bounded_batches, checkpointed, chunks, ragged, released, rolled, utf8, words

K = 3
#: Diagonals at most this far apart are merged.
GAP = 3
#: Least share of a template's words, and of a span's words, that matches cover.
COVERED, DENSE = 0.75, 0.6
BROADCAST_GRAMS = 500_000

#: Notices by name; words only matter.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-3-clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column(1))
        for a, b in chunks(np.diff(off), 1 << 21):
            hashed, row, _, _ = words(data[off[a] : off[b]], off[a : b + 1] - off[a])
            gram, at = rolled(hashed, row, K)
            count = np.bincount(row[at], minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ragged(gram.view(np.int64), count, pa.int64())], ["doc_id", "grams"])


def template_grams(templates: dict[str, str]) -> list[tuple[int, str, int, int]]:
    """(hash, template, position, words of the template) of all templates."""
    out = []
    for name, text in sorted(templates.items()):
        hashed, row, _, _ = words(*utf8(pa.array([text])))
        gram, at = rolled(hashed, row, K)
        out += [(g, name, p, len(hashed)) for g, p in zip(gram.view(np.int64).tolist(), at.tolist(), strict=True)]
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, template, first_word, last_word, votes, covered) of the verified spans."""
    spark = docs.sparkSession
    bounded_batches(spark)
    grams = template_grams(templates)
    library = spark.createDataFrame(grams, "gram long, template string, place int, size int")
    library = F.broadcast(library) if len(grams) <= BROADCAST_GRAMS else library
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id is not null")
    rows = rows.mapInArrow(released(_grams), "doc_id long, grams array<long>").select("doc_id", F.posexplode("grams").alias("at", "gram"))
    votes = rows.join(library, "gram").select("doc_id", "template", "size", "at", "place", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    lines = votes.groupBy("doc_id", "template", "size", "diagonal").agg(F.collect_list(F.struct("at", "place")).alias("hits"))
    by_diagonal = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > GAP, F.lit(True))
    lines = lines.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(by_diagonal))
    merged = lines.groupBy("doc_id", "template", "size", "span").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    each = lambda name: F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h[name], h[name] + (K - 1)))))
    merged = merged.select("doc_id", "template", "size", F.size("hits").alias("votes"), each("at").alias("own"), F.size(each("place")).alias("theirs"))
    merged = merged.select("doc_id", "template", F.array_min("own").cast("long").alias("first_word"), F.array_max("own").cast("long").alias("last_word"), F.col("votes").cast("long").alias("votes"), F.round(F.col("theirs") / F.col("size"), 6).alias("covered"), F.size("own").alias("words"))
    # both sides of the anti-join below: cut, or all documents would be read for each
    good = checkpointed(merged.where((F.col("covered") >= COVERED) & (F.col("words") >= DENSE * (F.col("last_word") - F.col("first_word") + 1))))
    other = good.select(*[F.col(c).alias(f"o_{c}") for c in good.columns])
    better = (F.struct(F.col("o_covered"), F.col("o_votes")) > F.struct(F.col("covered"), F.col("votes"))) | ((F.col("o_covered") == F.col("covered")) & (F.col("o_votes") == F.col("votes")) & (F.struct("o_template", "o_first_word") < F.struct("template", "first_word")))
    beaten = (F.col("doc_id") == F.col("o_doc_id")) & (F.col("o_first_word") <= F.col("last_word")) & (F.col("first_word") <= F.col("o_last_word")) & better
    return good.join(other, beaten, "left_anti").drop("words")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TOKENS = r"regexp_extract_all(lower({}), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
OP10_SQL = f"""
WITH lib AS (SELECT template, {_TOKENS.format("body")} AS w FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}) AS v(template, body)),
tg AS (SELECT template, len(w) AS size, p AS place, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram FROM lib, LATERAL (SELECT unnest(range(len(w) - {K - 1})) AS p)),
dw AS (SELECT doc_id, {_TOKENS.format("text")} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
dg AS (SELECT doc_id, p AS pos, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram FROM dw, LATERAL (SELECT unnest(range(len(w) - {K - 1})) AS p)),
votes AS (SELECT DISTINCT doc_id, template, size, pos, place, pos - place AS diagonal FROM dg JOIN tg USING (gram)),
ds AS (SELECT DISTINCT doc_id, template, diagonal FROM votes),
df AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP}, true) THEN 1 ELSE 0 END AS far FROM ds),
sp AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM df),
vs AS (SELECT v.*, span FROM votes v JOIN sp USING (doc_id, template, diagonal)),
own AS (SELECT doc_id, template, span, min(x) AS first_word, max(x) AS last_word, count(DISTINCT x) AS words FROM (SELECT doc_id, template, span, pos + k AS x FROM vs, (VALUES (0), (1), (2)) AS s(k)) GROUP BY ALL),
theirs AS (SELECT doc_id, template, span, count(DISTINCT place + k) AS n FROM vs, (VALUES (0), (1), (2)) AS s(k) GROUP BY ALL),
cnt AS (SELECT doc_id, template, span, size, count(*) AS votes FROM vs GROUP BY ALL),
good AS (SELECT doc_id, template, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, CAST(votes AS BIGINT) AS votes, round(n / size, 6) AS covered
  FROM cnt JOIN own USING (doc_id, template, span) JOIN theirs USING (doc_id, template, span) WHERE round(n / size, 6) >= {COVERED} AND words >= {DENSE} * (last_word - first_word + 1))
SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM good o WHERE o.doc_id = g.doc_id AND o.first_word <= g.last_word AND g.first_word <= o.last_word
  AND (o.covered > g.covered OR (o.covered = g.covered AND o.votes > g.votes) OR (o.covered = g.covered AND o.votes = g.votes AND (o.template < g.template OR (o.template = g.template AND o.first_word < g.first_word)))))
"""
