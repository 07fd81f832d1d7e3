"""Total orders without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """rows with their place in the order, from 0. Ranges of the order are sorted each by its own task, then offset by the sizes of the
    ranges before, of which there is one number for each task: rows are moved once."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    # the upper bits are the task's number, the lower ones a row's place there
    part = F.shiftright("__at", 33)
    sizes = sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, rows_before = {}, 0
    for r in sizes:
        before[r["part"]], rows_before = rows_before, rows_before + r["n"]
    table = ranged.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")
    return ranged.withColumn("__part", part).join(F.broadcast(table), "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")
