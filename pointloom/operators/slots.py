"""Numbering of rows without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slots(points: DataFrame, key, *within_: str) -> DataFrame:
    """Add slot: the 1-based place in the order of the text key, within groups if given.

    Rows are counted by the key's first three hexadecimal digits and numbered inside these
    buckets, so no task sorts a whole pattern. key must start with such digits, as md5 does.
    """
    taken = {c.lower() for c in points.columns}
    k, b, n, before, inner = (next(x for x in (f"{wish}{'_' * m}" for m in range(1, 99)) if x not in taken) for wish in ("key", "bucket", "n", "before", "inner"))
    keyed = points.withColumn(k, key).withColumn(b, F.substring(k, 1, 3))
    counts = keyed.groupBy(*within_, b).agg(F.count("*").alias(n))
    upto = Window.partitionBy(*within_).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*within_, b, F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(*within_, b).orderBy(k))
    numbered = keyed.withColumn(inner, place).join(counts, [*within_, b])
    return numbered.withColumn("slot", F.col(before) + F.col(inner)).drop(k, b, n, before, inner)
