"""Joins beyond Spark SQL's syntax."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before its time (null if none).

    Both sides become one table sorted by key and time; a running last non-null value
    carries the right row forward: one shuffle, no range join.
    """
    carried = F.struct(*values)
    a = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType).alias("__right"))
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), carried.alias("__right"))
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__right", ignorenulls=True).over(w))
    return both.filter("__side = 1").select("__left.*", "__last.*")


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")
