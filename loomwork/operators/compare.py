"""Comparison of two tables on a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(a: DataFrame, b: DataFrame, key: str, how: str) -> tuple[DataFrame, list[str]]:
    common = [c for c in a.columns if c in b.columns and c != key]
    left = a.select(F.col(key).alias("key_a"), *[F.col(c).alias(f"a_{i}") for i, c in enumerate(common)])
    right = b.select(F.col(key).alias("key_b"), *[F.col(c).alias(f"b_{i}") for i, c in enumerate(common)])
    return left.join(right, F.col("key_a") == F.col("key_b"), how), common


def _differs(i: int) -> Column:
    return ~F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}"))


def buckets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """only_a, only_b, matched, differing in one row; a row with a null key counts in both 'only' buckets, as keys never match it."""
    both, common = _joined(a, b, key, "full_outer")
    n_diffs = sum((_differs(i).cast("int") for i in range(len(common))), F.lit(0))
    hit = F.col("key_a").isNotNull() & F.col("key_b").isNotNull()
    return both.agg(
        F.count_if(F.col("key_b").isNull()).alias("only_a"), F.count_if(F.col("key_a").isNull()).alias("only_b"),
        F.count_if(hit).alias("matched"), F.count_if(hit & (n_diffs > 0)).alias("differing"),
    )


def differing_rows(a: DataFrame, b: DataFrame, key: str, limit: int | None = 25) -> DataFrame:
    """(key, column_name, a_value, b_value) of matched rows that differ; the first ``limit`` keys (a preview) or all."""
    both, common = _joined(a, b, key, "inner")
    diffs = F.array(*[F.when(_differs(i), F.struct(F.lit(c).alias("column_name"), F.col(f"a_{i}").cast("string").alias("a_value"), F.col(f"b_{i}").cast("string").alias("b_value"))) for i, c in enumerate(common)])
    rows = both.select(F.col("key_a").alias("key"), F.filter(diffs, lambda d: d.isNotNull()).alias("diffs")).filter(F.size("diffs") > 0)
    if limit is not None:
        rows = rows.orderBy("key").limit(limit)
    return rows.select("key", F.explode("diffs").alias("d")).select("key", "d.*")
