"""Pivots, histograms, shares and other shapes that reports and charts show."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import dealt

#: Groups of a level-of-detail field that go to all tasks; more are joined by their keys.
FEW_GROUPS = 10_000
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def number(column: str) -> Column:
    return F.expr(f"try_cast(`{column}` as double)")


def pivot(df: DataFrame, row: str, col: str, value: str | None, how: str) -> DataFrame:
    """(row_key, col_key, cell) in long form with row, column and grand totals (null keys), one job.

    Keys are text, null as ''; values that are no number are ignored but their cell exists.
    """
    keyed = df.select(F.coalesce(F.col(row).cast("string"), F.lit("")).alias("row_key"), F.coalesce(F.col(col).cast("string"), F.lit("")).alias("col_key"), (number(value) if value else F.lit(1.0)).alias("v"))
    made = F.count(F.lit(1)).cast("double") if how == "count" else AGGREGATES[how]("v")
    return keyed.cube("row_key", "col_key").agg(made.alias("cell"), F.grouping_id().cast("int").alias("level"))


def pivot_wide(df: DataFrame, row: str, col: str, value: str, how: str, keys: list) -> DataFrame:
    """A column for each of the stated keys; stating them saves a job."""
    return df.groupBy(row).pivot(col, keys).agg(AGGREGATES[how](number(value)))


def histogram(df: DataFrame, value: Column, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, the last one closed; equal values give one bin; empty bins are rows."""
    v = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo is not null")
    ends = ends.select("lo", "hi", F.when(F.col("hi") > F.col("lo"), bins).otherwise(1).alias("bins"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.when((F.col("v") >= F.col("hi")), F.col("bins") - 1).otherwise(F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0)))))
    counted = v.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def is_numeric_text(df: DataFrame, column: str, share: float = 0.8) -> DataFrame:
    """Whether at least that share of the non-empty values parse as numbers."""
    filled = df.filter(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != ""))
    parsed = F.avg(number(column).isNotNull().cast("double"))
    return filled.agg(F.coalesce(parsed >= share, F.lit(False)).alias("numeric"), F.coalesce(parsed, F.lit(0.0)).alias("share"))


def category_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """(category, n) of the most frequent values, the sum of all others as '(other)' and of nulls and '' as '(null)'."""
    text = F.nullif(F.col(column).cast("string"), F.lit(""))
    counted = df.groupBy(text.alias("category")).agg(F.count("*").alias("n"))
    head = counted.filter("category is not null").orderBy(F.desc("n"), "category").limit(top).select("category", F.lit(True).alias("shown"))
    marked = counted.join(F.broadcast(head), "category", "left")  # ``top`` rows
    label = F.when(F.col("category").isNull(), "(null)").when(F.col("shown"), F.col("category")).otherwise("(other)")
    return marked.groupBy(label.alias("category")).agg(F.sum("n").alias("n"))


def pie_slices(df: DataFrame, label: str, value: str, top: int = 11) -> DataFrame:
    """Positive values summed by label: the largest ``top`` and, beyond one more, 'Other'."""
    summed = df.filter(number(value) > 0).groupBy(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).agg(F.sum(number(value)).alias("total"))
    # The window runs over two rows more than are shown at most, which tell whether there is a rest.
    head = summed.orderBy(F.desc("total"), "label").limit(top + 2)
    place = Window.partitionBy(F.lit(0))
    head = head.select("label", F.row_number().over(place.orderBy(F.desc("total"), "label")).alias("rank"), F.count("*").over(place).alias("of"))
    head = head.filter((F.col("of") <= top + 1) | (F.col("rank") <= top)).select("label", F.lit(True).alias("shown"))
    marked = summed.join(F.broadcast(head), "label", "left")
    return marked.groupBy(F.when(F.col("shown"), F.col("label")).otherwise("Other").alias("label")).agg(F.sum("total").alias("total"))


def funnel_rates(steps: DataFrame, position: str, count: str) -> DataFrame:
    """Share of the first step and loss against the step before."""
    order = Window.orderBy(position)
    first, before = F.first(count).over(order), F.lag(count).over(order)
    return steps.withColumn("share_of_first", F.try_divide(F.col(count) * 100.0, first)).withColumn("drop_from_previous", F.try_divide((before - F.col(count)) * 100.0, before))


def lod(df: DataFrame, alias: str, how: str, value: str, by: list[str]) -> DataFrame:
    """A level-of-detail field: an aggregate over the whole partition beside every row.

    The groups are aggregated and joined, so that a group of any size is in no task as a whole.
    """
    keys = [f"__key_{i}" for i in range(len(by))]
    groups = lambda rows, *more: rows.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], *more).agg(AGGREGATES[how](value).alias(alias))
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)])
    about = df.agg(F.approx_count_distinct(F.xxhash64(*[F.col(f"`{c}`") for c in by]))).first()[0]  # only chooses the way
    if about <= FEW_GROUPS:
        return df.join(F.broadcast(groups(df)), same).drop(*keys)
    marked = df.withColumn("__hash", F.xxhash64(*[F.col(f"`{c}`") for c in by]))
    held = groups(dealt(marked, rows := df.count(), "__hash"), F.col("__hash").alias("__of"))
    return dealt(marked, rows, "__hash").join(held.hint("merge"), (F.col("__hash") == F.col("__of")) & same).drop(*keys, "__hash", "__of")


def summarize(df: DataFrame, value: str) -> DataFrame:
    """Sum, mean and count of the finite values, for a tile."""
    v = number(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return df.agg(F.sum(finite).alias("total"), F.avg(finite).alias("average"), F.count(finite).alias("n"))
