"""What to chart: columns, key order, facets, tiles, and the actions that a column's type calls for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shape import number

#: Types that are summed, grouped by, or counted over time or once each.
SUMMED = ("amount", "quantity", "percentage", "duration_ms")
GROUPED = ("log_level", "event_name", "http_status", "currency_iso", "country_name", "vendor_name")
DATED = ("iso_date", "iso_datetime")
COUNTED_ONCE = ("user_id", "uuid")


def numeric_columns(df: DataFrame, share: float = 0.8) -> list[str]:
    """Columns of which at least that share of the non-null values are numbers, in order; one aggregate over the whole table."""
    row = df.agg(*[F.avg(F.when(F.col(f"`{c}`").isNotNull(), number(c).isNotNull().cast("double"))).alias(f"c{i}") for i, c in enumerate(df.columns)]).first() if df.columns else ()
    return [c for c, part in zip(df.columns, row, strict=True) if part is not None and part >= share]


def chart_columns(df: DataFrame, share: float = 0.8) -> tuple[str, str] | None:
    """(category, value): the first column that is no number and the last that is; None if either is missing."""
    numeric = numeric_columns(df, share)
    other = [c for c in df.columns if c not in numeric]
    return (other[0], numeric[-1]) if numeric and other else None


def ordered_keys(df: DataFrame, column: str) -> DataFrame:
    """(key, number) of the distinct keys as a pivot shows them: by number if all are finite numbers (else number is null), then by text."""
    keys = df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("key")).distinct()
    v = number("key")
    finite = F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    every = keys.agg(F.coalesce(F.bool_and(finite), F.lit(False)).alias("all_numbers"))
    return keys.crossJoin(F.broadcast(every)).select("key", F.when(F.col("all_numbers"), v).alias("number")).orderBy("number", "key")  # one row beside each


def facets(df: DataFrame, partition: str, value: str, top: int = 9) -> DataFrame:
    """(facet, total) of the partitions with the largest sums of positive values: a top-k report."""
    summed = df.filter(number(value) > 0).groupBy(F.coalesce(F.col(partition).cast("string"), F.lit("")).alias("facet")).agg(F.sum(number(value)).alias("total"))
    return summed.orderBy(F.desc("total"), "facet").limit(top)


def kpi(df: DataFrame, column: str) -> DataFrame:
    """One row for a tile: total (0 without numbers) and average of the numbers, and the count of all rows."""
    v = number(column)
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return df.agg(F.coalesce(F.sum(finite), F.lit(0.0)).alias("total"), F.avg(finite).alias("average"), F.count(F.lit(1)).alias("count"))


def kpi_measures(name: str, column: str) -> dict[str, str]:
    """The same three as named measures for ``macros``; the name becomes a plain identifier of 48 signs at most."""
    stem = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
    stem = (f"_{stem}" if stem[:1].isdigit() else stem)[:48].rstrip("_") or "result"
    quoted = "`" + column.replace("`", "``") + "`"
    return {f"{stem}_total": f"sum({quoted})", f"{stem}_average": f"avg({quoted})", f"{stem}_count": "count(*)"}


def sum_by(df: DataFrame, column: str, by: str, top: int = 20) -> DataFrame:
    out = df.groupBy(F.col(by).alias("category")).agg(F.sum(column).alias("total"), F.count(F.lit(1)).alias("rows"))
    return out.orderBy(F.desc_nulls_last("total"), "category").limit(top)


def count_by(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(top)


def rate_by(df: DataFrame, flag: str, by: str) -> DataFrame:
    """Mean of a 0/1 outcome for each category."""
    return df.groupBy(F.col(by).alias("category")).agg(F.round(F.avg(F.col(flag).cast("double")), 3).alias("rate"), F.count(F.lit(1)).alias("n"))


def per_day(df: DataFrame, column: str) -> DataFrame:
    day = F.date_trunc("day", F.col(column)).cast("timestamp_ntz")
    return df.filter(F.col(column).isNotNull()).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(f"unique_{column}"))


def prefix_totals(df: DataFrame, column: str, amount: str, signs: int = 2) -> DataFrame:
    """Totals by the first signs of a code, as of tax numbers that begin with the state."""
    return df.groupBy(F.substring(column, 1, signs).alias("prefix")).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"))


def quick_actions(types: dict[str, str | None], column: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """What one column of a classified table offers: action id -> function of the table."""
    kind, out = types.get(column), {}
    partner = next((c for c, t in types.items() if c != column and t in GROUPED), None)
    if kind in SUMMED:
        if partner:
            out[f"sum_{column}_by_{partner}"] = lambda df: sum_by(df, column, partner)
        out[f"distribution_{column}"] = lambda df: df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    if kind in GROUPED:
        out[f"count_by_{column}"] = lambda df: count_by(df, column)
    if kind == "outcome_flag" and partner:
        out[f"rate_{column}_by_{partner}"] = lambda df: rate_by(df, column, partner)
    if kind in DATED:
        out[f"per_day_{column}"] = lambda df: per_day(df, column)
    if kind in COUNTED_ONCE:
        out[f"unique_{column}"] = lambda df: unique(df, column)
    amount = next((c for c, t in types.items() if t == "amount"), None)
    if kind == "gstin" and amount:
        out[f"totals_by_state_of_{column}"] = lambda df: prefix_totals(df, column, amount)
    return out
