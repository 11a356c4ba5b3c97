"""Cleaning: projections that mend a column, and their measured effect on the whole table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what counts as missing.
MISSING = ("N/A", "NA", "NULL", "NONE", "NIL", "-", "--", "?", "")
#: Delimiters in the order in which they are tried, the more specific ones first.
DELIMITERS = (", ", " | ", " - ", ";", ",", "|", "\t", "/", "-", "_", " ")


def trim(c: Column) -> Column:
    return F.trim(c)


def missing_to_null(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).isin(*MISSING), None).otherwise(c)


def fold_case(c: Column, how: str = "lower") -> Column:
    return {"lower": F.lower, "upper": F.upper, "title": F.initcap}[how](c)


def fill_null(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def embedded_number(c: Column) -> Column:
    """The only number in a text, or null."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    return F.when(F.regexp_count(c, F.lit(number)) == 1, F.regexp_extract(c, number, 1).try_cast("double"))


def split_column(df: DataFrame, column: str, delimiter: str, parts: int) -> DataFrame:
    """column_1 .. column_n; missing parts are ''."""
    return df.withColumns({f"{column}_{i}": F.split_part(F.col(column), F.lit(delimiter), F.lit(i)) for i in range(1, parts + 1)})


def choose_delimiter(df: DataFrame, column: str, share: float = 0.9) -> DataFrame:
    """(delimiter, parts, agreement): for each delimiter its most frequent part count above one, over the whole table, if ``share`` of rows agree."""
    text = F.col(column).cast("string")
    sizes = df.filter(text.isNotNull()).select(F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(d).alias("delimiter"), F.size(F.split(text, re.escape(d))).alias("parts")) for i, d in enumerate(DELIMITERS)])).alias("r")).select("r.*")
    counted = sizes.groupBy("nth", "delimiter", "parts").agg(F.count("*").alias("n"))
    best = counted.groupBy("nth", "delimiter").agg(F.max_by("parts", F.struct("n", "parts")).alias("parts"), F.max("n").alias("most"), F.sum("n").alias("of"))
    return best.filter("parts > 1").select("nth", "delimiter", "parts", (F.col("most") / F.col("of")).alias("agreement")).filter(F.col("agreement") >= share).orderBy("nth").drop("nth").limit(1)


def merge_columns(df: DataFrame, first: str, second: str, into: str) -> DataFrame:
    """The first column's value or else the second's, and whether both are given and differ."""
    a, b = F.col(first), F.col(second)
    return df.withColumns({into: F.coalesce(a, b), f"{into}_collision": F.coalesce(a != b, F.lit(False))})


def unpivot_years(df: DataFrame, stem: str, keep: list[str], value: str = "value") -> DataFrame:
    """Columns ``stem_2023`` and the like as rows (year, value); nulls give no row."""
    years = {c: int(m[1]) for c in df.columns if (m := re.fullmatch(rf"{re.escape(stem)}_?((?:19|20)\d\d)", c))}
    structs = [F.struct(F.lit(y).alias("year"), F.col(c).alias(value)) for c, y in sorted(years.items(), key=lambda x: x[1])]
    structs = structs or [F.struct(F.lit(0).alias("year"), F.lit(None).cast("double").alias(value))]  # no such column: no rows
    return df.select(*keep, F.explode(F.array(*structs)).alias("r")).select(*keep, "r.*").filter(F.col(value).isNotNull())


def drop_null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def impact(df: DataFrame, columns: list[str], floor: float = 0.01) -> DataFrame:
    """(column_name, fix, rows, share) of every fix that would change ``floor`` of the rows or more: one scan for all columns and fixes."""
    fixes: list[tuple[str, str, Column]] = []
    for c in columns:
        v = F.col(f"`{c}`").cast("string")
        fixes += [
            (c, "trim", v.isNotNull() & (F.regexp_replace(v, r"^\s+|\s+$", "") != v)),
            (c, "missing", F.upper(F.trim(v)).isin(*MISSING)),
            (c, "null", v.isNull()),
            (c, "lower", v.isNotNull() & (F.lower(v) != v)),
        ]
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(x).alias(f"f{i}") for i, (_, _, x) in enumerate(fixes)])
    rows = one.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(n).alias("fix"), F.col(f"f{i}").alias("rows")) for i, (c, n, _) in enumerate(fixes)])).alias("r"))
    return rows.select("r.*", F.try_divide("r.rows", "total").alias("share")).filter(F.col("share") >= floor)
