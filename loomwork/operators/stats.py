"""Column statistics: every statistic of a table in one scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.staging import stage

#: Counted values that a range of ``percentiles`` holds.
RANGE_ROWS = 500_000


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _long_form(one_row: DataFrame, rows: list[list], names: list[str]) -> DataFrame:
    """A one-row aggregate as one row for each entry of ``rows`` (lists of columns in the order of ``names``)."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names, strict=True)]) for row in rows]
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def percentiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact percentiles (between two values by their distance) of expressions of type double, a few numbers for each.

    Values are counted and dealt by range; sums per range tell which range holds a wanted place, and only the
    counts of such ranges are added up one by one.  No task holds all values of a column, as ``percentile`` would.
    """
    if not columns:
        return {}
    names = list(columns)
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), columns[n].cast("double").alias("v")) for i, n in enumerate(names)])
    counts = df.select(F.explode(pairs).alias("r")).select("r.*").filter("v is not null")
    counts = stage(counts.groupBy("c", "v").agg(F.count("*").alias("n")), "counts")
    ranges = stage(counts.repartitionByRange(max(1, -(-counts.count() // RANGE_ROWS)), "c", "v").withColumn("part", F.spark_partition_id()), "ranges")
    sums: dict[int, list] = {i: [] for i in range(len(names))}
    for r in ranges.groupBy("c", "part").agg(F.sum("n").alias("n")).collect():
        sums[r.c].append((r.part, r.n))
    asked: dict[tuple[int, int], int] = {}  # (column, range): rows of the column before it
    places: dict[int, list[tuple[int, int, float]]] = {}
    for c, parts in sums.items():
        total, before = sum(n for _, n in parts), 0
        at = [(total - 1) * q for q in shares] if total else []
        places[c] = [(math.floor(x), math.ceil(x), x) for x in at]
        wanted = {k for low, high, _ in places[c] for k in (low, high)}
        for part, n in sorted(parts):
            if any(before <= k < before + n for k in wanted):
                asked[c, part] = before
            before += n
    if not asked:
        return {n: [None] * len(shares) for n in names}
    spark = df.sparkSession
    held = ranges.join(F.broadcast(spark.createDataFrame([(*k, n) for k, n in asked.items()], "c int, part int, before long")), ["c", "part"])  # two ranges a share at most
    upto = held.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = [(c, k) for c, some in places.items() for k in sorted({k for low, high, _ in some for k in (low, high)})]
    wanted = F.broadcast(spark.createDataFrame(wanted, "c int, place long"))
    found = upto.join(wanted, "c").filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    value = {(r.c, r.place): r.v for r in found.select("c", "place", "v").collect()}
    out = {}
    for c, name in enumerate(names):
        out[name] = [value[c, low] if low == high else (high - x) * value[c, low] + (x - low) * value[c, high] for low, high, x in places[c]] or [None] * len(shares)
    return out


def descriptives(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, nulls and distinct of every column; min, max, mean, stddev and median of numeric ones; a row for each column."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"c{i}_count"), F.count_if(v.isNull()).alias(f"c{i}_nulls")]
        if is_numeric(df, c):
            d = v.cast("double")
            aggs += [F.min(d).alias(f"c{i}_min"), F.max(d).alias(f"c{i}_max"), F.avg(d).alias(f"c{i}_mean"), F.stddev(d).alias(f"c{i}_stddev")]
    middle = percentiles(df, {c: F.col(f"`{c}`").cast("double") for c in columns if is_numeric(df, c)}, [0.5])
    rows = []
    for i, c in enumerate(columns):
        own = [F.lit(c), *(F.col(f"c{i}_{x}") for x in ("count", "nulls"))]
        stats = [_finite(F.col(f"c{i}_{x}")) if is_numeric(df, c) else F.lit(None).cast("double") for x in ("min", "max", "mean", "stddev")]
        stats.append(_finite(F.lit(middle.get(c, [None])[0]).cast("double")))
        rows.append(own + stats)
    facts = _long_form(df.agg(*aggs), rows, ["column_name", "n", "nulls", "min", "max", "mean", "stddev", "median"])
    out = facts.join(distinct_counts(df, columns), "column_name", "left")
    return out.select("column_name", "n", "nulls", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "min", "max", "mean", "stddev", "median")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct) of all columns: one pass of (column, value) rows, combined before they are dealt out.

    Many distinct counts in one aggregate would multiply every row by their number and carry all other state along.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    kinds = df.select(F.explode(pairs).alias("r")).select("r.*").filter("value is not null").distinct()
    return kinds.groupBy("column_name").agg(F.count("*").alias("n_distinct"))


def _finite(c):
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def _corr(a, b):
    """Pearson correlation over rows where both are given; null if either is constant (``corr`` itself fails then under ANSI)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b)))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair (upper triangle with diagonal), one scan; undefined ones are null."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(*[_corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"corr__{i}__{j}") for i, j in pairs])
    return _long_form(one, [[F.lit(columns[i]), F.lit(columns[j]), _finite(F.col(f"corr__{i}__{j}"))] for i, j in pairs], ["a", "b", "corr"])


def correlation_graph(df: DataFrame, columns: list[str], least: float = 0.5, most_columns: int = 60) -> DataFrame:
    """Edges between columns of absolute correlation ``least`` or more, strongest first."""
    kept = list(dict.fromkeys(columns))[:most_columns]
    edges = correlation_matrix(df, kept).filter((F.col("a") != F.col("b")) & (F.abs("corr") >= least))
    return edges.orderBy(F.desc(F.abs("corr")), "a", "b")


def column_profile(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """Per column: total, nulls, distinct, text lengths, and the most frequent values; two scans for all columns."""
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(columns):
        n = F.length(text[c])
        aggs += [F.count_if(text[c].isNull()).alias(f"n{i}"), F.min(n).alias(f"l{i}"), F.max(n).alias(f"h{i}"), F.avg(n).alias(f"a{i}")]
    rows = [[F.lit(c), F.col("total"), F.col(f"n{i}"), F.col(f"l{i}").cast("long"), F.col(f"h{i}").cast("long"), F.col(f"a{i}")] for i, c in enumerate(columns)]
    facts = _long_form(df.agg(*aggs), rows, ["column_name", "total", "nulls", "min_length", "max_length", "avg_length"])
    facts = facts.join(distinct_counts(df, columns), "column_name", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    counted = top_values(df, columns, top)
    lists = counted.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), " | ").alias("top_values"))
    return facts.join(lists, "column_name", "left")


def top_values(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """(column_name, value, n, rank) of the most frequent values of each column; ties by value."""
    from pyspark.sql import Window

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("r")).select("r.*")
    counted = long.filter("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("rank") <= top)


def numeric_profile(df: DataFrame, columns: list[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, range and count of outliers by the interquartile rule, for all columns with any numeric value."""
    number = {c: F.expr(f"try_cast(`{c}` as double)") for c in columns}
    quarters = percentiles(df, number, [0.25, 0.5, 0.75])
    held = df.select(*[number[c].alias(f"v{i}") for i, c in enumerate(columns)], *[F.array(*[F.lit(x).cast("double") for x in quarters[c]]).alias(f"q{i}") for i, c in enumerate(columns)])
    aggs = []
    for i in range(len(columns)):
        v, q = F.col(f"v{i}"), F.col(f"q{i}")
        span = (q[2] - q[0]) * reach
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.count_if((v < q[0] - span) | (v > q[2] + span)).alias(f"o{i}"), F.first(q).alias(f"q{i}")]
    rows = [[F.lit(c), F.col(f"n{i}"), F.col(f"lo{i}"), F.col(f"q{i}")[0], F.col(f"q{i}")[1], F.col(f"q{i}")[2], F.col(f"hi{i}"), F.col(f"o{i}")] for i, c in enumerate(columns)]
    return _long_form(held.agg(*aggs), rows, ["column_name", "n", "min", "q1", "median", "q3", "max", "outliers"]).filter("n > 0")


def agent_stats(df: DataFrame, sensitivity: dict[str, str]) -> DataFrame:
    """Null share (3 digits) and distinct count of every column; min and max only of public columns."""
    aggs, rows = [], []
    for i, (c, level) in enumerate(sensitivity.items()):
        v = F.col(f"`{c}`")
        aggs += [F.round(F.avg(v.isNull().cast("double")), 3).alias(f"n{i}"), F.count_distinct(v).alias(f"d{i}"), F.min(v).cast("string").alias(f"lo{i}"), F.max(v).cast("string").alias(f"hi{i}")]
        shown = (lambda x: F.col(x)) if level == "public" else (lambda x: F.lit(None).cast("string"))
        rows.append([F.lit(c), F.col(f"n{i}"), F.col(f"d{i}"), shown(f"lo{i}"), shown(f"hi{i}")])
    return _long_form(df.agg(*aggs), rows, ["column_name", "null_share", "n_distinct", "min", "max"])
