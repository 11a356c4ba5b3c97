"""Report shapes: ageing, concentration, errors, percentiles, activity, funnels, paths, retention, conversion, briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def ageing(df: DataFrame, due: str, amount: str, as_of: str) -> DataFrame:
    """Open amounts by days past due: current, 1-30, 31-60, 61-90, 90+."""
    days = F.datediff(F.lit(as_of).cast("date"), F.col(due).cast("date"))
    bucket = F.when(days <= 0, "current").when(days <= 30, "1-30").when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise("90+")
    return df.groupBy(bucket.alias("bucket")).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def concentration(df: DataFrame, party: str, amount: Column, top: int = 20) -> DataFrame:
    """The largest parties by amount with their share of all of it."""
    per = df.groupBy(party).agg(F.sum(amount).alias("total"))
    whole = per.agg(F.sum("total").alias("whole"))
    return per.crossJoin(F.broadcast(whole)).withColumn("share", F.try_divide("total", "whole")).drop("whole").orderBy(F.desc_nulls_last("total"), party).limit(top)


def prefix_groups(df: DataFrame, code: str, amount: str, length: int = 2) -> DataFrame:
    return df.groupBy(F.substring(F.col(code).cast("string"), 1, length).alias("prefix")).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


def counts_by_time(df: DataFrame, time: str, unit: str, by: list[str] | None = None, distinct: str | None = None) -> DataFrame:
    """Rows, or distinct values of a column, per unit of time."""
    made = F.count_distinct(distinct) if distinct else F.count("*")
    return df.groupBy(ntz(F.date_trunc(unit, time)).alias("period"), *(by or [])).agg(made.alias("n"))


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.groupBy(by).agg(p.alias("p"), F.count("*").alias("n")).select(by, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "n")


def top_events(df: DataFrame, event: str, user: str, top: int = 20) -> DataFrame:
    return df.groupBy(event).agg(F.count("*").alias("n"), F.count_distinct(user).alias("users")).orderBy(F.desc("n"), event).limit(top)


def funnel(df: DataFrame, user: str, time: str, event: str, steps: list[str] | None = None) -> DataFrame:
    """(step, event, users): users who did the steps in order, each later than the one before.

    Without stated steps, the three most frequent events (ties by name).  Each step is
    the first time after the last one, found in an equi-join with a time residual.
    """
    if steps is None:
        ranked = df.groupBy(event).agg(F.count("*").alias("n")).orderBy(F.desc("n"), event).limit(3)
        steps = [r[0] for r in ranked.collect()]
    rows = df.select(F.col(user).alias("u"), F.col(time).alias("t"), F.col(event).alias("e"))
    reached, out = None, None
    for k, name in enumerate(steps, 1):
        own = rows.filter(F.col("e") == name).select("u", "t")
        if reached is not None:
            own = own.join(reached, "u").filter(F.col("t") > F.col("before"))
        reached = own.groupBy("u").agg(F.min("t").alias("before"))
        row = reached.agg(F.count("*").alias("users")).select(F.lit(k).alias("step"), F.lit(name).alias("event"), "users")
        out = row if out is None else out.unionByName(row)
    return out


def top_paths(df: DataFrame, user: str, time: str, event: str, tie: str, top: int = 25) -> DataFrame:
    """Most common first three events of a user."""
    w = Window.partitionBy(user).orderBy(time, tie)
    seq = df.select(F.row_number().over(w).alias("nth"), F.col(event).alias("e1"), F.lead(event, 1).over(w).alias("e2"), F.lead(event, 2).over(w).alias("e3"))
    full = seq.filter("nth = 1 and e2 is not null and e3 is not null")
    return full.groupBy(F.concat_ws(" > ", "e1", "e2", "e3").alias("path")).agg(F.count("*").alias("users")).orderBy(F.desc("users"), "path").limit(top)


def retention(df: DataFrame, user: str, time: str, weeks: int = 4) -> DataFrame:
    """(cohort, week_offset, users): weeks after a user's first week in which they came."""
    w = df.select(F.col(user).alias("u"), ntz(F.date_trunc("week", time)).alias("w")).distinct()
    first = w.groupBy("u").agg(F.min("w").alias("cohort"))
    offset = (F.datediff("w", "cohort") / 7).cast("int")
    return w.join(first, "u").select("cohort", offset.alias("week_offset"), "u").filter(F.col("week_offset").between(0, weeks)).groupBy("cohort", "week_offset").agg(F.count_distinct("u").alias("users"))


def conversion(df: DataFrame, user: str, source: Column, converted: Column, least: int = 5) -> DataFrame:
    """(source, users, converted, rate) of sources with at least ``least`` users."""
    seen = df.select(F.col(user).alias("u"), source.alias("source")).filter("source is not null").distinct()
    won = df.filter(converted).select(F.col(user).alias("v")).distinct()
    both = seen.join(won, F.col("u") == F.col("v"), "left")
    rate = both.groupBy("source").agg(F.count_distinct("u").alias("users"), F.count_distinct("v").alias("converted"))
    return rate.filter(F.col("users") >= least).withColumn("rate", F.col("converted") / F.col("users"))


def brief(df: DataFrame, dimension: Column, metric: Column, how: str = "sum", optional: dict[str, Column] | None = None, top: int = 30) -> DataFrame:
    """One aggregate per value of a dimension, the largest first: the shape of all domain briefs."""
    made = {"sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max, "min": F.min}[how](metric)
    extra = [F.avg(c).alias(n) for n, c in (optional or {}).items()]
    return df.groupBy(dimension.alias("dimension")).agg(made.alias("metric"), F.count(F.lit(1)).alias("n"), *extra).orderBy(F.desc_nulls_last("metric"), "dimension").limit(top)


#: The columns by semantic type, the aggregate and the optional type of each domain brief: (dimension, metric, how, optional).
BRIEFS: dict[str, tuple[str, str, str, str | None]] = {
    "marketplace": ("category", "price", "avg", "rating"),
    "outcome": ("outcome", "amount", "sum", None),
    "geo": ("region", "amount", "sum", None),
    "retail": ("product", "revenue", "sum", "quantity"),
    "content": ("source", "length", "avg", None),
    "hr": ("department", "salary", "avg", "tenure"),
    "real_estate": ("locality", "price", "avg", "area"),
    "education": ("course", "score", "avg", "attendance"),
    "clinical": ("diagnosis", "cost", "avg", "stay"),
    "demographic": ("group", "population", "sum", "age"),
    "sensor": ("device", "reading", "avg", None),
    "fraud": ("channel", "amount", "sum", "risk"),
    "banking": ("account_type", "balance", "sum", "rate"),
    "insurance": ("policy_type", "premium", "sum", "claims"),
    "support": ("queue", "resolution_time", "avg", "satisfaction"),
    "inventory": ("warehouse", "quantity", "sum", "reorder_level"),
    "consumption": ("meter", "usage", "sum", None),
    "production": ("line", "output", "sum", "defects"),
    "contract": ("party", "value", "sum", "term"),
    "nonprofit": ("campaign", "donation", "sum", None),
    "research": ("field", "citations", "sum", None),
    "government": ("agency", "budget", "sum", "spent"),
    "agriculture": ("crop", "yield", "avg", "area"),
    "sports": ("team", "points", "sum", None),
}


def domain_brief(df: DataFrame, name: str, bound: dict[str, Column]) -> DataFrame:
    """A brief of ``BRIEFS`` with its semantic types bound to columns of one table; an unbound optional type is left out."""
    dimension, metric, how, optional = BRIEFS[name]
    if dimension not in bound or metric not in bound:
        raise ValueError(f"{name} needs {dimension} and {metric}")
    extra = {optional: bound[optional]} if optional and optional in bound else None
    return brief(df, bound[dimension], bound[metric], how, extra)


def bind(types: dict[str, dict[str, tuple[str, float]]], required: list[str]) -> dict[str, tuple[str, str]] | None:
    """type -> (table, column): all required types from the one table that covers them with most confidence; shorter names win ties."""
    best = None
    for table, columns in types.items():
        found, total = {}, 0.0
        for want in required:
            fits = sorted(((-conf, len(c), c) for c, (t, conf) in columns.items() if t == want))
            if not fits:
                break
            found[want] = (table, fits[0][2])
            total += -fits[0][0]
        if len(found) == len(required) and (best is None or total > best[0]):
            best = (total, found)
    return best and best[1]
