"""Entity resolution: value clusters, merges and golden tables."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph_components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) without nulls and empty texts."""
    return df.select(F.col(column).cast("string").alias("value")).filter("value is not null and value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def _strip_marks(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


def fingerprint(c: Column, ascii_only: bool = False) -> Column:
    """Key under which case, punctuation, accents, order and repetition of words don't matter.

    Text outside ASCII goes through a vectorised normaliser; with ``ascii_only`` the
    whole expression stays in the JVM.
    """
    if not ascii_only:
        c = F.pandas_udf(_strip_marks, "string")(c)
    plain = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: t != ""))), " ")


def canonical(n: str = "n", value: str = "value") -> Column:
    """Of a group: the most frequent value, then the longest, then the first in order."""
    return F.min(F.struct((-F.col(n)).alias("a"), (-F.length(value)).alias("b"), F.col(value).alias("v")))["v"]


def key_clusters(counts: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(fingerprint, members, total, canonical) of fingerprints with two values or more."""
    keyed = counts.withColumn("fingerprint", fingerprint(F.col("value"), ascii_only)).filter("fingerprint <> ''")
    return keyed.groupBy("fingerprint").agg(F.count("*").alias("members"), F.sum("n").alias("total"), canonical().alias("canonical")).filter("members > 1")


def near_pairs(counts: DataFrame, threshold: float = 0.85, margin: float = 0.0, ascii_only: bool = False) -> DataFrame:
    """(a, b, similarity) of values whose edit similarity is at least ``threshold - margin``.

    Values meet if their fingerprints start alike and their lengths allow the
    similarity.  For this each value goes to the length classes of ratio 1/t around
    its own, so the join has an equality on (first sign, length class) and no block
    holds all values of a sign.
    """
    least = threshold - margin
    base = counts.select("value", F.length("value").alias("len"), F.substring(fingerprint(F.col("value"), ascii_only), 1, 1).alias("block"))
    # Every length in [len, len / least] lies in few classes of that ratio.
    kind = lambda x: F.floor(F.log(x) / F.log(F.lit(1 / least))).cast("int")
    a = base.select(F.col("value").alias("a"), F.col("len").alias("la"), "block", F.explode(F.sequence(kind(F.col("len")), kind(F.col("len") / least + 0.001))).alias("class"))
    b = base.select(F.col("value").alias("b"), F.col("len").alias("lb"), "block", kind(F.col("len")).alias("class"))
    later = (F.col("lb") > F.col("la")) | ((F.col("lb") == F.col("la")) & (F.col("b") > F.col("a")))
    met = a.join(b, ["block", "class"]).filter(later & (F.col("la") >= F.col("lb") * least - 1e-9))
    most = F.floor((1 - least) * F.col("lb") + 1e-9).cast("int")
    scored = met.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= most)
    return scored.select("a", "b", (1 - F.col("distance") / F.col("lb")).alias("similarity"))


def near_clusters(counts: DataFrame, threshold: float = 0.85, ascii_only: bool = False) -> DataFrame:
    """(value, cluster, canonical): single-link clusters of near pairs."""
    parts = connected_components(near_pairs(counts, threshold, ascii_only=ascii_only), "a", "b").withColumnsRenamed({"node": "value", "component": "cluster"})
    named = parts.join(counts, "value")
    best = named.groupBy("cluster").agg(canonical().alias("canonical"))
    return named.join(best, "cluster").select("value", "cluster", "canonical")


def borderline(counts: DataFrame, threshold: float = 0.85, limit: int = 20, ascii_only: bool = False) -> DataFrame:
    """Pairs just below the threshold, by how many rows they concern: a report of the top ``limit``."""
    pairs = near_pairs(counts, threshold, 0.1, ascii_only).filter(F.col("similarity") < threshold)
    n = counts.select(F.col("value").alias("a"), F.col("n").alias("na"))
    m = counts.select(F.col("value").alias("b"), F.col("n").alias("nb"))
    both = pairs.join(n, "a").join(m, "b").withColumn("rows", F.col("na") + F.col("nb"))
    return both.select("a", "b", "similarity", "rows").orderBy(F.desc("rows"), "a", "b").limit(limit)


def merge_values(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column__merged``: the canonical value where the mapping (value, canonical) has one.

    The mapping is joined, so it may be of any size; Spark broadcasts it if it is small.
    """
    return df.join(mapping.select(F.col("value").alias(column), F.col("canonical").alias("__to")), column, "left").withColumn(f"{column}__merged", F.coalesce("__to", column)).drop("__to")


def golden(df: DataFrame, entity: str, rules: dict[str, str], order: str, tie: str) -> DataFrame:
    """One row per entity; rules: first, latest (by ``order``, then ``tie``; nulls skipped), min or max."""
    at = F.struct(F.col(order), F.col(tie))
    aggs = []
    for c, rule in rules.items():
        v = F.col(c)
        made = {"min": lambda v: F.min(v), "max": lambda v: F.max(v), "first": lambda v: F.min_by(v, at), "latest": lambda v: F.max_by(v, F.when(v.isNotNull(), at))}[rule](v)
        aggs.append(made.alias(c))
    return df.groupBy(entity).agg(*aggs)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
