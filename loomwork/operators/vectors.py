"""Vector columns: coercion, cosine similarity, nearest rows, principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_vector(c: Column, is_text: bool = False) -> Column:
    """array<double>; JSON text is parsed; a vector with a value that is not finite is null."""
    v = F.from_json(c, "array<double>") if is_text else c.cast("array<double>")
    return F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length, 0 if one has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def top_k(df: DataFrame, vector: str, query: list[float], k: int, tie: str) -> DataFrame:
    """The k rows most like the query, with their similarity."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("similarity", cosine(as_vector(F.col(vector)), q)).orderBy(F.desc_nulls_last("similarity"), tie).limit(k)


def pca_2d(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and x, y: the two leading principal components, signs fixed by the largest loading.

    Means and the d x d second moments are summed in tasks (d is the vectors' length,
    not the data's size); only these reach the driver.
    """
    rows = df.select(*keep, as_vector(F.col(vector)).alias("__v")).filter("__v is not null")

    def moments(batches):
        n, s, m = 0, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["__v"].to_numpy())
            n, s, m = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if m is None else m)
        if n:
            import pandas as pd

            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "m": [m.ravel().tolist()]})

    parts = rows.select("__v").mapInPandas(moments, "n long, s array<double>, m array<double>")
    sums = parts.select("n", F.posexplode(F.concat("s", "m")).alias("at", "v")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("at").collect()
    if not sums:
        return rows.select(*keep, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    n, flat = sums[0]["n"], np.array([r["v"] for r in sums])
    d = int((-1 + (1 + 4 * len(flat)) ** 0.5) / 2)
    mean = flat[:d] / n
    values, axes = np.linalg.eigh(flat[d:].reshape(d, d) / n - np.outer(mean, mean))
    lead = axes[:, np.argsort(-values)[:2]].T
    lead = lead * np.sign(lead[np.arange(len(lead)), np.abs(lead).argmax(1)])[:, None]
    centred = F.zip_with("__v", F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    axis = [F.array(*[F.lit(float(x)) for x in row]) for row in lead]
    return rows.withColumn("__c", centred).select(*keep, dot(F.col("__c"), axis[0]).alias("x"), (dot(F.col("__c"), axis[1]) if len(axis) > 1 else F.lit(0.0)).alias("y"))
