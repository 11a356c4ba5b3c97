"""Python cells, demo names, chart fields and source fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def python_cell(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by: list[str] | None = None) -> DataFrame:
    """A pandas function on each batch of rows, or on each group; never on the whole table in one place."""
    if by:
        return df.groupBy(*by).applyInPandas(function, schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def demo_names(df: DataFrame, secret: set[str]) -> DataFrame:
    """Columns that must not show their names become field_1, field_2 .."""
    names = {c: f"field_{i}" for i, c in enumerate((c for c in df.columns if c in secret), 1)}
    return df.withColumnsRenamed(names)


def field_class(name: str, kind: T.DataType) -> str:
    """temporal, numeric, measure, identifier or categorical, from type and name."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if re.search(r"(?i)(^|_)(id|key|code|no|uuid)$", name):
        return "identifier"
    if isinstance(kind, T.NumericType):
        return "measure" if re.search(r"(?i)amount|total|price|value|qty|quantity|balance|cost|revenue", name) else "numeric"
    return "categorical"


def chart_binding(df: DataFrame) -> dict[str, str | None]:
    """x, y and kind of the chart that a result suggests; identifiers are never y."""
    classes = {f.name: field_class(f.name, f.dataType) for f in df.schema}
    pick = lambda *kinds: next((c for k in kinds for c, v in classes.items() if v == k), None)
    time, group, y = pick("temporal"), pick("categorical", "identifier"), pick("measure", "numeric")
    x = time or group
    return {"x": x, "y": y, "kind": "line" if time and y else "bar" if group and y else "table"}


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the files' names, sizes and times, listed by Spark, so any store will do."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.unix_millis("modificationTime").alias("t"))
    one = files.select(F.xxhash64("path", "length", "t").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x")).first()
    return hashlib.sha256(f"{one.n}:{one.x}".encode()).hexdigest()[:16]


def changed(before: dict[str, str], now: dict[str, str]) -> dict[str, list[str]]:
    """Sources that are stale, new or gone between two sets of fingerprints."""
    return {"stale": sorted(k for k in before if k in now and before[k] != now[k]), "new": sorted(now.keys() - before.keys()), "gone": sorted(before.keys() - now.keys())}
