"""Anonymised projections and export-safe text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what is done with a column of each sensitivity unless said otherwise.
DEFAULT = {"pii": "hash", "financial": "bucket", "secret": "redact", "public": "keep"}


def default_strategy(sensitivity: str | None) -> str:
    return DEFAULT.get(sensitivity or "", "redact")


def masked(df: DataFrame, column: str, strategy: str, salt: str = "") -> Column | None:
    """keep, salted md5 (null hashes as ''), redact, bucket (hundreds, months) or drop (None)."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if strategy == "drop":
        return None
    if strategy == "keep":
        return c
    if strategy == "hash":
        return F.md5(F.concat(F.lit(salt), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"))
    if strategy == "bucket" and isinstance(kind, T.NumericType):
        return F.floor(c.cast("double") / 100).cast("double") * 100
    if strategy == "bucket" and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM")
    return F.lit("[REDACTED]")


def anonymize(df: DataFrame, strategies: dict[str, str], salt: str = "") -> DataFrame:
    made = {c: masked(df, c, s, salt) for c, s in strategies.items()}
    kept = [v.alias(c) for c, v in made.items() if v is not None]
    return df.select(*kept or [F.lit(None).alias("_empty")])


def manifest(strategies: dict[str, str]) -> dict:
    """What was done to each column; never the salt."""
    return {"columns": [{"name": c, "strategy": s} for c, s in strategies.items()]}


def neutralised(c: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a quote in front."""
    return F.when(F.left(c, F.lit(1)).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_safe(df: DataFrame) -> DataFrame:
    """All text columns and all header names neutralised; numbers as they are."""
    out = []
    for f in df.schema:
        name = f"'{f.name}" if f.name[:1] in "=+-@\t\r" else f.name
        c = F.col(f"`{f.name}`")
        out.append((neutralised(c) if isinstance(f.dataType, T.StringType) else c).alias(name))
    return df.select(*out)
