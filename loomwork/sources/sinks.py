"""Writers and row mappings for other systems."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.privacy import anonymize, csv_safe, manifest


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that no spreadsheet reads as formulas."""
    csv_safe(df).write.mode("error").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_anonymized(df: DataFrame, path: str, strategies: dict[str, str], salt: str) -> str:
    """Anonymised CSV; returns its manifest as JSON, without the salt."""
    write_csv(anonymize(df, strategies, salt), path)
    return json.dumps(manifest(strategies), indent=1)


def cards(df: DataFrame, title: str, due: str | None = None) -> DataFrame:
    """Kanban cards as JSON: title, due_date, the first other text column as description."""
    text = next((f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in (title, due)), None)
    parts = [F.col(title).cast("string").alias("title")]
    if due:
        parts.append(F.col(due).cast("date").cast("string").alias("due_date"))
    if text:
        parts.append(F.col(text).alias("description"))
    return df.select(F.to_json(F.struct(*parts)).alias("card"))


def journal_entries(df: DataFrame, date: str, amount: str, memo: str | None = None) -> DataFrame:
    """Journal entries as JSON; amounts that are no number count 0."""
    parts = [F.col(date).cast("date").cast("string").alias("date"), F.coalesce(F.expr(f"try_cast(`{amount}` as double)"), F.lit(0.0)).alias("amount")]
    if memo:
        parts.append(F.coalesce(F.col(memo).cast("string"), F.lit("")).alias("memo"))
    return df.select(F.to_json(F.struct(*parts)).alias("entry"))


def filled_template(template: str, columns: list[str]) -> Column:
    """``${column}`` in a text becomes the row's value ('' for null); unknown names stay as they are."""
    parts = []
    for piece in re.split(r"(\$\{[^}]+\})", template):
        name = piece[2:-1] if piece.startswith("${") else None
        parts.append(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in columns else F.lit(piece))
    return F.concat(*parts)


def snapshot(df: DataFrame, sql: str, rows: int = 100) -> dict:
    """A preview of a result with the hash of its SQL; stale if the SQL's hash differs."""
    return {"sql_hash": fnv1a(sql), "rows": [r.asDict(recursive=True) for r in df.limit(rows).collect()]}


def fnv1a(text: str) -> str:
    h = 0x811C9DC5
    for b in text.encode():
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"
