"""Points and features."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coordinate_columns(columns: list[str]) -> tuple[str, str] | None:
    """The pair of columns named like latitude and longitude."""
    lat = next((c for c in columns if re.fullmatch(r"(?i)lat|latitude|.*_lat|.*_latitude", c)), None)
    lon = next((c for c in columns if re.fullmatch(r"(?i)lon|lng|long|longitude|.*_(lon|lng|longitude)", c)), None)
    return (lat, lon) if lat and lon else None


def valid_point(lat: str, lon: str) -> Column:
    a, b = F.expr(f"try_cast(`{lat}` as double)"), F.expr(f"try_cast(`{lon}` as double)")
    return F.coalesce(a.between(-90, 90) & b.between(-180, 180), F.lit(False))


def features(df: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """GeoJSON text of every valid point with its properties."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.filter(valid_point(lat, lon)).select(*properties, F.to_json(feature).alias("feature"))


def point_validity(df: DataFrame, lat: str, lon: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count_if(valid_point(lat, lon)).alias("points"), F.count_if(~valid_point(lat, lon)).alias("invalid"))
