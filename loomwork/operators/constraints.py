"""Shape constraints on rows: cardinality, datatype, bounds, pattern, enumeration; all counted in one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import safe_pattern


@dataclass(frozen=True)
class Shape:
    """Constraints on one field; a field that is an array has as many values as it has elements."""

    field: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    pattern: str | None = None
    values: tuple | None = None


def violations_of(df: DataFrame, shape: Shape) -> dict[str, Column]:
    """Constraint name -> condition under which a row violates it."""
    c, kind = F.col(f"`{shape.field}`"), df.schema[shape.field].dataType
    many = c if isinstance(kind, T.ArrayType) else F.when(c.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(c))
    many = F.filter(F.coalesce(many, F.array().cast(many_type(kind))), lambda x: x.isNotNull())
    each = lambda bad: F.exists(many, lambda x: F.coalesce(bad(x), F.lit(True)))
    out: dict[str, Column] = {}
    if shape.min_count is not None:
        out["min_count"] = F.size(many) < shape.min_count
    if shape.max_count is not None:
        out["max_count"] = F.size(many) > shape.max_count
    if shape.datatype:
        out["datatype"] = each(lambda x: x.cast("string").try_cast(shape.datatype).isNull())
    if shape.minimum is not None:
        out["min_inclusive"] = each(lambda x: x.cast("string").try_cast("double") < shape.minimum)
    if shape.maximum is not None:
        out["max_inclusive"] = each(lambda x: x.cast("string").try_cast("double") > shape.maximum)
    if shape.pattern:
        if not safe_pattern(shape.pattern):
            raise ValueError(f"unsafe pattern on {shape.field}")
        out["pattern"] = each(lambda x: ~x.cast("string").rlike(shape.pattern))
    if shape.values is not None:
        out["enumeration"] = each(lambda x: ~x.cast("string").isin([str(v) for v in shape.values]))
    return out


def many_type(kind: T.DataType) -> T.DataType:
    return kind if isinstance(kind, T.ArrayType) else T.ArrayType(kind)


def validate(df: DataFrame, shapes: list[Shape]) -> DataFrame:
    """(field, constraint_name, violations) of every constraint: one aggregate."""
    found = [(s.field, n, c) for s in shapes for n, c in violations_of(df, s).items()]
    one = df.agg(*[F.count_if(c).alias(f"v{i}") for i, (_, _, c) in enumerate(found)])
    rows = [F.struct(F.lit(f).alias("field"), F.lit(n).alias("constraint_name"), F.col(f"v{i}").alias("violations")) for i, (f, n, _) in enumerate(found)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def violating_rows(df: DataFrame, shapes: list[Shape]) -> DataFrame:
    """Rows with at least one violation and their names (field.constraint)."""
    named = F.array(*[F.when(c, F.lit(f"{s.field}.{n}")) for s in shapes for n, c in violations_of(df, s).items()])
    return df.withColumn("violated", F.filter(named, lambda x: x.isNotNull())).filter(F.size("violated") > 0)
