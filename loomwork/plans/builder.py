"""The visual query builder's specification as DataFrame calls."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max}
MOST_ROWS, DEFAULT_ROWS = 1_000_000, 100


@dataclass
class Spec:
    """FROM, equi-joins (table, left column, right column), columns, filters, grouping, order, limit; names are table.column."""

    table: str
    joins: list[tuple[str, str, str]] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    filters: list[tuple[str, str, object]] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregates: list[tuple[str, str, str]] = field(default_factory=list)  # function, column, alias
    order_by: tuple[str, str] | None = None
    limit: int | None = None


def literal(value: object, kind: T.DataType) -> object | None:
    """The typed value, or None if it is not one of that kind."""
    text = str(value).strip()
    if isinstance(kind, T.NumericType):
        return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else None
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        try:
            return datetime.datetime.fromisoformat(text)
        except ValueError:
            return None
    if isinstance(kind, T.BooleanType):
        return {"true": True, "false": False}.get(text.lower())
    return str(value)


def condition(column: Column, kind: T.DataType, op: str, value: object) -> Column | None:
    """A predicate, or None for a literal that does not fit: such a filter is skipped."""
    op = op.upper()
    if op in ("IS NULL", "IS NOT NULL"):
        return column.isNull() if op == "IS NULL" else column.isNotNull()
    if op == "LIKE":
        return column.cast("string").like(str(value))
    made = literal(value, kind)
    if made is None:
        return None
    v = F.lit(made)
    return {"=": column == v, "!=": column != v, ">": column > v, "<": column < v, ">=": column >= v, "<=": column <= v}[op]


def validate(spec: Spec, tables: dict[str, DataFrame]) -> list[str]:
    """What is wrong with a specification; an empty list if nothing is."""
    errors, scope = [], {spec.table}
    if not spec.table:
        errors.append("FROM is required")
    for table, left, _ in spec.joins:
        if left.split(".")[0] not in scope:
            errors.append(f"join: {left} is not in scope")
        scope.add(table)
    errors += [f"unknown table {t}" for t in scope if t not in tables]
    if any(ord(ch) < 32 for name in [*spec.columns, *spec.group_by, *scope] for ch in name):
        errors.append("control characters in a name")
    if spec.limit is not None and not spec.limit >= 1:
        errors.append("limit must be at least 1")
    if spec.aggregates or spec.group_by:
        errors += [f"{c} is neither grouped nor aggregated" for c in spec.columns if c not in spec.group_by]
    return errors


def build(spec: Spec, tables: dict[str, DataFrame], limited: bool = True) -> DataFrame:
    """The query as a lazy DataFrame; the limit is kept for the last step of a pipeline."""
    if errors := validate(spec, tables):
        raise ValueError("; ".join(errors))
    df, kinds = tables[spec.table].alias(spec.table), {f"{spec.table}.{f.name}": f.dataType for f in tables[spec.table].schema}
    for table, left, right in spec.joins:
        df = df.join(tables[table].alias(table), F.col(left) == F.col(right), "inner")
        kinds |= {f"{table}.{f.name}": f.dataType for f in tables[table].schema}
    kind_of = lambda c: kinds.get(c) or next(k for n, k in kinds.items() if n.endswith(f".{c}"))
    for column, op, value in spec.filters:
        made = condition(F.col(column), kind_of(column), op, value)
        if made is not None:
            df = df.filter(made)
    if spec.aggregates:
        df = df.groupBy(*[F.col(c) for c in spec.group_by]).agg(*[AGGREGATES[f.upper()](F.col(c) if c != "*" else F.lit(1)).alias(a) for f, c, a in spec.aggregates])
    elif spec.columns:
        df = df.select(*[F.col(c) for c in spec.columns])
    if spec.order_by:
        column, way = spec.order_by
        name = column if column in df.columns or not spec.aggregates else column.split(".")[-1]
        df = df.orderBy(F.col(name).desc_nulls_last() if way.upper() == "DESC" else F.col(name).asc_nulls_last(), *[c for c in df.columns if c != name])
    return df.limit(max(1, min(MOST_ROWS, spec.limit or DEFAULT_ROWS))) if limited else df


@dataclass
class Step:
    """A later step on the result of the one before: filters, then an optional grouping."""

    filters: list[tuple[str, str, object]] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregates: list[tuple[str, str, str]] = field(default_factory=list)


def pipeline(spec: Spec, steps: list[Step], tables: dict[str, DataFrame]) -> DataFrame:
    """The base query and its steps; only the end is limited, so that steps see all rows."""
    df = build(spec, tables, limited=False)
    for step in steps:
        if step.group_by and not step.aggregates:
            raise ValueError("a grouped step needs an aggregate")
        for column, op, value in step.filters:
            made = condition(F.col(column), df.schema[column].dataType, op, value)
            if made is not None:
                df = df.filter(made)
        if step.aggregates:
            df = df.groupBy(*step.group_by).agg(*[AGGREGATES[f.upper()](F.col(c) if c != "*" else F.lit(1)).alias(a) for f, c, a in step.aggregates])
    return df.limit(max(1, min(MOST_ROWS, spec.limit or DEFAULT_ROWS)))


def calculated(df: DataFrame, alias: str, expression: str) -> DataFrame:
    """A column appended by a SQL expression; the alias has 1 to 64 characters."""
    if not 1 <= len(alias) <= 64:
        raise ValueError("alias length")
    return df.withColumn(alias, F.expr(expression))
