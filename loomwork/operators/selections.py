"""Associative selection: what each column's values have in common with what is selected."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(selections: dict[str, list], skip: str | None = None) -> Column:
    """AND of the selections of all columns but one; an empty list is FALSE, none at all is TRUE."""
    out = F.lit(True)
    for c, values in selections.items():
        if c != skip:
            out = out & (F.coalesce(F.col(c).isin(values), F.lit(False)) if values else F.lit(False))
    return out


def range_predicate(column: str, low, high, kind: str = "double") -> Column:
    """Inclusive range on the column read as a number or time; ends given the wrong way round are swapped."""
    low, high = (high, low) if low > high else (low, high)
    return F.expr(f"try_cast(`{column}` as {kind})").between(low, high)


def value_states(df: DataFrame, columns: list[str], selections: dict[str, list]) -> DataFrame:
    """(column_name, value, n, state) of every value: selected, associated, excluded, or neutral if nothing is selected.

    One scan: each row gives one (column, value) row per column with a flag whether all
    other columns' selections hold there.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), predicate(selections, c).alias("held")) for c in columns])
    grouped = df.select(F.explode(entries).alias("r")).select("r.*").groupBy("column_name", "value").agg(F.count("*").alias("n"), F.max("held").alias("held"))
    chosen = F.lit(False)
    for c, values in selections.items():
        chosen = chosen | ((F.col("column_name") == c) & F.col("value").isin([str(v) for v in values]))
    state = F.when(F.coalesce(chosen, F.lit(False)), "selected")
    if any(selections.values()):
        state = state.when(F.col("held"), "associated").otherwise("excluded")
    else:
        state = state.otherwise("neutral")
    return grouped.select("column_name", "value", "n", state.alias("state"))


def effective(selections: dict[tuple[str, str], list], links: list[tuple[tuple[str, str], tuple[str, str]]]) -> dict[tuple[str, str], list]:
    """Selections carried along column links to every reachable (table, column); own selections win."""
    near: dict[tuple, set] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = dict(selections)
    for start, values in selections.items():
        queue, seen = deque([start]), {start}
        while queue:
            for other in sorted(near.get(queue.popleft(), ())):
                if other not in seen:
                    seen.add(other)
                    queue.append(other)
                    out.setdefault(other, values)
    return out


def suggest_links(columns: dict[tuple[str, str], str | None]) -> list[tuple[tuple[str, str], tuple[str, str]]]:
    """Pairs of columns of two tables with the same semantic type, or else the same name."""
    keys = sorted(columns)
    return [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] != b[0] and ((columns[a] and columns[a] == columns[b]) or a[1].lower() == b[1].lower())]
