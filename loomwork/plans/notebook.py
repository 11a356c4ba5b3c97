"""Cells as temp views: order, staleness, lineage, and a read-only check by Spark's own parser."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import macros


@dataclass
class Cell:
    name: str
    sql: str
    result: DataFrame | None = None
    stale: bool = True


@dataclass
class Notebook:
    """SQL cells that read each other by @name."""

    spark: SparkSession
    cells: dict[str, Cell] = field(default_factory=dict)
    fragments: dict[str, dict[str, str]] = field(default_factory=dict)
    inputs: dict[str, object] = field(default_factory=dict)

    def add(self, name: str, sql: str) -> Cell:
        self.cells[name] = Cell(name, sql)
        return self.cells[name]

    def needs(self, name: str) -> list[str]:
        return [r for r in macros.cell_references(self.cells[name].sql) if r in self.cells]

    def order(self, wanted: list[str] | None = None) -> list[str]:
        """Upstream first; an error names a circle."""
        out, state = [], {}

        def visit(name: str, path: list[str]) -> None:
            if state.get(name) == 1:
                raise ValueError(" -> ".join([*path, name]))
            if name not in state:
                state[name] = 1
                for other in self.needs(name):
                    visit(other, [*path, name])
                state[name] = 2
                out.append(name)

        for n in wanted or list(self.cells):
            visit(n, [])
        return out

    def downstream(self, seeds: list[str]) -> list[str]:
        """All cells that read a seed, directly or not, in running order."""
        hit, queue = set(seeds), deque(seeds)
        while queue:
            at = queue.popleft()
            for n in self.cells:
                if n not in hit and at in self.needs(n):
                    hit.add(n)
                    queue.append(n)
        return [n for n in self.order() if n in hit]

    def mark_stale(self, seeds: list[str]) -> list[str]:
        names = self.downstream(seeds)
        for n in names:
            self.cells[n].stale = True
        return names

    def run(self, name: str) -> DataFrame:
        """Run what a cell needs and is stale, then the cell; each result is a lazy view."""
        for n in self.order([name]):
            cell = self.cells[n]
            if cell.stale or cell.result is None:
                text = macros.expanded(cell.sql, **self.fragments)
                text, args = macros.bind_cells(text, {k: f"cell_{k}" for k in self.cells}, self.inputs)
                cell.result = self.spark.sql(text, args or None)
                cell.result.createOrReplaceTempView(f"cell_{n}")
                cell.stale = False
        return self.cells[name].result


#: Functions that run code or name files, however they are spelled in a query.
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length"}


def _plans_inside(expression) -> list:
    """The plans of sub-queries anywhere in an expression; a refused function is an error."""
    found, queue = [], deque([expression])
    while queue:
        e = queue.popleft()
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction" and e.nameParts().last().lower() in REFUSED_FUNCTIONS:
            raise ValueError(f"{e.nameParts().last()} is not allowed")
        if hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            found.append(e.plan())
        children = e.children()
        queue.extend(children.apply(i) for i in range(children.size()))
    return found


def read_only_tables(spark: SparkSession, sql: str, allowed: set[str] | None = None) -> set[str]:
    """The tables that one query reads; anything but a query, a path relation or a table outside ``allowed`` is an error.

    Spark's parser does the parsing; only the kinds of its plan nodes are looked at.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names, ctes, queue = set(), set(), deque([plan])
    while queue:
        node = queue.popleft()
        kind = node.getClass().getSimpleName()
        if kind.endswith("Command") or kind.startswith(("Describe", "Show", "Explain", "Analyze", "Insert", "Create", "Drop", "Replace", "Delete", "Update", "Merge", "Alter", "Set", "Truncate", "Load", "Cache", "Uncache", "Refresh", "Add")):
            raise ValueError(f"{kind} is not a query")
        if kind == "UnresolvedTableValuedFunction" and "range" not in node.toString().lower():
            raise ValueError("table functions are not allowed")
        if kind == "UnresolvedRelation":
            parts = node.tableName()
            names.add(parts.replace("`", ""))
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.size()):
                ctes.add(relations.apply(i)._1())
                queue.append(relations.apply(i)._2())
        expressions = node.expressions()
        for i in range(expressions.size()):
            queue.extend(_plans_inside(expressions.apply(i)))
        children = node.children()
        queue.extend(children.apply(i) for i in range(children.size()))
    names -= ctes
    for n in names:
        if n.split(".")[0].lower() in ("parquet", "csv", "json", "orc", "text", "binaryfile", "delta", "avro"):
            raise ValueError("file paths are not allowed")
    if allowed is not None and names - allowed:
        raise ValueError(f"not allowed: {', '.join(sorted(names - allowed))}")
    return names


def preview(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The capped read that an agent gets."""
    return df.limit(rows)


def lineage(spark: SparkSession, sql: str, df: DataFrame) -> dict:
    """What a cell reads: table names from the parsed text, and files from the plan."""
    return {"tables": sorted(read_only_tables(spark, sql)), "files": sorted(df.inputFiles()), "columns": df.columns}
