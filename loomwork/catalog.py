"""Mounted tables: names, folders, and all-or-nothing refresh."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomwork.sources import readers


def table_name(text: str, taken: set[str] | None = None) -> str:
    """Lower case, other signs to _, t_ before a digit, _2, _3 .. on collisions."""
    name = re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_") or "table"
    name = f"t_{name}" if name[0].isdigit() else name
    out, k = name, 2
    while taken and out in taken:
        out, k = f"{name}_{k}", k + 1
    return out


@dataclass
class Source:
    path: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


class Catalog:
    """Sources and their temp views in one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.sources = spark, {}, []

    def register(self, name: str, df: DataFrame) -> str:
        name = table_name(name, set(self.tables))
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        return name

    def mount(self, path: str, fmt: str | None = None) -> Source:
        """A file: one table, or one for each sheet or inner table."""
        fmt, stem = fmt or readers.format_of(path), os.path.splitext(os.path.basename(path.rstrip("/")))[0]
        if fmt == "xlsx":
            made = {f"{stem}__{n}": df for n, df in readers.read_xlsx(self.spark, path).items()}
        elif fmt == "sqlite":
            made = readers.read_sqlite(self.spark, path)
        else:
            made = {stem: readers.read(self.spark, path, fmt)}
        source = Source(path, {self.register(n, df): df for n, df in made.items()})
        self.sources.append(source)
        return source

    def mount_folder(self, path: str, most: int = 5000) -> Source:
        """All readable files of a folder, not its subfolders; a file that fails is noted; an error only if nothing is mounted."""
        whole = Source(path)
        for entry in sorted(os.scandir(path), key=lambda e: e.name)[:most]:
            try:
                part = self.mount(entry.path)
                whole.tables |= part.tables
            except Exception as error:  # noqa: BLE001 - one bad file must not hide the others
                whole.errors[entry.name] = str(error).splitlines()[0] if str(error) else type(error).__name__
        if not whole.tables:
            raise ValueError(f"no table in {path}: {whole.errors}")
        return whole

    def refresh(self, new: dict[str, DataFrame]) -> None:
        """Replace several tables at once: all are validated by reading a row before any view changes."""
        for name, df in new.items():
            if name not in self.tables:
                raise KeyError(name)
            df.limit(1).count()
        for name, df in new.items():
            df.createOrReplaceTempView(name)
            self.tables[name] = df

    def describe(self, name: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.tables[name].schema]
