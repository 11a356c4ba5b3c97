"""Readers: each file format as a DataFrame.

Formats that Spark reads itself use its readers.  The rest are Python data sources,
so the reading happens in tasks: one partition per file (and sheet, table or row range).
"""

from __future__ import annotations

import io
import os
import re
import sys
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMATS = {
    ".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "jsonl", ".parquet": "parquet",
    ".arrow": "arrow", ".feather": "arrow", ".ipc": "arrow", ".xlsx": "xlsx", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite",
    ".dta": "stata", ".sas7bdat": "sas", ".xpt": "sas", ".sav": "spss", ".geojson": "geojson", ".kml": "kml",
}


def format_of(path: str) -> str:
    """The format of a path by its suffix."""
    suffix = os.path.splitext(urlparse(path).path)[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {path!r}")
    return FORMATS[suffix]


def encoding_of(head: bytes, declared: str | None = None) -> str:
    """The declared charset, else UTF-8 if the bytes are that, else Windows-1252."""
    if declared:
        return {"latin1": "windows-1252", "iso-8859-1": "windows-1252"}.get(declared.lower(), declared.lower())
    for cut in range(4):  # a head may end inside a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "windows-1252"


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", schema=None) -> DataFrame:
    """Header, types from the whole file unless a schema is given, short rows padded, rows that don't fit kept as far as they do."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def csv_rejects(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(line) of rows that do not have as many fields as the header or whose values don't fit their types."""
    kinds = read_csv(spark, path, sep).schema
    wide = kinds.add("_corrupt_record", "string")
    return spark.read.option("header", True).option("sep", sep).option("columnNameOfCorruptRecord", "_corrupt_record").schema(wide).csv(path).cache().filter("_corrupt_record is not null").select(F.col("_corrupt_record").alias("line"))


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row for each feature: its properties and its geometry as GeoJSON text."""
    found = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return found.select("f.properties.*", F.to_json("f.geometry").alias("geometry"))


def _jdbc_like_paths(path: str) -> list[str]:
    return sorted(os.path.join(path, x) for x in os.listdir(path)) if os.path.isdir(path) else [path]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) through Spark's own file access, so any store that Spark reads will do."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files and streams (Feather 2)."""

    def opened(raw: bytes) -> pa.Table:
        buffer = pa.py_buffer(raw)
        return (pa.ipc.open_file(buffer) if raw[:6] == b"ARROW1" else pa.ipc.open_stream(buffer)).read_all()

    return _decoded(spark, path, opened)


def read_stat(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Stata and SAS files through pandas in tasks; SPSS needs a library that is not here."""
    if kind == "spss":
        raise NotImplementedError("SPSS files need the package pyreadstat, which is not installed")

    def opened(raw: bytes) -> pa.Table:
        import pandas as pd

        frame = pd.read_stata(io.BytesIO(raw)) if kind == "stata" else pd.read_sas(io.BytesIO(raw), format="sas7bdat" if raw[:4] == b"\0\0\0\0" else "xport", encoding="utf-8")
        return pa.Table.from_pandas(frame, preserve_index=False)

    return _decoded(spark, path, opened)


def _decoded(spark: SparkSession, path: str, opened) -> DataFrame:
    """Files of one schema, decoded to Arrow in tasks; the schema is the first file's."""
    files = _files(spark, path)
    first = files.orderBy("path").first()
    schema = spark.createDataFrame(opened(bytes(first["content"])).slice(0, 0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                yield from opened(raw).to_batches(max_chunksize=10_000)

    return files.mapInArrow(run, schema)


# --- spreadsheets, SQLite and KML: rows of text, typed afterwards -------------------


def xlsx_sheets(raw: bytes) -> dict[str, list[list[str | None]]]:
    """Sheet name -> rows of cell texts, from the parts of the zip file."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space):
                shared.append("".join(t.text or "" for t in item.iter("{%s}t" % space["m"])))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", space):
            target = links[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
            name = target.lstrip("/") if target.startswith("/") else "xl/" + target
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter("{%s}row" % space["m"]):
                cells: list[str | None] = []
                for cell in row.findall("m:c", space):
                    place = 0
                    for letter in re.match(r"[A-Z]+", cell.get("r", "A"))[0]:
                        place = place * 26 + ord(letter) - 64
                    cells += [None] * (place - 1 - len(cells))
                    value, kind = cell.find("m:v", space), cell.get("t")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in cell.iter("{%s}t" % space["m"])))
                    elif value is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}.get(value.text) if kind == "b" else value.text)
                rows.append(cells)
            out[sheet.get("name")] = rows
    return out


def read_xlsx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A DataFrame for each sheet that has rows: the first row names the columns, types are inferred by Spark."""
    raw = bytes(_files(spark, path).first()["content"])
    out = {}
    for name, rows in xlsx_sheets(raw).items():
        rows = [r for r in rows if any(c not in (None, "") for c in r)]
        if not rows:
            continue
        width = max(map(len, rows))
        names = [str(c) if c else f"column_{i}" for i, c in enumerate([*rows[0], *[None] * (width - len(rows[0]))])]
        body = [tuple([*r, *[None] * (width - len(r))]) for r in rows[1:]]
        texts = spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))
        out[name] = typed(texts)
    return out


def typed(texts: DataFrame) -> DataFrame:
    """Text columns as the narrowest of long, double, date and text that all values fit; one aggregate."""
    tries = ("bigint", "double", "date")
    fits = texts.agg(*[F.bool_and(F.col(f"`{c}`").isNull() | F.expr(f"try_cast(`{c}` as {t})").isNotNull()).alias(f"f{i}_{t}") for i, c in enumerate(texts.columns) for t in tries]).first()
    kinds = {c: next((t for t in tries if fits[f"f{i}_{t}"]), "string") for i, c in enumerate(texts.columns)}
    return texts.select(*[F.expr(f"try_cast(`{c}` as {t})").alias(c) for c, t in kinds.items()])


class _RowRange(InputPartition):
    def __init__(self, path: str, table: str, low: int, high: int):
        self.path, self.table, self.low, self.high = path, table, low, high


class SqliteSource(DataSource):
    """One table of a SQLite file, read by ranges of rowid; blobs become null."""

    @classmethod
    def name(cls) -> str:
        return "loomwork_sqlite"

    def schema(self) -> str:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {_sqlite_type(c[2])}" for c in columns)

    def reader(self, schema):
        return SqliteReader(self.options, [f.name for f in schema], [f.dataType.simpleString() for f in schema])


def _sqlite_type(declared: str) -> str:
    d = declared.upper()
    return "bigint" if "INT" in d else "double" if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"


class SqliteReader(DataSourceReader):
    STEP = 100_000

    def __init__(self, options, names: list[str], kinds: list[str]):
        self.path, self.table, self.names, self.kinds = options["path"], options["table"], names, kinds

    def partitions(self):
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        return [_RowRange(self.path, self.table, k, k + self.STEP) for k in range(low or 0, (high or 0) + 1, self.STEP)] or [_RowRange(self.path, self.table, 0, 0)]

    def read(self, part):
        import sqlite3

        make = {"bigint": lambda v: v if isinstance(v, int) else None, "double": lambda v: float(v) if isinstance(v, (int, float)) else None, "string": str}
        with sqlite3.connect(f"file:{part.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'select * from "{part.table}" where rowid >= ? and rowid < ?', (part.low, part.high)):
                yield tuple(None if v is None or isinstance(v, bytes) else make[k](v) for v, k in zip(row, self.kinds, strict=True))


def read_sqlite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A DataFrame for each user table."""
    import sqlite3

    spark.dataSource.register(SqliteSource)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
    return {n: spark.read.format("loomwork_sqlite").option("path", path).option("table", n).load() for n in names}


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, geometry as GeoJSON text) of every placemark that is a point, line or polygon."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = lambda e: e.tag.rpartition("}")[2]
        pairs = lambda text: [[float(v) for v in p.split(",")[:2]] for p in (text or "").split()]
        for batch in batches:
            rows = []
            for raw in batch.column("content").to_pylist():
                for mark in (e for e in ElementTree.fromstring(raw).iter() if tag(e) == "Placemark"):
                    own = {tag(e): (e.text or "").strip() for e in mark}
                    shape = None
                    for e in mark.iter():
                        points = [pairs(c.text) for c in e.iter() if tag(c) == "coordinates"] if tag(e) in ("Point", "LineString", "Polygon") else []
                        if points and points[0]:
                            shape = {"type": tag(e), "coordinates": points[0][0] if tag(e) == "Point" else points[0] if tag(e) == "LineString" else points}
                            break
                    rows.append((own.get("name"), own.get("description"), json.dumps(shape) if shape else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["name", "description", "geometry"])

    return _files(spark, path).mapInArrow(run, "name string, description string, geometry string")


def read_s3(spark: SparkSession, url: str, endpoint: str | None = None, key: str | None = None, secret: str | None = None, path_style: bool = False, fmt: str | None = None) -> DataFrame:
    """An S3-compatible store through the s3a file system, with per-bucket settings."""
    bucket = urlparse(url).netloc
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in (("endpoint", endpoint), ("access.key", key), ("secret.key", secret), ("path.style.access", str(path_style).lower())):
        if value:
            conf.set(f"fs.s3a.bucket.{bucket}.{name}", value)
    return read(spark, re.sub(r"^s3n?://", "s3a://", url), fmt)


def read_iceberg(spark: SparkSession, table: str) -> DataFrame:
    """A table of an Iceberg catalog set up in the session; an error names what is missing otherwise."""
    try:
        return spark.read.format("iceberg").load(table)
    except Exception as error:
        raise RuntimeError("reading Iceberg needs its Spark runtime jar and a catalog in the session") from error


def read_warehouse(spark: SparkSession, url: str, query: str, cap: int = 100_000, **options) -> DataFrame:
    """A query against a warehouse over JDBC, with a row cap of at most a million (a preview's limit)."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    return reader.options(**options).load().limit(min(cap, 1_000_000))


def read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A path by its format; formats of several tables are read by ``catalog.mount``."""
    fmt = fmt or format_of(path)
    if fmt in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if fmt == "tsv" else ",", _encoding(spark, path))
    if fmt in ("stata", "sas", "spss"):
        return read_stat(spark, path, fmt)
    return {"jsonl": read_json_lines, "parquet": lambda s, p: s.read.parquet(p), "arrow": read_arrow, "geojson": read_geojson, "kml": read_kml}[fmt](spark, path)


def _encoding(spark: SparkSession, path: str) -> str:
    """From the first 64 KB of the first file, read by Spark."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("head")).first()
    return encoding_of(bytes(head["head"])) if head else "utf-8"
