"""Tables written once in the middle of a job.

A staged table cuts the lineage: it is Parquet in the folder that the session
names in ``spark.checkpoint.dir``, so every executor can read it again after
another one is lost.  Only where that setting is missing (tests, notebooks) a
folder of this process is used.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``, or an own one if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="loomwork-"))
    return _OWN[0]


def stage(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork-{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of staged tables, for ``release``."""
    return len(_STAGED)


def release(since: int, *keep: DataFrame) -> None:
    """Delete the tables staged since a mark, but those that the frames of ``keep`` still read.

    For the end of an operator whose result no longer needs its rounds' tables.
    """
    if len(_STAGED) <= since:
        return
    read = [file for df in keep for file in df.inputFiles()]
    spark = keep[0].sparkSession
    for path in _STAGED[since:]:
        name = path.rsplit("/", 1)[-1]  # unique, and the same whether or not a path names its file system
        if not any(f"/{name}/" in file for file in read):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            _STAGED.remove(path)
    free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that only finished, staged work has used.

    It removes them when the driver's garbage collector meets their owners, which may
    otherwise be long after the next step has filled the disks.
    """
    gc.collect()
    spark._jvm.System.gc()
