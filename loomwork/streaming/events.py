"""Streaming twins of the event reports (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.staging import shared_dir


def read_events(spark: SparkSession, path: str, schema: StructType, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event files as a stream with a watermark."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, width: str, by: str, value: str) -> DataFrame:
    return events.groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, time: str, width: str, step: str, by: str) -> DataFrame:
    return events.groupBy(F.window(time, width, step), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, gap: str, user: str) -> DataFrame:
    return events.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str) -> DataFrame:
    return events.dropDuplicatesWithinWatermark([key])


def drain(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, then stop; its table as a batch DataFrame.

    The rows go from the executors to Parquet in the shared folder.  A complete result
    replaces that of the trigger before; the other modes add to it.
    """
    spark = result.sparkSession
    import uuid

    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = result.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "complete":
        spark.createDataFrame([], result.schema).write.parquet(f"{place}/out")  # stays if there is no trigger
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{place}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{place}/out")
    writer.start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{place}/out")
