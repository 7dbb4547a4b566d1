"""Structured Streaming over event tables: tumbling windows, read back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.stored import shared_folder


def tumbling(spark: SparkSession, path: str, width: str = "1 hour") -> DataFrame:
    """(event_type, hour, n, total) of all events under ``path``, by an available-now stream with checkpointed state.

    The sink replaces its table with each batch's complete result, so that a repeated batch changes nothing; state and
    sink live in the folder that driver and executors share.
    """
    folder = shared_folder(spark, "stream")
    events = _source(spark, path).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    counts = events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    stream = counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.read.parquet(f"{folder}/result")
    return rows.select("event_type", F.unix_timestamp("w.start").alias("hour"), "n", F.round("total", 6).alias("total"))


def _source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the rows under ``path``, a folder or one file."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        # a stream reads folders: a single file is its folder, filtered by name
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


def closed_windows(spark: SparkSession, path: str, folder: str, width: str = "1 hour", delay: str = "2 hours", files: int | None = None) -> tuple[DataFrame, int]:
    """(event_type, hour, n, total) of the windows that the watermark has closed, and how many rows came too late.

    Windows are counted in event time and appended once, when no row within ``delay`` of the latest one can fall into them
    any more; their state goes then, so state is bounded by the delay, and rows of closed windows are dropped and counted.
    The run goes on from the checkpoint in ``folder``; a repeated batch writes nothing twice.
    """
    events = _source(spark, path, files).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", delay)
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    rows = counts.select("event_type", F.unix_timestamp("w.start").alias("hour"), "n", F.round("total", 6).alias("total"))
    stream = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/result").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    late = sum(int(o["numRowsDroppedByWatermark"]) for p in stream.recentProgress for o in p["stateOperators"])
    return spark.read.schema(rows.schema).parquet(f"{folder}/result"), late
