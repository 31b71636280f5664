"""Streams over a snapshot folder; an extension, the batch operators don't need it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.session import scratch_dir


def events(spark: SparkSession, folder: str, late: str = "40 days") -> DataFrame:
    """The event table as a stream: new part files are new events."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 50)
    # a single file is a folder of one by its name
    source = stream.option("pathGlobFilter", "*.parquet").parquet(path if _is_dir(spark, path) else f"{folder}/event*.parquet")
    return source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def windowed_counts(spark: SparkSession, folder: str, size: str = "1 day") -> DataFrame:
    """Events and their value by type in tumbling windows; state is one row a
    window and type."""
    e = events(spark, folder)
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events(spark, folder).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")


def sessions(spark: SparkSession, folder: str, gap: str = "6 hours") -> DataFrame:
    e = events(spark, folder)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read the result as a table."""
    root = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
