"""Streaming counts of events (an addition: the blueprint's sources have no streaming operators)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder


def hourly_counts(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 hour")
    return events.groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a path or pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def run_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with a day's watermark, drained into Parquet in the shared folder.

    Rows are written once their hour is past the watermark; the last hours, which a stream would hold back for late
    events, are closed by the end of the data: they are counted from what is there.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a file source takes a folder or a pattern; the pattern matches a table that is one file as well as one that is a folder
    events = stream(spark, f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = hourly_counts(events.withWatermark("ts", "1 day"))
    q = counts.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.schema(counts.schema).parquet(f"{folder}/out")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = batch.agg((F.max("ts") - F.expr("interval 1 day")).alias("mark")).first()["mark"]
    late = hourly_counts(batch.where(F.date_trunc("hour", "ts") + F.expr("interval 1 hour") > F.lit(end)))
    out = done.unionByName(late.join(done, ["event_type", "start"], "left_anti"))
    return out.withColumn("start", F.col("start").cast(hourly_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).schema["start"].dataType))
