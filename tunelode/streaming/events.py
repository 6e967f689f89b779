"""The events table read as a stream: an extension, run to the end of what there is and written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def source(spark: SparkSession, sf_dir: str, late: str = "2 days") -> DataFrame:
    """events as a stream with event time `at`."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def finished(out: DataFrame, tag: str) -> DataFrame:
    """The last state of a complete-mode stream; each batch replaces the result as a whole, so a retried one is safe."""
    spark = out.sparkSession
    at = f"{shared_dir(spark)}/tunelode/{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{tag}")

    run = out.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/{tag}")


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = source(spark, sf_dir).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return finished(day, "days").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = source(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("status"))
    return finished(last, "latest")
