"""Structured Streaming over the given tables: watermarked windows and the latest state of a key."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.catalogue import query
from plumbline.session import checkpoint_folder, table


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    source = spark.readStream.schema(table(spark, sf_dir, name).schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(hadoop):
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return source.parquet(path)


def run_to_end(frame: DataFrame) -> DataFrame:
    """Runs a stream over what is there, with its state in the shared checkpoint folder, and gives what it wrote."""
    spark = frame.sparkSession
    place = os.path.join(checkpoint_folder(spark), f"stream-{uuid.uuid4().hex}")
    frame.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{place}/out")


def issue_windows(issues: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """Issues per window and severity; a window is given out once the watermark has passed it, which the last one of a
    finite stream never is."""
    timed = issues.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", f"{days} days"), "severity").agg(F.count("*").alias("issues"), F.count("latency_ms").alias("timed"))
    return counted.select(F.col("window.start").cast("string").alias("window_start"), "severity", "issues", "timed")


@query("""WITH w AS (SELECT floor(epoch(created_at) / 2592000) AS slot, severity, latency_ms FROM review_issues WHERE created_at IS NOT NULL),
mark AS (SELECT max(epoch(created_at)) - 86400 AS mark FROM review_issues)
SELECT strftime(make_timestamp((slot * 2592000 * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS window_start, severity, count(*) AS issues, count(latency_ms) AS timed FROM w, mark
WHERE (slot + 1) * 2592000 <= mark GROUP BY slot, severity""")
def stream_issue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: watermarked tumbling windows over review issues as a stream."""
    return run_to_end(issue_windows(stream(spark, sf_dir, "review_issues")))
