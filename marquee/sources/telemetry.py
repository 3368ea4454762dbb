"""Crawl events: append, read, reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.schema import TELEMETRY


def append_events(events: DataFrame, path: str) -> None:
    events.select("ts", "tag").write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).parquet(path)


def reset_events(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], TELEMETRY).write.mode("overwrite").parquet(path)
