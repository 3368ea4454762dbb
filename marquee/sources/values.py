"""Statistic files: one value per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def read_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_values(df: DataFrame, value: Column, path: str) -> None:
    df.select(value.cast("string").alias("value")).filter("value is not null").write.mode(
        "overwrite"
    ).text(path)
