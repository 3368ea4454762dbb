"""Counts kept as sketches, one row per part of a catalog, that can be stored, replaced part by part and united (A7, A8, A10).

A sketch has a fixed size, whatever it has seen: ``distinct`` tells how many different values there are (a HyperLogLog
of 2^LG_K registers), ``frequent`` which are common (at most ``TRACKED`` values with upper bounds of their counts). Tasks
send sketches, never values, so no frequent value meets in one task. To add titles, only their part is read.

The bounds: the distinct number is within ``DISTINCT_ERROR`` of the estimate (four standard errors of a union, so it
holds but for one case in 15,000); the number of times a value occurs is never above its estimate and never below it
by more than ``COUNT_ERROR`` of all rows. Nulls are no values. Parts without values have no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 14
TRACKED = 10_000
DISTINCT_ERROR = 4 * 1.04 / math.sqrt(2**LG_K)
#: A sketch of frequent items is wrong by 3.5 rows in the size of its table: a power of two, three fourths filled.
COUNT_ERROR = 3.5 / 2 ** math.ceil(math.log2(TRACKED / 0.75))


def sketch_parts(values: DataFrame, column: str, part: Column) -> DataFrame:
    """``(part, rows, distinct, frequent)``: the sketches of every part's values, combined in each task before they move."""
    named = values.select(part.alias("part"), F.col(column).alias("value")).filter(F.col("value").isNotNull())
    return named.groupBy("part").agg(
        F.count("*").alias("rows"),
        F.hll_sketch_agg("value", LG_K).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("frequent"),
    )


def store_parts(sketches: DataFrame, path: str) -> None:
    """Writes the parts in ``sketches`` and leaves other stored ones; a part that is written again is replaced."""
    writer = sketches.repartition("part").write.mode("overwrite").partitionBy("part")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def stored_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def united(sketches: DataFrame) -> DataFrame:
    """One row with the sketches of all parts together; none without parts, as Spark has no union of no frequent values."""
    return sketches.groupBy(F.lit(0).alias("_all")).agg(
        F.sum("rows").alias("rows"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    ).drop("_all")


def distinct_estimate(sketches: DataFrame) -> DataFrame:
    """One row ``(estimate, low, high)``: about how many different values there are, and the bounds.

    A sketch that was never merged also knows the order of its values and tells another number, so it is united with itself:
    the estimate then follows from the registers alone, and does not depend on how parts, or tasks, were cut.
    """
    estimate = F.coalesce(F.hll_sketch_estimate(F.hll_union("distinct", "distinct")), F.lit(0))
    return sketches.agg(F.hll_union_agg("distinct").alias("distinct")).select(
        estimate.alias("estimate"),
        F.floor(estimate / (1 + DISTINCT_ERROR)).alias("low"),
        F.ceil(estimate / (1 - DISTINCT_ERROR)).alias("high"),
    )


def frequent_estimates(sketches: DataFrame, k: int) -> DataFrame:
    """``(value, low, high)`` of about the ``k`` most frequent values: the bounds hold for how often each occurs."""
    listed = united(sketches).select("rows", F.expr(f"inline(approx_top_k_estimate(frequent, {k}))"))
    low = F.greatest(F.col("count") - F.ceil(F.col("rows") * COUNT_ERROR), F.lit(1))
    return listed.select(F.col("item").alias("value"), low.alias("low"), F.col("count").alias("high"), "rows")


def heavy_values(values: DataFrame, column: str, sketches: DataFrame, share: float) -> DataFrame:
    """``(value, count)``, exact, of every value that makes up more than ``share`` of all values.

    ``sketches`` are those of the same values. As their counts are never too low, they name every such value among
    at most ``1 / (share - COUNT_ERROR)`` candidates. Only these are broadcast and counted, so the others never move.
    """
    if share < 2 * COUNT_ERROR:
        raise ValueError(f"share must be {2 * COUNT_ERROR} or more")
    most = min(TRACKED, math.ceil(1 / (share - COUNT_ERROR)))
    candidates = frequent_estimates(sketches, most).filter(F.col("high") > F.col("rows") * share).select("value", "rows")
    named = values.select(F.col(column).alias("value")).filter(F.col("value").isNotNull())
    counted = named.join(F.broadcast(candidates), "value").groupBy("value", "rows").agg(F.count("*").alias("count"))
    return counted.filter(F.col("count") > F.col("rows") * share).select("value", "count")
