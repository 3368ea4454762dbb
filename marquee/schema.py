"""Schemas of the catalog dump, the page archive, requests and telemetry."""

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType(), True)

#: One crawled record, as written to and read from JSON lines.
CATALOG = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("hours", T.FloatType()),
        T.StructField("minutes", T.FloatType()),
        T.StructField("title", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("cover", T.StringType()),
        T.StructField("director", T.StringType()),
        T.StructField("genre", _STRINGS),
        T.StructField("nationalities", _STRINGS),
        T.StructField("score_press", T.FloatType()),
        T.StructField("reviews_press", T.FloatType()),
        T.StructField("score_viewers", T.FloatType()),
        T.StructField("reviews_viewers", T.FloatType()),
        T.StructField("pictures", _STRINGS),
        T.StructField("actors", _STRINGS),
        T.StructField("synopsis", T.StringType()),
        T.StructField("misc", T.StringType()),
        T.StructField("trailer", T.StringType()),
        T.StructField("rank", T.FloatType()),
    ]
)

#: Stored web pages; a null ``html`` is a failed fetch.
ARCHIVE = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)

#: ``feature`` is "d" (discover), "f" (full detail) or "a" (analyse).
REQUESTS = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("feature", T.StringType()),
        T.StructField("input", T.StringType()),
    ]
)

TELEMETRY = T.StructType(
    [T.StructField("ts", T.TimestampType()), T.StructField("tag", T.StringType())]
)
