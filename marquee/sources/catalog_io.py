"""The catalog dump as JSON lines, and as Parquet for repeated use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.schema import CATALOG

_BROKEN = "_broken"


def read_dump(
    spark: SparkSession, path: str, fail_fast: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(records, quarantine)`` of a JSON-lines dump, a file or a directory of part files.

    A dump written here holds each record's ``movie_id``. In another one it is the hash of the record and the
    name of its file, so it does not depend on how the files are split; equal records of one file share it.
    Broken lines and records without a title go to the quarantine as text; with ``fail_fast`` a broken line
    ends the job.
    """
    schema = T.StructType(
        [*CATALOG.fields, T.StructField("movie_id", T.LongType()), T.StructField(_BROKEN, T.StringType())]
    )
    reader = spark.read.schema(schema)
    if fail_fast:
        rows = reader.option("mode", "FAILFAST").json(path)
    else:
        rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).json(path)
    usable = F.col(_BROKEN).isNull() & F.col("title").isNotNull()
    names = [f.name for f in CATALOG.fields]
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = rows.withColumn("movie_id", F.coalesce("movie_id", F.xxhash64(file, F.to_json(F.struct(*names)))))
    text = F.coalesce(F.col(_BROKEN), F.to_json(F.struct(*names)))
    return (
        rows.filter(usable).select("movie_id", *names),
        rows.filter(~usable).select(text.alias("line")),
    )


def write_dump(records: DataFrame, path: str, merged: bool = False) -> None:
    """Records as JSON lines, replacing an earlier dump.

    ``merged`` makes parts of any number one ordered dump: each task writes a range of ids, sorted, and the names of the
    files are in the order of their ranges, so to read them one after another is to read the whole in order.
    """
    ids = [c for c in ("movie_id",) if c in records.columns]
    rows = records.select(*ids, *[f.name for f in CATALOG.fields])
    if merged:
        rows = rows.repartitionByRange("movie_id").sortWithinPartitions("movie_id")
    rows.write.mode("overwrite").json(path)


def dry_run(df: DataFrame) -> None:
    """Computes every row and keeps none."""
    df.write.format("noop").mode("overwrite").save()
