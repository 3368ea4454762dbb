"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder the cluster shares, so later steps do not compute it again.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session may lack it; it then gets a
    folder of its own. Spark's cleaner can drop the files once nothing refers to them.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="marquee-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def known(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose number of (narrow) rows has been counted: at most a million."""
    return F.broadcast(df) if rows <= 1_000_000 else df


def null_safe(name: str) -> Column:
    """A join key that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batches(frames: Iterator) -> Iterator:
    """The non-empty record batches of a ``mapInArrow`` input."""
    return (batch for batch in frames if batch.num_rows)
