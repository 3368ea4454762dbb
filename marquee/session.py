"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from marquee.packed import PACKED, packed, unpacked


def build_session(app: str = "marquee", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; every one can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call site per column
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster shares (``spark.checkpoint.dir``).

    Only a local session may lack one, as in a test: it gets a folder that goes with the process. On a
    cluster executors would each write to a disk of their own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="marquee-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` below the folder the cluster shares; later steps read it, partition by partition.

    What was shuffled for it is not needed any more and goes at once.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(scratch_path(df.sparkSession, "checkpoint"))
    kept = df.checkpoint()
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)
    return kept


def settle_packed(df: DataFrame) -> DataFrame:
    """``settle`` for very many rows: kept packed, they take a small part of the disk."""
    return settle(df.mapInArrow(packed, PACKED)).select("rows").mapInArrow(unpacked, df.schema)
