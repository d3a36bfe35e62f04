"""A folder that driver and executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, a temporary one if driver and executors are one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="driftloom-")
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: Shuffle files of a table's query go once it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in a new shared folder: its lineage is cut, and it outlives the executors that made it."""
    path = folder(df.sparkSession, label)
    before = df.sparkSession.conf.get(_CLEANUP)
    df.sparkSession.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: a small table that many steps read, dealt out as it was."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
