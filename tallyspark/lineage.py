"""Cutting lineage in loops: reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A table of at most this many rows may be sent to every executor.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by spark.checkpoint.dir.

    Where the setting is absent, a session of this machine alone gets a temporary folder; on a cluster that is an error.
    """
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            local = tempfile.mkdtemp(prefix="tally-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            folder = f"file://{local}"
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written into the shared folder and read from there: a lost executor costs nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[str]:
    """A new path in the shared folder, deleted in the end."""
    path = f"{shared_folder(spark)}/tally/{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is broadcast if its counted rows allow it."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
