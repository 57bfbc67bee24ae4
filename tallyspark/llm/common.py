"""Shared pieces of the corpus operators: the shared folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the blank and the control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"

#: A key table of at most this many rows may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by spark.checkpoint.dir.

    Only where the setting is absent and the session runs in this process (local tests), a temporary folder of
    this machine is set; a cluster without the setting is an error, as its executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="tally-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{local}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    An executor that is lost later costs nothing, as the files do not live on it.
    """
    path = f"{shared_dir(df.sparkSession)}/tally/{label}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


#: Paths of tables written inside each open ``scratch``.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the tables written inside, when it ends, but for those put into the list it gives.

    What is kept belongs to the scratch around it, if there is one: it goes when that one ends.
    """
    kept: list[DataFrame] = []
    _SCRATCH.append([])
    try:
        yield kept
    finally:
        paths, needed = _SCRATCH.pop(), {d.written_path for d in kept}
        if _SCRATCH:
            _SCRATCH[-1].extend(needed)
        for path in set(paths) - needed:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that clash with no column of ``df`` (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        name = f"__{n}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def semi(df: DataFrame, keys: DataFrame, on: list[tuple[str, str]], how: str = "left_semi") -> DataFrame:
    """Null-safe semi or anti join with a key table, broadcast only if its counted size allows it."""
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    cond = None
    for a, b in on:
        c = df[a].eqNullSafe(keys[b])
        cond = c if cond is None else cond & c
    return df.join(keys, cond, how)
