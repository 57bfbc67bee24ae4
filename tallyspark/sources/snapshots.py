"""Snapshots: Parquet tables beside a manifest of rows, schemas and an order-free digest of the content.

Saving reads each table once: what goes by on its way into the files is counted and digested by an observation. Results can
carry their identity in the same way (``identified``), and whoever takes them checks it (``checked``).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyspark.contracts import ContractError


def _metrics(columns: list[str]) -> list:
    """Rows and two sums of hashes, which do not depend on order or partitioning."""
    hashed = lambda *seed: F.sum(F.xxhash64(*seed, *columns).cast("decimal(38,0)"))
    return [F.count("*").alias("rows"), hashed().alias("a"), hashed(F.lit(7)).alias("b")]


def _identity(df: DataFrame, row: dict) -> dict:
    schema = {c: df.schema[c].dataType.simpleString() for c in sorted(df.columns)}
    text = json.dumps([row["rows"], str(row["a"]), str(row["b"]), schema], sort_keys=True)
    return {"rows": row["rows"], "schema": schema, "sha256": hashlib.sha256(text.encode()).hexdigest()}


def identity(df: DataFrame) -> dict:
    """rows, schema and digest of a table, independent of row order and partitioning, in one aggregate."""
    return _identity(df, df.agg(*_metrics(sorted(df.columns))).first().asDict())


def _id(tables: dict[str, dict], metadata: dict) -> str:
    return hashlib.sha256(json.dumps({"format": 1, "metadata": metadata, "tables": tables}, sort_keys=True, allow_nan=False).encode()).hexdigest()


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def save_snapshot(tables: dict[str, DataFrame], metadata: dict, path: str) -> str:
    """Write the tables and the manifest; refuses an existing folder, and takes a half-written one away. Returns the snapshot id."""
    spark = next(iter(tables.values())).sparkSession
    place, files = _place(spark, path)
    if files.exists(place):
        raise ContractError(f"{path} exists already")
    try:
        found = {}
        for name, df in tables.items():
            seen = Observation()
            df.observe(seen, *_metrics(sorted(df.columns))).write.mode("errorifexists").parquet(f"{path}/{name}")
            found[name] = _identity(df, seen.get)
        manifest = {"format": 1, "metadata": metadata, "tables": found, "snapshot_id": _id(found, metadata)}
        spark.createDataFrame(
            [(json.dumps(manifest, sort_keys=True, allow_nan=False),)], "value string",
        ).coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    except BaseException:
        files.delete(place, True)
        raise
    return manifest["snapshot_id"]


def load_snapshot(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and metadata, after every table's digest and the id have been recomputed."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if _id(manifest["tables"], manifest["metadata"]) != manifest["snapshot_id"]:
        raise ContractError("the manifest does not match its snapshot_id")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}
    for n, df in tables.items():
        if identity(df) != manifest["tables"][n]:
            raise ContractError(f"table {n} does not match the manifest")
    return tables, manifest["metadata"]


def observed_rows(spark: SparkSession, path: str) -> DataFrame:
    """name, rows of the tables of a saved snapshot, as the writes have counted them."""
    tables = json.loads(spark.read.text(f"{path}/manifest").first()["value"])["tables"]
    return spark.createDataFrame([(n, t["rows"]) for n, t in sorted(tables.items())], "name string, rows long")


@dataclass(frozen=True)
class Identified:
    """Tables of a result with what identifies them: contents, schemas and metadata."""

    tables: dict[str, DataFrame]
    metadata: dict
    snapshot_id: str
    parents: tuple[str, ...] = field(default=())


def identified(tables: dict[str, DataFrame], metadata: dict, *parents: Identified) -> Identified:
    """A result that carries its identity; those of the results it was made from are part of it."""
    known = tuple(p.snapshot_id for p in parents)
    return Identified(dict(tables), dict(metadata), _id({n: identity(t) for n, t in tables.items()}, metadata | {"parents": known}), known)


def checked(result: Identified, *parents: Identified) -> Identified:
    """``result`` if its tables and metadata are what they were, and were made from ``parents`` where these are given."""
    if not isinstance(result, Identified):
        raise ContractError("a result with an identity is needed")
    now = _id({n: identity(t) for n, t in result.tables.items()}, result.metadata | {"parents": result.parents})
    if now != result.snapshot_id:
        raise ContractError("the result changed after it was made")
    if parents and tuple(p.snapshot_id for p in parents) != result.parents:
        raise ContractError("the result was made from other inputs")
    return result
