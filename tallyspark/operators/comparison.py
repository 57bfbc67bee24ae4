"""Comparing reports: what they were made with, where they differ, and metrics side by side without a hidden sample.

A report's conventions are rows (scenario, field, content). Interval series (coverage, risk-free returns, a benchmark) are
named by a digest of their rows that does not depend on order, so equal series are found equal without a join, and
benchmarks with equal contents merge. Where digests differ, ``interval_differences`` has the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ON = ["period_start", "session"]


def content_key(series: DataFrame, field: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """scenario, field, content: number of intervals and a digest of (period_start, session, columns), for each scenario."""
    row = [*ON, *columns]
    two = [F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return series.groupBy("scenario").agg(F.concat_ws(":", F.count("*").cast("string"), *two).alias("content")).select("scenario", F.lit(field).alias("field"), "content")


def differences(signatures: DataFrame, reference: str) -> DataFrame:
    """scenario, field, reference, actual of every field in which a scenario differs from the reference; a field that one lacks differs."""
    ref = signatures.where(F.col("scenario") == reference).select("field", F.col("content").alias("reference"))
    every = signatures.select("scenario").distinct().join(signatures.select("field").distinct())  # scenarios by fields: a few dozen rows
    d = every.join(signatures, ["scenario", "field"], "left").join(ref, "field", "left")
    return d.where(~F.col("content").eqNullSafe(F.col("reference"))).select("scenario", "field", "reference", F.col("content").alias("actual"))


def interval_differences(series: DataFrame, reference: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """scenario, period_start, session, side of intervals that only one of a scenario and the reference has, or whose values differ.

    Both ends are compared null-safely, so an interval that starts elsewhere is one on each side.
    """
    taken = lambda prefix, *first: [F.col(c).alias(f"{prefix}_{c}") for c in (*first, *ON, *columns)]
    names = series.where(F.col("scenario") != reference).select(F.col("scenario").alias("w_scenario")).distinct()
    wanted = names.join(series.where(F.col("scenario") == reference).select(*taken("w"), F.lit(True).alias("there")))  # the reference once for each scenario
    mine = series.where(F.col("scenario") != reference).select(*taken("m", "scenario"), F.lit(True).alias("here"))
    same = reduce(lambda a, b: a & b, (F.col(f"m_{c}").eqNullSafe(F.col(f"w_{c}")) for c in ("scenario", *ON)))
    d = mine.join(wanted, same, "full_outer").select(
        *(F.coalesce(f"m_{c}", f"w_{c}").alias(c) for c in ("scenario", *ON)), "here", "there",
        reduce(lambda a, b: a | b, (~F.col(f"m_{c}").eqNullSafe(F.col(f"w_{c}")) for c in columns), F.lit(False)).alias("other"),
    )
    side = F.when(F.col("there").isNull(), "only_scenario").when(F.col("here").isNull(), "only_reference").when(F.col("other"), "values_differ")
    return d.withColumn("side", side).where("side is not null").select("scenario", *ON, "side")


def check(diff: DataFrame, coverage: str = "strict", assumptions: str = "strict") -> DataFrame:
    """``diff`` if its differences are allowed: ``separate`` coverage or assumptions let the fields of that kind differ.

    Where coverage differs, risk-free and benchmark rows differ with it, so separate coverage needs separate assumptions too.
    """
    if {coverage, assumptions} - {"strict", "separate"}:
        raise ValueError("coverage and assumptions must be strict or separate")
    is_coverage = F.col("field") == "coverage"
    bad = diff.where((is_coverage & F.lit(coverage == "strict")) | (~is_coverage & F.lit(assumptions == "strict")))
    if found := bad.orderBy(~is_coverage, "scenario", "field").limit(5).collect():
        raise ValueError(f"reports differ, choose separate handling: {[(r['scenario'], r['field']) for r in found]}")
    return diff


def compared(metrics: DataFrame, benchmarks: DataFrame, signatures: DataFrame, label: str, separate: bool) -> DataFrame:
    """scenario, kind, metric, value, unit, n_obs, status: the scenarios' metrics, and those of each distinct benchmark once.

    ``benchmarks`` has the metric rows of each scenario's benchmark. Benchmarks of scenarios with equal signatures are one; it is
    named ``label``, with the first of its scenarios behind it if handling is separate.
    """
    columns = ["metric", "value", "unit", "n_obs", "status"]
    if twice := metrics.groupBy("scenario", "metric").count().where("count > 1").limit(5).collect():
        raise ValueError(f"a report has duplicate metrics: {[tuple(r)[:2] for r in twice]}")
    keys = signatures.groupBy("scenario").agg(F.sort_array(F.collect_list(F.struct("field", "content"))).alias("key"))  # some dozen fields
    first = keys.groupBy("key").agg(F.min("scenario").alias("scenario"))
    name = F.concat(F.lit(f"{label} ["), "scenario", F.lit("]")) if separate else F.lit(label)
    b = benchmarks.join(first, "scenario", "left_semi").select(name.alias("scenario"), F.lit("benchmark").alias("kind"), *columns)
    return metrics.select("scenario", F.lit("portfolio").alias("kind"), *columns).unionByName(b)
