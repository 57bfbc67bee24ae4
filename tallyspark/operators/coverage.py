"""Exact coverage without a grid: gaps and islands within each asset instead of a calendar joined with every asset.

What is missing or not expected comes as ranges, so a table that lacks a year of one asset yields one row. ``cells`` opens
ranges into keys. Each asset's own days are ordered, as many as the calendar has at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.lineage import small


def _ranges(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """asset, problem, first, last of integer places ``k``: what ``rows`` (asset, k) lack of ``spans`` (asset, low, high), or have beyond."""
    d = rows.groupBy("asset", "k").agg(F.count("*").alias("n")).join(spans, "asset", "left")
    inside = F.col("k").between(F.col("low"), F.col("high"))
    known = d.where(inside)
    after = F.lead("k").over(Window.partitionBy("asset").orderBy("k"))
    gaps = known.select("asset", (F.col("k") + 1).alias("first"), (after - 1).alias("last")).where("first <= last")
    ends = spans.join(known.groupBy("asset").agg(F.min("k").alias("a"), F.max("k").alias("b")), "asset", "left").where("low <= high")
    edges = F.when(F.col("a").isNull(), F.array(F.struct(F.col("low").alias("first"), F.col("high").alias("last")))).otherwise(
        F.array(F.struct(F.col("low").alias("first"), (F.col("a") - 1).alias("last")), F.struct((F.col("b") + 1).alias("first"), F.col("high").alias("last")))
    )
    gaps = gaps.unionByName(ends.select("asset", F.explode(edges).alias("e")).select("asset", "e.*").where("first <= last"))
    odd = d.where(F.col("low").isNull() | ~inside).withColumn("problem", F.when(F.col("low").isNull(), "unknown_asset").otherwise("unexpected"))
    odd = odd.unionByName(known.where("n > 1").withColumn("problem", F.lit("repeated")))
    island = F.col("k") - F.row_number().over(Window.partitionBy("asset", "problem").orderBy("k"))
    odd = odd.withColumn("island", island).groupBy("asset", "problem", "island").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    return gaps.select("asset", F.lit("missing").alias("problem"), "first", "last").unionByName(odd.drop("island"))


def date_cover(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """asset, problem, first, last, n: calendar dates that ``rows`` (asset, date) lack of ``spans`` (asset, first, last), or have beyond them.

    Problems: ``missing``, ``unexpected`` (outside of the asset's span), ``unknown_asset`` and ``repeated``. A span
    that ends before it starts asks for nothing.
    """
    day, date = F.unix_date, F.date_from_unix_date
    s = spans.select("asset", day("first").alias("low"), day("last").alias("high"))
    out = _ranges(rows.select("asset", day("date").alias("k")), s)
    return out.select("asset", "problem", date("first").alias("first"), date("last").alias("last"), (F.col("last") - F.col("first") + 1).cast("long").alias("n"))


def session_cover(rows: DataFrame, sessions: DataFrame, assets: DataFrame) -> DataFrame:
    """asset, problem, first, last, n: the same over trading sessions, which every asset of ``assets`` must have all.

    Sessions get their number in the calendar, so neighbours differ by one. A row on no session is ``off_calendar``.
    """
    k = sessions.select("session").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session")))  # a calendar
    placed = rows.select("asset", "session").join(small(k), "session", "left")
    last = k.agg(F.max("k").alias("high"))
    spans = assets.select("asset").distinct().withColumn("low", F.lit(1)).join(F.broadcast(last))  # one row
    out = _ranges(placed.where("k is not null").select("asset", "k"), spans)
    start, end = (k.select(F.col("session").alias(f"{c}_session"), F.col("k").alias(c)) for c in ("first", "last"))
    out = out.join(small(start), "first").join(small(end), "last")
    out = out.select("asset", "problem", F.col("first_session").alias("first"), F.col("last_session").alias("last"), (F.col("last") - F.col("first") + 1).cast("long").alias("n"))
    off = placed.where("k is null").groupBy("asset", F.col("session").alias("first")).agg(F.count("*").alias("n"))
    return out.unionByName(off.select("asset", F.lit("off_calendar").alias("problem"), "first", F.col("first").alias("last"), "n"))


def cells(ranges: DataFrame, day: str = "date") -> DataFrame:
    """asset, problem, day: every date of each range of ``date_cover``."""
    return ranges.select("asset", "problem", F.explode(F.sequence("first", "last")).alias(day))


def borrow_plan(rates: DataFrame, spans: DataFrame, timezone: str = "America/New_York") -> DataFrame:
    """date, asset, annual_rate, available_at, cutoff_at, status of each accrual date of every asset that may be short.

    ``rates``: date, asset, annual_rate, available_at; ``spans``: asset, entry, end and terminated (null if none). Dates run from the
    day after the entry to the end, for terminated assets up to the day before. Rates must cover just these,
    else ValueError with the first ranges. ``status``: ok, or ``late`` where a rate was not known by the local midnight that starts its date.
    """
    s = spans.select("asset", F.date_add("entry", 1).alias("first"), F.least("end", F.date_sub("terminated", 1)).alias("last"))
    if bad := date_cover(rates, s).orderBy("asset", "first").limit(5).collect():
        raise ValueError(f"borrow rates must cover every date and asset exactly, first offenders {[tuple(map(str, r)) for r in bad]}")
    cutoff = F.to_utc_timestamp(F.col("date").cast("timestamp"), timezone)
    status = F.when(F.col("available_at") > F.col("cutoff_at"), "late").otherwise("ok")
    return rates.select("date", "asset", "annual_rate", "available_at", cutoff.alias("cutoff_at")).withColumn("status", status)
