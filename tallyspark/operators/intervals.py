"""Calendars and intervals: as-of and interval joins, contiguity, security status, trading calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.lineage import small


def asof(left: DataFrame, right: DataFrame, at: str, known: str, value_columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with the columns of the last ``right`` row whose ``known`` is not after ``at`` (same ``by``); null if none.

    Both sides are one stream in time order and each left row takes the last value before it, so neither
    side is joined by ranges. Without ``by`` the stream is one partition: use it for calendars.
    """
    keys = list(by)
    l = left.withColumn("__left", F.struct(*left.columns)).select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__o"), "__left", F.lit(None).alias("__right"))  # noqa: E741
    r = right.withColumn("__right", F.struct(*value_columns)).select(
        *keys, F.col(known).alias("__t"), F.lit(0).alias("__o"), F.lit(None).alias("__left"), "__right",
    )
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    u = l.unionByName(r).withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__o = 1")
    return u.select("__left.*", *(F.col(f"__last.{c}").alias(c) for c in value_columns))


def rate_plan(days: DataFrame, rates: DataFrame, spread_bps: float, max_age_days: int, timezone: str = "America/New_York") -> DataFrame:
    """date, cutoff_at, observation_date, rate_age_days, sofr, borrowing_rate, status for each accrual date.

    The rate is the last one published by the local midnight that starts the date; older than the age limit,
    or absent, it is null with a status.
    """
    d = days.select("date", F.to_utc_timestamp(F.col("date").cast("timestamp"), timezone).alias("cutoff_at"))
    d = asof(d, rates, "cutoff_at", "available_at", ("observation_date", "sofr"))
    d = d.withColumn("rate_age_days", F.datediff("date", "observation_date").cast("long"))
    status = F.when(F.col("sofr").isNull(), "no_rate").when(F.col("rate_age_days") > max_age_days, "stale").otherwise("ok")
    d = d.withColumn("status", status)
    return d.select(
        "date", "cutoff_at", "observation_date", "rate_age_days", F.when(status == "ok", F.col("sofr")).alias("sofr"),
        F.when(status == "ok", F.col("sofr") + spread_bps / 10_000).alias("borrowing_rate"), "status",
    )


def resolve_aliases(observations: DataFrame, aliases: DataFrame, ticker: str = "ticker", day: str = "date") -> DataFrame:
    """``observations`` with ``asset`` and ``n_matches``: windows (ticker, valid_from, valid_to or open) that hold the day.

    An equi-join on the ticker carries the range as a residual condition. Exactly one matching asset resolves, also
    where several windows name it; none or several leave asset null, and ``require_resolved`` raises for them. Matches
    are counted once for each distinct (ticker, day) and joined back, so repeated observations stay as many rows.
    """
    a = aliases.select(F.col(ticker).alias("__ticker"), "asset", "valid_from", "valid_to")
    on = (F.col(ticker) == F.col("__ticker")) & (F.col(day) >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col(day) <= F.col("valid_to"))
    )
    days = observations.select(ticker, day).distinct()
    found = days.join(a, on, "left").groupBy(ticker, day).agg(F.count_distinct("asset").alias("n_matches"), F.min("asset").alias("asset"))
    found = found.select(
        F.col(ticker).alias("__t"), F.col(day).alias("__d"), F.when(F.col("n_matches") == 1, F.col("asset")).alias("asset"),
        "n_matches",
    )
    same = F.col(ticker).eqNullSafe(F.col("__t")) & F.col(day).eqNullSafe(F.col("__d"))
    return observations.join(found, same).drop("__t", "__d")


def require_resolved(resolved: DataFrame) -> DataFrame:
    if bad := resolved.where("n_matches <> 1").limit(5).collect():
        raise ValueError(f"every observation needs exactly one alias, first offenders {[tuple(r) for r in bad]}")
    return resolved.drop("n_matches")


def contiguity(intervals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``intervals`` with ``contiguous``: whether an interval starts where its predecessor ended (true for the first)."""
    before = F.lag("session").over(Window.partitionBy(*keys).orderBy("session"))
    return intervals.withColumn("contiguous", before.isNull() | (before == F.col("period_start")))


def quote_status(sessions: DataFrame, securities: DataFrame, prices: DataFrame, suspensions: DataFrame) -> DataFrame:
    """session, asset, status, tradable of every session and security, by priority:
    terminated, not_listed, unquoted_after_last_session, suspended, quoted; ``missing`` if a quote was due."""
    grid = small(sessions.select("session")).join(securities)  # every session of every security is the result
    s = suspensions.select(F.col("asset").alias("s_asset"), F.col("first_session").alias("s_from"), F.col("last_session").alias("s_to"))
    halted = grid.join(
        s, (F.col("asset") == F.col("s_asset")) & F.col("session").between(F.col("s_from"), F.col("s_to")), "left_semi",
    ).select("session", "asset", F.lit(True).alias("halted"))
    d = grid.join(halted, ["session", "asset"], "left").join(prices.select("session", "asset", "close"), ["session", "asset"], "left")
    status = (
        F.when(F.col("session") >= F.col("terminated_date"), "terminated")
        .when(F.col("session") < F.col("first_session"), "not_listed")
        .when(F.col("session") > F.col("last_session"), "unquoted_after_last_session")
        .when(F.col("halted"), "suspended")
        .when(F.col("close").isNull(), "missing")
        .otherwise("quoted")
    )
    return d.select("session", "asset", status.alias("status"), (status == "quoted").alias("tradable"))


def session_slice(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """The sessions from ``start`` to ``end``; raises where the calendar does not reach from one to the other."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    span = sessions.agg((F.min("session") <= a).alias("low"), (F.max("session") >= b).alias("high")).first()
    if not (span["low"] and span["high"]):
        raise ValueError(f"the calendar does not cover {start} to {end}")
    return sessions.where(F.col("session").between(a, b))


def skipped_sessions(intervals: DataFrame, sessions: DataFrame) -> DataFrame:
    """``intervals`` with ``n_skipped``: sessions of the calendar strictly between an interval's ends; null if an end is no session."""
    k = sessions.select("session", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session")).alias("k"))
    d = intervals.join(
        F.broadcast(k.select(F.col("session").alias("__s"), F.col("k").alias("__k0"))), F.col("period_start") == F.col("__s"),
        "left",
    )
    d = d.drop("__s").join(F.broadcast(k.withColumnRenamed("k", "__k1")), "session", "left")
    return d.withColumn("n_skipped", (F.col("__k1") - F.col("__k0") - 1).cast("long")).drop("__k0", "__k1")


def security_status(status: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """A table of ``quote_status`` with the ticker and exchange valid on each session, and what was announced by its close."""
    a = aliases.select(F.col("asset").alias("__asset"), "ticker", "exchange", "valid_from", "valid_to")
    valid = (F.col("asset") == F.col("__asset")) & (F.col("session") >= F.col("valid_from")) & (
        F.col("session") <= F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    )
    d = status.join(a, valid, "left").drop("__asset", "valid_from", "valid_to")
    return d.join(known, ["session", "asset"], "left")


def combined_calendar(calendars: list[DataFrame], how: str) -> DataFrame:
    """session, close_at of several calendars: their union or intersection, with the latest close."""
    if how not in ("union", "intersection"):
        raise ValueError("how must be union or intersection")
    d = reduce(DataFrame.unionByName, calendars).groupBy("session").agg(F.max("close_at").alias("close_at"), F.count("*").alias("n"))
    return (d if how == "union" else d.where(F.col("n") == len(calendars))).drop("n")


def shared_calendar(sessions: DataFrame, by: str) -> DataFrame:
    """session, close_at of the sessions that every value of ``by`` has, with the latest close: any number of calendars in one grouping."""
    d = sessions.groupBy("session").agg(F.max("close_at").alias("close_at"), F.count_distinct(by).alias("n"))
    every = sessions.agg(F.count_distinct(by).alias("every"))
    return d.join(F.broadcast(every), F.col("n") == F.col("every")).select("session", "close_at")  # one row
