"""Whether the records of runs agree with each other: intervals, money, returns and the sequence of valuations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIVE, ABSOLUTE = 1e-10, 1e-8


def close_to(a: Column, b: Column, relative: float = RELATIVE, absolute: float = ABSOLUTE) -> Column:
    """Whether two numbers agree within either tolerance; a null agrees with nothing."""
    near = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.coalesce(near, F.lit(False))


def expected_phases(daily: DataFrame, events: DataFrame) -> DataFrame:
    """scenario, session, phase, place: the valuations a run must have, in order.

    Two stand at the entry, before and after it; each session ends with its close. ``events`` (scenario, session, kind) names sessions with one more before
    their close: ``rebalance`` (which goes first where a session has both) or ``reinvestment``.
    """
    entry = daily.groupBy("scenario").agg(F.min("period_start").alias("session"))
    entry = entry.select("scenario", "session", F.explode(F.array(F.lit("pre_entry"), F.lit("post_entry"))).alias("phase"))
    more = events.groupBy("scenario", "session").agg(F.max(F.col("kind") == "rebalance").alias("rebalance"))
    more = more.select("scenario", "session", F.when(F.col("rebalance"), "pre_rebalance").otherwise("pre_reinvestment").alias("phase"))
    days = daily.select("scenario", "session")
    more = more.join(days, ["scenario", "session"], "left_semi")
    d = entry.unionByName(more).unionByName(days.withColumn("phase", F.lit("close")))
    order = F.when(F.col("phase") == "pre_entry", 0).when(F.col("phase") == "post_entry", 1).when(F.col("phase") == "close", 3).otherwise(2)
    return d.withColumn("place", F.row_number().over(Window.partitionBy("scenario").orderBy("session", order)))


def run_problems(daily: DataFrame, valuations: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """scenario, session, rule of every record that disagrees; empty for sound runs.

    ``daily``: scenario, period_start, session, opening_equity, equity, pnl, simple_return, cumulative_pnl, cumulative_simple_return,
    compounded_return. ``valuations``: scenario, session, phase, equity, place (their order). ``runs``: scenario, capital, entry_session, end_session,
    actual_end_session, status, stop_reason, stop_session. ``events`` as in ``expected_phases``.
    """
    w = Window.partitionBy("scenario").orderBy("session")
    to_now = w.rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("simple_return")
    d = daily.join(F.broadcast(runs.select("scenario", "capital")), "scenario")  # one row for each run
    d = d.withColumn("before", F.coalesce(F.lag("equity").over(w), F.col("capital"))).withColumn("ended", F.lag("session").over(w))
    d = d.withColumn("added", F.sum(r).over(to_now)).withColumn("grown", F.product(1 + r).over(to_now))
    of = lambda a, b: ~close_to(F.col(a), b)
    rules = {
        "interval_reversed": F.col("period_start") >= F.col("session"), "interval_gap": F.col("ended").isNotNull() & ~F.col("period_start").eqNullSafe(F.col("ended")),
        "denominator_not_positive": F.col("before") <= 0, "opening_equity": of("opening_equity", F.col("before")), "pnl": of("pnl", F.col("equity") - F.col("before")),
        "simple_return": of("simple_return", F.try_divide("pnl", "before")), "cumulative_pnl": of("cumulative_pnl", F.col("equity") - F.col("capital")),
        "cumulative_simple_return": of("cumulative_simple_return", F.col("added")), "compounded_return": of("compounded_return", F.col("grown") - 1),
        "wealth": of("equity", F.col("capital") * F.col("grown")),
    }
    found = F.array_compact(F.array(*(F.when(broken, F.lit(rule)) for rule, broken in rules.items())))
    parts = [d.select("scenario", "session", F.explode(found).alias("rule"))]

    ends = daily.groupBy("scenario").agg(F.min("period_start").alias("first"), F.max("session").alias("last"))
    c = runs.join(ends, "scenario", "left")
    span = {
        "no_daily_records": F.col("first").isNull(), "capital_not_positive": ~F.coalesce(F.col("capital") > 0, F.lit(False)),
        "status_unknown": ~F.coalesce(F.col("status").isin("complete", "stopped"), F.lit(False)), "entry": F.col("first") != F.col("entry_session"),
        "actual_end": F.col("last") != F.col("actual_end_session"), "complete_before_its_end": (F.col("status") == "complete") & (F.col("actual_end_session") != F.col("end_session")),
        "stop_without_reason": (F.col("status") == "stopped") & (F.coalesce(F.trim("stop_reason"), F.lit("")) == ""),
        "stop_session": (F.col("status") == "stopped") & ~F.col("stop_session").eqNullSafe(F.col("last")),
    }
    found = F.array_compact(F.array(*(F.when(broken, F.lit(rule)) for rule, broken in span.items())))
    parts.append(c.select("scenario", F.lit(None).cast("date").alias("session"), F.explode(found).alias("rule")))

    # The expected and the observed sequence meet by what they name; what both have must stand in the same order.
    e, o = expected_phases(daily, events), valuations.select("scenario", "session", "phase", F.col("place").alias("seen"), "equity")
    both = e.join(o, ["scenario", "session", "phase"], "full_outer")
    order = Window.partitionBy("scenario").orderBy("place")
    met = both.where("place is not null and seen is not null").withColumn("before", F.lag("seen").over(order))
    first = F.min("seen").over(Window.partitionBy("scenario"))
    parts += [
        both.where("seen is null").select("scenario", "session", F.concat(F.lit("valuation_missing_"), "phase").alias("rule")),
        both.where("place is null").select("scenario", "session", F.concat(F.lit("valuation_unexpected_"), "phase").alias("rule")),
        met.where("seen <= before").select("scenario", "session", F.concat(F.lit("valuation_out_of_order_"), "phase").alias("rule")),
        met.withColumn("first", first).join(F.broadcast(runs.select("scenario", "capital")), "scenario")
        .where(((F.col("phase") == "pre_entry") & ~close_to(F.col("equity"), F.col("capital"), 1e-9, 0.0)) | ((F.col("phase") == "post_entry") & ~F.coalesce(F.col("equity") > 0, F.lit(False))))
        .select("scenario", "session", F.lit("entry_valuation").alias("rule")),
        met.where("phase = 'close'").select("scenario", "session", "equity").join(daily.select("scenario", "session", F.col("equity").alias("booked")), ["scenario", "session"])
        .where(~close_to(F.col("equity"), F.col("booked"))).select("scenario", "session", F.lit("close_valuation").alias("rule")),
    ]
    return reduce(DataFrame.unionByName, parts)


def validated(daily: DataFrame, valuations: DataFrame, runs: DataFrame, events: DataFrame, allow_partial: bool = False) -> DataFrame:
    """``daily`` if its runs are sound and, unless ``allow_partial``, complete; else ValueError with the first offenders."""
    if not allow_partial and (cut := runs.where("status <> 'complete'").limit(5).collect()):
        raise ValueError(f"runs are not complete: {[r['scenario'] for r in cut]}")
    if bad := run_problems(daily, valuations, runs, events).orderBy("scenario", "session", "rule").limit(5).collect():
        raise ValueError(f"records of runs disagree, first offenders {[tuple(map(str, r)) for r in bad]}")
    return daily
