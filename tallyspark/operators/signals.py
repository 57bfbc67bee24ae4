"""Signal diagnostics by date: matching with named exclusions, groups, spreads, coverage and a summary over dates.

Every date that has a signal or an outcome appears in each table; a date that cannot be grouped says why. All of it is
windows and grouped aggregates within a date, so dates run in parallel and no table is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["signal_date", "asset"]


def unmatched(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """signal_date, asset, side: keys that only one side has."""
    s, o = signals.select(*KEYS), outcomes.select(*KEYS)
    alone = s.join(o, KEYS, "left_anti").withColumn("side", F.lit("signal_without_outcome"))
    return alone.unionByName(o.join(s, KEYS, "left_anti").withColumn("side", F.lit("outcome_without_signal")))


def reconciled(signals: DataFrame, outcomes: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matched rows, and the unmatched ones with their reasons.

    Raises for an unmatched key without a reason, for a reason given to a matched key, and for a key excluded twice.
    """
    if twice := exclusions.groupBy(*KEYS).count().where("count > 1").limit(5).collect():
        raise ValueError(f"exclusions must name each key once, got {[tuple(map(str, r)) for r in twice]}")
    odd = unmatched(signals, outcomes)
    unexplained = odd.join(exclusions.select(*KEYS), KEYS, "left_anti").withColumn("what", F.lit("unexplained"))
    needless = exclusions.select(*KEYS).join(odd.select(*KEYS), KEYS, "left_anti")
    needless = needless.select(*KEYS, F.lit(None).cast("string").alias("side"), F.lit("excluded although matched").alias("what"))
    if bad := unexplained.unionByName(needless).limit(5).collect():
        raise ValueError(f"exclusions must name the unmatched keys and no others, first offenders {[tuple(map(str, r)) for r in bad]}")
    return signals.join(outcomes, KEYS), odd.join(exclusions.select(*KEYS, "reason"), KEYS)


def outcome_problems(outcomes: DataFrame, same_session: bool = False) -> DataFrame:
    """signal_date, asset, problem: intervals that end before they start, look back, start at the signal, or differ within a date.

    ``same_session``: whether an outcome may start at the close of its signal's session.
    """
    start, end = F.col("period_start"), F.col("period_end")
    date = outcomes.groupBy("signal_date").agg(F.count_distinct(F.struct("period_start", "period_end")).alias("intervals"))
    d = outcomes.join(date, "signal_date")
    problem = F.when(end <= start, "reversed_interval").when(start < F.col("signal_date"), "backward_looking")
    if not same_session:
        problem = problem.when(start == F.col("signal_date"), "starts_at_signal")
    problem = problem.when(F.col("intervals") > 1, "mixed_intervals")
    return d.select("signal_date", "asset", problem.alias("problem")).where(F.col("problem").isNotNull())


def _label(i: Column, n: Column, q: int, grouping: str) -> Column:
    """The group of position i (from 0) of n, lowest signals first; null where a position belongs to none."""
    if grouping == "equal_count":
        return (F.floor(i * q / n) + 1).cast("long")
    m = F.floor(n / q)
    middle = 2 + F.floor((i - m) * (q - 2) / F.nullif(n - 2 * m, F.lit(0))) if q > 2 else F.lit(None)
    return F.when(i < m, 1).when(i >= n - m, q).otherwise(middle).cast("long")


def grouped(pairs: DataFrame, q: int, grouping: str = "equal_count", ties: str = "asset_order") -> DataFrame:
    """``pairs`` with ``label`` and ``group_status`` of the date.

    ``grouping``: ``equal_count``, or ``extremes`` (lowest and highest floor(n / q), the rest split among the others).
    ``ties``: ``asset_order`` splits equal signals by asset, ``reject_boundary_ties`` leaves dates ungrouped where equal
    signals would fall into two groups.
    """
    if q < 2 or grouping not in ("equal_count", "extremes") or ties not in ("asset_order", "reject_boundary_ties"):
        raise ValueError("q must be 2 or more, grouping equal_count or extremes, ties asset_order or reject_boundary_ties")
    date, tied = Window.partitionBy("signal_date"), Window.partitionBy("signal_date", "signal")
    d = pairs.withColumn("i", F.row_number().over(date.orderBy("signal", "asset")) - 1).withColumn("n", F.count("*").over(date))
    d = d.withColumn("label", _label(F.col("i"), F.col("n"), q, grouping))
    place = F.coalesce("label", F.lit(0))
    d = d.withColumn("torn", (F.min(place).over(tied) < F.max(place).over(tied)) if ties == "reject_boundary_ties" else F.lit(False))
    status = (
        F.when(F.col("n") < q, "insufficient_assets_for_quantiles")
        .when(F.min("signal").over(date) == F.max("signal").over(date), "constant_signal")
        .when(F.max("torn").over(date), "tie_at_group_boundary")
        .otherwise("ok")
    )
    d = d.withColumn("group_status", status)
    return d.withColumn("label", F.when(F.col("group_status") == "ok", F.col("label"))).drop("i", "n", "torn")


def group_table(labelled: DataFrame, dates: DataFrame, q: int) -> DataFrame:
    """signal_date, quantile, n_assets, mean_signal, mean_forward_return, status: q rows for each of ``dates``."""
    by_date = labelled.groupBy("signal_date").agg(F.max("group_status").alias("status"))
    grid = dates.join(by_date, "signal_date", "left").withColumn(
        "quantile", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(q).cast("long"))),
    )
    means = labelled.where("label is not null").groupBy("signal_date", F.col("label").alias("quantile")).agg(
        F.count("*").alias("n_assets"), F.avg("signal").alias("mean_signal"), F.avg("forward_return").alias("mean_forward_return")
    )
    out = grid.join(means, ["signal_date", "quantile"], "left")
    status = F.coalesce("status", F.lit("insufficient_assets_for_quantiles"))
    count = F.coalesce("n_assets", F.lit(0).cast("long")).alias("n_assets")
    return out.select("signal_date", "quantile", count, "mean_signal", "mean_forward_return", status.alias("status"))


def spread_table(groups: DataFrame, q: int) -> DataFrame:
    """signal_date, n_low, n_high, high_minus_low, status from a group table."""
    pick = lambda k, c: F.max(F.when(F.col("quantile") == k, F.col(c)))
    spread = pick(q, "mean_forward_return") - pick(1, "mean_forward_return")
    return groups.groupBy("signal_date").agg(
        pick(1, "n_assets").alias("n_low"), pick(q, "n_assets").alias("n_high"), spread.alias("high_minus_low"), F.max("status").alias("status")
    )


def coverage(signals: DataFrame, outcomes: DataFrame, labelled: DataFrame, excluded: DataFrame) -> DataFrame:
    """signal_date, n_signals, n_outcomes, n_matched, n_excluded, n_unassigned of every date that has either side."""
    one = lambda d, *what: d.select("signal_date", *(F.lit(1 if c in what else 0).alias(c) for c in names))
    names = ("n_signals", "n_outcomes", "n_matched", "n_excluded", "n_unassigned")
    rows = one(signals, "n_signals").unionByName(one(outcomes, "n_outcomes")).unionByName(one(excluded, "n_excluded"))
    rows = rows.unionByName(one(labelled.where("label is not null"), "n_matched"))
    rows = rows.unionByName(one(labelled.where("label is null"), "n_matched", "n_unassigned"))
    return rows.groupBy("signal_date").agg(*(F.sum(c).alias(c) for c in names))


def summary(by_date: DataFrame, value: str, label: str, unit: str) -> DataFrame:
    """metric, value, unit, n_obs, status over dates: mean, deviation, positive share, evaluated and unevaluated dates."""
    v = F.col(value)
    a = by_date.agg(
        F.count(v).alias("n"), F.count("*").alias("total"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.avg(F.when(v > 0, 1.0).when(v.isNotNull(), 0.0)).alias("share"),
    )
    n, none = F.col("n"), F.when(F.col("n") == 0, "no_evaluated_dates").otherwise("ok")
    rows = [
        (f"mean_{label}", F.col("mean"), unit, none),
        (f"{label}_std", F.when(n >= 2, F.col("std")), unit, F.when(n >= 2, "ok").otherwise("insufficient_dates")),
        (f"positive_{label}_share", F.col("share"), "fraction", none),
        (f"evaluated_{label}_dates", n.cast("double"), "dates", F.lit("ok")),
        (f"unevaluated_{label}_dates", (F.col("total") - n).cast("double"), "dates", F.lit("ok")),
    ]
    structs = [F.struct(F.lit(m).alias("metric"), x.alias("value"), F.lit(u).alias("unit"), n.alias("n_obs"), s.alias("status")) for m, x, u, s in rows]
    return a.select(F.explode(F.array(*structs)).alias("m")).select("m.*")
