"""Signals and research: rank IC, quantile spreads, lagged features, splits, standardising, selection, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.stats import average_rank, correlation


def by_date():
    return Window.partitionBy("signal_date")


def matched(signals: DataFrame, outcomes: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Inner join on (signal_date, asset); every key only one side has must be excluded by name, or it raises."""
    keys = ["signal_date", "asset"]
    odd = signals.select(*keys).join(outcomes.select(*keys), keys, "left_anti").unionByName(
        outcomes.select(*keys).join(signals.select(*keys), keys, "left_anti")
    )
    if exclusions is not None:
        odd = odd.join(exclusions.select(*keys), keys, "left_anti")
    if bad := odd.limit(5).collect():
        raise ValueError(f"signals and outcomes must have the same keys, first offenders {[tuple(r) for r in bad]}")
    return signals.join(outcomes, keys)


def rank_ic(pairs: DataFrame) -> DataFrame:
    """signal_date, n_assets, rank_ic, status: Spearman correlation of signal and forward return by date, ties averaged."""
    d = pairs.withColumn("x", average_rank("signal", "signal_date")).withColumn("y", average_rank("forward_return", "signal_date"))
    a = d.groupBy("signal_date").agg(
        F.count("*").alias("n_assets"), correlation("x", "y").alias("ic"), F.min("signal").alias("s0"),
        F.max("signal").alias("s1"), F.min("forward_return").alias("f0"), F.max("forward_return").alias("f1"),
    )
    status = F.when(F.col("n_assets") < 2, "insufficient_assets").when(F.col("s0") == F.col("s1"), "constant_signal").when(
        F.col("f0") == F.col("f1"), "constant_outcome",
    ).otherwise("ok")
    return a.select("signal_date", "n_assets", F.when(status == "ok", F.col("ic")).alias("rank_ic"), status.alias("status"))


def quantiles(pairs: DataFrame, q: int) -> DataFrame:
    """signal_date, quantile, n_assets, mean_signal, mean_forward_return: groups floor((i - 1) q / n) + 1 by (signal, asset)."""
    d = pairs.withColumn("i", F.row_number().over(by_date().orderBy("signal", "asset")) - 1).withColumn("n", F.count("*").over(by_date()))
    d = d.withColumn("flat", F.min("signal").over(by_date()) == F.max("signal").over(by_date())).where((F.col("n") >= q) & ~F.col("flat"))
    d = d.withColumn("quantile", (F.floor(F.col("i") * q / F.col("n")) + 1).cast("long"))
    return d.groupBy("signal_date", "quantile").agg(
        F.count("*").alias("n_assets"), F.avg("signal").alias("mean_signal"),
        F.avg("forward_return").alias("mean_forward_return"),
    )


def spreads(groups: DataFrame, q: int) -> DataFrame:
    """signal_date, high_minus_low: mean forward return of the highest group less that of the lowest."""
    pick = lambda k: F.max(F.when(F.col("quantile") == k, F.col("mean_forward_return")))
    return groups.groupBy("signal_date").agg((pick(q) - pick(1)).alias("high_minus_low"))


def over_dates(by_date: DataFrame, value: str, label: str) -> DataFrame:
    """metric, value, n_obs: mean, sample standard deviation and share of positive values over evaluated dates."""
    a = by_date.where(F.col(value).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("p"),
    )
    rows = [
        F.struct(F.lit(f"mean_{label}").alias("metric"), F.col("m").alias("value"), F.col("n").alias("n_obs")),
        F.struct(F.lit(f"{label}_std").alias("metric"), F.col("s").alias("value"), F.col("n").alias("n_obs")),
        F.struct(F.lit(f"positive_{label}_share").alias("metric"), F.col("p").alias("value"), F.col("n").alias("n_obs")),
    ]
    return a.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def lagged_features(observations: DataFrame, columns: tuple[str, ...], lags: tuple[int, ...]) -> DataFrame:
    """session, asset, <column>__lag<n> ..., available_at, n_missing, status (warmup, unavailable, ready).

    ``observations`` is a complete panel of (session, asset, close_at, available_at, columns): a lag counts
    supplied sessions. A feature row is usable when all its sources were available by the session's close.
    """
    w = Window.partitionBy("asset").orderBy("session")
    values = [F.lag(c, n).over(w).alias(f"{c}__lag{n}") for c in columns for n in lags]
    known = [F.lag("available_at", n).over(w).alias(f"__at{n}") for n in lags]
    d = observations.select("session", "asset", "close_at", *values, *known)
    ats = [F.col(f"__at{n}") for n in lags]
    absent = sum((F.when(a.isNull(), len(columns)).otherwise(0) for a in ats), F.lit(0))
    latest = F.greatest(*ats) if len(ats) > 1 else ats[0]
    d = d.withColumn("n_missing", absent.cast("long")).withColumn("available_at", F.when(absent == 0, latest))
    status = F.when(F.col("n_missing") > 0, "warmup").when(F.col("available_at") > F.col("close_at"), "unavailable").otherwise("ready")
    return d.withColumn("status", status).drop("close_at", *(f"__at{n}" for n in lags))


def chronological_split(
    features: DataFrame, labels: DataFrame, sessions: DataFrame, train_end: str, validation_end: str, test_end: str,
    gap: int = 0,
) -> DataFrame:
    """``features`` with label columns, partition and reason; only rows with reason ``included`` may be used.

    Reasons in their order: the feature status, boundary_gap, label_horizon_crosses_boundary,
    label_unavailable_at_boundary. Boundaries are sessions; the gap counts sessions after a boundary.
    """
    s = sessions.select(
        "session", F.col("close_at").alias("end_close"),
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session")).alias("k"),
    )
    ends = [F.lit(e).cast("date") for e in (train_end, validation_end, test_end)]
    part = F.when(F.col("session") <= ends[0], "train").when(F.col("session") <= ends[1], "validation").otherwise("test")
    end = F.when(F.col("session") <= ends[0], ends[0]).when(F.col("session") <= ends[1], ends[1]).otherwise(ends[2])
    d = features.where(F.col("session") <= ends[2]).join(
        labels.withColumnRenamed("available_at", "label_available_at"), ["session", "asset"], "left",
    )
    d = d.withColumn("partition", part).withColumn("boundary", end)
    d = d.join(F.broadcast(s.select("session", "k")), "session").join(
        F.broadcast(s.select(F.col("session").alias("boundary"), "end_close")), "boundary",
    )
    starts = F.broadcast(
        s.where(F.col("session").isin(train_end, validation_end)).select(
            F.when(F.col("session") == ends[0], "validation").otherwise("test").alias("partition"), F.col("k").alias("k0"),
        )
    )
    d = d.join(starts, "partition", "left")
    reason = (
        F.when(F.col("status") != "ready", F.col("status"))
        .when(F.col("k") <= F.col("k0") + gap, "boundary_gap")
        .when(F.col("label_end") > F.col("boundary"), "label_horizon_crosses_boundary")
        .when(F.col("label_available_at") > F.col("end_close"), "label_unavailable_at_boundary")
        .otherwise("included")
    )
    return d.withColumn("reason", reason).drop("k", "k0", "end_close", "boundary")


def standardize(split: DataFrame, columns: tuple[str, ...], zero_variance: str = "raise") -> DataFrame:
    """Included rows scaled by mean and sample deviation of the included training rows; others stay as they are."""
    train = split.where("partition = 'train' and reason = 'included'")
    stats = train.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    if zero_variance == "raise" and (bad := [c for c in columns if not stats.first()[f"__s_{c}"]]):
        raise ValueError(f"features without variance in training: {bad}")
    d = split.join(F.broadcast(stats))  # one row
    scaled = {c: F.when(F.col("reason") == "included", F.try_divide(F.col(c) - F.col(f"__m_{c}"), f"__s_{c}")).otherwise(F.col(c)) for c in columns}
    return d.withColumns(scaled).drop(*(f"__{n}_{c}" for c in columns for n in "ms"))


def candidate_losses(predictions: DataFrame, targets: DataFrame, metric: str = "mse") -> DataFrame:
    """candidate, loss, n_obs, selected: the lowest loss, then the first candidate by name, is selected."""
    e = F.col("prediction") - F.col("target")
    d = predictions.join(targets, ["session", "asset"]).groupBy("candidate").agg(
        F.avg(e * e if metric == "mse" else F.abs(e)).alias("loss"), F.count("*").alias("n_obs"),
    )
    return d.withColumn("selected", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("loss", "candidate")) == 1)


def signal_targets(signals: DataFrame, sessions: DataFrame, rebalance: str = "each_signal") -> DataFrame:
    """decision_session, session (the next one), asset, weight, gross_leverage, action (target or unchanged_target)."""
    nxt = sessions.select(
        F.col("session").alias("decision_session"),
        F.lead("session").over(Window.partitionBy(F.lit(0)).orderBy("session")).alias("session"),
    )
    by_date = signals.groupBy("decision_session").agg(
        F.sort_array(F.collect_list(F.struct("asset", "weight", "gross_leverage"))).alias("basket")
    )
    before = F.lag("basket").over(Window.partitionBy(F.lit(0)).orderBy("decision_session"))
    changed = F.lit(True) if rebalance == "each_signal" else ~F.col("basket").eqNullSafe(before)
    acts = by_date.withColumn("action", F.when(changed, "target").otherwise("unchanged_target")).select("decision_session", "action")
    return signals.join(F.broadcast(nxt), "decision_session").join(F.broadcast(acts), "decision_session").where(F.col("session").isNotNull()).select("decision_session", "session", "asset", "weight", "gross_leverage", "action")
