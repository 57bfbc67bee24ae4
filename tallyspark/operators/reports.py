"""Performance reports of a daily P&L or return series, one row of aggregates each, unpivoted to metric rows.

A series may carry a ``scenario`` column; every window and aggregate is within it, so many runs are reported in
one plan and no window is without a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.exact import exact_sums
from tallyspark.functions.stats import adjusted_kurtosis, adjusted_skewness, correlation, slope
from tallyspark.lineage import small
from tallyspark.operators import selection


#: Rows of a group that one task may order by value.
SORTED = 1_000_000


def _by(*keys: str):
    return Window.partitionBy(*keys).orderBy("session")


def net_asset_value(pnl: DataFrame, capital: float, keys: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """keys, period_start, session, pnl, cumulative_pnl, equity, simple_return, wealth, drawdown.

    The first denominator is the initial capital, which is also the first peak. A return on a value of zero is
    null, and so is what is derived from it (``nav_problems`` names such rows).
    """
    run = _by(*keys).rowsBetween(Window.unboundedPreceding, 0)
    d = pnl.withColumn("cumulative_pnl", F.sum("pnl").over(run))
    d = d.withColumn("equity", F.lit(capital) + F.col("cumulative_pnl"))
    d = d.withColumn("simple_return", F.try_divide("pnl", F.col("equity") - F.col("pnl")))
    d = d.withColumn("wealth", F.col("equity") / capital)
    return d.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(float(capital)), F.max("equity").over(run)) - 1)


def nav_problems(daily: DataFrame, keys: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """keys, session, problem: rows that started from a value of zero or less, or ended there."""
    before = F.col("equity") - F.col("pnl")
    problem = F.when(before <= 0, "nonpositive_start").when(F.col("equity") <= 0, "nonpositive_end")
    return daily.select(*keys, "session", problem.alias("problem")).where(F.col("problem").isNotNull())


def summary(
    daily: DataFrame, periods: float, minimum: float = 0.0, risk_free: float = 0.0, keys: tuple[str, ...] = ("scenario",), exact: bool = False,
) -> DataFrame:
    """keys, metric, value, unit, n_obs, status; ``minimum`` and ``risk_free`` are returns of one period.

    Volatility has one degree of freedom less than observations; the Sharpe ratio is over the volatility of
    the returns; Sortino's downside is over all observations. Undefined metrics are null with a status. With ``exact`` all
    sums are exact (``exact_sums``): the report has the same bits for any partitioning.
    """
    r, root = F.col("simple_return"), float(periods) ** 0.5
    a = daily.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max_by("equity", "session").alias("ending_equity"), F.sum("pnl").alias("cumulative_pnl"), F.sum(r).alias("cumulative_simple_return"),
        (F.max_by("wealth", "session") - 1).alias("compounded_return"), (F.avg(r) * periods).alias("annualized_arithmetic_mean"), F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.stddev_samp(r).alias("vol"), F.avg(r).alias("mean"), F.sqrt(
            F.avg(F.pow(F.least(r - minimum, F.lit(0.0)), F.lit(2.0)))
        ).alias("down"),
    )
    if exact:
        a = _exact(daily, a, periods, minimum, keys)
    few, n = F.col("n") < 2, F.col("n")
    flat = F.when(few, "insufficient_samples").when(F.col("vol") == 0, "zero_volatility").otherwise("ok")
    rows = [
        ("ending_equity", F.col("ending_equity"), "money", F.lit("ok")), ("cumulative_pnl", F.col("cumulative_pnl"), "money", F.lit("ok")),
        (
            "cumulative_simple_return", F.col("cumulative_simple_return"), "fraction", F.lit("ok"),
        ), ("compounded_return", F.col("compounded_return"), "fraction", F.lit("ok")),
        (
            "annualized_arithmetic_mean", F.col("annualized_arithmetic_mean"), "fraction/year", F.lit("ok"),
        ), ("max_drawdown", F.col("max_drawdown"), "fraction", F.lit("ok")),
        ("annualized_volatility", F.col("vol") * root, "fraction/sqrt(year)", F.when(few, "insufficient_samples").otherwise("ok")),
        ("sharpe", F.try_divide((F.col("mean") - risk_free) * root, F.col("vol")), "ratio", flat),
        (
            "sortino", F.when(~few, F.try_divide((F.col("mean") - minimum) * root, F.col("down"))), "ratio",
            F.when(few, "insufficient_samples").when(F.col("down") == 0, "zero_downside_risk").otherwise("ok"),
        ),
    ]
    structs = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(u).alias("unit"), n.alias("n_obs"), s.alias("status")) for m, v, u, s in rows]
    return a.select(*keys, F.explode(F.array(*structs)).alias("m")).select(*keys, "m.*")


def _exact(daily: DataFrame, a: DataFrame, periods: float, minimum: float, keys: tuple[str, ...]) -> DataFrame:
    """The aggregates of ``summary`` with every sum made exactly; deviations are from the exact mean, in a second pass."""
    on, r = list(keys), F.col("simple_return")
    short = F.least(r - minimum, F.lit(0.0))
    sums = exact_sums(daily, keys, {"s_pnl": F.col("pnl"), "s_r": r, "s_down": short * short})
    a = a.join(sums, on).withColumn("mean", F.col("s_r") / F.col("n"))
    off = r - F.col("mean")
    spread = exact_sums(daily.join(small(a.select(*keys, "mean")), on), keys, {"s_off": off * off})
    return a.join(spread, on).withColumns({
        "cumulative_pnl": F.col("s_pnl"), "cumulative_simple_return": F.col("s_r"), "annualized_arithmetic_mean": F.col("mean") * periods,
        "vol": F.sqrt(F.try_divide(F.col("s_off"), F.col("n") - 1)), "down": F.sqrt(F.col("s_down") / F.col("n")),
    })


def rolling_risk(
    daily: DataFrame, window: int, periods: float, keys: tuple[str, ...] = ("scenario",), benchmark: str | None = None,
) -> DataFrame:
    """keys, session, n_obs, annualized_volatility, sharpe, statuses and, with a benchmark column, beta and correlation."""
    w = _by(*keys).rowsBetween(-(window - 1), 0)
    r, root = F.col("simple_return"), float(periods) ** 0.5
    full = F.count("*").over(w) == window
    d = daily.withColumn("n_obs", F.count("*").over(w)).withColumn(
        "vol", F.when(full, F.stddev_samp(r).over(w)),
    ).withColumn("mean", F.avg(r).over(w))
    status = F.when(F.col("vol").isNull(), "insufficient_samples")
    out = [
        *keys, "session", "n_obs", (F.col("vol") * root).alias("annualized_volatility"),
        F.try_divide(F.col("mean") * root, F.col("vol")).alias("sharpe"), status.otherwise("ok").alias("volatility_status"),
        status.when(F.col("vol") == 0, "zero_volatility").otherwise("ok").alias("sharpe_status"),
    ]
    if benchmark:
        b = F.col(benchmark)
        d = d.withColumn("cov", F.when(full, F.covar_samp(b, r).over(w))).withColumn("b_vol", F.stddev_samp(b).over(w))
        out += [
            F.try_divide("cov", F.col("b_vol") * F.col("b_vol")).alias("beta"),
            F.try_divide("cov", F.col("b_vol") * F.col("vol")).alias("correlation"),
        ]
    return d.select(*out)


def tail_risk(
    daily: DataFrame, confidences: tuple[str, ...], keys: tuple[str, ...] = ("scenario",), value: str = "simple_return",
) -> DataFrame:
    """keys, confidence, threshold, tail_mean, n_tail: value at the descending rank ceil(c n), and the mean at or below it.

    Confidences are decimal strings, so that the rank is exact (0.07 of 100 is 7, not 8). Where a group has more than SORTED rows,
    ranks are found by counting (``selection``), so no task orders a whole group; the results are the same.
    """
    largest = daily.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if (largest or 0) > SORTED:
        return selection.tail_by_counts(daily, confidences, keys, value)
    levels = daily.sparkSession.createDataFrame([(c,) for c in confidences], "confidence string")
    d = daily.select(
        *keys, F.col(value).alias("v"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value))).alias("rank"),
        F.count("*").over(Window.partitionBy(*keys)).alias("n"),
    )
    d = d.join(F.broadcast(levels)).withColumn("at", F.ceil(F.col("confidence").cast("decimal(12,10)") * F.col("n")))
    t = d.groupBy(*keys, "confidence").agg(F.max(F.when(F.col("rank") == F.col("at"), F.col("v"))).alias("threshold"))
    on = ["confidence", *keys]
    d = d.join(t, on).where("v <= threshold")
    return d.groupBy(*on).agg(F.max("threshold").alias("threshold"), F.avg("v").alias("tail_mean"), F.count("*").alias("n_tail"))


def higher_moments(daily: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.count(value).alias("n_obs"), adjusted_skewness(value).alias("skewness"),
        adjusted_kurtosis(value).alias("excess_kurtosis"),
    )


def growth(daily: DataFrame, periods: float, days_per_year: float = 365.25, keys: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """CAGR by trading periods and by calendar time, and Calmar; null where wealth is not positive or nothing was lost."""
    a = daily.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.max_by("wealth", "session").alias("w"),
        F.datediff(F.max("session"), F.min("period_start")).alias("days"), F.least(F.min("drawdown"), F.lit(0.0)).alias("dd"),
    )
    rate = lambda years: F.when(F.col("w") > 0, F.expm1(F.ln("w") / years))
    a = a.withColumn("cagr_periods", rate(F.col("n_obs") / periods)).withColumn("cagr_calendar", rate(F.col("days") / days_per_year))
    status = F.when(F.col("w") <= 0, "nonpositive_ending_wealth").when(F.col("dd") == 0, "zero_drawdown").otherwise("ok")
    return a.select(
        *keys, "n_obs", "cagr_periods", "cagr_calendar", F.try_divide("cagr_calendar", F.abs("dd")).alias("calmar"),
        status.alias("calmar_status"),
    )


def against_benchmark(series: DataFrame, periods: float, keys: tuple[str, ...]) -> DataFrame:
    """Correlation, beta, tracking error and information ratio of ``r`` against ``b`` on the same intervals."""
    root = float(periods) ** 0.5
    a = series.withColumn("active", F.col("r") - F.col("b")).groupBy(*keys).agg(
        F.count("*").alias("n_obs"), correlation("b", "r").alias("correlation"), slope("b", "r").alias("beta"), (F.stddev_samp("active") * root).alias("tracking_error"), (F.avg("active") * periods).alias("active_mean")
    )
    return a.select(
        *keys, "n_obs", "correlation", "beta", "tracking_error",
        F.try_divide("active_mean", "tracking_error").alias("information_ratio"),
    )


def histogram(values: DataFrame, value: str, bins: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, bin (from 1), low, high, n: equal bins between the smallest and largest value; the last is closed."""
    edges = values.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    d = values.join(edges, list(keys)).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    d = d.withColumn(
        "bin",
        F.when(F.col("width") == 0, 1).otherwise(
            F.least(F.lit(bins), F.floor((F.col(value) - F.col("lo")) / F.nullif("width", F.lit(0.0))) + 1)
        ).cast("long"),
    )
    return d.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.max(F.col("lo") + F.col("width") * (F.col("bin") - 1)).alias("low"),
        F.max(F.col("lo") + F.col("width") * F.col("bin")).alias("high"),
    )
