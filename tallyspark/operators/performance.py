"""The performance report of a daily series: seeded cumulative tables, a benchmark, tails in returns and money.

``daily`` is a table of ``reports.net_asset_value``. A benchmark is a table of the same intervals with ``b``, its
simple return. Everything is windows and aggregates within the keys, so many scenarios are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.stats import correlation, slope
from tallyspark.operators import reports

DENOMINATORS = ("portfolio_returns", "excess_returns")
KEYS = ("scenario",)


def metric_rows(a: DataFrame, keys: tuple[str, ...], rows: list[tuple[str, Column, str, Column]], n: str = "n_obs") -> DataFrame:
    """keys, metric, value, unit, n_obs, status from one row of aggregates for each key."""
    structs = [
        F.struct(
            F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(u).alias("unit"), F.col(n).alias("n_obs"),
            s.alias("status"),
        )
        for m, v, u, s in rows
    ]
    return a.select(*keys, F.explode(F.array(*structs)).alias("m")).select(*keys, "m.*")


def aligned(daily: DataFrame, other: DataFrame, value: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``daily`` with the ``value`` of a table that has the same (period_start, session) intervals, else an error.

    ``other`` holds one series for all scenarios; it is small, as it has one row for each interval.
    """
    on = ["period_start", "session"]
    if other.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError("an interval is repeated")
    ours, theirs = daily.select(*on).distinct(), other.select(*on)
    odd = ours.join(theirs, on, "left_anti").unionByName(theirs.join(ours, on, "left_anti"))
    if bad := odd.limit(5).collect():
        raise ValueError(f"intervals must match at both ends, first offenders {[tuple(map(str, r)) for r in bad]}")
    return daily.join(other.select(*on, value), on)


def scalar_risk_free(daily: DataFrame, annual_effective: float, periods: float) -> DataFrame:
    """``daily`` with ``rf``: the same periodic rate, whose compounding over ``periods`` is the annual one."""
    if annual_effective <= -1:
        raise ValueError("an annual rate must be above -1")
    return daily.withColumn("rf", F.expm1(F.log1p(F.lit(float(annual_effective))) / float(periods)))


def summary(
    daily: DataFrame, periods: float, minimum: float = 0.0, denominator: str = "portfolio_returns",
    keys: tuple[str, ...] = KEYS, exact: bool = False,
) -> DataFrame:
    """The nine metrics of ``reports.summary`` with dated risk-free returns in ``rf``.

    ``denominator``: the Sharpe ratio is over the volatility of the returns, or over that of the excess returns.
    """
    if denominator not in DENOMINATORS:
        raise ValueError(f"denominator must be one of {DENOMINATORS}")
    base = reports.summary(daily, periods, minimum=minimum, keys=keys, exact=exact).where("metric <> 'sharpe'")
    excess = F.col("simple_return") - F.col("rf")
    over = excess if denominator == "excess_returns" else F.col("simple_return")
    a = daily.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.avg(excess).alias("mean"), F.stddev_samp(over).alias("vol"))
    flat = "zero_excess_volatility" if denominator == "excess_returns" else "zero_volatility"
    status = F.when(F.col("n_obs") < 2, "insufficient_samples").when(F.col("vol") == 0, flat).otherwise("ok")
    sharpe = [("sharpe", F.try_divide(F.col("mean") * float(periods) ** 0.5, F.col("vol")), "ratio", status)]
    return base.unionByName(metric_rows(a, keys, sharpe))


def cumulative(daily: DataFrame, value: str, series: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, session, series, cumulative_simple_return, compounded_return, wealth; seeded with 0, 0, 1 at the first start."""
    run = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    v, names = F.col(value), ("cumulative_simple_return", "wealth")
    d = daily.select(*keys, "session", F.sum(v).over(run).alias(names[0]), F.product(1 + v).over(run).alias(names[1]))
    seed = daily.groupBy(*keys).agg(F.min("period_start").alias("session"), F.lit(0.0).alias(names[0]), F.lit(1.0).alias(names[1]))
    d = seed.unionByName(d)
    return d.select(*keys, "session", F.lit(series).alias("series"), names[0], (F.col("wealth") - 1).alias("compounded_return"), "wealth")


def against_benchmark(daily: DataFrame, capital: float, periods: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Metric rows of ``daily`` (with ``b``) against its benchmark, also relative wealth and the difference in points."""
    r, b, root = F.col("simple_return"), F.col("b"), float(periods) ** 0.5
    a = daily.withColumn("active", r - b).groupBy(*keys).agg(
        F.count("*").alias("n_obs"), correlation("b", "simple_return").alias("corr"), slope("b", "simple_return").alias("beta"),
        F.stddev_samp("active").alias("tracking"), F.avg("active").alias("mean"), F.stddev_samp("simple_return").alias("r_vol"), F.stddev_samp("b").alias("b_vol"),
        F.product(1 + b).alias("b_wealth"), F.max_by("equity", "session").alias("equity"), F.max_by("wealth", "session").alias("wealth"),
    )
    few = F.when(F.col("n_obs") < 2, "insufficient_samples")
    ok, flat = F.lit("ok"), (F.col("b_vol") == 0) | (F.col("r_vol") == 0)
    rows = [
        ("return_correlation", F.col("corr"), "correlation", few.when(flat, "zero_volatility").otherwise("ok")),
        ("beta", F.col("beta"), "ratio", few.when(F.col("b_vol") == 0, "zero_benchmark_variance").otherwise("ok")),
        ("annualized_tracking_error", F.col("tracking") * root, "fraction/sqrt(year)", few.otherwise("ok")),
        (
            "information_ratio", F.try_divide(F.col("mean") * root, F.col("tracking")), "ratio",
            few.when(F.col("tracking") == 0, "zero_tracking_error").otherwise("ok"),
        ),
        ("benchmark_compounded_return", F.col("b_wealth") - 1, "fraction", ok),
        ("compounded_return_difference", 100 * (F.col("wealth") - F.col("b_wealth")), "percentage_points", ok),
        ("relative_wealth_return", F.try_divide(F.col("equity"), capital * F.col("b_wealth")) - 1, "fraction", ok),
    ]
    return metric_rows(a, keys, rows)


def benchmark_daily(daily: DataFrame, capital: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The benchmark as a daily series of its own, for the same reports: equity starts at the capital."""
    run = Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.select(
        *keys, "period_start", "session", F.col("b").alias("simple_return"),
        F.product(1 + F.col("b")).over(run).alias("wealth"),
    )
    d = d.withColumn("equity", F.lit(float(capital)) * F.col("wealth")).withColumn(
        "pnl", F.col("equity") - F.col("equity") / (1 + F.col("simple_return")),
    )
    return d.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(float(capital)), F.max("equity").over(run)) - 1)


def tails(daily: DataFrame, confidences: tuple[str, ...], scenarios: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, confidence, var_return, etl_return, var_pnl, etl_pnl, n_obs, n_tail, n_tail_pnl, status.

    Returns and money have tails of their own, which may hold different intervals. Of ``scenarios`` those without a
    row have the status ``empty_sample``.
    """
    r = reports.tail_risk(daily, confidences, keys).withColumnsRenamed({"threshold": "var_return", "tail_mean": "etl_return"})
    p = reports.tail_risk(daily, confidences, keys, "pnl").withColumnsRenamed(
        {"threshold": "var_pnl", "tail_mean": "etl_pnl", "n_tail": "n_tail_pnl"}
    )
    n = daily.groupBy(*keys).agg(F.count("*").alias("n_obs"))
    out = r.join(p, [*keys, "confidence"]).join(n, list(keys)).withColumn("status", F.lit("ok"))
    if scenarios is not None:
        levels = F.explode(F.array(*map(F.lit, confidences)))
        grid = scenarios.select(*keys).distinct().withColumn("confidence", levels)
        out = grid.join(out, [*keys, "confidence"], "left")
        out = out.fillna(0, ["n_obs", "n_tail", "n_tail_pnl"]).fillna("empty_sample", ["status"])
    return out.select(*keys, "confidence", "var_return", "etl_return", "var_pnl", "etl_pnl", "n_obs", "n_tail", "n_tail_pnl", "status")


def compare(reports_by_label: dict[str, tuple[DataFrame, dict]]) -> DataFrame:
    """Metric rows of several reports, by label. Reports must agree in what they were made with (their signatures).

    Each value is (metric rows, signature): periods, currency, hurdle, interval ends and whatever else must be equal.
    """
    from functools import reduce

    if len(reports_by_label) < 2:
        raise ValueError("at least two reports are compared")
    (first, (_, want)), *rest = sorted(reports_by_label.items())
    for label, (_, has) in rest:
        if odd := sorted(k for k in want.keys() | has.keys() if want.get(k) != has.get(k)):
            raise ValueError(f"reports {first} and {label} differ in {odd}")
    return reduce(DataFrame.unionByName, [d.withColumn("report", F.lit(k)) for k, (d, _) in sorted(reports_by_label.items())])
