"""Returns: simple, log, total and cumulative returns, correlation, risk-free interval returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.stats import correlation


def by_asset():
    return Window.partitionBy("asset").orderBy("session")


def returns(panel: DataFrame, method: str = "simple", splits: DataFrame | None = None, dividends: DataFrame | None = None) -> DataFrame:
    """period_start, session, asset, value of each holding interval; the first of an asset is null.

    With ``splits`` and ``dividends`` (raw prices) the total return reinvests at the ex-date close:
    ``(close + dividends) * ratio`` over the previous close. ``method``: simple or log.
    """
    if method not in ("simple", "log"):
        raise ValueError("method must be simple or log")
    p, worth = panel.select("session", "asset", "close"), F.col("close")
    if dividends is not None:
        d = dividends.groupBy("asset", F.col("ex_session").alias("session")).agg(F.sum("cash_per_share").alias("cash"))
        p, worth = p.join(d, ["asset", "session"], "left"), worth + F.coalesce("cash", F.lit(0.0))
    if splits is not None:
        p = p.join(splits.select("asset", F.col("effective_session").alias("session"), "ratio"), ["asset", "session"], "left")
        worth = worth * F.coalesce("ratio", F.lit(1.0))
    before = F.lag("close").over(by_asset())
    change = (worth - before) / before
    # log1p keeps small changes, the difference of logarithms extreme ones
    logs = F.when((change > -1) & (change < float("inf")), F.log1p(change)).otherwise(F.ln(worth) - F.ln(before))
    return p.select(
        F.lag("session").over(by_asset()).alias("period_start"), "session", "asset", (change if method == "simple" else logs).alias("value"),
    )


#: Price bases that serve each basis of returns.
BASES = {"price": ("raw", "split_adjusted"), "total_return": ("total_return_adjusted",)}


def outside_wealth(panel: DataFrame, rets: DataFrame, method: str = "simple") -> DataFrame:
    """session, asset, problem: prices or returns beyond representable positive wealth.

    ``nonpositive_price``: a close that is null, not finite, zero or less; ``outside_wealth``: a later return that is null or not
    finite, or a simple one of -1 or less.
    """
    c, v, inf = F.col("close"), F.col("value"), float("inf")
    odd = panel.where(c.isNull() | F.isnan(c) | (c <= 0) | (c == inf)).select("session", "asset", F.lit("nonpositive_price").alias("problem"))
    lost = v <= -1 if method == "simple" else F.lit(False)
    bad = rets.where(F.col("period_start").isNotNull() & (v.isNull() | F.isnan(v) | (F.abs(v) == inf) | lost))
    return odd.unionByName(bad.select("session", "asset", F.lit("outside_wealth").alias("problem")))


def market_returns(
    panel: DataFrame, price_basis: str, basis: str, method: str = "simple", dividend_policy: str | None = None, splits: DataFrame | None = None,
    dividends: DataFrame | None = None,
) -> DataFrame:
    """``returns`` of a panel whose ``price_basis`` is stated, guarded: bases that do not go together and impossible returns raise.

    Price returns take raw or split-adjusted closes (raw ones keep the jumps of splits). Total returns take closes that are
    adjusted for them, or raw ones with their splits and dividends and the policy ``reinvest_ex_close``, which nothing else may state.
    """
    reinvests = basis == "total_return" and price_basis == "raw"
    if reinvests and dividend_policy != "reinvest_ex_close":
        raise ValueError("total returns of raw prices need dividend_policy='reinvest_ex_close'")
    if not reinvests and dividend_policy is not None:
        raise ValueError("a dividend policy belongs to total returns of raw prices only")
    if not reinvests and price_basis not in BASES.get(basis, ()):
        raise ValueError(f"returns on the basis {basis} cannot be taken from prices that are {price_basis}")
    out = returns(panel, method, splits if reinvests else None, dividends if reinvests else None)
    if bad := outside_wealth(panel, out, method).orderBy("asset", "session").limit(5).collect():
        raise ValueError(f"returns outside representable positive wealth, first offenders {[tuple(map(str, r)) for r in bad]}")
    return out


def cumulative_returns(rets: DataFrame, method: str, kind: str = "simple") -> DataFrame:
    """``rets`` with ``cumulative``: sum, compound or wealth since the first session of each asset.

    ``kind`` names what ``value`` holds: simple or log returns. Wealth of log returns is the exponential of
    their running sum. The first row of an asset, which has neither value nor period_start, stays null.
    """
    if method not in ("sum", "compound", "wealth") or kind not in ("simple", "log"):
        raise ValueError("method must be sum, compound or wealth, and kind simple or log")
    to_now = by_asset().rowsBetween(Window.unboundedPreceding, 0)
    added = F.sum("value").over(to_now)
    wealth = F.exp(added) if kind == "log" else F.product(1 + F.col("value")).over(to_now)
    total = {"sum": added, "compound": wealth - 1, "wealth": wealth}[method]
    return rets.withColumn("cumulative", F.when(F.col("value").isNotNull(), total))


def return_problems(rets: DataFrame, kind: str = "simple") -> DataFrame:
    """session, asset, problem: rows that cannot be accumulated.

    ``leading_value``: the first row of an asset has a value or a start; ``missing_value``: a later one has none or
    one that is not finite; ``gap``: an interval does not start where the one before ended; ``no_wealth``: a simple return
    of -1 or less; ``repeated_key``: an asset has a session twice.
    """
    before = F.lag("session").over(by_asset())
    v, start, first = F.col("value"), F.col("period_start"), before.isNull()
    problem = (
        F.when(before == F.col("session"), "repeated_key")
        .when(first & (v.isNotNull() | start.isNotNull()), "leading_value")
        .when(~first & (v.isNull() | F.isnan(v) | F.abs(v).eqNullSafe(F.lit(float("inf")))), "missing_value")
        .when(~first & ~start.eqNullSafe(before), "gap")
    )
    problem = problem.when(v <= -1, "no_wealth") if kind == "simple" else problem
    return rets.select("session", "asset", problem.alias("problem")).where(F.col("problem").isNotNull())


def checked_returns(rets: DataFrame, kind: str = "simple") -> DataFrame:
    """``rets`` unless it has problems: these raise, with the first offenders."""
    if bad := return_problems(rets, kind).orderBy("asset", "session").limit(5).collect():
        raise ValueError(f"returns cannot be accumulated, first offenders {[tuple(map(str, r)) for r in bad]}")
    return rets


def asset_correlation(rets: DataFrame) -> DataFrame:
    """asset_x, asset_y, n_obs, correlation, status for all pairs, each with itself included.

    Pairs without a common session have no observations and the status ``empty_sample``. The matrix of assets is the
    result itself, so its size is what the caller asks for.
    """
    r = rets.where(F.col("value").isNotNull())
    x = r.select("session", F.col("asset").alias("asset_x"), F.col("value").alias("x"))
    y = r.select("session", F.col("asset").alias("asset_y"), F.col("value").alias("y"))
    met = x.join(y, "session").groupBy("asset_x", "asset_y").agg(F.count("*").alias("n_obs"), correlation("x", "y").alias("correlation"))
    one = rets.select("asset").distinct()
    pairs = one.select(F.col("asset").alias("asset_x")).join(one.select(F.col("asset").alias("asset_y")))
    out = pairs.join(met, ["asset_x", "asset_y"], "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("long")))
    status = (
        F.when(F.col("n_obs") == 0, "empty_sample")
        .when(F.col("n_obs") < 2, "insufficient_samples")
        .when(F.col("correlation").isNull(), "zero_volatility")
        .otherwise("ok")
    )
    return out.withColumn("status", status)


def risk_free_returns(
    daily_rates: DataFrame, intervals: DataFrame, day_count: int = 365, compounding: str = "daily", timezone: str = "UTC",
) -> DataFrame:
    """period_start, session, n_days, simple_return: rates of each calendar date of the interval, its first excluded.

    A rate counts only if it is available by the local midnight that starts its date; a date without
    one makes the interval's return null.
    """
    days = intervals.select("period_start", "session", F.explode(F.sequence(F.date_add("period_start", 1), F.col("session"))).alias("date"))
    usable = daily_rates.where(F.col("available_at") <= F.to_utc_timestamp(F.col("date").cast("timestamp"), timezone))
    x = days.join(usable.select("date", "annual_rate"), "date", "left")
    grown = F.expm1(F.sum(F.log1p(F.col("annual_rate") / day_count))) if compounding == "daily" else F.sum(F.col("annual_rate") / day_count)
    x = x.groupBy("period_start", "session").agg(F.count("*").alias("n_days"), F.count("annual_rate").alias("known"), grown.alias("grown"))
    return x.select("period_start", "session", "n_days", F.when(F.col("known") == F.col("n_days"), F.col("grown")).alias("simple_return"))
