"""Allocation: inverse volatility with caps, risk contributions, liquidity and trade costs, strategy mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.lineage import small


def lookback(rows: DataFrame, decision: str, sessions: int) -> DataFrame:
    """Rows of the last ``sessions`` sessions strictly before the decision."""
    d = rows.where(F.col("session") < F.lit(decision).cast("date"))
    last = d.select("session").distinct().orderBy(F.desc("session")).limit(sessions)
    return d.join(F.broadcast(last), "session", "left_semi")


def equal_weights(assets: DataFrame, cap: float = 1.0) -> DataFrame:
    """asset, weight: one over the number of distinct assets; raises where that is above ``cap``."""
    d = assets.select("asset").distinct().withColumn("weight", 1 / F.count("*").over(Window.partitionBy(F.lit(0))).cast("double"))
    if d.where(F.col("weight") > cap + 1e-12).limit(1).count():
        raise ValueError("infeasible concentration cap: asset_count * cap < 1")
    return d


def weight_problems(weights: DataFrame, cap: float = 1.0) -> DataFrame:
    """asset, problem of a weight table: repeated_asset, missing_weight, negative_weight, above_cap, or a sum that is not one."""
    w, n = F.col("weight"), F.count("*").over(Window.partitionBy("asset"))
    problem = (
        F.when(n > 1, "repeated_asset")
        .when(w.isNull() | F.isnan(w), "missing_weight")
        .when(w < 0, "negative_weight")
        .when(w > cap + 1e-12, "above_cap")
    )
    rows = weights.select("asset", problem.alias("problem")).where(F.col("problem").isNotNull())
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total")).where(F.abs(F.col("total") - 1) > 1e-9)
    return rows.unionByName(total.select(F.lit(None).cast("string").alias("asset"), F.lit("sum_not_one").alias("problem")))


def inverse_volatility_weights(
    rets: DataFrame, decision: str, sessions: int, cap: float, periods: float = 1.0, cap_policy: str = "redistribute"
) -> DataFrame:
    """asset, volatility, n_obs, uncapped_weight, weight, at_cap: proportional to 1 / volatility.

    Volatility is that of ``periods`` periods (252 for annual from daily). With the policy ``redistribute`` excess over
    ``cap`` is shared among the others, in closed form: by descending share, the first k are at the cap where k is the
    smallest number that leaves the next one at or below it. With ``raise`` a weight over the cap is an error, as
    are a cap that cannot hold (assets * cap < 1), fewer sessions than asked for and a volatility that is not
    positive. One row for each asset.
    """
    if cap_policy not in ("raise", "redistribute") or not 0 < cap <= 1:
        raise ValueError("cap_policy must be raise or redistribute, and cap in (0, 1]")
    v = lookback(rets, decision, sessions).groupBy("asset").agg(
        (F.stddev_samp("value") * float(periods) ** 0.5).alias("volatility"), F.count("value").alias("n_obs")
    )
    s = v.agg(
        F.count("*").alias("assets"), F.min("n_obs").alias("least"),
        F.count_if(
            F.coalesce(F.col("volatility"), F.lit(0.0)) <= 0
        ).alias("flat"), F.sum(F.try_divide(F.lit(1.0), "volatility")).alias("total"),
        F.max(F.try_divide(F.lit(1.0), "volatility")).alias("largest"),
    ).first()
    if not s["assets"] or s["least"] < sessions:
        raise ValueError(f"insufficient return observations before the decision: {s['least']} of {sessions}")
    if s["flat"]:
        raise ValueError("inverse volatility requires finite, strictly positive asset volatility")
    if s["assets"] * cap < 1 - 1e-12:
        raise ValueError("infeasible concentration cap: asset_count * cap < 1")
    if cap_policy == "raise" and s["largest"] / s["total"] > cap + 1e-12:
        raise ValueError("a weight exceeds the concentration cap")
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.desc("inv"), "asset")
    v = v.withColumn("inv", F.try_divide(F.lit(1.0), "volatility")).withColumn("k", F.row_number().over(order) - 1)
    v = v.withColumn("rest", F.sum("inv").over(order.rowsBetween(0, Window.unboundedFollowing)))
    v = v.withColumn("uncapped_weight", F.col("inv") / F.sum("inv").over(one))
    level = (1 - F.col("k") * cap) / F.col("rest")
    v = v.withColumn("level", F.min(F.when(F.col("inv") * level <= cap + 1e-15, F.struct("k", level.alias("level")))).over(one))
    weight = F.when(F.col("k") < F.coalesce("level.k", F.lit(1 << 30)), cap).otherwise(F.col("inv") * F.col("level.level"))
    out = v.select("asset", "volatility", "n_obs", "uncapped_weight", weight.alias("weight"))
    return out.withColumn("at_cap", F.abs(F.col("weight") - cap) <= 1e-12)


def incomplete_window(rets: DataFrame, decision: str, sessions: int) -> DataFrame:
    """asset, n_obs of assets that have fewer than ``sessions`` values in the window before the decision."""
    d = lookback(rets, decision, sessions).groupBy("asset").agg(F.count("value").alias("n_obs"))
    return d.where(F.col("n_obs") < sessions)


def risk_report(rets: DataFrame, weights: DataFrame, decision: str, sessions: int, periods: float, leverage: float = 1.0) -> DataFrame:
    """asset, equity_weight, marginal_volatility, volatility_contribution, fraction_of_total, n_obs, status.

    Weights are brought to a sum of ``leverage`` and must cover every asset of the window, else ValueError, as for assets
    with too few returns. A marginal is the covariance with the portfolio's own returns over its volatility, so there are
    as many numbers as returns, not as pairs of assets. A portfolio that does not move has nulls and a status.
    """
    if bad := incomplete_window(rets, decision, sessions).limit(5).collect():
        raise ValueError(f"insufficient return observations before the decision: {[tuple(r) for r in bad]}")
    d = lookback(rets, decision, sessions).select("session", "asset", "value")
    w = weights.select("asset", "weight")
    ours, theirs = d.select("asset").distinct(), w.select("asset").distinct()
    if bad := ours.join(theirs, "asset", "left_anti").unionByName(theirs.join(ours, "asset", "left_anti")).limit(5).collect():
        raise ValueError(f"risk weights must cover every return asset, including explicit zeros: {[r[0] for r in bad]}")
    total = w.agg(F.sum("weight")).first()[0]
    w = w.select("asset", (F.col("weight") / total * float(leverage)).alias("equity_weight"))
    d = d.join(small(w), "asset")
    held = d.groupBy("session").agg(F.sum(F.col("equity_weight") * F.col("value")).alias("portfolio"))  # one row for each session of the window
    vol = held.agg((F.stddev_samp("portfolio") * float(periods) ** 0.5).alias("volatility"))
    m = d.join(F.broadcast(held), "session").groupBy("asset").agg(
        F.max("equity_weight").alias("equity_weight"), (F.covar_samp("value", "portfolio") * float(periods)).alias("cov"), F.count("*").alias("n_obs"),
    ).join(F.broadcast(vol))  # fmt: skip  one row
    moves = F.col("volatility") > 0
    marginal = F.when(moves, F.try_divide("cov", "volatility"))
    contribution = F.col("equity_weight") * marginal
    return m.select(
        "asset", "equity_weight", marginal.alias("marginal_volatility"), contribution.alias("volatility_contribution"),
        F.when(moves, F.try_divide(contribution, F.col("volatility"))).alias("fraction_of_total"), "n_obs",
        F.when(moves, "ok").otherwise("zero_portfolio_volatility").alias("status"),
    )


def covariances(rets: DataFrame, decision: str, sessions: int, periods: float) -> DataFrame:
    """asset, other_asset, annualized_covariance of every pair of assets of the window: the matrix is the result."""
    d = lookback(rets, decision, sessions).select("session", "asset", "value")
    other = d.select("session", F.col("asset").alias("other_asset"), F.col("value").alias("other"))
    return d.join(other, "session").groupBy("asset", "other_asset").agg((F.covar_samp("value", "other") * float(periods)).alias("annualized_covariance"))


def risk_contributions(rets: DataFrame, weights: DataFrame, decision: str, sessions: int, periods: float) -> DataFrame:
    """asset, weight, volatility_contribution, fraction: Euler shares of the annual portfolio volatility, of weights that sum to one."""
    d = risk_report(rets, weights, decision, sessions, periods)
    return d.select("asset", F.col("equity_weight").alias("weight"), "volatility_contribution", F.col("fraction_of_total").alias("fraction"))


def liquidity_problems(rets: DataFrame, volume: DataFrame, decision: str, sessions: int, timezone: str = "UTC") -> DataFrame:
    """asset, session, problem of what keeps liquidity from being estimated.

    Over the last ``sessions`` sessions before the decision every asset needs one return and one volume, and no volume may belong
    to another asset: ``missing_return``, ``missing_volume``, ``unexpected_volume``, ``repeated_volume``, ``negative_volume``. Volumes with
    an ``available_at`` after the local midnight that starts the decision are ``unavailable``; an asset whose volumes are
    all zero has ``nonpositive_average`` and no session.
    """
    r = lookback(rets.where(F.col("value").isNotNull()), decision, sessions).select("session", "asset").distinct()
    days, assets = r.select("session").distinct(), r.select("asset").distinct()
    per = r.groupBy("asset").agg(F.count("*").alias("n")).join(F.broadcast(days.agg(F.count("*").alias("all"))))  # one row
    lacks = per.where(F.col("n") < F.col("all")).select("asset").join(days).join(r, ["session", "asset"], "left_anti")  # only for assets that lack some
    v = volume.join(F.broadcast(days), "session", "left_semi")  # at most ``sessions`` rows
    late = F.lit(False)
    if "available_at" in volume.columns:
        late = F.col("available_at") > F.to_utc_timestamp(F.lit(decision).cast("timestamp"), timezone)
    n = F.count("*").over(Window.partitionBy("session", "asset"))
    problem = F.when(n > 1, "repeated_volume").when(F.col("dollar_volume").isNull(), "missing_volume").when(F.col("dollar_volume") < 0, "negative_volume").when(late, "unavailable")
    v = v.withColumn("problem", problem)
    mean = v.groupBy("asset").agg(F.avg("dollar_volume").alias("mean")).join(assets, "asset", "left_semi").where(F.col("mean") <= 0)
    parts = [
        lacks.select("asset", "session", F.lit("missing_return").alias("problem")), v.where(F.col("problem").isNotNull()).select("asset", "session", "problem").distinct(),
        r.join(v, ["session", "asset"], "left_anti").select("asset", "session", F.lit("missing_volume").alias("problem")),
        v.join(assets, "asset", "left_anti").select("asset", "session", F.lit("unexpected_volume").alias("problem")),
        mean.select("asset", F.lit(None).cast("date").alias("session"), F.lit("nonpositive_average").alias("problem")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def liquidity(rets: DataFrame, volume: DataFrame, decision: str, sessions: int, timezone: str = "UTC") -> DataFrame:
    """asset, daily_volatility, dollar_adv, n_obs before the decision; ValueError where ``liquidity_problems`` has a row."""
    if bad := liquidity_problems(rets, volume, decision, sessions, timezone).orderBy("asset", "session").limit(5).collect():
        raise ValueError(f"liquidity needs complete returns and volumes known before the decision: {[tuple(map(str, r)) for r in bad]}")
    d = lookback(rets.where(F.col("value").isNotNull()), decision, sessions).join(
        volume.select("session", "asset", "dollar_volume"), ["session", "asset"],
    )
    return d.groupBy("asset").agg(
        F.stddev_samp("value").alias("daily_volatility"), F.avg("dollar_volume").alias("dollar_adv"),
        F.count("*").alias("n_obs"),
    )


def impact_costs(orders: DataFrame, liquid: DataFrame, commission_bps: float, half_spread_bps: float, coefficient: float) -> DataFrame:
    """asset, signed_notional, commission, half_spread, impact (square-root law), total_cost."""
    q = F.abs("signed_notional")
    d = orders.join(liquid, "asset")
    d = d.withColumn("commission", q * (commission_bps / 1e4)).withColumn("half_spread", q * (half_spread_bps / 1e4))
    no_volume = F.raise_error(F.concat(F.lit("impact costs need a positive average dollar volume of "), F.col("asset"))).cast("double")
    depth = F.when(F.col("dollar_adv") > 0, F.col("dollar_adv")).otherwise(no_volume)
    d = d.withColumn("impact", q * coefficient * F.col("daily_volatility") * F.sqrt(q / depth))
    return d.select(
        "asset", "signed_notional", "commission", "half_spread", "impact",
        (F.col("commission") + F.col("half_spread") + F.col("impact")).alias("total_cost"),
    )


def restoring_turnover(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """session, one_way_turnover: half of what must be traded to bring drifted holdings back to (asset, weight).

    ``rets`` has (session, asset, value) of one period; the basket starts each one at its weights.
    """
    d = rets.join(small(weights), "asset").withColumn("grown", F.col("weight") * (1 + F.col("value")))
    total = F.sum("grown").over(Window.partitionBy("session")) / F.sum("weight").over(Window.partitionBy("session"))
    moved = F.abs(F.col("weight") - F.col("grown") / total)
    return d.select("session", moved.alias("moved")).groupBy("session").agg((F.sum("moved") / 2).alias("one_way_turnover"))


def size_entry(
    weights: DataFrame, liquid: DataFrame, capital: float, leverage: float, commission_bps: float, half_spread_bps: float,
    coefficient: float,
) -> DataFrame:
    """asset, signed_notional, total_cost, gross_notional, post_cost_equity: orders whose gross is ``leverage`` times the equity after their costs.

    Costs of a gross notional g are a g + b g^(3/2) by the square-root law, so its root s solves the cubic
    L b s^3 + (1 + L a) s^2 = L C, which is convex and rising for s > 0: Newton steps from above come down to it.
    """
    d = weights.join(liquid, "asset")
    rate = (commission_bps + half_spread_bps) / 1e4
    w, impact = F.col("weight"), coefficient * F.col("daily_volatility") / F.sqrt("dollar_adv")
    one = d.agg(F.sum(w * rate).alias("a"), F.sum(impact * F.pow(w, F.lit(1.5))).alias("b"))
    a, b = F.col("a") * leverage + 1, F.col("b") * leverage
    step = lambda s, _: s - (b * s * s * s + a * s * s - leverage * capital) / (3 * b * s * s + 2 * a * s)
    root = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.sqrt(F.lit(float(leverage * capital))), step)
    gross = one.select((root * root).alias("gross_notional"))  # one row
    d = d.join(F.broadcast(gross)).withColumn("signed_notional", w * F.col("gross_notional"))
    q = F.col("signed_notional")
    d = d.withColumn("total_cost", q * rate + impact * F.pow(q, F.lit(1.5)))
    left = F.lit(float(capital)) - F.sum("total_cost").over(Window.partitionBy(F.lit(0)))
    return d.select("asset", "signed_notional", "total_cost", "gross_notional", left.alias("post_cost_equity"))


def selected(series: DataFrame, start: str, end: str) -> DataFrame:
    """The intervals (period_start, session) from ``start`` to ``end``; both must be ends of intervals, and none may cross them."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    c = series.agg(
        F.count_if(
            (F.col("period_start") < a) & (F.col("session") > a)
        ).alias("cross_start"), F.count_if((F.col("period_start") < b) & (F.col("session") > b)).alias("cross_end"),
        F.count_if(F.col("period_start") == a).alias("starts"), F.count_if(F.col("session") == b).alias("ends"),
    ).first()
    if c["cross_start"] or c["cross_end"] or not c["starts"] or not c["ends"]:
        raise ValueError(f"the window from {start} to {end} must begin and end with intervals of every series: {c.asDict()}")
    return series.where((F.col("period_start") >= a) & (F.col("session") <= b))


def combine(strategies: DataFrame, weights: dict[str, float], capital: float) -> DataFrame:
    """session, simple_return, wealth, equity of a fixed-weight mix of (session, strategy, r); every strategy every session."""
    w = strategies.sparkSession.createDataFrame(sorted(weights.items()), "strategy string, weight double")
    d = strategies.join(F.broadcast(w), "strategy").groupBy("session").agg(
        F.sum(F.col("weight") * F.col("r")).alias("simple_return"), F.lit(1).alias("run"),
    )
    d = d.withColumn(
        "wealth",
        F.product(1 + F.col("simple_return")).over(Window.partitionBy("run").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)),
    )
    return d.select("session", "simple_return", "wealth", (F.col("wealth") * capital).alias("equity"))


def information_ratio_weights(pair: DataFrame, periods: float, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """candidate, weight, information_ratio, selected of the mix w a + (1 - w) b against ``m``, rows of (session, a, b, m).

    Candidates: both bounds, the stationary point of the ratio and the least tracking error, clipped to the
    bounds; the best ratio wins, then the smallest weight.
    """
    x = pair.select((F.col("a") - F.col("m")).alias("x"), (F.col("b") - F.col("m")).alias("y"))
    s = x.agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"),
        F.covar_samp("x", "y").alias("c"),
    )
    clip = lambda w: F.when(w.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), w)))
    p, q = F.col("mx") * F.col("vy") - F.col("my") * F.col("c"), F.col("my") * F.col("vx") - F.col("mx") * F.col("c")
    least = F.try_divide(F.col("vy") - F.col("c"), F.col("vx") + F.col("vy") - 2 * F.col("c"))
    cands = [
        ("lower", F.lit(low)), ("upper", F.lit(high)), ("stationary", clip(F.try_divide(p, p + q))),
        ("least_tracking_error", clip(least)),
    ]
    d = s.select(
        "*", F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), w.alias("weight")) for n, w in cands))).alias("k"),
    ).select("*", "k.*").where(F.col("weight").isNotNull())
    w = F.col("weight")
    var = w * w * F.col("vx") + (1 - w) * (1 - w) * F.col("vy") + 2 * w * (1 - w) * F.col("c")
    d = d.withColumn("information_ratio", F.try_divide((w * F.col("mx") + (1 - w) * F.col("my")) * float(periods) ** 0.5, F.sqrt(var)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("information_ratio"), "weight", "candidate")
    return d.select("candidate", "weight", "information_ratio", (F.row_number().over(order) == 1).alias("selected"))
