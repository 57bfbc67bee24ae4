"""Mixes of two strategies: where an evaluation window lies to its estimation window, contributions, and what kind of optimum a mix has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.allocation import selected

ON = ["period_start", "session"]
#: How close two optima may be to count as one, and a weight to its bound.
TIE, AT_BOUND = 1e-12, 1e-12


def sample_label(estimated: DataFrame, evaluated: DataFrame, overlap: str = "reject") -> DataFrame:
    """label, overlapping_intervals, overlap_start, overlap_end of two sets of intervals: one row.

    ``in_sample``: the same intervals; ``after_estimation_window``: all later; ``overlapping_estimation_window``: in part, which raises unless
    ``overlap`` is ``identify``. An evaluation before the estimation raises, as its weights would know the future.
    """
    if overlap not in ("reject", "identify"):
        raise ValueError("overlap must be reject or identify")
    a, b = (x.select(*ON).distinct().withColumn(side, F.lit(True)) for x, side in ((estimated, "est"), (evaluated, "ev")))
    count = lambda c: F.count_if(c)
    one = lambda c, of, f: f(F.when(F.col(of), F.col(c)))
    s = a.join(b, ON, "full_outer").fillna(False, ["est", "ev"]).agg(
        count(F.col("est") & F.col("ev")).alias("shared"), count(F.col("est") & ~F.col("ev")).alias("only_est"), count(~F.col("est") & F.col("ev")).alias("only_ev"),
        one("period_start", "est", F.min).alias("est_start"), one("session", "est", F.max).alias("est_end"), one("period_start", "ev", F.min).alias("ev_start"), one("session", "ev", F.max).alias("ev_end"),
    )
    apart = F.col("ev_start") >= F.col("est_end")
    label = (
        F.when((F.col("only_est") == 0) & (F.col("only_ev") == 0), "in_sample")
        .when(apart, "after_estimation_window")
        .when(F.col("ev_end") <= F.col("est_start"), "before_estimation_window")
        .otherwise("overlapping_estimation_window")
    )
    part = F.col("label") == "overlapping_estimation_window"
    out = s.withColumn("label", label).select(
        "label", F.col("shared").alias("overlapping_intervals"), F.when(part, F.greatest("ev_start", "est_start")).alias("overlap_start"), F.when(part, F.least("ev_end", "est_end")).alias("overlap_end"),
    )
    got = out.first()["label"]
    if got == "before_estimation_window":
        raise ValueError("the evaluation window precedes the estimation window: its weights would use future information")
    if got == "overlapping_estimation_window" and overlap == "reject":
        raise ValueError("the evaluation window overlaps the estimation window; overlap='identify' labels it")
    return out


def window_of(series: DataFrame, start: str, end: str) -> DataFrame:
    """The rows (strategy, period_start, session, r) of a window: each strategy must have the same contiguous intervals, from ``start`` to ``end``."""
    d = selected(series, start, end)
    before = F.lag("session").over(Window.partitionBy("strategy").orderBy("session"))
    if gap := d.withColumn("before", before).where("before <> period_start").limit(3).collect():
        raise ValueError(f"intervals inside the window must be contiguous, first offenders {[(r['strategy'], str(r['period_start'])) for r in gap]}")
    names = d.select("strategy").distinct().count()
    if odd := d.groupBy(*ON).agg(F.count("*").alias("n"), F.count_distinct("strategy").alias("k")).where((F.col("n") != names) | (F.col("k") != names)).limit(3).collect():
        raise ValueError(f"strategies must have the same intervals inside the window, first offenders {[tuple(map(str, r))[:2] for r in odd]}")
    return d


def contributions(series: DataFrame, weights: dict[str, float], benchmark: DataFrame | None = None, capital: float | None = None) -> DataFrame:
    """period_start, session, strategy, weight, strategy_return, return_contribution, active_return, active_contribution, sleeve_opening, pnl_contribution.

    A mix is brought back to its weights each interval. Without a benchmark (period_start, session, b) or a capital their columns are null.
    """
    names = {r[0] for r in series.select("strategy").distinct().limit(3).collect()}
    if names != set(weights) or any(not w >= 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > AT_BOUND:
        raise ValueError(f"weights must be nonnegative, sum to one and cover exactly the strategies {sorted(names)}")
    w = series.sparkSession.createDataFrame(sorted(weights.items()), "strategy string, weight double")
    none = F.lit(None).cast("double")
    d = series.join(F.broadcast(w), "strategy").withColumn("part", F.col("weight") * F.col("r"))  # one row for each strategy
    d = d.join(benchmark.select(*ON, "b"), ON, "left") if benchmark is not None else d.withColumn("b", none)
    day = d.groupBy(*ON).agg(F.sum("part").alias("combined"))
    grown = F.product(1 + F.col("combined")).over(Window.partitionBy(F.lit(0)).orderBy("session").rowsBetween(Window.unboundedPreceding, -1))  # a calendar
    opening = F.lit(float(capital)) * F.coalesce(grown, F.lit(1.0)) if capital is not None else none
    d = d.join(day.withColumn("opening", opening), ON)
    return d.select(
        *ON, "strategy", "weight", F.col("r").alias("strategy_return"), F.col("part").alias("return_contribution"), (F.col("r") - F.col("b")).alias("active_return"),
        (F.col("weight") * (F.col("r") - F.col("b"))).alias("active_contribution"), (F.col("opening") * F.col("weight")).alias("sleeve_opening"),
        (F.col("opening") * F.col("part")).alias("pnl_contribution"),
    )


def optimum(pair: DataFrame, periods: float, low: float = 0.0, high: float = 1.0, covariance: str = "estimated") -> DataFrame:
    """candidate, weight, active_mean, tracking_error, information_ratio, candidate_status, selected, status, optimum of mixes w a + (1 - w) b against m.

    ``pair``: session, a, b, m. Candidates are both bounds and, strictly between them, the stationary point of the ratio and the least tracking
    error. ``status``: ``unbounded_information_ratio`` where a mix with a positive active mean has no tracking error, ``undefined_zero_tracking_error``
    where none has any, else ok. ``optimum``: none, unique, multiple_optima (of which the smallest weight is selected) or flat_objective, where the mix
    between the extreme optima is as good. With ``zero_correlation`` variances stay and the covariance counts as zero.
    """
    if covariance not in ("estimated", "zero_correlation"):
        raise ValueError("covariance must be estimated or zero_correlation")
    x = pair.select((F.col("a") - F.col("m")).alias("x"), (F.col("b") - F.col("m")).alias("y"))
    c = F.covar_samp("x", "y") if covariance == "estimated" else F.lit(0.0)
    s = x.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), c.alias("c"))
    p, q = F.col("mx") * F.col("vy") - F.col("my") * F.col("c"), F.col("my") * F.col("vx") - F.col("mx") * F.col("c")
    inside = lambda w: F.when((w > low) & (w < high), w)
    points = {
        "lower_endpoint": F.lit(float(low)), "upper_endpoint": F.lit(float(high)) if high > low else F.lit(None).cast("double"), "stationary": inside(F.try_divide(p, p + q)),
        "minimum_tracking_error": inside(F.try_divide(F.col("vy") - F.col("c"), F.col("vx") + F.col("vy") - 2 * F.col("c"))),
    }

    def ratio(w):
        """Active mean, variance (zero where only rounding is left of it) and information ratio of a weight."""
        first, second, cross = w * w * F.col("vx"), (1 - w) * (1 - w) * F.col("vy"), 2 * w * (1 - w) * F.col("c")
        var = first + second + cross
        var = F.when(var <= 1e-14 * (first + second + F.abs(cross)), F.lit(0.0)).otherwise(var)
        mean = w * F.col("mx") + (1 - w) * F.col("my")
        return mean, var, F.try_divide(mean * float(periods) ** 0.5, F.sqrt(var))

    d = s.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("candidate"), w.alias("weight")) for k, w in points.items()))).alias("k")).select("*", "k.*").drop("k")
    mean, var, ir = ratio(F.col("weight"))
    d = d.where(F.col("weight").isNotNull()).withColumns({"mean": mean, "var": var, "ir": ir})
    riskless, gains = F.col("var") == 0, F.col("mean") > TIE * F.greatest(F.abs("mx"), F.abs("my"))
    d = d.withColumn("candidate_status", F.when(riskless & gains, "zero_tracking_error_positive_mean").when(riskless, "zero_tracking_error").otherwise("ok"))
    every = Window.partitionBy(F.lit(0))  # four candidates at most
    best = F.max("ir").over(every)
    d = d.withColumn("wins", F.coalesce(F.col("ir") >= best - TIE * F.greatest(F.lit(1.0), F.abs(best)), F.lit(False))).withColumn("best", best)
    d = d.withColumn("lo", F.min(F.when(F.col("wins"), F.col("weight"))).over(every)).withColumn("hi", F.max(F.when(F.col("wins"), F.col("weight"))).over(every))
    status = F.when(F.max(F.col("candidate_status") == "zero_tracking_error_positive_mean").over(every), "unbounded_information_ratio").when(F.count("ir").over(every) == 0, "undefined_zero_tracking_error").otherwise("ok")
    d = d.withColumn("status", status)
    between = F.max((F.col("candidate_status") != "ok") & (F.col("weight") > F.col("lo")) & (F.col("weight") < F.col("hi"))).over(every)
    _, _, middle = ratio((F.col("lo") + F.col("hi")) / 2)
    flat = ~between & F.coalesce(middle >= F.col("best") - TIE * F.greatest(F.lit(1.0), F.abs("best")), F.lit(False))
    kind = F.when(F.col("status") != "ok", "none").when(F.col("lo") == F.col("hi"), "unique").when(flat, "flat_objective").otherwise("multiple_optima")
    first = F.row_number().over(every.orderBy(~F.col("wins"), "weight", "candidate")) == 1
    return d.select(
        "candidate", "weight", (F.col("mean") * float(periods)).alias("active_mean"), (F.sqrt("var") * float(periods) ** 0.5).alias("tracking_error"), F.col("ir").alias("information_ratio"),
        "candidate_status", ((F.col("status") == "ok") & F.col("wins") & first).alias("selected"), "status", kind.alias("optimum"),
    )
