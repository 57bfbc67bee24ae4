"""Signal groups, reports, factor fits and security returns on hand-calculated tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import factors, performance, reports, securities, signals

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def scores(spark, rows):
    return spark.createDataFrame(rows, "signal_date date, asset string, signal double, forward_return double")


def test_extreme_groups_leave_the_middle_to_the_others(spark):
    p = scores(spark, [(D(0), f"a{i}", float(i), i / 100) for i in range(11)])
    label = lambda q, how: [r.label for r in signals.grouped(p, q, how).orderBy("signal").collect()]
    assert label(4, "extremes") == [1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4]
    assert label(2, "extremes") == [1] * 5 + [None] + [2] * 5
    assert label(4, "equal_count") == [i * 4 // 11 + 1 for i in range(11)]


def test_dates_that_are_not_grouped_say_why(spark):
    rows = [(D(0), f"a{i}", float(i // 2), 0.01 * i) for i in range(6)] + [(D(1), f"a{i}", float(i), 0.01 * i) for i in range(6)]
    rows += [(D(2), "a0", 1.0, 0.1)] + [(D(3), f"a{i}", 2.0, 0.01 * i) for i in range(6)]
    p = scores(spark, rows)
    dates = p.select("signal_date").distinct().unionByName(spark.createDataFrame([(D(4),)], "signal_date date"))
    cases = {"reject_boundary_ties": "ok", "asset_order": "ok"}
    for ties, first in cases.items():
        g = signals.group_table(signals.grouped(p, 3, "equal_count", ties), dates, 3)
        got = {r.signal_date: (r.status, r.high_minus_low) for r in signals.spread_table(g, 3).collect()}
        assert got[D(0)][0] == first and got[D(1)][0] == "ok" and math.isclose(got[D(1)][1], 0.04)
        assert got[D(2)] == ("insufficient_assets_for_quantiles", None) and got[D(3)] == ("constant_signal", None)
        assert got[D(4)] == ("insufficient_assets_for_quantiles", None) and g.count() == 15
    torn = signals.grouped(p.where(F.col("signal_date") == D(0)), 2, "equal_count", "reject_boundary_ties")
    assert {r.group_status for r in torn.collect()} == {"tie_at_group_boundary"}
    s = {r.metric: (r.value, r.n_obs) for r in signals.summary(signals.spread_table(g, 3), "high_minus_low", "spread", "x").collect()}
    assert s["evaluated_spread_dates"] == (2.0, 2) and s["unevaluated_spread_dates"] == (3.0, 2)


def test_exclusions_name_the_unmatched_keys_and_no_others(spark):
    s = spark.createDataFrame([(D(0), "A", 1.0), (D(0), "B", 2.0)], "signal_date date, asset string, signal double")
    o = spark.createDataFrame([(D(0), "A", 0.1), (D(1), "C", 0.2)], "signal_date date, asset string, forward_return double")
    why = lambda *keys: spark.createDataFrame([(D(k), a, "known") for k, a in keys], "signal_date date, asset string, reason string")
    pairs, excluded = signals.reconciled(s, o, why((0, "B"), (1, "C")))
    assert pairs.count() == 1 and {r.side for r in excluded.collect()} == {"signal_without_outcome", "outcome_without_signal"}
    for keys in (((0, "B"),), ((0, "A"), (0, "B"), (1, "C"))):
        with pytest.raises(ValueError):
            signals.reconciled(s, o, why(*keys))
    c = {r.signal_date: tuple(r)[1:] for r in signals.coverage(s, o, signals.grouped(pairs, 2), excluded).collect()}
    assert c == {D(0): (2, 1, 1, 1, 1), D(1): (0, 1, 0, 1, 0)}


@pytest.fixture
def daily(spark):
    pnl = spark.createDataFrame(
        [("s", D(0), D(1), -10.0), ("s", D(1), D(2), 20.0), ("s", D(2), D(3), -5.0)],
        "scenario string, period_start date, session date, pnl double",
    )
    return reports.net_asset_value(pnl, 100.0)


def test_benchmark_report_and_seeded_tables(spark, daily):
    b = spark.createDataFrame([(D(0), D(1), 0.02), (D(1), D(2), -0.01), (D(2), D(3), 0.03)], "period_start date, session date, b double")
    d = performance.aligned(daily, b, "b")
    m = {r.metric: r.value for r in performance.against_benchmark(d, 100.0, 4.0).collect()}
    x, y = np.array([-0.1, 20 / 90, -5 / 110]), np.array([0.02, -0.01, 0.03])
    grown = np.prod(1 + y)
    assert math.isclose(m["beta"], np.cov(x, y)[0, 1] / y.var(ddof=1)) and math.isclose(
        m["information_ratio"], 2 * (x - y).mean() / (x - y).std(ddof=1),
    )
    assert math.isclose(
        m["compounded_return_difference"], 100 * (1.05 - grown),
    ) and math.isclose(m["relative_wealth_return"], 1.05 / grown - 1)
    seeded = performance.cumulative(d, "b", "benchmark").orderBy("session").collect()
    assert tuple(seeded[0])[1:] == (D(0), "benchmark", 0.0, 0.0, 1.0) and math.isclose(seeded[3].wealth, grown) and math.isclose(
        seeded[3].cumulative_simple_return, 0.04,
    )
    own = {r.metric: r.value for r in reports.summary(performance.benchmark_daily(d, 100.0), 4.0).collect()}
    assert math.isclose(own["ending_equity"], 100 * grown) and math.isclose(own["cumulative_pnl"], 100 * grown - 100)
    with pytest.raises(ValueError, match="intervals"):
        performance.aligned(daily, b.limit(2), "b")


def test_sharpe_denominators(daily):
    x = np.array([-0.1, 20 / 90, -5 / 110])
    rf = daily.withColumn("rf", F.col("simple_return") / 2)
    for how, want in (("portfolio_returns", x.std(ddof=1)), ("excess_returns", (x / 2).std(ddof=1))):
        got = {r.metric: r.value for r in performance.summary(rf, 4.0, denominator=how).collect()}
        assert math.isclose(got["sharpe"], 2 * (x / 2).mean() / want) and len(got) == 9
    flat = daily.withColumn("rf", F.col("simple_return"))
    got = {r.metric: r.status for r in performance.summary(flat, 4.0, denominator="excess_returns").collect()}
    assert got["sharpe"] == "zero_excess_volatility"
    rate = performance.scalar_risk_free(daily, 0.05, 4.0).first().rf
    assert math.isclose((1 + rate) ** 4, 1.05)


def test_tails_of_returns_and_money_and_empty_samples(spark, daily):
    both = spark.createDataFrame([("s",), ("none",)], "scenario string")
    got = {r.scenario: r for r in performance.tails(daily, ("0.5",), both).collect()}
    assert math.isclose(got["s"].var_return, -5 / 110) and got["s"].var_pnl == -5.0 and got["s"].etl_pnl == -7.5 and got["s"].n_tail_pnl == 2
    assert (got["none"].status, got["none"].n_obs, got["none"].var_pnl) == ("empty_sample", 0, None)


def test_reports_with_other_signatures_are_not_compared(daily):
    rows = reports.summary(daily, 4.0)
    out = performance.compare({"a": (rows, {"periods": 4}), "b": (rows, {"periods": 4})})
    assert out.groupBy("report").count().count() == 2
    with pytest.raises(ValueError, match="periods"):
        performance.compare({"a": (rows, {"periods": 4}), "b": (rows, {"periods": 252})})


def test_fits_have_residuals_and_idiosyncratic_volatility(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    y = 0.1 + x @ [1.0, -2.0] + rng.normal(size=50) * 0.3
    s = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "f double, g double, r double")
    fit = factors.fitted(s, ("f", "g"), factors.joint_ols(s, ("f", "g")))
    m = {r.metric: r.value for r in factors.fit_summary(fit, ("f", "g"), 252.0).collect()}
    a = np.column_stack([np.ones(50), x])
    e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    assert math.isclose(m["r_squared"], 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))) and math.isclose(
        m["annualized_idiosyncratic_volatility"], math.sqrt(252 * (e @ e) / 47),
    )
    flat = s.withColumn("g", F.col("f"))
    none = factors.fitted(flat, ("f", "g"), factors.joint_ols(flat, ("f", "g")))
    assert {r.metric: r.status for r in factors.fit_summary(none, ("f", "g"), 252.0).collect()}["r_squared"] == "no_fit"
    c = {(r.series, r.other_series): r.correlation for r in factors.series_correlations(s, ("f", "g", "r")).collect()}
    assert math.isclose(c[("f", "r")], np.corrcoef(x[:, 0], y)[0, 1]) and math.isclose(c[("g", "g")], 1)
    assert factors.excess(s.withColumn("rf", F.lit(0.01)), ("r",)).where("abs(r) > 100").count() == 0


def test_gaps_are_spells_without_quotes(spark):
    rows = [(D(k), "A", s) for k, s in enumerate(["not_listed", "quoted", "suspended", "suspended", "quoted", "unquoted_after_last_session", "terminated"])]
    got = securities.quote_gaps(spark.createDataFrame(rows, "session date, asset string, status string")).orderBy("first_session").collect()
    assert [(r.first_session, r.last_session, r.n_sessions, r.reason) for r in got] == [
        (D(2), D(3), 2, "suspended"), (D(5), D(5), 1, "unquoted_after_last_session"),
    ]
