"""The research operators on hand-calculated tables."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark import contracts
from tallyspark.functions import stats
from tallyspark.operators import allocation, factors, intervals, ledger, reports, research
from tallyspark.operators import returns as rets
from tallyspark.sources import provider, snapshots
from tallyspark.streaming import bars

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def panel(spark, **closes):
    rows = [(D(i), a, float(c)) for a, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "session date, asset string, close double")


def test_simple_and_log_returns_of_the_tiny_panel(spark):
    p = panel(spark, A=[100, 110, 99])
    got = [r.value for r in rets.returns(p).orderBy("session").collect()]
    assert got[0] is None and np.allclose(got[1:], [0.1, -0.1])
    logs = [r.value for r in rets.returns(p, "log").orderBy("session").collect()]
    assert np.allclose(logs[1:], [math.log(1.1), math.log(0.9)])
    wealth = [r.cumulative for r in rets.cumulative_returns(rets.returns(p), "wealth").orderBy("session").collect()]
    assert wealth[0] is None and np.allclose(wealth[1:], [1.1, 0.99])
    doubled = rets.returns(panel(spark, A=[100, 200, 400]), "log")
    got = {m: [r.cumulative for r in rets.cumulative_returns(doubled, m, "log").orderBy("session").collect()] for m in ("sum", "compound", "wealth")}
    assert all(v[0] is None for v in got.values()) and np.allclose(got["wealth"][1:], [2, 4]) and np.allclose(got["compound"][1:], [1, 3])
    assert np.allclose(got["sum"][1:], [math.log(2), math.log(4)])
    broken = rets.returns(p).withColumn("value", F.when(F.col("session") > D(1), F.lit(-1.0)).otherwise(F.col("value")))
    with pytest.raises(ValueError, match="no_wealth"):
        rets.checked_returns(broken)
    assert rets.checked_returns(rets.returns(p)).count() == 3
    with pytest.raises(ValueError):
        rets.returns(p, "weekly")


def test_total_return_reinvests_dividends_and_splits(spark):
    p = panel(spark, A=[100, 54, 60])
    splits = spark.createDataFrame([("A", D(1), 2.0)], "asset string, effective_session date, ratio double")
    div = spark.createDataFrame([("A", D(2), 1.0), ("A", D(2), 2.0)], "asset string, ex_session date, cash_per_share double")
    got = [r.value for r in rets.returns(p, splits=splits, dividends=div).orderBy("session").collect()]
    assert np.allclose(got[1:], [54 * 2 / 100 - 1, 63 / 54 - 1])


def test_contracts_name_the_offence(spark):
    good = panel(spark, A=[1, 2])
    assert contracts.PRICES.check(good).columns == ["session", "asset", "close"]
    for bad, word in (
        (good.withColumn("x", F.lit(1)), "schema"), (good.limit(0), "empty"), (good.unionByName(good), "unique"), (
            good.withColumn("close", F.lit(float("nan"))), "nonfinite",
        ),
        (good.withColumn("asset", F.lit(" ")), "blank"), (good.withColumn("close", -F.col("close")), "nonpositive"), (
            good.withColumn("asset", F.lit(None).cast("string")), "null",
        ),
    ):
        with pytest.raises(contracts.ContractError, match=word):
            contracts.PRICES.check(bad)


def test_incomplete_panels_are_reported(spark):
    p = panel(spark, A=[1, 2, 3], B=[1, 2])
    off = contracts.panel_completeness(p, p.select("session"), p.select("asset")).collect()
    assert [tuple(r) for r in off] == [(D(2), "B", "missing")]


def test_degenerate_samples_give_null(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    r = flat.agg(stats.correlation("x", "y"), stats.slope("x", "y"), stats.adjusted_skewness("y"), stats.adjusted_kurtosis("y")).first()
    assert all(v is None for v in r)


def test_report_of_a_hand_calculated_series(spark):
    pnl = spark.createDataFrame(
        [("s", D(0), D(1), -10.0), ("s", D(1), D(2), 20.0), ("s", D(2), D(3), -5.0)],
        "scenario string, period_start date, session date, pnl double",
    )
    d = reports.net_asset_value(pnl, 100.0)
    m = {r.metric: r for r in reports.summary(d, 4.0).collect()}
    r = np.array([-0.1, 20 / 90, -5 / 110])
    assert math.isclose(m["max_drawdown"].value, -0.1) and math.isclose(m["ending_equity"].value, 105)
    assert math.isclose(m["annualized_volatility"].value, r.std(ddof=1) * 2)
    assert math.isclose(m["sortino"].value, 2 * r.mean() / np.sqrt((np.minimum(r, 0) ** 2).mean()))
    flat = reports.net_asset_value(pnl.withColumn("pnl", F.lit(0.0)), 100.0)
    s = {x.metric: (x.value, x.status) for x in reports.summary(flat, 4.0).collect()}
    assert s["sharpe"] == (None, "zero_volatility") and s["sortino"] == (None, "zero_downside_risk")


def test_tail_rank_is_exact(spark):
    d = spark.createDataFrame([("s", float(i)) for i in range(100)], "scenario string, simple_return double")
    got = {r.confidence: (r.threshold, r.tail_mean, r.n_tail) for r in reports.tail_risk(d, ("0.07", "0.95")).collect()}
    assert got["0.07"] == (93.0, 46.5, 94) and got["0.95"] == (5.0, 2.5, 6)


def test_rank_ic_and_quantiles(spark):
    rows = [(D(0), a, s, f) for a, s, f in zip("ABCD", (1.0, 2.0, 3.0, 4.0), (0.01, 0.02, 0.03, 0.04))] + [(D(1), a, s, f) for a, s, f in zip("ABCD", (1.0, 2.0, 3.0, 4.0), (0.04, 0.03, 0.02, 0.01))] + [(D(2), a, 1.0, f) for a, f in zip("AB", (0.1, 0.2))]
    p = spark.createDataFrame(rows, "signal_date date, asset string, signal double, forward_return double")
    ic = {r.signal_date: (r.rank_ic, r.status) for r in research.rank_ic(p).collect()}
    assert np.isclose(ic[D(0)][0], 1) and np.isclose(ic[D(1)][0], -1) and ic[D(2)] == (None, "constant_signal")
    q = research.quantiles(p, 3)
    assert [r.n_assets for r in q.where(F.col("signal_date") == D(0)).orderBy("quantile").collect()] == [2, 1, 1]
    s = {r.signal_date: r.high_minus_low for r in research.spreads(q, 3).collect()}
    assert np.isclose(s[D(0)], 0.04 - 0.015) and D(2) not in s
    with pytest.raises(ValueError):
        research.matched(p.drop("forward_return"), p.limit(2).drop("signal"))


def test_caps_are_filled_like_the_iterative_rule(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 5)) * [0.01, 0.02, 0.05, 0.08, 0.1]
    r = spark.createDataFrame(
        [(D(i), "ABCDE"[k], float(x[i, k])) for i in range(30) for k in range(5)], "session date, asset string, value double",
    )
    for cap in (0.25, 0.4, 1.0):
        inv = 1 / x[5:29].std(axis=0, ddof=1)
        free, w = set(range(5)), {}
        while free:
            rest, total = 1 - sum(w.values()), sum(inv[k] for k in free)
            bound = [k for k in free if rest * inv[k] / total > cap]
            w |= {k: cap for k in bound} if bound else {k: rest * inv[k] / total for k in free}
            free -= set(bound) or free.copy()
        got = {r.asset: r.weight for r in allocation.inverse_volatility_weights(r, str(D(29)), 24, cap).collect()}
        assert np.allclose([got[a] for a in "ABCDE"], [w[k] for k in range(5)])


def test_impossible_weights_are_named_errors(spark):
    x = spark.createDataFrame(
        [(D(i), a, (-1.0) ** i * v) for i in range(12) for a, v in (("A", 0.01), ("B", 0.02), ("C", 0.04))],
        "session date, asset string, value double",
    )
    for cap, policy, n, word in (
        (0.25, "redistribute", 10, "infeasible"), (0.5, "raise", 10, "exceeds"), (0.5, "redistribute", 50, "insufficient"),
    ):
        with pytest.raises(ValueError, match=word):
            allocation.inverse_volatility_weights(x, str(D(11)), n, cap, cap_policy=policy)
    flat = x.withColumn("value", F.when(F.col("asset") == "A", 0.0).otherwise(F.col("value")))
    with pytest.raises(ValueError, match="positive asset volatility"):
        allocation.inverse_volatility_weights(flat, str(D(11)), 10, 0.5)
    got = {r.asset: r for r in allocation.inverse_volatility_weights(x, str(D(11)), 10, 0.4, 252.0).collect()}
    assert math.isclose(sum(r.weight for r in got.values()), 1) and got["A"].at_cap and math.isclose(got["B"].weight, 0.4) and math.isclose(got["A"].uncapped_weight, 4 / 7)
    w = spark.createDataFrame([("A", 0.5), ("A", 0.5), ("B", None)], "asset string, weight double")
    assert {r.problem for r in allocation.weight_problems(w).collect()} == {"repeated_asset", "missing_weight"}
    with pytest.raises(ValueError, match="infeasible"):
        allocation.equal_weights(x, 0.2)


def test_pairs_without_common_sessions_have_an_empty_sample(spark):
    r = spark.createDataFrame([(D(0), "A", 0.1), (D(1), "B", 0.2)], "session date, asset string, value double")
    got = {(x.asset_x, x.asset_y): (x.n_obs, x.correlation, x.status) for x in rets.asset_correlation(r).collect()}
    assert got[("A", "B")] == (0, None, "empty_sample") and got[("A", "A")] == (1, None, "insufficient_samples") and len(got) == 4


def test_a_value_of_zero_is_a_problem_and_no_crash(spark):
    pnl = spark.createDataFrame(
        [("s", D(0), D(1), -100.0), ("s", D(1), D(2), 5.0)], "scenario string, period_start date, session date, pnl double",
    )
    d = reports.net_asset_value(pnl, 100.0)
    assert [r.simple_return for r in d.orderBy("session").collect()] == [-1.0, None]
    assert [r.problem for r in reports.nav_problems(d).orderBy("session").collect()] == ["nonpositive_end", "nonpositive_start"]


def test_asof_takes_the_last_published_rate_and_ages_it(spark):
    days = spark.createDataFrame([(D(i),) for i in range(1, 9)], "date date")
    rates = spark.createDataFrame(
        [(D(0), 0.036, dt.datetime(2024, 1, 2, 13)), (D(2), 0.072, dt.datetime(2024, 1, 4, 13))],
        "observation_date date, sofr double, available_at timestamp",
    )
    got = {r.date: (r.sofr, r.status) for r in intervals.rate_plan(days, rates, 0.0, 4).collect()}
    assert got[D(1)] == (None, "no_rate") and got[D(2)] == (0.036, "ok") and got[D(4)] == (0.072, "ok") and got[D(7)] == (None, "stale")


def test_aliases_resolve_once_or_raise(spark):
    o = spark.createDataFrame([("X", D(0)), ("X", D(5)), ("Y", D(0))], "ticker string, date date")
    a = spark.createDataFrame(
        [("X", "one", D(0), D(3)), ("X", "two", D(4), None)], "ticker string, asset string, valid_from date, valid_to date",
    )
    got = intervals.resolve_aliases(o, a)
    assert {(r.ticker, r.date): r.asset for r in got.collect()} == {("X", D(0)): "one", ("X", D(5)): "two", ("Y", D(0)): None}
    with pytest.raises(ValueError):
        intervals.require_resolved(got)
    twice = intervals.resolve_aliases(o.unionByName(o.limit(1)), a.unionByName(a.limit(1)))
    assert sorted((r.ticker, r.date, r.asset or "", r.n_matches) for r in twice.collect()) == [("X", D(0), "one", 1)] * 2 + [("X", D(5), "two", 1), ("Y", D(0), "", 0)]


def test_calendars_join_by_union_and_intersection(spark):
    c = [spark.createDataFrame([(D(i), dt.datetime(2024, 1, 1 + i, h)) for i in days], "session date, close_at timestamp") for days, h in (((0, 1), 20), ((1, 2), 21))]
    assert intervals.combined_calendar(c, "union").count() == 3
    assert [r.close_at.hour for r in intervals.combined_calendar(c, "intersection").collect()] == [21]


def test_joint_fit_matches_least_squares_and_flags_rank(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 0.5 + x @ [2.0, -1.0] + rng.normal(size=200) * 0.1
    s = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "f double, g double, r double").repartition(3)
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose([r.coefficient for r in factors.joint_ols(s, ("f", "g")).collect()], want)
    assert {r.status for r in factors.joint_ols(s.withColumn("g", 2 * F.col("f")), ("f", "g")).collect()} == {"rank_deficient"}
    assert {r.status for r in factors.joint_ols(s.limit(2), ("f", "g")).collect()} == {"insufficient_observations"}
    assert {r.status for r in factors.joint_ols(s.limit(3), ("f", "g")).collect()} == {"ok"}  # as many rows as coefficients


def book(spark, p, weights, leverage, capital=100.0, fin=ledger.Financing(), costs=ledger.TradeCosts(), **actions):
    t = spark.createDataFrame(
        [("r", D(k), a, w, leverage) for k, ws in weights.items() for a, w in ws.items()],
        "run_id string, session date, asset string, weight double, gross_leverage double",
    )
    return ledger.run_books(ledger.growth_index(p, **actions), t, capital, fin, costs).orderBy("session")


def test_levered_books_pay_costs_and_interest(spark):
    p = panel(spark, A=[100, 110, 99])
    rows = book(spark, p, {0: {"A": 1.0}}, 2.0, fin=ledger.Financing(borrowing_rate=0.0365), costs=ledger.TradeCosts(10)).collect()
    x = 100 / 1.002
    assert math.isclose(rows[0].equity, x, rel_tol=1e-9) and math.isclose(rows[0].debt, x, rel_tol=1e-9)
    assert math.isclose(rows[1].equity, 2 * x * 1.1 - x * 1.0001, rel_tol=1e-9) and math.isclose(rows[0].trade_cost, 100 - x, rel_tol=1e-9)


def test_books_with_splits_dividends_shorts_and_stops(spark):
    p = panel(spark, A=[100, 50, 60], B=[100, 100, 100])
    splits = spark.createDataFrame([("A", D(1), 2.0)], "asset string, effective_session date, ratio double")
    div = spark.createDataFrame([("A", D(1), D(2), 1.0)], "asset string, ex_session date, pay_date date, cash_per_share double")
    rows = book(spark, p, {0: {"A": 0.5, "B": 0.5}}, 1.0, splits=splits, dividends=div).collect()
    assert np.allclose([r.equity for r in rows], [100, 50 + 50 * 1.02, 50 + 50 * 1.02 * 1.2]) and all(r.cash == 0 for r in rows)
    short = book(spark, p, {0: {"A": -1.0, "B": 1.0}}, 1.0)  # nothing net: the capital stays in cash
    assert np.allclose([r.equity for r in short.collect()], [100, 150, 140]) and short.first().cash == 100
    assert ledger.audit(short, 100.0).where("abs(equity_gap) > 1e-9 or abs(balance_gap) > 1e-9").count() == 0
    stop = book(spark, panel(spark, A=[100, 60, 60]), {0: {"A": 1.0}}, 2.0, fin=ledger.Financing(maintenance_equity_ratio=0.3))
    assert stop.count() == 2


def test_baskets_are_solved_as_by_bisection(spark):
    """Signed and unsigned baskets that change, against a fold with a numeric solver over the sessions."""
    rng = np.random.default_rng(8)
    prices = {a: np.exp(np.cumsum(rng.normal(0, 0.05, 13))) * 100 for a in "ABC"}
    baskets = {0: {"A": 0.5, "B": 0.5}, 3: {"B": 1.2, "C": -0.2}, 6: {"A": 0.2, "B": 0.3, "C": 0.5}, 9: {"C": 1.0}}
    for leverage, rate in ((1.0, 30), (1.8, 120), (0.5, 10)):
        fin = ledger.Financing(0.02, 0.07)
        got = book(spark, panel(spark, **prices), baskets, leverage, 1000.0, fin, ledger.TradeCosts(rate)).collect()
        k, equity, held, rest, want = rate / 1e4, 1000.0, {}, 1000.0, []
        for day in range(13):
            if day:
                rest *= 1 + (fin.borrowing_rate if rest < 0 else fin.cash_rate) / 365
                held = {a: v * prices[a][day] / prices[a][day - 1] for a, v in held.items()}
            equity = rest + sum(held.values())
            if day in baskets:
                w = {a: baskets[day].get(a, 0.0) * leverage for a in "ABC"}
                low, high = 0.0, equity
                for _ in range(200):
                    x = (low + high) / 2
                    over = x + k * sum(abs(w[a] * x - held.get(a, 0.0)) for a in "ABC") > equity
                    low, high = (low, x) if over else (x, high)
                equity, held = low, {a: v * low for a, v in w.items()}
                rest = equity - sum(held.values())
            want.append(equity)
        assert np.allclose([r.equity for r in got], want)


def test_closed_form_equals_the_books(spark):
    p = panel(spark, A=[100, 104, 99, 120], B=[50, 49, 53, 51])
    w = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "asset string, weight double")
    a = [r.equity for r in ledger.buy_and_hold_unlevered(p, w, 1000.0, ledger.TradeCosts(20)).orderBy("session").collect()]
    b = [r.equity for r in book(spark, p, {0: {"A": 0.5, "B": 0.5}}, 1.0, 1000.0, costs=ledger.TradeCosts(20)).collect()]
    assert np.allclose(a, b)


def test_snapshots_round_trip_and_detect_changes(spark, tmp_path):
    p = panel(spark, A=[1, 2, 3])
    path = str(tmp_path / "snap")
    snapshots.save_snapshot({"prices": p}, {"source": "test"}, path)
    tables, meta = snapshots.load_snapshot(spark, path)
    assert meta == {"source": "test"} and tables["prices"].count() == 3
    panel(spark, A=[1, 2, 4]).write.mode("overwrite").parquet(f"{path}/prices")
    with pytest.raises(contracts.ContractError):
        snapshots.load_snapshot(spark, path)


def test_provider_bars_are_local_dates(spark):
    body = json.dumps(
        {
            "meta": {"symbol": "X", "exchangeTimezoneName": "America/New_York"}, "timestamp": [1704207600, 1704310200],
            "indicators": {"quote": [{"close": [1.5, None], "volume": [10, 20]}]},
        }
    )
    got = provider.chart_bars(spark.createDataFrame([(body,)], "body string")).orderBy("session").collect()
    assert [(r.session, r.close) for r in got] == [(dt.date(2024, 1, 2), 1.5), (dt.date(2024, 1, 3), None)]
    o = spark.createDataFrame([("X", D(1)), ("X", D(9))], "asset string, session date")
    e = spark.createDataFrame([("X", D(1)), ("X", D(2))], "asset string, session date")
    assert {(r.session, r.status) for r in provider.coverage(o, e, str(D(0)), str(D(5))).collect()} == {(D(1), "ok"), (D(2), "missing"), (D(9), "outside_coverage")}


def test_daily_bars_from_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i // 4, 10 + i % 4), "A", float(i)) for i in range(16)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = bars.daily_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.session, r.close) for r in spark.table("bars_out").collect()}
    assert {(D(0), 1.5), (D(1), 5.5), (D(2), 9.5)} <= got
