"""Validated runs, comparisons, mixes and dated costs: an offender for each rule, and plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import allocation, comparison, dated_costs, mixes, returns, runs, signals

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
DAILY = "scenario string, period_start date, session date, opening_equity double, equity double, pnl double, simple_return double, cumulative_pnl double, cumulative_simple_return double, compounded_return double"
RUNS = "scenario string, capital double, entry_session date, end_session date, actual_end_session date, status string, stop_reason string, stop_session date"


def run_tables(name, moves=(0.01, -0.02, 0.03, 0.0), capital=1000.0):
    rows, equity, added = [], capital, 0.0
    for k, r in enumerate(moves):
        opening, equity, added = equity, equity * (1 + r), added + r
        rows.append([name, DAY(k), DAY(k + 1), opening, equity, equity - opening, r, equity - capital, added, equity / capital - 1])
    phases = [[name, DAY(0), "pre_entry", capital], [name, DAY(0), "post_entry", capital - 1]]
    for row in rows:
        if row[2] == DAY(2):
            phases.append([name, DAY(2), "pre_rebalance", row[4]])
        if row[2] == DAY(3):
            phases.append([name, DAY(3), "pre_reinvestment", row[4]])
        phases.append([name, row[2], "close", row[4]])
    return rows, [[*p, k] for k, p in enumerate(phases)], [name, capital, DAY(0), DAY(4), DAY(4), "complete", None, None]


def test_each_rule_of_a_run_has_its_offender(spark):
    def broken(what):
        rows, phases, run = run_tables(what)
        columns = DAILY.replace(" date", "").replace(" string", "").replace(" double", "").split(", ")
        if what in columns:
            rows[2][columns.index(what)] += 0.5
        elif what == "interval_gap":
            rows[2][1] = DAY(1)
        elif what == "interval_reversed":
            rows[0][1] = run[2] = DAY(1)
            for p in phases[:2]:
                p[1] = DAY(1)
        elif what == "entry":
            run[2] = DAY(1)
        elif what == "actual_end":
            run[4] = DAY(3)
        elif what == "complete_before_its_end":
            run[3] = DAY(9)
        elif what == "stop_without_reason":
            run[5:] = ["stopped", " ", DAY(4)]
        elif what == "stop_session":
            run[5:] = ["stopped", "margin", DAY(3)]
        elif what == "status_unknown":
            run[5] = "odd"
        elif what == "valuation_missing_close":
            del phases[4]
        elif what == "valuation_unexpected_pre_rebalance":
            phases.append([what, DAY(4), "pre_rebalance", 1.0, 99])
        elif what == "valuation_out_of_order_pre_rebalance":
            phases[2][4], phases[3][4] = phases[3][4], phases[2][4]
        elif what == "entry_valuation":
            phases[0][3] += 1
        elif what == "close_valuation":
            phases[-1][3] += 1
        return rows, phases, run

    cases = {
        "fine": set(), "opening_equity": {"opening_equity"}, "pnl": {"pnl", "simple_return"}, "simple_return": None, "cumulative_pnl": {"cumulative_pnl"}, "cumulative_simple_return": {"cumulative_simple_return"},
        "compounded_return": {"compounded_return"}, "interval_gap": {"interval_gap"}, "interval_reversed": {"interval_reversed", "entry"}, "entry": {"entry"}, "actual_end": {"actual_end", "complete_before_its_end"},
        "complete_before_its_end": {"complete_before_its_end"}, "stop_without_reason": {"stop_without_reason"}, "stop_session": {"stop_session"}, "status_unknown": {"status_unknown"}, "valuation_missing_close": {"valuation_missing_close"},
        "valuation_unexpected_pre_rebalance": {"valuation_unexpected_pre_rebalance"}, "valuation_out_of_order_pre_rebalance": {"valuation_out_of_order_pre_rebalance"}, "entry_valuation": {"entry_valuation"}, "close_valuation": {"close_valuation"},
    }
    made = [broken(c) for c in cases]
    daily = spark.createDataFrame([r for m in made for r in m[0]], DAILY)
    valuations = spark.createDataFrame([p for m in made for p in m[1]], "scenario string, session date, phase string, equity double, place int")
    table = spark.createDataFrame([m[2] for m in made], RUNS)
    events = spark.createDataFrame([(c, DAY(k), kind) for c in cases for k, kind in ((2, "rebalance"), (2, "reinvestment"), (3, "reinvestment"), (8, "rebalance"))], "scenario string, session date, kind string")
    found = {}
    for r in runs.run_problems(daily, valuations, table, events).collect():
        found.setdefault(r.scenario, set()).add(r.rule)
    cases["interval_reversed"] = {"interval_reversed"}
    for c, want in cases.items():
        assert found.get(c, set()) == want or (want is None and {"simple_return", "cumulative_simple_return", "wealth"} <= found[c]), (c, found.get(c))
    only = lambda df: df.where("scenario = 'fine'")
    assert runs.validated(only(daily), only(valuations), only(table), only(events)).count() == 4
    with pytest.raises(ValueError, match="disagree"):
        runs.validated(daily, valuations, table.where("status = 'complete'"), events)
    with pytest.raises(ValueError, match="not complete"):
        runs.validated(daily, valuations, table, events)


def test_comparison_names_fields_and_intervals(spark):
    series = [(s, DAY(k), DAY(k + 1), 0.01 * k) for s in "abc" for k in range(4)]
    series[-1] = ("c", DAY(3), DAY(5), 0.03)
    series[5] = ("b", DAY(1), DAY(2), 0.5)
    df = spark.createDataFrame(series, "scenario string, period_start date, session date, rf double")
    cover, rf = comparison.content_key(df, "coverage"), comparison.content_key(df, "risk_free", ("rf",))
    assert len({r.content for r in cover.collect()}) == 2 and len({r.content for r in rf.collect()}) == 3
    shuffled = comparison.content_key(df.repartition(5).orderBy(F.rand(1)), "coverage")
    assert {tuple(r) for r in cover.collect()} == {tuple(r) for r in shuffled.collect()}
    settings = spark.createDataFrame([("a", "currency", "USD"), ("b", "currency", "USD"), ("c", "currency", None), ("b", "ddof", "1")], "scenario string, field string, content string")
    sig = cover.unionByName(rf).unionByName(settings)
    diff = comparison.differences(sig, "a")
    assert {(r.scenario, r.field) for r in diff.collect()} == {("b", "risk_free"), ("b", "ddof"), ("c", "coverage"), ("c", "risk_free"), ("c", "currency")}
    gone = comparison.interval_differences(df, "a", ("rf",))
    assert {(r.scenario, r.period_start, r.session, r.side) for r in gone.collect()} == {("b", DAY(1), DAY(2), "values_differ"), ("c", DAY(3), DAY(5), "only_scenario"), ("c", DAY(3), DAY(4), "only_reference")}
    with pytest.raises(ValueError, match="coverage"):
        comparison.check(diff, assumptions="separate")
    with pytest.raises(ValueError, match="risk_free"):
        comparison.check(diff.where("scenario = 'b'"), coverage="separate")
    assert comparison.check(diff, "separate", "separate").count() == 5
    metric = "scenario string, metric string, value double, unit string, n_obs long, status string"
    m = spark.createDataFrame([(s, "beta", 1.0, "ratio", 4, "ok") for s in "abd"], metric)
    same = spark.createDataFrame([(s, "currency", "EUR" if s == "d" else "USD") for s in "abd"], "scenario string, field string, content string")
    out = comparison.compared(m, m, same, "index", separate=True)
    assert sorted((r.scenario, r.kind) for r in out.collect()) == [("a", "portfolio"), ("b", "portfolio"), ("d", "portfolio"), ("index [a]", "benchmark"), ("index [d]", "benchmark")]
    with pytest.raises(ValueError, match="duplicate"):
        comparison.compared(m.unionByName(m), m, same, "index", False)


def intervals(spark, ks):
    return spark.createDataFrame([(DAY(k), DAY(k + 1)) for k in ks], "period_start date, session date")


def test_labels_of_evaluation_windows(spark):
    est = intervals(spark, range(10, 20))
    label = lambda ks, **more: tuple(mixes.sample_label(est, intervals(spark, ks), **more).first())
    assert label(range(10, 20)) == ("in_sample", 10, None, None) and label(range(20, 25)) == ("after_estimation_window", 0, None, None)
    assert label(range(15, 25), overlap="identify") == ("overlapping_estimation_window", 5, DAY(15), DAY(20))
    for ks, said in ((range(15, 25), "overlaps"), (range(1, 5), "precedes")):
        with pytest.raises(ValueError, match=said):
            label(ks)


def test_contributions_add_up_and_windows_are_matched(spark):
    rng = np.random.default_rng(1)
    r = {s: rng.normal(0, 0.01, 12) for s in "xy"}
    rows = [(s, DAY(k), DAY(k + 1), float(r[s][k])) for s in "xy" for k in range(12)]
    schema = "strategy string, period_start date, session date, r double"
    df = spark.createDataFrame(rows, schema)
    w = mixes.window_of(df, str(DAY(2)), str(DAY(9)))
    assert w.count() == 14
    b = intervals(spark, range(12)).withColumn("b", F.lit(0.001))
    out = mixes.contributions(w, {"x": 0.25, "y": 0.75}, b, 500.0).orderBy("session", "strategy").collect()
    equity, k = 500.0, 2
    for a, c in zip(out[::2], out[1::2], strict=True):
        mix = 0.25 * r["x"][k] + 0.75 * r["y"][k]
        assert np.isclose(a.return_contribution + c.return_contribution, mix) and np.isclose(a.sleeve_opening, equity * 0.25)
        assert np.isclose(a.active_contribution + c.active_contribution, mix - 0.001) and np.isclose(a.pnl_contribution + c.pnl_contribution, equity * mix)
        equity, k = equity * (1 + mix), k + 1
    with pytest.raises(ValueError, match="weights"):
        mixes.contributions(w, {"x": 0.5, "y": 0.6})
    with pytest.raises(ValueError, match="contiguous"):
        mixes.window_of(df.where(F.col("session") != F.lit(DAY(5))), str(DAY(2)), str(DAY(9)))
    with pytest.raises(ValueError, match="same intervals|begin and end"):
        mixes.window_of(spark.createDataFrame(rows[:-2] + [("y", DAY(10), DAY(12), 0.1)], schema), str(DAY(2)), str(DAY(12)))


def test_kinds_of_optima(spark):
    def solve(a, b, **more):
        df = spark.createDataFrame([(k, float(x), float(y), 0.0) for k, (x, y) in enumerate(zip(a, b, strict=True))], "session int, a double, b double, m double")
        rows = mixes.optimum(df, 252.0, **more).collect()
        return rows[0].status, rows[0].optimum, [r.weight for r in rows if r.selected], rows

    rng = np.random.default_rng(2)
    a, b = rng.normal(0.001, 0.01, 60), rng.normal(0.0005, 0.008, 60)
    status, kind, weight, rows = solve(a, b)
    grid = [(np.mean(w * a + (1 - w) * b) / np.std(w * a + (1 - w) * b, ddof=1), w) for w in np.linspace(0, 1, 20_001)]
    assert (status, kind) == ("ok", "unique") and abs(weight[0] - max(grid)[1]) < 1e-3
    assert abs(max(r.information_ratio for r in rows) - max(grid)[0] * 252**0.5) < 1e-5
    x = [0.01, -0.02, 0.03, 0.0]
    assert solve(x, [-v + 0.01 for v in x])[:3] == ("unbounded_information_ratio", "none", [])
    assert solve([0.0] * 4, [0.0] * 4)[:3] == ("undefined_zero_tracking_error", "none", [])
    assert solve(x, x)[:3] == ("ok", "flat_objective", [0.0])
    assert solve([0.01, 0.03, 0.01, 0.03], [0.01, 0.01, 0.03, 0.03], low=0.4, high=0.4)[1] == "unique"
    assert solve(a, b, covariance="zero_correlation")[0] == "ok"


def test_dated_costs_bind_or_name_the_rule(spark):
    at = lambda k, h=21: dt.datetime.combine(DAY(k), dt.time(h))
    sessions = spark.createDataFrame([(DAY(k), at(k)) for k in range(10)], "session date, close_at timestamp")
    ex = [(DAY(5), DAY(4), "a"), (DAY(5), DAY(4), "b"), (DAY(8), DAY(7), "a")]
    models = [(DAY(4), "a", 0.01, 1e6, DAY(0), DAY(3), at(3, 22)), (DAY(4), "b", 0.0, 2e6, DAY(0), DAY(3), at(4)), (DAY(7), "a", 0.02, 3e6, DAY(2), DAY(6), at(6))]
    e = lambda rows: spark.createDataFrame(rows, "session date, decision date, asset string")
    m = lambda rows: spark.createDataFrame(rows, "decision date, asset string, daily_volatility double, dollar_adv double, sample_start date, sample_end date, available_at timestamp")
    bound = dated_costs.bound_costs(e(ex), m(models), sessions)
    assert {(r.session, r.asset, r.dollar_adv) for r in bound.collect()} == {(DAY(5), "a", 1e6), (DAY(5), "b", 2e6), (DAY(8), "a", 3e6)}
    cost = dated_costs.dated_impact(bound.withColumn("signed_notional", F.lit(-4e4)), 1.0, 2.0, 0.5).where("asset = 'a' and dollar_adv = 1e6").first()
    assert np.isclose(cost.total_cost, 4.0 + 8.0 + 4e4 * 0.5 * 0.01 * 0.2)
    rules = lambda rows, ms: {r.rule for r in dated_costs.binding_problems(e(rows), m(ms), sessions).collect()}
    with_ = lambda **change: [(*models[0][:k], v, *models[0][k + 1 :]) for k, v in [next(iter((int(key[1:]), v) for key, v in change.items()))]] + models[1:]
    assert rules(ex, models) == set()
    assert rules([*ex, (DAY(9), None, "a")], models) == {"execution_without_decision"} and rules(ex[:2], models) == {"model_without_decision"}
    assert rules(ex, models[:2]) == {"decision_without_model"} and rules([*ex, (DAY(8), DAY(7), "c")], models) == {"asset_without_parameters"}
    assert rules(ex, [*models, models[0]]) == {"repeated_parameters"} and rules(ex, with_(_3=0.0)) == {"unusable_parameters"}
    assert rules(ex, with_(_4=DAY(-3))) == {"sample_off_sessions"} and "sample_not_before_decision" in rules(ex, with_(_5=DAY(4)))
    assert rules(ex, with_(_4=DAY(3))) == set() and "sample_reversed" in rules(ex, [(DAY(4), "a", 0.01, 1e6, DAY(3), DAY(2), at(3)), *models[1:]])
    assert rules(ex, with_(_6=at(3, 20))) == {"available_before_sample_ends"} and rules(ex, with_(_6=at(4, 22))) == {"available_after_decision"}
    with pytest.raises(ValueError, match="available_after_decision"):
        dated_costs.bound_costs(e(ex), m(with_(_6=at(4, 22))), sessions)


def test_guards_of_returns_liquidity_and_exclusions(spark):
    panel = lambda rows: spark.createDataFrame(rows, "session date, asset string, close double")
    with pytest.raises(ValueError, match="nonpositive_price"):
        returns.market_returns(panel([(DAY(0), "a", 1.0), (DAY(1), "a", -1.0)]), "raw", "price")
    for args, said in ((("raw", "total_return"), "reinvest_ex_close"), (("raw", "price", "simple", "reinvest_ex_close"), "belongs"), (("split_adjusted", "total_return"), "cannot be taken"), (("other", "price"), "cannot be taken")):
        with pytest.raises(ValueError, match=said):
            returns.market_returns(panel([(DAY(0), "a", 1.0)]), *args)
    extreme = returns.market_returns(panel([(DAY(0), "a", 1e300), (DAY(1), "a", 1e-300)]), "raw", "price", "log").orderBy("session").collect()
    assert np.isclose(extreme[1].value, np.log(1e-300) - np.log(1e300))
    rets = spark.createDataFrame([(DAY(k), a, 0.01 * (k % 3)) for k in range(6) for a in "ab"], "session date, asset string, value double")
    volume = [(DAY(k), a, 100.0) for k in range(6) for a in "ab"]
    v = lambda rows: spark.createDataFrame(rows, "session date, asset string, dollar_volume double")
    assert allocation.liquidity(rets, v(volume), str(DAY(5)), 5).count() == 2
    with pytest.raises(ValueError, match="missing_volume"):
        allocation.liquidity(rets, v(volume[:3] + volume[4:]), str(DAY(5)), 5)
    costs = allocation.impact_costs(spark.createDataFrame([("a", 10.0)], "asset string, signed_notional double"), spark.createDataFrame([("a", 0.1, 0.0)], "asset string, daily_volatility double, dollar_adv double"), 1, 1, 1)
    with pytest.raises(Exception, match="positive average dollar volume of a"):
        costs.collect()
    keys = spark.createDataFrame([(DAY(0), "a")], "signal_date date, asset string")
    twice = keys.unionByName(keys).withColumn("reason", F.lit("x"))
    with pytest.raises(ValueError, match="each key once"):
        signals.reconciled(keys.withColumn("signal", F.lit(1.0)), keys.limit(0).withColumn("forward_return", F.lit(1.0)), twice)
    with pytest.raises(ValueError, match="every return asset"):
        allocation.risk_report(rets, spark.createDataFrame([("a", 1.0)], "asset string, weight double"), str(DAY(5)), 5, 252.0)
    still = allocation.risk_report(rets.withColumn("value", F.lit(0.0)), spark.createDataFrame([("a", 1.0), ("b", 0.0)], "asset string, weight double"), str(DAY(5)), 5, 252.0)
    assert {(r.status, r.marginal_volatility) for r in still.collect()} == {("zero_portfolio_volatility", None)}
