"""Exact sums, order statistics by counts, closure, coverage without a grid, and pivoted fits, against plain versions."""

import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import exact
from tallyspark.operators import coverage, factors, reachability, reports, selection

EDGE = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, 2.0**52, 2.0**-1000, 0.1]


def doubles(rng, n):
    return [struct.unpack("<d", struct.pack("<Q", (rng.getrandbits(1) << 63) | (rng.randrange(0, 2047) << 52) | rng.getrandbits(52)))[0] for _ in range(n)]


def test_sums_are_those_of_exact_arithmetic_for_any_partitioning(spark):
    rng = random.Random(1)
    groups = {
        "cancel": [1e300, 1.0, -1e300, 1e-300, 3e15, -3e15] * 7, "tiny": [5e-324] * 9 + [-5e-324] * 4, "plain": [rng.gauss(0, 1) for _ in range(500)],
        "wide": [x / 1e4 for x in doubles(rng, 400)], "edge": [x for x in EDGE if abs(x) < 1e300], "half": [1.0, 2**-53, 2**-53, 2**-106], "zero": [0.0, -0.0],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("nulls", None), ("nan", float("nan")), ("both", math.inf), ("both", -math.inf), ("up", math.inf), ("up", 1.0)]
    out = []
    for seed, parts in ((1, 1), (2, 7)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
        out.append({r.g: (r.s, r.twice) for r in exact.exact_sums(df, ("g",), {"s": F.col("x"), "twice": -F.col("x")}).collect()})
    assert {k: v for k, v in out[0].items() if k not in ("nan", "both")} == {k: v for k, v in out[1].items() if k not in ("nan", "both")}
    for k, xs in groups.items():
        assert out[0][k] == (math.fsum(xs), math.fsum(-x for x in xs)), k
    assert out[0]["nulls"] == (None, None) and math.isnan(out[0]["nan"][0]) and math.isnan(out[0]["both"][0]) and out[0]["up"] == (math.inf, -math.inf)
    over = spark.createDataFrame([(1, 1.7976931348623157e308)] * 3, "g int, x double")
    assert exact.exact_sums(over, ("g",), {"s": F.col("x")}).first().s == math.inf


def test_ordinals_order_as_doubles_do(spark):
    values = sorted({*EDGE, *doubles(random.Random(2), 3000)})
    got = [r.o for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", exact.ordinal(F.col("x")).alias("o")).orderBy("i").collect()]
    bits = [struct.unpack("<q", struct.pack("<d", x + 0.0))[0] for x in values]
    assert got == [b if b >= 0 else -(b & (2**63 - 1)) for b in bits]


def test_selection_equals_sorting(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(900)] + [("b", rng.choice([-1.0, 0.0, -0.0, 2.5])) for _ in range(400)] + [("c", 7.0), ("d", None)] + [("e", x) for x in doubles(rng, 300)]
    df = spark.createDataFrame(rows, "scenario string, simple_return double").repartition(5)
    levels = ("0.95", "0.9", "0.07", "0.5")
    got = {(r.scenario, r.confidence): (r.threshold, r.n_tail) for r in selection.tail_by_counts(df, levels, ("scenario",), "simple_return").collect()}
    want = {}
    for g in "abce":
        xs = sorted((x for k, x in rows if k == g), reverse=True)
        for c in levels:
            t = xs[math.ceil(round(float(c) * 100) * len(xs) / 100) - 1]
            want[g, c] = t, sum(x <= t for x in xs)
    assert got == want
    known = df.where("scenario in ('a', 'b', 'c')")
    by_sort, by_counts = ({(r.scenario, r.confidence): (r.threshold, round(r.tail_mean, 12), r.n_tail) for r in f.collect()} for f in (reports.tail_risk(known, levels), selection.tail_by_counts(known, levels, ("scenario",), "simple_return")))
    assert by_sort == by_counts


def test_one_large_scenario_is_never_sorted_by_value(spark):
    big = spark.range(2_000_000).select(F.lit("one").alias("scenario"), (F.pmod(F.col("id") * 7919, F.lit(2_000_003)) / 1000.0).alias("v"))
    ranks = spark.createDataFrame([("one", "low", 1), ("one", "mid", 1_000_000), ("one", "top", 2_000_000), ("one", "none", 2_000_001)], "scenario string, level string, rank long")
    plan = []
    out = selection.select_ranks(big, ranks, ("scenario",))
    got = {r.level: r.v for r in out.collect()}
    xs = np.sort((np.arange(2_000_000) * 7919 % 2_000_003) / 1000.0)
    assert got == {"low": xs[0], "mid": xs[999_999], "top": xs[-1]} and not plan
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def brute_closure(edges, starts):
    out = {}
    for run in {r for r, _ in starts}:
        level, depth = {a for r, a in starts if r == run}, 0
        while level:
            out |= {(run, a): depth for a in level}
            level, depth = {t for s, t in edges if s in level} - {a for r, a in out if r == run}, depth + 1
    return {(r, a, d) for (r, a), d in out.items()}


def test_closure_with_cycles_warrants_and_several_starts(spark):
    rng = random.Random(4)
    edges = [(f"a{rng.randrange(40)}", f"a{rng.randrange(40)}") for _ in range(45)] + [("x", "x"), ("w1", "u1"), ("u1", "w1"), *((f"c{k}", f"c{k + 1}") for k in range(12))]
    starts = [(r, f"a{rng.randrange(40)}") for r in ("r1", "r2", "r3") for _ in range(2)] + [("r4", "x"), ("r5", "w1"), ("r5", "w1"), ("r6", "alone"), ("r7", "c0"), ("r7", "c3")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = reachability.reachable(df(edges, "source string, target string"), df(starts, "run string, asset string"))
    assert {tuple(r) for r in got.select("run", "asset", "depth").collect()} == brute_closure(edges, starts) and got.count() == len(brute_closure(edges, starts))
    day = dt.date
    actions = df([("1", "a", day(2024, 1, 5)), ("2", "b", day(2024, 2, 5)), ("3", "z", day(2024, 1, 6)), ("4", "c", day(2024, 1, 1)), ("5", "b", day(2024, 1, 9))], "action_id string, source_asset string, effective_date date")
    legs = df([("1", "security", "b"), ("1", "cash", None), ("2", "security", "c"), ("3", "security", "a"), ("5", "security", "d")], "action_id string, leg_type string, asset string")
    warrants = df([("c", "u")], "asset string, underlying_asset string")
    edges = reachability.holding_edges(actions, legs, warrants)
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("b", "c"), ("z", "a"), ("b", "d"), ("c", "u")}
    spans = df([("r", day(2024, 1, 1), day(2024, 1, 31)), ("s", day(2024, 1, 1), day(2024, 2, 28))], "run string, entry date, end date")
    reach = reachability.reachable(edges, df([("r", "a"), ("s", "a")], "run string, asset string"))
    effective = reachability.effective_actions(reach, actions, spans)
    assert {(r.run, r.action_id) for r in effective.collect()} == {("r", "1"), ("r", "5"), ("s", "1"), ("s", "2"), ("s", "5")}
    shorts = reachability.short_successors(df([("r", "a"), ("s", "a")], "run string, asset string"), effective, actions, legs)
    assert {tuple(r) for r in shorts.collect()} == {("r", "a", 0), ("r", "b", 1), ("r", "d", 2), ("s", "a", 0), ("s", "b", 1), ("s", "c", 2), ("s", "d", 2)}
    assert reachability.reachable(edges, df([], "run string, asset string")).count() == 0


@pytest.fixture
def rows_cut(monkeypatch):
    """How many rows each table has that the closure cuts from its lineage."""
    rows = []

    def counting(df, cut=reachability.cut):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(reachability, "cut", counting)
    return rows


def test_closure_of_many_runs_has_no_row_for_each_run_and_asset(spark, rows_cut):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    star = [("hub", f"a{k}") for k in range(30)] + [(f"a{k}", "hub") for k in range(30)]
    starts = [(f"r{k}", "hub") for k in range(40)]
    got = reachability.reachable(df(star, "source string, target string"), df(starts, "run string, asset string"))
    assert {tuple(r) for r in got.collect()} == brute_closure(star, starts) and got.count() == 40 * 31
    assert max(rows_cut) == 60  # the edges; a round has a row for each asset
    rng = random.Random(9)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(70)]
    starts = [(k, rng.randrange(50)) for k in range(300) for _ in range(1 + k % 2)]  # more runs than bits, in several blocks
    got = [tuple(r) for r in reachability.reachable(df(edges, "source long, target long"), df(starts, "run long, asset long")).collect()]
    assert set(got) == brute_closure(edges, starts) and len(got) == len(set(got))
    places = reachability.numbered_runs(df(starts, "run long, asset long")).collect()
    assert len({(r.block, r.bit) for r in places}) == len({r.run for r in places}) == 300 and {r.bit for r in places} <= set(range(64))


def test_effective_summary_has_no_row_for_each_run_and_action(spark, rows_cut):
    rng, day = random.Random(10), lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    starts = [(f"r{k}", rng.randrange(30)) for k in range(90)]
    spans = [(f"r{k}", day(rng.randrange(30)), day(rng.randrange(60))) for k in range(85)]  # some are empty, some runs have none
    actions = [(f"{rng.randrange(150)}", rng.randrange(32), day(rng.randrange(70))) for _ in range(260)] + [("0", 1, None), (None, 2, day(20))]
    c = reachability.closure(df(edges, "source long, target long"), df(starts, "run string, asset long"))
    a, s = df(actions, "action_id string, source_asset long, effective_date date"), df(spans, "run string, entry date, end date")
    rows_cut.clear()
    got = {tuple(r) for r in reachability.effective_summary(c, a, s).collect()}
    reach, want = brute_closure(edges, starts), {}
    for run, entry, end in spans:
        own = {asset for r, asset, _ in reach if r == run}
        hits = [(i, d) for i, asset, d in actions if asset in own and d and entry < d <= end]
        if hits:
            want[run] = (run, len({i for i, _ in hits if i is not None}), min(d for _, d in hits), max(d for _, d in hits))
    assert got == set(want.values()) and len(got) > 40
    blocks = c.runs.select("block").distinct().count()
    assert rows_cut and max(rows_cut) <= len(actions) * blocks < sum(n for _, n, _, _ in want.values())
    plain = reachability.effective_actions(c.rounds.join(c.runs, "block").where(reachability.MARKED), a, s).groupBy("run")
    assert {tuple(r) for r in plain.agg(F.count_distinct("action_id"), F.min("effective_date"), F.max("effective_date")).collect()} == got


def test_coverage_names_ranges(spark):
    rng, day = random.Random(5), lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    spans = {"full": (0, 20), "holes": (0, 30), "none": (5, 9), "ended": (10, 9), "early": (3, 6)}
    rows = [("full", k) for k in range(21)] + [("holes", k) for k in range(31) if rng.random() < 0.6] + [("early", k) for k in range(9)] + [("stray", 2), ("stray", 3), ("stray", 7), ("ended", 10), ("full", 4)]
    out = coverage.date_cover(spark.createDataFrame([(a, day(k)) for a, k in rows], "asset string, date date"), spark.createDataFrame([(a, day(x), day(y)) for a, (x, y) in spans.items()], "asset string, first date, last date"))
    got = {(r.asset, r.problem, r.date) for r in coverage.cells(out).collect()}
    want = {(a, "missing", day(k)) for a, (x, y) in spans.items() for k in range(x, y + 1) if (a, k) not in rows} | {("full", "repeated", day(4))}
    want |= {(a, "unexpected" if a in spans else "unknown_asset", day(k)) for a, k in rows if not (a in spans and spans[a][0] <= k <= spans[a][1])}
    assert got == want and {(r.asset, str(r.first), r.n) for r in out.where("problem = 'unknown_asset'").collect()} == {("stray", "2024-01-03", 2), ("stray", "2024-01-08", 1)}
    sessions = [day(k) for k in (0, 1, 2, 5, 6, 7, 12)]
    prices = [("a", s) for s in sessions] + [("b", s) for s in (day(0), day(5), day(12))] + [("b", day(3))]
    out = coverage.session_cover(*(spark.createDataFrame(x, s) for x, s in ((prices, "asset string, session date"), ([(s,) for s in sessions], "session date"), ([("a",), ("b",), ("c",)], "asset string"))))
    assert {tuple(r) for r in out.collect()} == {("b", "missing", day(1), day(2), 2), ("b", "missing", day(6), day(7), 2), ("b", "off_calendar", day(3), day(3), 1), ("c", "missing", day(0), day(12), 7)}


def test_borrow_plan_needs_exact_cover_and_tells_late_rates(spark):
    day = lambda k: dt.date(2024, 3, 1) + dt.timedelta(days=k)
    spans = spark.createDataFrame([("a", day(0), day(4), None), ("b", day(0), day(4), day(3))], "asset string, entry date, end date, terminated date")
    at = lambda k: dt.datetime.combine(day(k), dt.time(5 if k != 3 else 6))  # noqa: E731  midnight in New York is 5:00 UTC
    rows = [(day(k), a, 0.01 * k, at(k)) for a, n in (("a", 4), ("b", 2)) for k in range(1, n + 1)]
    frame = lambda r: spark.createDataFrame(r, "date date, asset string, annual_rate double, available_at timestamp")
    out = {(r.asset, r.date): r.status for r in coverage.borrow_plan(frame(rows), spans).collect()}
    assert len(out) == 6 and {k for k, v in out.items() if v == "late"} == {("a", day(3))}
    for broken in (rows[1:], rows + [(day(3), "b", 0.1, at(3))], rows + [(day(2), "c", 0.1, at(2))], rows + [rows[0]]):
        with pytest.raises(ValueError, match="cover every date"):
            coverage.borrow_plan(frame(broken), spans)


def test_fits_at_the_edge_of_identification(spark):
    def fit(r, **named):
        names = tuple(named)
        rows = [tuple(map(float, x)) for x in zip(r, *named.values(), strict=True)]
        return factors.design_fit(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ("r", *names))), names)

    exactly = fit([0.01, 0.03, 0.02], a=[0.01, 0.02, 0.04], b=[0.03, -0.01, 0.02])  # as many rows as coefficients
    want = np.linalg.solve(np.array([[1, 0.01, 0.03], [1, 0.02, -0.01], [1, 0.04, 0.02]]), [0.01, 0.03, 0.02])
    assert exactly["status"] == "ok" and exactly["rank"] == 3 and np.allclose(exactly["coefficients"], want)
    x = [-0.01, 0.02, 0.0, 0.01, -0.02]
    collinear = fit([0.5 * v for v in x], a=x, b=[2 * v for v in x])
    assert (collinear["status"], collinear["rank"], collinear["coefficients"]) == ("rank_deficient", 2, None)
    constant = fit(x, a=x, flat=[0.001] * 5)
    assert (constant["status"], constant["constant_factors"]) == ("rank_deficient", ["flat"])
    few = fit([0.01, 0.02], a=[0.01, 0.03], b=[0.02, -0.01])
    assert few["status"] == "insufficient_observations" and fit([], a=[], b=[])["status"] == "insufficient_observations"
    flat = fit([0.01] * 4, a=[0.01, -0.02, 0.03, 0.0])
    assert flat["status"] == "ok" and np.allclose(flat["coefficients"], [0.01, 0.0], atol=1e-15)
    rng = np.random.default_rng(6)
    z = rng.normal(size=(400, 4)) * [1, 1e-6, 1e5, 1]
    y = z @ [1, 2e5, -3e-5, 0.5] + 3 + rng.normal(size=400) * 0.01
    many = fit(y, **{f"f{k}": z[:, k] for k in range(4)})
    assert np.allclose(many["coefficients"], np.linalg.lstsq(np.column_stack([np.ones(400), z]), y, rcond=None)[0], rtol=1e-8) and many["rank"] == 5


def test_reports_have_the_same_bits_for_any_partitioning(spark):
    rng = random.Random(8)
    rows, equity, peak = [], 1000.0, 1000.0
    for k in range(400):
        pnl = rng.choice([1e6, -1e6, 1e-6, 3.3]) * rng.random()
        r = rng.gauss(0, 0.01)
        equity += pnl
        peak = max(peak, equity)
        rows.append(("s", dt.date(2020, 1, 1) + dt.timedelta(days=k), dt.date(2020, 1, 2) + dt.timedelta(days=k), pnl, equity, r, equity / 1000, equity / peak - 1))
    made = []
    for parts in (1, 3, 8):
        random.Random(parts).shuffle(rows)
        df = spark.createDataFrame(rows, "scenario string, period_start date, session date, pnl double, equity double, simple_return double, wealth double, drawdown double").repartition(parts)
        made.append({r.metric: r.value for r in reports.summary(df, 252.0, exact=True).collect()})
    assert made[0] == made[1] == made[2]
    xs = [r[5] for r in rows]
    mean = math.fsum(xs) / len(xs)
    assert made[0]["cumulative_pnl"] == math.fsum(r[3] for r in rows) and made[0]["cumulative_simple_return"] == math.fsum(xs)
    assert made[0]["annualized_volatility"] == math.sqrt(math.fsum((x - mean) * (x - mean) for x in xs) / (len(xs) - 1)) * 252**0.5
    plain = {r.metric: r.value for r in reports.summary(df, 252.0).collect()}
    assert all(math.isclose(plain[k], made[0][k], rel_tol=1e-9, abs_tol=1e-6) for k in plain)
