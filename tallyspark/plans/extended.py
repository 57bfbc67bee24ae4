"""More of the query catalogue: closures, exact sums, order statistics by counts, coverage without grids, designs of fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import exact
from tallyspark.lineage import cut, temporary
from tallyspark.operators import allocation, comparison, coverage, dated_costs, factors, mixes, reachability, reports, runs, selection
from tallyspark.operators import returns as rets
from tallyspark.plans import catalog
from tallyspark.plans.catalog import CAPITAL, DAILY, FIT, _factor_series, daily, equal_weight, query, rounded
from tallyspark.sources import provider, snapshots, views

#: Action legs of the parts: each line gives its part's holders the part of the order's next line. Some parts are warrants.
LEGS = """, q AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS action_id, l_partkey AS source, CAST(l_shipdate AS DATE) AS effective_date,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount) AS target, l_discount, l_returnflag FROM lineitem),
legs AS (SELECT * FROM q WHERE l_returnflag = 'R' AND l_discount >= 0.07 AND target IS NOT NULL),
edges AS (SELECT source, target FROM legs UNION SELECT p_partkey, b FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS b FROM part) WHERE p_type = 'PROMO' AND p_size >= 45),
walk(run, asset, depth) AS (SELECT p_brand, p_partkey, 0 FROM part WHERE p_size = 50 UNION SELECT run, target, depth + 1 FROM walk JOIN edges ON asset = source WHERE depth < 60),
closed AS (SELECT run, asset, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY run, asset)
"""


def _holdings(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """actions, legs, warrants and start sets of the runs (one for each brand)."""
    line = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*line))
    lines = views.table(spark, d, "lineitem").select("l_orderkey", *line, "l_returnflag", following.alias("target")).where("l_returnflag = 'R' and target is not null")
    lines = lines.select("l_orderkey", *line[:3], F.to_date("l_shipdate").alias("effective_date"), (F.col("l_discount") >= 0.07).alias("security"), "target")
    lines = cut(lines.distinct())  # dealt by order already; an action is left at most four times, as equal lines are neighbours
    lines = lines.withColumn("action_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    actions = lines.select("action_id", F.col("l_partkey").alias("source_asset"), "effective_date")
    legs = lines.select("action_id", F.when(F.col("security"), "security").otherwise("cash").alias("leg_type"), F.when(F.col("security"), F.col("target")).alias("asset"))
    part = views.table(spark, d, "part")
    first = part.groupBy("p_brand").agg(F.min("p_partkey").alias("underlying_asset"))
    warrants = part.where("p_type = 'PROMO' and p_size >= 45").join(first, "p_brand").select(F.col("p_partkey").alias("asset"), "underlying_asset")
    return actions, legs, warrants, part.where("p_size = 50").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("asset"))


@query(LEGS + "SELECT run, asset, depth FROM closed")
def reachable_assets(spark, d):
    """Parts that each brand's start set comes to hold over action legs and warrants, cycles included."""
    actions, legs, warrants, starts = _holdings(spark, d)
    return reachability.reachable(reachability.holding_edges(actions, legs, warrants), starts)


@query(LEGS + """, a AS (SELECT DISTINCT action_id, source, effective_date FROM q WHERE l_returnflag = 'R' AND target IS NOT NULL)
SELECT run, count(DISTINCT action_id) AS n_actions, min(effective_date) AS first_effective, max(effective_date) AS last_effective
  FROM closed JOIN a ON asset = source WHERE effective_date > DATE '1996-06-30' AND effective_date <= DATE '1998-06-30' GROUP BY run""")
def effective_actions(spark, d):
    """Actions that take effect for what each run can reach, over two years."""
    actions, legs, warrants, starts = _holdings(spark, d)
    closed = reachability.closure(reachability.holding_edges(actions, legs, warrants), starts)
    spans = starts.select("run").distinct().select("run", F.lit("1996-06-30").cast("date").alias("entry"), F.lit("1998-06-30").cast("date").alias("end"))
    return reachability.effective_summary(closed, actions, spans)


@query("""SELECT l_returnflag AS flag, round(CAST(sum(CAST(l_tax * 1152921504606846976.0::DOUBLE AS HUGEINT)) AS DOUBLE) / 1152921504606846976.0::DOUBLE, 12) AS cancelled,
  round(CAST(sum(CAST(l_extendedprice * 1099511627776.0::DOUBLE AS HUGEINT)) AS DOUBLE) / 1099511627776.0::DOUBLE, 6) AS total FROM lineitem GROUP BY 1""")
def exact_sums(spark, d):
    """Taxes among numbers sixteen powers of ten larger that cancel: rounding sums lose them all."""
    line = views.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"))
    big = F.col("price") * 1e12
    each = F.explode(F.array(F.struct(big.alias("x"), F.col("price").alias("p")), F.struct(F.col("tax").alias("x"), F.lit(None).cast("double").alias("p")), F.struct((-big).alias("x"), F.lit(None).cast("double").alias("p"))))
    out = exact.exact_sums(line.select("flag", each.alias("e")).select("flag", "e.*"), ("flag",), {"cancelled": F.col("x"), "total": F.col("p")})
    return out.select("flag", F.round("cancelled", 12).alias("cancelled"), F.round("total", 6).alias("total"))


@query("""SELECT event_type AS asset, count(*) AS n_events, round(avg(value), 9) AS exact_mean FROM events GROUP BY 1""")
def exact_means(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_type").alias("asset"), "value")
    out = exact.exact_sums(e, ("asset",), {"s": F.col("value"), "n": F.when(F.col("value").isNotNull(), F.lit(1.0))})
    return out.select("asset", F.col("n").cast("long").alias("n_events"), F.round(F.col("s") / F.col("n"), 9).alias("exact_mean"))


@query(""", x AS (SELECT concat(l_returnflag, l_linestatus) AS scenario, l_extendedprice * (l_discount - l_tax) AS v FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY v DESC) AS rank, count(*) OVER (PARTITION BY scenario) AS n FROM x), l AS (SELECT unnest(['0.99', '0.95', '0.5', '0.07']) AS confidence),
t AS (SELECT scenario, confidence, max(v) FILTER (WHERE rank = ceil(CAST(confidence AS DECIMAL(12,10)) * n)) AS threshold FROM k, l GROUP BY 1, 2)
SELECT scenario, confidence, round(threshold, 9) AS threshold, round(avg(v), 6) AS tail_mean, count(*) AS n_tail FROM t JOIN x USING (scenario) WHERE v <= threshold GROUP BY scenario, confidence, threshold""")
def tails_by_counts(spark, d):
    """Tails of every line's margin: radix selection, no scenario is sorted."""
    line = views.table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("scenario"), (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("v"),
    )
    out = selection.tail_by_counts(line, ("0.99", "0.95", "0.5", "0.07"), ("scenario",), "v")
    return out.select("scenario", "confidence", F.round("threshold", 9).alias("threshold"), F.round("tail_mean", 6).alias("tail_mean"), "n_tail")


@query(""", r AS (SELECT DISTINCT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date FROM orders),
s AS (SELECT asset, min(date) + 10 AS first, max(date) + 3 AS last FROM r WHERE asset <> '5-LOW' GROUP BY asset),
g AS (SELECT asset, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date FROM s),
p AS (SELECT asset, 'missing' AS problem, date FROM g ANTI JOIN r ON g.asset = r.asset AND g.date = r.date
  UNION ALL SELECT asset, 'unexpected', date FROM r JOIN s USING (asset) WHERE date NOT BETWEEN first AND last
  UNION ALL SELECT asset, 'unknown_asset', date FROM r WHERE asset = '5-LOW'),
i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY asset, problem ORDER BY date) AS INTEGER) AS island FROM p)
SELECT asset, problem, min(date) AS first, max(date) AS last, count(*) AS n FROM i GROUP BY asset, problem, island""")
def borrow_cover(spark, d):
    """Days of each priority as borrow rates: gaps, days before the start, days after the last, a priority that no span knows."""
    r = views.table(spark, d, "orders").select(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date")).distinct()
    spans = r.where("asset <> '5-LOW'").groupBy("asset").agg(F.date_add(F.min("date"), 10).alias("first"), F.date_add(F.max("date"), 3).alias("last"))
    return coverage.date_cover(r, spans)


@query(""", r AS (SELECT DISTINCT user_id AS asset, CAST(ts AS DATE) AS session FROM events),
k AS (SELECT session, row_number() OVER (ORDER BY session) AS k FROM (SELECT DISTINCT session FROM r)),
g AS (SELECT a.asset, k.session, k.k FROM (SELECT DISTINCT asset FROM r) a CROSS JOIN k),
p AS (SELECT g.asset, g.session, g.k - row_number() OVER (PARTITION BY g.asset ORDER BY g.k) AS island FROM g ANTI JOIN r ON g.asset = r.asset AND g.session = r.session)
SELECT asset, 'missing' AS problem, min(session) AS first, max(session) AS last, count(*) AS n FROM p GROUP BY asset, island""")
def session_cover(spark, d):
    """Days on which each user is missing, as ranges of sessions: the completeness of a panel without its grid."""
    r = views.table(spark, d, "events").select(F.col("user_id").alias("asset"), F.to_date("ts").alias("session")).distinct()
    return coverage.session_cover(r, r.select("session"), r.select("asset"))


@query(FIT + """, n AS (SELECT count(*) AS n FROM f) SELECT design, status, n_obs, CAST(rank AS INTEGER) AS rank, CAST(n_constant AS INTEGER) AS n_constant, constant_factors FROM n, LATERAL (VALUES
 ('sound', 'ok', n, 3, 0, ''), ('collinear', 'rank_deficient', n, 2, 0, ''), ('constant', 'rank_deficient', n, 2, 1, 'flat'), ('few', 'insufficient_observations', 2::BIGINT, 2, 0, ''),
 ('exact', 'ok', 3::BIGINT, 3, 0, '')) AS v(design, status, n_obs, rank, n_constant, constant_factors)""")
def factor_designs(spark, d):
    """Rank and status of a sound design and of four at the edge of identification."""
    s = _factor_series(spark, d)
    first = lambda k: s.orderBy("session").limit(k)
    twice, flat = s.withColumn("twice", 2 * F.col("first")), s.withColumn("flat", F.lit(0.001))
    cases = {
        "sound": (s, ("first", "last")), "collinear": (twice, ("first", "twice")), "constant": (flat, ("first", "flat")), "few": (first(2), ("first", "last")),
        "exact": (first(3), ("first", "last")),
    }
    parts = [factors.design(rows, names).withColumn("design", F.lit(k)) for k, (rows, names) in cases.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(FIT + """, e AS (SELECT * FROM f ORDER BY session LIMIT 3), k AS (SELECT list(x ORDER BY session) AS x, list(z ORDER BY session) AS z, list(y ORDER BY session) AS y FROM e),
d AS (SELECT *, (x[2] - x[1]) * (z[3] - z[1]) - (x[3] - x[1]) * (z[2] - z[1]) AS det FROM k),
h AS (SELECT *, ((y[2] - y[1]) * (z[3] - z[1]) - (y[3] - y[1]) * (z[2] - z[1])) / det AS b1, ((x[2] - x[1]) * (y[3] - y[1]) - (x[3] - x[1]) * (y[2] - y[1])) / det AS b2 FROM d)
SELECT term, round(c, 6) AS coefficient, 'ok' AS status FROM h, LATERAL (VALUES ('intercept', y[1] - b1 * x[1] - b2 * z[1]), ('first', b1), ('last', b2)) AS t(term, c)""")
def factor_exact_fit(spark, d):
    """As many sessions as coefficients: the plane through three points."""
    return rounded(factors.joint_ols(_factor_series(spark, d).orderBy("session").limit(3), ("first", "last")), 6)


@query(""", x AS (SELECT session, asset, CASE WHEN n = 4 AND asset = 'click' THEN -1.0 WHEN n = 6 AND asset = 'view' THEN NULL WHEN n = 8 AND asset = 'error' THEN 0.0 ELSE close END AS close FROM n1),
y AS (SELECT *, lag(session) OVER w AS ps, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS v FROM x WINDOW w AS (PARTITION BY asset ORDER BY session))
SELECT session, asset, 'nonpositive_price' AS problem FROM x WHERE close IS NULL OR close <= 0
UNION ALL SELECT session, asset, 'outside_wealth' FROM y WHERE ps IS NOT NULL AND (v IS NULL OR v <= -1)""")
def return_guards(spark, d):
    """What keeps a panel from having returns: a negative, a missing and a zero close, and what follows from them."""
    p, n = views.numbered(views.events_panel(spark, d)), F.col("n")
    at = lambda k, a: (n == k) & (F.col("asset") == a)
    close = F.when(at(4, "click"), -1.0).when(at(6, "view"), None).when(at(8, "error"), 0.0).otherwise(F.col("close"))
    p = p.withColumn("close", close)
    before = F.lag("close").over(rets.by_asset())
    value = F.try_divide(F.col("close") - before, before)
    r = p.select("session", "asset", F.lag("session").over(rets.by_asset()).alias("period_start"), value.alias("value"))
    return rets.outside_wealth(p, r)


LAST = "(SELECT max(session) FROM v1)"


@query(f""", w AS (SELECT DISTINCT session FROM r1 WHERE r IS NOT NULL AND session < {LAST} ORDER BY session DESC LIMIT 10),
k AS (SELECT asset, session, dollar_volume, row_number() OVER (PARTITION BY asset ORDER BY session DESC) AS k FROM r1 JOIN w USING (session))
SELECT asset, session, 'missing_volume' AS problem FROM k WHERE asset = 'click' AND k IN (2, 5)
UNION ALL SELECT asset, session, 'negative_volume' FROM k WHERE asset = 'view' AND k = 3
UNION ALL SELECT asset, session, 'unavailable' FROM k WHERE asset = 'error' AND k = 1
UNION ALL SELECT 'stranger', session, 'unexpected_volume' FROM k WHERE asset = 'view' AND k = 4
UNION ALL SELECT asset, session, 'missing_return' FROM k WHERE asset = 'signup' AND k = 6
UNION ALL SELECT asset, session, 'unexpected_volume' FROM k WHERE FALSE
UNION ALL SELECT 'purchase', NULL, 'nonpositive_average'""")
def liquidity_guards(spark, d):
    """Each rule of liquidity with an offender: volumes lost, negative, late, of a stranger, all zero, and a lost return."""
    p = views.events_panel(spark, d)
    r = rets.returns(p)
    last = p.agg(F.max("session")).first()[0]
    days = r.where("value is not null").select("session").distinct().where(F.col("session") < F.lit(last)).orderBy(F.desc("session")).limit(10)
    k = r.join(F.broadcast(days), "session", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("session"))))
    v = k.select("session", "asset", "k").join(p.select("session", "asset", "dollar_volume"), ["session", "asset"])
    is_ = lambda a, *ks: (F.col("asset") == a) & F.col("k").isin(*ks)
    volume = F.when(is_("view", 3), -1.0).when(F.col("asset") == "purchase", 0.0).otherwise(F.col("dollar_volume"))
    known = F.when(is_("error", 1), F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("session").cast("timestamp"))
    v = v.where(~is_("click", 2, 5)).withColumn("dollar_volume", volume).withColumn("available_at", known)
    v = v.unionByName(v.where(is_("view", 4)).withColumn("asset", F.lit("stranger")))
    lost = k.where(is_("signup", 6)).select("session", "asset")
    return allocation.liquidity_problems(r.join(lost, ["session", "asset"], "left_anti"), v, str(last), 10)


@query(f""", w AS (SELECT DISTINCT session FROM r1 WHERE session < {LAST} ORDER BY session DESC LIMIT 15),
x AS (SELECT session, asset, r FROM r1 JOIN w USING (session)), e AS (SELECT asset, (row_number() OVER (ORDER BY asset) - 1) AS u FROM (SELECT DISTINCT asset FROM v1)),
g AS (SELECT asset, u / (SELECT sum(u) FROM e) * 1.5 AS w FROM e), pf AS (SELECT session, sum(w * r) AS p FROM x JOIN g USING (asset) GROUP BY session),
s AS (SELECT stddev_samp(p) * sqrt(252) AS vol FROM pf), c AS (SELECT asset, covar_samp(r, p) * 252 AS cov, count(*) AS n FROM x JOIN pf USING (session) GROUP BY asset)
SELECT asset, round(w, 9) AS equity_weight, round(cov / vol, 9) AS marginal_volatility, round(w * cov / vol, 9) AS volatility_contribution,
  round(w * cov / vol / vol, 9) AS fraction_of_total, n AS n_obs, 'ok' AS status FROM c JOIN g USING (asset), s""")
def risk_report(spark, d):
    """Marginal and total contributions at one and a half times equity, one asset with a weight of zero."""
    p = views.events_panel(spark, d)
    last = str(p.agg(F.max("session")).first()[0])
    w = p.select("asset").distinct().withColumn("weight", (F.row_number().over(Window.orderBy("asset")) - 1).cast("double"))
    return rounded(allocation.risk_report(rets.returns(p), w, last, 15, 252.0, 1.5))


@query(f""", w AS (SELECT DISTINCT session FROM r1 WHERE session < {LAST} ORDER BY session DESC LIMIT 15), x AS (SELECT session, asset, r FROM r1 JOIN w USING (session))
SELECT a.asset, b.asset AS other_asset, round(covar_samp(a.r, b.r) * 252, 9) AS annualized_covariance FROM x a JOIN x b USING (session) GROUP BY 1, 2""")
def covariance_table(spark, d):
    p = views.events_panel(spark, d)
    return rounded(allocation.covariances(rets.returns(p), str(p.agg(F.max("session")).first()[0]), 15, 252.0))


RUN = DAILY + """, o AS (SELECT *, row_number() OVER (ORDER BY session) AS n FROM d1)
"""


@query(RUN + """SELECT 'equal_weight' AS scenario, session, rule FROM o, LATERAL (VALUES (5, 'cumulative_pnl'), (8, 'opening_equity'), (11, 'valuation_missing_close'),
  (12, 'close_valuation'), (3, 'valuation_unexpected_pre_rebalance'), (6, 'valuation_missing_pre_reinvestment')) AS v(k, rule) WHERE n = k
UNION ALL SELECT 'equal_weight', NULL, 'stop_without_reason' UNION ALL SELECT 'equal_weight', period_start, 'entry_valuation' FROM o WHERE n = 1""")
def run_problems(spark, d):
    """A sound run with eight faults: in its money, its valuations and what it says of itself."""
    o = daily(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("scenario").orderBy("session")))
    n, before = F.col("n"), F.col("equity") - F.col("pnl")
    to_now = Window.partitionBy("scenario").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    records = o.select(
        "scenario", "period_start", "session", (before + F.when(n == 8, 1.0).otherwise(0.0)).alias("opening_equity"), "equity", "pnl", "simple_return",
        (F.col("cumulative_pnl") + F.when(n == 5, 1.0).otherwise(0.0)).alias("cumulative_pnl"), F.sum("simple_return").over(to_now).alias("cumulative_simple_return"),
        (F.col("wealth") - 1).alias("compounded_return"),
    )
    row = lambda phase, equity, place: F.struct(F.lit(phase).alias("phase"), equity.alias("equity"), place.alias("place"))
    entry = o.where("n = 1").select("scenario", F.col("period_start").alias("session"), F.explode(F.array(row("pre_entry", F.lit(CAPITAL + 5), F.lit(0)), row("post_entry", F.lit(CAPITAL), F.lit(1)))).alias("v"))
    more = o.where("n = 3").select("scenario", "session", row("pre_rebalance", F.col("equity"), n * 2 + 1).alias("v"))
    closes = o.where("n <> 11").select("scenario", "session", row("close", F.col("equity") + F.when(n == 12, 1.0).otherwise(0.0), n * 2 + 2).alias("v"))
    valuations = entry.unionByName(more).unionByName(closes).select("scenario", "session", "v.*")
    ends = o.groupBy("scenario").agg(F.min("period_start").alias("entry_session"), F.max("session").alias("actual_end_session"))
    table = ends.select(
        "scenario", F.lit(CAPITAL).alias("capital"), "entry_session", F.date_add("actual_end_session", 5).alias("end_session"), "actual_end_session", F.lit("stopped").alias("status"),
        F.lit(" ").alias("stop_reason"), F.col("actual_end_session").alias("stop_session"),
    )
    return runs.run_problems(records, valuations, table, o.where("n = 6").select("scenario", "session", F.lit("reinvestment").alias("kind")))


def _three_reports(spark, d) -> DataFrame:
    """The equal-weight run, one that ends two sessions earlier, and one with another return on its fourth session."""
    o = daily(spark, d).select("period_start", "session", "simple_return", F.row_number().over(Window.partitionBy("scenario").orderBy("session")).alias("n"))
    last = o.agg(F.max("n").alias("last"))
    o = o.join(F.broadcast(last))  # one row
    value = F.when((F.col("scenario") == "other") & (F.col("n") == 4), 0.5).otherwise(F.col("simple_return"))
    o = o.withColumn("scenario", F.explode(F.array(*map(F.lit, ("base", "short", "other"))))).withColumn("simple_return", value)
    return o.where("scenario <> 'short' or n <= last - 2").select("scenario", "period_start", "session", "simple_return")


@query(RUN + """SELECT v.scenario, period_start, session, v.side FROM o, LATERAL (VALUES ('short', 'only_reference'), ('other', 'values_differ')) AS v(scenario, side)
  WHERE CASE v.scenario WHEN 'short' THEN n > (SELECT max(n) FROM o) - 2 ELSE n = 4 END""")
def report_differences(spark, d):
    """Intervals and returns in which two reports differ from a third."""
    return comparison.interval_differences(_three_reports(spark, d), "base", ("simple_return",))


@query("SELECT * FROM (VALUES ('short', 'coverage'), ('short', 'returns'), ('other', 'returns'), ('other', 'currency')) AS v(scenario, field)")
def report_fields(spark, d):
    """Fields in which reports differ, found by the digests of their series and by their settings."""
    s = _three_reports(spark, d)
    settings = s.select("scenario").distinct().select("scenario", F.lit("currency").alias("field"), F.when(F.col("scenario") == "other", "EUR").otherwise("USD").alias("content"))
    sig = comparison.content_key(s, "coverage").unionByName(comparison.content_key(s, "returns", ("simple_return",))).unionByName(settings)
    return comparison.differences(sig, "base").select("scenario", "field")


MIX = """, f AS (SELECT p1.session, p1.period_start, p1.r AS m, max(r1.r) FILTER (WHERE asset = (SELECT min(asset) FROM v1)) AS a, max(r1.r) FILTER (WHERE asset = (SELECT max(asset) FROM v1)) AS b
  FROM p1 JOIN r1 USING (session) GROUP BY 1, 2, 3)
"""


def _two_strategies(spark, d) -> DataFrame:
    """session, period_start, a, b, m: the returns of the first and the last asset, and of all of them."""
    r = rets.returns(views.events_panel(spark, d)).where(F.col("value").isNotNull())
    wide = r.groupBy("session").agg(F.min_by("value", "asset").alias("a"), F.max_by("value", "asset").alias("b"))
    return wide.join(equal_weight(spark, d).select("session", "period_start", F.col("r").alias("m")), "session")


@query(MIX + """, c AS (SELECT *, 0.3 * a + 0.7 * b AS x FROM f), g AS (SELECT *, 1000 * coalesce(product(1 + x) OVER (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS opening FROM c)
SELECT period_start, session, s.strategy, s.weight, round(s.r, 9) AS strategy_return, round(s.weight * s.r, 9) AS return_contribution, round(s.r - m, 9) AS active_return, round(s.weight * (s.r - m), 9) AS active_contribution,
  round(opening * s.weight, 6) AS sleeve_opening, round(opening * s.weight * s.r, 6) AS pnl_contribution FROM g, LATERAL (VALUES ('a', 0.3::DOUBLE, a), ('b', 0.7::DOUBLE, b)) AS s(strategy, weight, r)""")
def mix_contributions(spark, d):
    """What each of two strategies adds to a mix, to its active return and to its money."""
    f = _two_strategies(spark, d)
    long = f.select("period_start", "session", F.explode(F.array(*(F.struct(F.lit(k).alias("strategy"), F.col(k).alias("r")) for k in "ab"))).alias("s")).select("period_start", "session", "s.*")
    ends = long.agg(F.min("period_start").alias("a"), F.max("session").alias("b")).first()
    out = mixes.contributions(mixes.window_of(long, str(ends["a"]), str(ends["b"])), {"a": 0.3, "b": 0.7}, f.select("period_start", "session", F.col("m").alias("b")), 1000.0)
    return rounded(out).withColumns({c: F.round(c, 6) for c in ("sleeve_opening", "pnl_contribution")})


@query(MIX + """, s AS (SELECT avg(a - m) AS mx, avg(b - m) AS my, var_samp(a - m) AS vx, var_samp(b - m) AS vy, covar_samp(a - m, b - m) AS c FROM f),
k AS (SELECT *, (mx * vy - my * c) / (mx * vy - my * c + my * vx - mx * c) AS st, (vy - c) / (vx + vy - 2 * c) AS lt FROM s),
w AS (SELECT s.*, v.candidate, v.weight FROM k AS s, LATERAL (VALUES ('lower_endpoint', 0.1::DOUBLE), ('upper_endpoint', 0.8), ('stationary', CASE WHEN st > 0.1 AND st < 0.8 THEN st END),
  ('minimum_tracking_error', CASE WHEN lt > 0.1 AND lt < 0.8 THEN lt END)) AS v(candidate, weight) WHERE weight IS NOT NULL),
r AS (SELECT *, weight * mx + (1 - weight) * my AS mean, weight * weight * vx + (1 - weight) * (1 - weight) * vy + 2 * weight * (1 - weight) * c AS var FROM w)
SELECT candidate, round(weight, 9) AS weight, round(mean * 252, 9) AS active_mean, round(sqrt(var * 252), 9) AS tracking_error, round(mean * sqrt(252) / sqrt(var), 9) AS information_ratio, 'ok' AS candidate_status,
  mean / sqrt(var) = max(mean / sqrt(var)) OVER () AS selected, 'ok' AS status, 'unique' AS optimum FROM r""")
def mix_optimum(spark, d):
    """Candidates for the best information ratio of a mix of two assets within bounds."""
    return rounded(mixes.optimum(_two_strategies(spark, d).select("session", "a", "b", "m"), 252.0, 0.1, 0.8))


DATED = """, x AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY session) AS n, lead(session) OVER (PARTITION BY asset ORDER BY session) AS next FROM r1),
z AS (SELECT *, stddev_samp(r) OVER w AS vol, avg(dollar_volume) OVER w AS adv, count(r) OVER w AS known FROM x WINDOW w AS (PARTITION BY asset ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
b AS (SELECT session AS decision, next AS session, asset, n, vol, adv, close FROM z WHERE known = 5 AND next IS NOT NULL)
"""


def _dated(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Executions at the session after each decision, models from the five sessions before it, and the calendar."""
    w = Window.partitionBy("asset").orderBy("session")
    p = views.events_panel(spark, d)
    x = rets.returns(p).join(p.select("session", "asset", "dollar_volume", "close"), ["session", "asset"])
    five = w.rowsBetween(-5, -1)
    x = x.select(
        "asset", "session", "close", F.row_number().over(w).alias("n"), F.lead("session").over(w).alias("next"), F.stddev_samp("value").over(five).alias("daily_volatility"),
        F.avg("dollar_volume").over(five).alias("dollar_adv"), F.count("value").over(five).alias("known"), F.min("session").over(five).alias("sample_start"), F.max("session").over(five).alias("sample_end"),
    ).where("known = 5 and next is not null")
    models = x.select(
        F.col("session").alias("decision"), "asset", "n", "daily_volatility", "dollar_adv", "sample_start", "sample_end", (F.col("sample_end").cast("timestamp") + F.expr("INTERVAL 22 HOURS")).alias("available_at"),
    )
    executions = x.select(F.col("next").alias("session"), F.col("session").alias("decision"), "asset", (F.col("close") * 100).alias("signed_notional"))
    return executions, models, p.select("session").distinct().withColumn("close_at", F.col("session").cast("timestamp") + F.expr("INTERVAL 21 HOURS"))


@query(DATED + """SELECT session, decision, asset, round(close * 100 * 0.0003, 9) AS direct_costs, round(close * 100 * 0.5 * vol * sqrt(close * 100 / adv), 6) AS impact FROM b""")
def dated_costs_of_executions(spark, d):
    """Costs of every execution by the parameters of exactly its decision."""
    executions, models, sessions = _dated(spark, d)
    out = dated_costs.dated_impact(dated_costs.bound_costs(executions, models.drop("n"), sessions), 1.0, 2.0, 0.5)
    return out.select("session", "decision", "asset", F.round(F.col("commission") + F.col("half_spread"), 9).alias("direct_costs"), F.round("impact", 6).alias("impact"))


@query(DATED + """SELECT decision, asset, rule FROM b, LATERAL (VALUES (9, 'click', 'asset_without_parameters'), (10, 'view', 'unusable_parameters'), (11, 'error', 'sample_not_before_decision'),
  (11, 'error', 'available_before_sample_ends'), (12, 'signup', 'available_after_decision'), (13, 'view', 'sample_off_sessions'), (14, 'click', 'repeated_parameters')) AS v(k, who, rule) WHERE n = k AND asset = who
UNION ALL SELECT DISTINCT decision, NULL, 'decision_without_model' FROM b WHERE n = 15""")
def cost_binding_problems(spark, d):
    """Models that lack an asset or a decision, know too much, or sample what is no session."""
    executions, m, sessions = _dated(spark, d)
    at = lambda k, a: (F.col("n") == k) & (F.col("asset") == a)
    m = m.where(~at(9, "click") & (F.col("n") != 15))
    m = m.unionByName(m.where(at(14, "click"))).withColumns({
        "dollar_adv": F.when(at(10, "view"), 0.0).otherwise(F.col("dollar_adv")), "sample_end": F.when(at(11, "error"), F.col("decision")).otherwise(F.col("sample_end")),
        "available_at": F.when(at(12, "signup"), F.col("decision").cast("timestamp") + F.expr("INTERVAL 22 HOURS")).otherwise(F.col("available_at")),
        "sample_start": F.when(at(13, "view"), F.date_sub("sample_start", 400)).otherwise(F.col("sample_start")),
    })
    return dated_costs.binding_problems(executions, m.drop("n"), sessions)


def _provider(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chart responses of the events panel (split-adjusted closes, volumes, event maps), and its splits and dividends."""
    p = views.events_panel(spark, d)
    splits, dividends = views.panel_splits(p), views.panel_dividends(p)
    factors = provider.split_factors(p.select(F.col("asset").alias("symbol"), "session"), splits)
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp")) + 14 * 3600
    b = p.join(factors.withColumnRenamed("symbol", "asset"), ["asset", "session"]).select("asset", "session", (F.col("close") / F.col("factor")).alias("close"), F.round(F.col("dollar_volume") * 100).cast("long").alias("volume"))
    bars = b.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct(at("session").alias("t"), "close", "volume"))).alias("bars"))  # an asset's days
    key = lambda c: at(c).cast("string")
    s = splits.groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct(key("effective_session"), F.struct(at("effective_session").alias("date"), F.col("ratio").alias("numerator"), F.lit(1.0).alias("denominator"))))).alias("splits"))
    c = dividends.groupBy("asset", "ex_session").agg(F.sum("cash_per_share").alias("cash"))
    c = c.groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct(key("ex_session"), F.struct(at("ex_session").alias("date"), F.col("cash").alias("amount"))))).alias("dividends"))
    x = bars.join(s, "asset", "left").join(c, "asset", "left")
    quote = F.struct(F.col("bars.close").alias("close"), F.col("bars.volume").alias("volume"))
    body = F.to_json(F.struct(
        F.struct(F.col("asset").alias("symbol"), F.lit("America/New_York").alias("exchangeTimezoneName")).alias("meta"), F.col("bars.t").alias("timestamp"),
        F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.col("bars.close").alias("adjclose"))).alias("adjclose")).alias("indicators"), F.struct("splits", "dividends").alias("events"),
    ))
    return x.select(body.alias("body")), splits, dividends


@query(""", s AS (SELECT n1.*, CASE WHEN n % 11 = 0 THEN 2.0::DOUBLE ELSE 1 END AS ratio FROM n1),
f AS (SELECT *, coalesce(product(ratio) OVER (PARTITION BY asset ORDER BY session DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS factor FROM s)
SELECT asset AS symbol, session, round(close, 9) AS close, round(floor(dollar_volume * 100 + 0.5) / factor, 6) AS share_volume, round(floor(dollar_volume * 100 + 0.5) / factor * close, 4) AS dollar_volume FROM f""")
def provider_bars(spark, d):
    """Raw closes and volumes out of split-adjusted charts, by backward products of the splits in their event maps."""
    responses, _, _ = _provider(spark, d)
    bars, events = provider.chart_bars(responses), provider.chart_events(responses)
    splits = events.where("kind = 'split'").select(F.col("symbol").alias("asset"), F.col("session").alias("effective_session"), F.col("value").alias("ratio"))
    out = provider.raw_bars(bars, provider.split_factors(bars, splits), "split_adjusted")
    return out.select("symbol", "session", F.round("close", 9).alias("close"), F.round("share_volume", 6).alias("share_volume"), F.round("dollar_volume", 4).alias("dollar_volume"))


@query("""SELECT asset AS symbol, session, kind, problem FROM n1, LATERAL (VALUES (11, 'click', 'split', 'not_in_table'), (22, 'view', 'split', 'value_differs'), (14, 'error', 'dividend', 'value_differs'),
  (7, 'signup', 'dividend', 'not_in_table'), (9, 'purchase', 'dividend', 'not_at_provider')) AS v(k, who, kind, problem) WHERE n = k AND asset = who""")
def provider_event_problems(spark, d):
    """Events of charts against tables that lack a split and a dividend, have one too many, and others of another size."""
    responses, splits, dividends = _provider(spark, d)
    n = views.numbered(views.events_panel(spark, d)).select("asset", "session", "n")
    s = splits.join(n.withColumnRenamed("session", "effective_session"), ["asset", "effective_session"]).where("not (asset = 'click' and n = 11)")
    s = s.withColumn("ratio", F.when((F.col("asset") == "view") & (F.col("n") == 22), 3.0).otherwise(F.col("ratio")))
    c = dividends.join(n.withColumnRenamed("session", "ex_session"), ["asset", "ex_session"]).where("not (asset = 'signup' and n = 7) and not (asset = 'error' and n = 14 and cash_per_share = 0.25)")
    more = n.where("asset = 'purchase' and n = 9").select("asset", F.col("session").alias("ex_session"), F.lit(1.0).alias("cash_per_share"))
    return provider.event_problems(provider.chart_events(responses), s, c.select("asset", "ex_session", "cash_per_share").unionByName(more))


@query("""SELECT 'dividends' AS name, 2 * count(*) AS rows FROM n1 WHERE n % 7 = 0 UNION ALL SELECT 'prices', count(*) FROM v1 UNION ALL SELECT 'splits', count(*) FROM n1 WHERE n % 11 = 0""")
def snapshot_rows(spark, d):
    """Rows of the tables of a snapshot, counted and digested by the writes themselves; the snapshot is loaded, checked and taken away again."""
    p = views.events_panel(spark, d)
    with temporary(spark) as folder:
        snapshots.save_snapshot({"prices": p, "splits": views.panel_splits(p), "dividends": views.panel_dividends(p)}, {"currency": "USD"}, f"{folder}/snapshot")
        snapshots.load_snapshot(spark, f"{folder}/snapshot")
        return snapshots.observed_rows(spark, f"{folder}/snapshot")


@query(catalog.SQL["series_report"].removeprefix("WITH RECURSIVE " + views.SQL.strip() + "\n"))
def series_report_exact(spark, d):
    """The report of the equal-weight run with exact sums: what rounding gives to nine digits, for any partitioning."""
    return rounded(reports.summary(daily(spark, d), 252.0, minimum=0.0001, risk_free=0.00005, exact=True))
