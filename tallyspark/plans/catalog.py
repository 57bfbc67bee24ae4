"""The query catalogue: every operator applied to a market view of the driver's tables, with SQL for DuckDB.

Doubles are rounded to nine decimals on both sides, as sums in another order may differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark import contracts
from tallyspark.functions.stats import correlation
from tallyspark.operators import allocation, factors, intervals, ledger, performance, reports, research, securities, signals
from tallyspark.operators import returns as rets
from tallyspark.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CAPITAL = 100_000.0
PERIODS = 252.0


def hours(n, day) -> Column:
    """The time ``n`` hours after the start of a date."""
    return F.timestamp_seconds(F.unix_seconds(F.col(day).cast("timestamp")) + n * 3600)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH RECURSIVE " + views.SQL.strip() + "\n" + sql.strip()
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def equal_weight(spark, d) -> DataFrame:
    """scenario, period_start, session, r: mean simple return of the assets each day."""
    r = rets.returns(views.events_panel(spark, d)).where(F.col("value").isNotNull())
    return r.groupBy("session").agg(
        F.min("period_start").alias("period_start"), F.avg("value").alias("r"),
    ).withColumn("scenario", F.lit("equal_weight"))


def daily(spark, d) -> DataFrame:
    p = equal_weight(spark, d).select("scenario", "period_start", "session", (F.col("r") * 10_000).alias("pnl"))
    return reports.net_asset_value(p, CAPITAL)


DAILY = """, g1 AS (SELECT session, period_start, r * 10000 AS pnl FROM p1),
e1 AS (SELECT *, 100000.0::DOUBLE + sum(pnl) OVER (ORDER BY session) AS equity, sum(pnl) OVER (ORDER BY session) AS
  cumulative_pnl FROM g1),
d1 AS (SELECT *, pnl / (equity - pnl) AS sr, equity / 100000.0::DOUBLE AS wealth, equity / greatest(100000.0::DOUBLE,
  max(equity) OVER (ORDER BY session)) - 1 AS drawdown FROM e1)
"""


@query(""", c AS (SELECT s.session, a.asset FROM (SELECT DISTINCT session FROM v3) s CROSS JOIN (SELECT DISTINCT asset
  FROM v3) a) SELECT c.session, c.asset, 'missing' AS problem FROM c ANTI JOIN v3 ON c.session = v3.session AND c.asset =
  v3.asset""")
def panel_completeness(spark, d):
    p = views.orders_panel(spark, d)
    return contracts.panel_completeness(p, p.select("session"), p.select("asset"))


@query("""SELECT asset, count(*) AS n_rows, count(*) FILTER (WHERE close IS NULL) AS n_null, count(*) FILTER (WHERE close <= 0) AS
  n_nonpositive, min(session) AS first_session, max(session) AS last_session FROM v1 GROUP BY asset""")
def panel_checks(spark, d):
    p = contracts.PRICES.check(views.events_panel(spark, d).select("session", "asset", "close"))
    return p.groupBy("asset").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("close").isNull()).alias("n_null"),
        F.count_if(F.col("close") <= 0).alias("n_nonpositive"), F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
    )


@query("""SELECT period_start, session, asset, round((close - lag(close) OVER w) / lag(close) OVER w, 9) AS value
  FROM r1 WINDOW w AS (PARTITION BY asset ORDER BY session)""")
def simple_returns(spark, d):
    return rounded(rets.returns(views.events_panel(spark, d)))


@query("""SELECT period_start, session, asset, round(ln(1 + (close - lag(close) OVER w) / lag(close) OVER w), 9) AS value
  FROM r1 WINDOW w AS (PARTITION BY asset ORDER BY session)""")
def log_returns(spark, d):
    return rounded(rets.returns(views.events_panel(spark, d), "log"))


@query("""SELECT period_start, session, asset, round(((close + CASE WHEN n % 7 = 0 THEN 0.75 ELSE 0 END) * CASE WHEN n % 11 = 0 THEN
  2.0::DOUBLE ELSE 1 END - p) / p, 9) AS value
FROM (SELECT n1.*, lag(close) OVER w AS p, lag(session) OVER w AS period_start FROM n1 WINDOW w AS (PARTITION BY asset
  ORDER BY session))""")
def total_returns(spark, d):
    p = views.events_panel(spark, d)
    return rounded(rets.returns(p, splits=views.panel_splits(p), dividends=views.panel_dividends(p)))


CUMULATIVE = """SELECT period_start, session, asset, round({value}, 9) AS value, CASE WHEN r IS NOT NULL THEN round({total}, 9) END AS cumulative
FROM r1 WINDOW w AS (PARTITION BY asset ORDER BY session)"""


@query(CUMULATIVE.format(value="r", total="product(1 + r) OVER w"))
def cumulative_wealth(spark, d):
    return rounded(rets.cumulative_returns(rets.returns(views.events_panel(spark, d)), "wealth"))


@query(CUMULATIVE.format(value="r", total="product(1 + r) OVER w - 1"))
def cumulative_compound(spark, d):
    return rounded(rets.cumulative_returns(rets.returns(views.events_panel(spark, d)), "compound"))


@query(CUMULATIVE.format(value="r", total="sum(r) OVER w"))
def cumulative_sum(spark, d):
    return rounded(rets.cumulative_returns(rets.returns(views.events_panel(spark, d)), "sum"))


@query("""SELECT period_start, session, asset, round(ln(1 + r), 9) AS value,
 CASE WHEN r IS NOT NULL THEN round(close / first_value(close) OVER w, 9) END AS cumulative
  FROM r1 WINDOW w AS (PARTITION BY asset ORDER BY session)""")
def cumulative_log_wealth(spark, d):
    """Wealth of log returns: it must be the ratio of closes."""
    return rounded(rets.cumulative_returns(rets.returns(views.events_panel(spark, d), "log"), "wealth", "log"))


@query(""", b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY session) AS n FROM r1),
x AS (SELECT session, asset, n, CASE WHEN n = 5 THEN session - 2 ELSE period_start END AS period_start, CASE WHEN n = 7 THEN
  NULL WHEN n = 9 THEN -1.5 ELSE r END AS r FROM b WHERE NOT (n = 1 AND asset = 'click'))
SELECT session, asset, CASE WHEN asset = 'click' AND n = 2 THEN 'leading_value' WHEN n = 7 THEN 'missing_value' WHEN n = 5 THEN
  'gap' WHEN n = 9 THEN 'no_wealth' END AS problem FROM x
WHERE (asset = 'click' AND n = 2) OR n IN (5, 7, 9)""")
def return_problems(spark, d):
    """Each rule of accumulation with its offenders: a lost first row, a shifted start, a lost value, a loss of everything."""
    r = views.numbered(rets.returns(views.events_panel(spark, d))).where("not (n = 1 and asset = 'click')")
    n = F.col("n")
    broken = r.withColumn("period_start", F.when(n == 5, F.date_sub("session", 2)).otherwise(F.col("period_start")))
    return rets.return_problems(broken.withColumn("value", F.when(n == 9, -1.5).when(n != 7, F.col("value"))))


@query("""SELECT a.asset AS asset_x, b.asset AS asset_y, count(p.rx) AS n_obs, CASE WHEN count(p.rx) > 1 THEN round(greatest(-1, least(1,
  corr(p.rx, p.ry))), 9) END AS correlation,
 CASE count(p.rx) WHEN 0 THEN 'empty_sample' WHEN 1 THEN 'insufficient_samples' ELSE 'ok' END AS status
FROM (SELECT DISTINCT asset FROM r1) a CROSS JOIN (SELECT DISTINCT asset FROM r1) b
LEFT JOIN (SELECT x.asset AS ax, y.asset AS ay, x.r AS rx, y.r AS ry FROM r1 x JOIN r1 y ON x.session = y.session
  WHERE x.r IS NOT NULL AND y.r IS NOT NULL
  AND (x.asset <> 'click' OR day(x.session) % 2 = 0) AND (y.asset <> 'click' OR day(y.session) % 2 = 0)
  AND (x.asset <> 'view' OR day(x.session) % 2 = 1) AND (y.asset <> 'view' OR day(y.session) % 2 = 1)) p ON p.ax = a.asset AND
  p.ay = b.asset GROUP BY 1, 2""")
def correlation_of_disjoint_assets(spark, d):
    """Assets that share no session have an empty sample, not an absent row."""
    r = rets.returns(views.events_panel(spark, d))
    odd = F.dayofmonth("session") % 2
    kept = (F.col("asset") != "click") | (odd == 0)
    return rounded(rets.asset_correlation(r.withColumn("value", F.when(kept & ((F.col("asset") != "view") | (odd == 1)), F.col("value")))))


@query("""SELECT x.asset AS asset_x, y.asset AS asset_y, count(*) AS n_obs, round(greatest(-1, least(1, corr(x.r, y.r))), 9) AS
  correlation, 'ok' AS status
FROM r1 x JOIN r1 y ON x.session = y.session WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2""")
def asset_correlation(spark, d):
    return rounded(rets.asset_correlation(rets.returns(views.events_panel(spark, d))))


@query(DAILY + """, a AS (SELECT count(*) AS n, max_by(equity, session) AS e, sum(pnl) AS p, sum(sr) AS s, max_by(wealth, session) - 1 AS c,
  avg(sr) AS m, least(min(drawdown), 0) AS dd, stddev_samp(sr) AS v, sqrt(avg(pow(least(sr - 0.0001, 0), 2))) AS down
  FROM d1)
SELECT 'equal_weight' AS scenario, m.metric, round(m.value, 9) AS value, m.unit, n AS n_obs, 'ok' AS status
  FROM a, LATERAL (VALUES
 ('ending_equity', e, 'money'), ('cumulative_pnl', p, 'money'), ('cumulative_simple_return', s, 'fraction'),
  ('compounded_return', c, 'fraction'), ('annualized_arithmetic_mean', a.m * 252, 'fraction/year'),
 ('max_drawdown', dd, 'fraction'), ('annualized_volatility', v * sqrt(252), 'fraction/sqrt(year)'), ('sharpe', (a.m - 0.00005) *
  sqrt(252) / v, 'ratio'), ('sortino', (a.m - 0.0001) * sqrt(252) / down, 'ratio')) AS m(metric, value, unit)""")
def series_report(spark, d):
    return rounded(reports.summary(daily(spark, d), PERIODS, minimum=0.0001, risk_free=0.00005))


@query(DAILY + "SELECT 'equal_weight' AS scenario, session, round(equity, 6) AS equity, round(drawdown, 9) AS drawdown FROM d1")
def drawdown(spark, d):
    return daily(spark, d).select("scenario", "session", F.round("equity", 6).alias("equity"), F.round("drawdown", 9).alias("drawdown"))


@query(DAILY + """, b AS (SELECT d1.*, r1.r AS b FROM d1 JOIN r1 USING (session) WHERE r1.asset = (SELECT min(asset) FROM v1)),
w AS (SELECT *, count(*) OVER f AS n_obs, stddev_samp(sr) OVER f AS v, avg(sr) OVER f AS m, covar_samp(b, sr) OVER f AS c,
  stddev_samp(b) OVER f AS bv FROM b WINDOW f AS (ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT 'equal_weight' AS scenario, session, n_obs, CASE WHEN n_obs = 10 THEN round(v * sqrt(252), 9) END AS
  annualized_volatility, CASE WHEN n_obs = 10 THEN round(m * sqrt(252) / v, 9) END AS sharpe,
 CASE WHEN n_obs = 10 THEN 'ok' ELSE 'insufficient_samples' END AS volatility_status, CASE WHEN n_obs = 10 THEN 'ok' ELSE
  'insufficient_samples' END AS sharpe_status,
 CASE WHEN n_obs = 10 THEN round(c / (bv * bv), 9) END AS beta, CASE WHEN n_obs = 10 THEN round(c / (bv * v), 9) END AS
  correlation FROM w""")
def rolling_risk(spark, d):
    r = rets.returns(views.events_panel(spark, d))
    first = r.groupBy("session").agg(F.min_by("value", "asset").alias("b"))
    return rounded(reports.rolling_risk(daily(spark, d).join(first, "session"), 10, PERIODS, benchmark="b"))


@query(DAILY + """, k AS (SELECT sr, row_number() OVER (ORDER BY sr DESC) AS rank, count(*) OVER () AS n FROM d1), l AS (SELECT unnest(['0.95',
  '0.9', '0.07']) AS confidence),
t AS (SELECT confidence, max(sr) FILTER (WHERE rank = ceil(CAST(confidence AS DECIMAL(12,10)) * n)) AS threshold
  FROM k, l GROUP BY 1)
SELECT 'equal_weight' AS scenario, confidence, round(threshold, 9) AS threshold, round(avg(sr), 9) AS tail_mean, count(*) AS
  n_tail FROM t JOIN k ON sr <= threshold GROUP BY confidence, threshold""")
def tail_risk(spark, d):
    return rounded(reports.tail_risk(daily(spark, d), ("0.95", "0.9", "0.07")))


@query(
    "SELECT asset, count(r) AS n_obs, round(skewness(r), 6) AS skewness, round(kurtosis(r), 6) AS excess_kurtosis FROM r1 GROUP BY asset"
)
def higher_moments(spark, d):
    return rounded(reports.higher_moments(rets.returns(views.events_panel(spark, d)), ("asset",), "value"), 6)


@query(DAILY + """, a AS (SELECT count(*) AS n, max_by(wealth, session) AS w, max(session) - min(period_start) AS days, least(min(drawdown), 0) AS
  dd FROM d1)
SELECT 'equal_weight' AS scenario, n AS n_obs, round(exp(ln(w) / (n / 252.0::DOUBLE)) - 1, 9) AS cagr_periods, round(exp(ln(w) /
  (days / 365.25::DOUBLE)) - 1, 9) AS cagr_calendar, round((exp(ln(w) / (days / 365.25::DOUBLE)) - 1) / abs(dd), 9) AS calmar,
  'ok' AS calmar_status FROM a""")
def growth(spark, d):
    return rounded(reports.growth(daily(spark, d), PERIODS))


@query("""SELECT asset, count(*) AS n_obs, round(corr(p1.r, r1.r), 9) AS correlation, round(covar_samp(p1.r, r1.r) / var_samp(p1.r), 9) AS
  beta, round(stddev_samp(r1.r - p1.r) * sqrt(252), 9) AS tracking_error,
round(avg(r1.r - p1.r) * 252 / (stddev_samp(r1.r - p1.r) * sqrt(252)), 9) AS information_ratio
  FROM r1 JOIN p1 USING (session) WHERE r1.r IS NOT NULL GROUP BY asset""")
def benchmark_stats(spark, d):
    r = rets.returns(views.events_panel(spark, d)).where(F.col("value").isNotNull()).select("session", "asset", F.col("value").alias("r"))
    return rounded(
        reports.against_benchmark(r.join(equal_weight(spark, d).select("session", F.col("r").alias("b")), "session"), PERIODS, ("asset",))
    )


@query("""SELECT asset, bin, count(*) AS n, round(max(lo + (hi - lo) / 12 * (bin - 1)), 9) AS low, round(max(lo + (hi - lo) / 12 * bin),
  9) AS high FROM (
 SELECT asset, lo, hi, CAST(least(12, floor((r - lo) / ((hi - lo) / 12)) + 1) AS BIGINT) AS bin
  FROM (SELECT asset, r, min(r) OVER (PARTITION BY asset) AS lo, max(r) OVER (PARTITION BY asset) AS hi
  FROM r1 WHERE r IS NOT NULL)) GROUP BY asset, bin""")
def return_distribution(spark, d):
    r = rets.returns(views.events_panel(spark, d)).where(F.col("value").isNotNull())
    return rounded(reports.histogram(r, "value", 12, ("asset",)))


@query(""", f AS (SELECT p1.session, p1.r, max(r1.r) FILTER (WHERE asset = (SELECT min(asset) FROM v1)) AS first, max(r1.r) FILTER (WHERE
  asset = (SELECT max(asset) FROM v1)) AS last FROM p1 JOIN r1 USING (session) GROUP BY 1, 2),
u AS (SELECT 'first' AS factor, r, first AS x FROM f UNION ALL SELECT 'last', r, last FROM f)
SELECT factor, count(*) AS n_obs, round(regr_slope(r, x), 9) AS beta, round(regr_intercept(r, x), 9) AS alpha, round(corr(r, x),
  9) AS correlation, round(corr(r, x) * corr(r, x), 9) AS r_squared FROM u GROUP BY factor""")
def factor_standalone(spark, d):
    return rounded(factors.standalone(_factor_series(spark, d), ("first", "last")))


def _factor_series(spark, d):
    r = rets.returns(views.events_panel(spark, d)).where(F.col("value").isNotNull())
    wide = r.groupBy("session").agg(F.min_by("value", "asset").alias("first"), F.max_by("value", "asset").alias("last"))
    return wide.join(equal_weight(spark, d).select("session", "r"), "session")


@query(""", f AS (SELECT p1.session, p1.r AS y, max(r1.r) FILTER (WHERE asset = (SELECT min(asset) FROM v1)) AS x, max(r1.r) FILTER (WHERE
  asset = (SELECT max(asset) FROM v1)) AS z FROM p1 JOIN r1 USING (session) GROUP BY 1, 2),
m AS (SELECT covar_samp(x, y) AS xy, covar_samp(z, y) AS zy, covar_samp(x, z) AS xz, var_samp(x) AS xx, var_samp(z) AS zz,
  avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM f),
b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2, * FROM m)
SELECT t.term, round(t.c, 9) AS coefficient, 'ok' AS status FROM b, LATERAL (VALUES ('intercept', my - b1 * mx - b2 * mz),
  ('first', b1), ('last', b2)) AS t(term, c)""")
def factor_joint_ols(spark, d):
    return rounded(factors.joint_ols(_factor_series(spark, d), ("first", "last")))


FIT = """, f AS (SELECT p1.session, p1.r AS y, max(r1.r) FILTER (WHERE asset = (SELECT min(asset) FROM v1)) AS x, max(r1.r) FILTER (WHERE
  asset = (SELECT max(asset) FROM v1)) AS z FROM p1 JOIN r1 USING (session) GROUP BY 1, 2),
m AS (SELECT covar_samp(x, y) AS xy, covar_samp(z, y) AS zy, covar_samp(x, z) AS xz, var_samp(x) AS xx, var_samp(z) AS zz,
  avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM f),
b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2, * FROM m),
t AS (SELECT session, x, z, y, my - b1 * mx - b2 * mz + b1 * x + b2 * z AS fitted FROM f, b)
"""


def _fit(spark, d):
    s, names = _factor_series(spark, d), ("first", "last")
    return factors.fitted(s, names, factors.joint_ols(s, names))


@query(FIT + "SELECT session, round(fitted, 9) AS fitted, round(y - fitted, 9) AS residual FROM t")
def factor_fitted(spark, d):
    return rounded(_fit(spark, d).select("session", "fitted", "residual"))


@query(FIT + """, a AS (SELECT count(*) AS n, sum((y - fitted) * (y - fitted)) AS sse, var_samp(y) * (count(*) - 1) AS sst FROM t)
SELECT metric, round(value, 9) AS value, unit, n AS n_obs, 'ok' AS status FROM a, LATERAL (VALUES ('n_obs', n::DOUBLE,
  'intervals'), ('n_factors', 2, 'count'), ('residual_df', n - 3, 'count'), ('r_squared', 1 - sse / sst, 'fraction'), ('sse',
  sse, 'fraction^2'),
 ('annualized_idiosyncratic_volatility', sqrt(252 * sse / (n - 3)), 'fraction/sqrt(year)')) AS v(metric, value, unit)""")
def factor_summary(spark, d):
    return rounded(factors.fit_summary(_fit(spark, d), ("first", "last"), PERIODS))


@query(FIT + """, u AS (SELECT session, unnest(['r', 'first', 'last']) AS s, unnest([y, x, z]) AS v FROM t)
SELECT a.s AS series, b.s AS other_series, round(greatest(-1, least(1, corr(a.v, b.v))), 9) AS correlation, count(*) AS n_obs,
  'ok' AS status FROM u a JOIN u b USING (session) GROUP BY 1, 2""")
def factor_correlations(spark, d):
    return rounded(factors.series_correlations(_factor_series(spark, d), ("r", "first", "last")))


#: Securities of the events panel: click is suspended, view, purchase and signup end with a deal, error distributes clicks.
SECURITIES = """, s1 AS (SELECT session, n FROM n1 WHERE asset = 'error'),
q1 AS (SELECT n1.*, CASE WHEN n % 11 = 0 THEN 2.0::DOUBLE ELSE 1 END AS ratio, CASE WHEN n % 7 = 0 THEN 0.75::DOUBLE ELSE 0 END
  AS cash FROM n1
  WHERE NOT (asset = 'click' AND n BETWEEN 10 AND 12) AND NOT (asset = 'view' AND n > 20) AND NOT (asset = 'purchase' AND n >
  28) AND NOT (asset = 'signup' AND n > 9)),
l1 AS (SELECT q1.*, lag(session) OVER w AS ps, lag(close) OVER w AS prior, CASE WHEN asset = 'error' AND n = 6 THEN 0.1 *
  (SELECT close FROM n1 WHERE asset = 'click' AND n = 6) / ratio WHEN asset = 'error' AND n = 10 THEN 0.1 * 7.0 / ratio ELSE 0
  END AS extra,
  CASE WHEN n = 1 THEN 'first_observation' WHEN asset = 'click' AND n = 13 THEN 'quote_gap' WHEN asset = 'error' AND n = 10 THEN
  'supplied_mark_valuation' WHEN asset = 'error' AND n = 12 THEN 'unvalued_distribution' ELSE 'ok' END AS status
  FROM q1 WINDOW w AS (PARTITION BY asset ORDER BY session))
"""


def _securities(spark, d):
    p = views.numbered(views.events_panel(spark, d).select("session", "asset", "close"))
    days = p.where("asset = 'error'").select("session", "n")
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("session")))
    dates = days.agg(
        *(at(k).alias(f"d{k}") for k in (1, 6, 9, 10, 11, 12, 20, 22, 24, 28)), F.date_add(F.max("session"), 10).alias("after"),
    )

    def rows(names: str, *values: str) -> DataFrame:
        """A small table from rows of SQL expressions over the dates."""
        structs = F.array(
            *(F.expr(f"named_struct({', '.join(f'{n!r}, {v}' for n, v in zip(names.split(), row.split('|'), strict=True))})") for row in values)
        )
        return dates.select(F.explode(structs).alias("x")).select("x.*")

    none, no_day, no_text = "cast(null as double)", "cast(null as date)", "cast(null as string)"
    secs = rows(
        "asset first_session last_session terminated_date", f"'click'|d1|{no_day}|{no_day}", f"'error'|d1|{no_day}|{no_day}",
        "'view'|d1|d20|d24", f"'purchase'|d1|d28|{no_day}", "'signup'|d1|d9|d12",
    )
    halts = rows("asset first_session last_session", "'click'|d10|d12")
    actions = rows(
        "action_id action_type source_asset effective_date announced_at", "'a1'|'distribution'|'error'|d6|cast(d1 as timestamp)", "'a2'|'distribution'|'error'|d10|cast(d6 as timestamp)",
        "'a3'|'distribution'|'error'|d12|cast(d6 as timestamp)", "'b1'|'acquisition'|'view'|d22|cast(d10 as timestamp)", "'b2'|'acquisition'|'purchase'|after|cast(d20 as timestamp)", "'b3'|'acquisition'|'signup'|d11|cast(d1 as timestamp)",
    )
    more = f"|{none}|{no_day}|{no_day}"
    legs = rows(
        "action_id leg_type asset units_per_source_share cash_per_source_share accrual_per_day accrual_start accrual_end", *(f"'a{k}'|'security'|'click'|0.1d|{none}{more}" for k in (1, 2, 3)),
        f"'b1'|'cash'|{no_text}|{none}|0.5d{more}", f"'b1'|'security'|'error'|0.5d|{none}{more}", f"'b2'|'cash'|{no_text}|{none}|1.0d{more}", f"'b3'|'security'|'click'|1.0d|{none}{more}",
    )
    marks = rows("session asset mark", "d10|'click'|7.0d")
    quoted = p.where(
        "not (asset = 'click' and n between 10 and 12) and not (asset = 'view' and n > 20) and not (asset = 'purchase' and n > 28) and not (asset = 'signup' and n > 9)"
    )
    sessions = days.select("session", hours(F.lit(21), "session").alias("close_at"))
    status = intervals.quote_status(sessions, secs, quoted, halts)
    return p, status, quoted.select("session", "asset", "close"), actions, legs, marks, sessions


@query(SECURITIES + """SELECT session, asset, ps AS period_start, CASE WHEN status NOT IN ('first_observation', 'quote_gap') THEN round(close / prior -
  1, 9) END AS price_return,
 CASE WHEN status IN ('ok', 'supplied_mark_valuation') THEN round((close + cash + extra) * ratio / prior - 1, 9) END AS
  total_return, status FROM l1
UNION ALL SELECT (SELECT session FROM s1 WHERE n = 22), 'view', session, NULL, round((0.5 + 0.5 * (SELECT close
  FROM n1 WHERE asset = 'error' AND n = 22)) / close - 1, 9), 'acquisition_consideration' FROM n1
  WHERE asset = 'view' AND n = 20
UNION ALL SELECT (SELECT max(session) + 10 FROM s1), 'purchase', session, NULL, NULL, 'consideration_after_coverage'
  FROM n1 WHERE asset = 'purchase' AND n = 28
UNION ALL SELECT (SELECT session FROM s1 WHERE n = 11), 'signup', session, NULL, NULL, 'unvalued_consideration'
  FROM n1 WHERE asset = 'signup' AND n = 9""")
def security_returns(spark, d):
    """Quoted and total returns across gaps, distributions and acquisitions: each of the eight statuses occurs."""
    p, status, quoted, actions, legs, marks, _ = _securities(spark, d)
    dividends = views.panel_dividends(p.drop("n"))
    return rounded(securities.security_returns(status, quoted, views.panel_splits(p.drop("n")), dividends, actions, legs, marks))


@query(SECURITIES + """SELECT asset, min(session) AS first_session, max(session) AS last_session, count(*) AS n_sessions, reason FROM (
 SELECT a.asset, s1.session, CASE a.asset WHEN 'click' THEN 'suspended' ELSE 'unquoted_after_last_session' END AS reason
  FROM s1 CROSS JOIN (VALUES ('click', 10, 12), ('view', 21, 23), ('purchase', 29, 999), ('signup', 10, 11)) a(asset, low, high)
  WHERE n BETWEEN low AND high) GROUP BY asset, reason""")
def quote_gaps(spark, d):
    return securities.quote_gaps(_securities(spark, d)[1])


@query(SECURITIES + """, k AS (SELECT * FROM (VALUES ('a1', 'error', 1, 6), ('a2', 'error', 6, 10), ('a3', 'error', 6, 12), ('b1', 'view', 10, 22),
  ('b2', 'purchase', 20, 999), ('b3', 'signup', 1, 11)) v(id, asset, known, due))
SELECT session, asset, string_agg(id, ',' ORDER BY id) AS announced_actions FROM s1 JOIN k ON n >= known AND n < due
  GROUP BY 1, 2""")
def announced_actions(spark, d):
    """Actions known by each close and not yet effective."""
    _, _, _, actions, _, _, sessions = _securities(spark, d)
    return securities.announced(sessions, actions)


def _pairs(spark, d):
    """Momentum signal of the brands (last month's return) and the return of the next month."""
    w = Window.partitionBy("asset").orderBy("session")
    r = rets.returns(views.brands_panel(spark, d))
    return r.select(
        F.col("session").alias("signal_date"), "asset", F.col("value").alias("signal"),
        F.lead("value").over(w).alias("forward_return"),
    ).where("signal is not null and forward_return is not null")


PAIRS = """, s4 AS (SELECT session, asset, close / lag(close) OVER (PARTITION BY asset ORDER BY session) - 1 AS r0, (close - lag(close)
  OVER (PARTITION BY asset ORDER BY session)) / lag(close) OVER (PARTITION BY asset ORDER BY session) AS signal
  FROM v4),
f4 AS (SELECT session AS signal_date, asset, signal, lead(signal) OVER (PARTITION BY asset ORDER BY session) AS forward_return
  FROM s4),
m4 AS (SELECT * FROM f4 WHERE signal IS NOT NULL AND forward_return IS NOT NULL),
k4 AS (SELECT *, rank() OVER (PARTITION BY signal_date ORDER BY signal) + (count(*) OVER (PARTITION BY signal_date, signal) - 1)
  / 2.0 AS x, rank() OVER (PARTITION BY signal_date ORDER BY forward_return) + (count(*) OVER (PARTITION BY signal_date,
  forward_return) - 1) / 2.0 AS y FROM m4),
i4 AS (SELECT signal_date, count(*) AS n_assets, CASE WHEN count(*) >= 2 THEN corr(x::DOUBLE, y::DOUBLE) END AS rank_ic
  FROM k4 GROUP BY signal_date),
q4 AS (SELECT signal_date, CAST(floor((row_number() OVER (PARTITION BY signal_date ORDER BY signal, asset) - 1) * 5 / count(*)
  OVER (PARTITION BY signal_date)) + 1 AS BIGINT) AS quantile, count(*) OVER (PARTITION BY signal_date) AS n, signal,
  forward_return FROM m4),
g4 AS (SELECT signal_date, quantile, count(*) AS n_assets, avg(signal) AS mean_signal, avg(forward_return) AS
  mean_forward_return FROM q4 WHERE n >= 5 GROUP BY 1, 2)
"""


@query(PAIRS + """SELECT signal_date, n_assets, round(rank_ic, 9) AS rank_ic, CASE WHEN n_assets < 2 THEN 'insufficient_assets' ELSE 'ok' END AS
  status FROM i4""")
def rank_ic(spark, d):
    return rounded(research.rank_ic(_pairs(spark, d)))


@query(PAIRS + """SELECT metric, round(value, 9) AS value, n_obs FROM (SELECT count(rank_ic) AS n_obs, avg(rank_ic) AS m, stddev_samp(rank_ic) AS
  s, avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE rank_ic IS NOT NULL) AS p
  FROM i4), LATERAL (VALUES ('mean_rank_ic', m), ('rank_ic_std', s), ('positive_rank_ic_share', p)) AS t(metric, value)""")
def rank_ic_summary(spark, d):
    return rounded(research.over_dates(research.rank_ic(_pairs(spark, d)), "rank_ic", "rank_ic"))


@query(PAIRS + """SELECT signal_date, quantile, n_assets, round(mean_signal, 9) AS mean_signal, round(mean_forward_return, 9) AS
  mean_forward_return FROM g4""")
def quantile_returns(spark, d):
    return rounded(research.quantiles(_pairs(spark, d), 5))


@query(PAIRS + """SELECT signal_date, round(max(mean_forward_return) FILTER (WHERE quantile = 5) - max(mean_forward_return) FILTER (WHERE quantile
  = 1), 9) AS high_minus_low FROM g4 GROUP BY signal_date""")
def quantile_spread(spark, d):
    return rounded(research.spreads(research.quantiles(_pairs(spark, d), 5), 5))


def _observations(spark, d):
    p = views.events_panel(spark, d).withColumn("close_at", hours(F.lit(21), "session"))
    return p.withColumn("available_at", hours(F.when(F.col("asset") == "click", 30).otherwise(20), "session"))


def _features(spark, d):
    return research.lagged_features(_observations(spark, d), ("close",), (0, 1, 2))


FEATURES = """, o AS (SELECT *, CAST(session AS TIMESTAMP) + INTERVAL 21 HOUR AS close_at, CAST(session AS TIMESTAMP) + CASE WHEN asset =
  'click' THEN INTERVAL 30 HOUR ELSE INTERVAL 20 HOUR END AS at0 FROM v1),
x AS (SELECT session, asset, close_at, close AS close__lag0, lag(close) OVER w AS close__lag1, lag(close, 2) OVER w AS
  close__lag2, at0, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY asset ORDER BY session)),
f AS (SELECT session, asset, close__lag0, close__lag1, close__lag2, CAST(greatest(0, 3 - n) AS BIGINT) AS n_missing, CASE WHEN n
  >= 3 THEN at0 END AS available_at,
 CASE WHEN n < 3 THEN 'warmup' WHEN at0 > close_at THEN 'unavailable' ELSE 'ready' END AS status FROM x)
"""


@query(FEATURES + """SELECT session, asset, round(close__lag0, 9) AS close__lag0, round(close__lag1, 9) AS close__lag1, round(close__lag2, 9) AS
  close__lag2, n_missing, CAST(available_at AS VARCHAR) AS available_at, status FROM f""")
def lagged_features(spark, d):
    return rounded(_features(spark, d)).withColumn("available_at", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss"))


def _split(spark, d):
    o = _observations(spark, d)
    w = Window.partitionBy("asset").orderBy("session")
    labels = o.select(
        "session", "asset", F.lead("session", 2).over(w).alias("label_end"),
        F.lead("available_at", 2).over(w).alias("available_at"),
        (F.lead("close", 2).over(w) / F.col("close") - 1).alias("target"),
    )
    s = o.select("session", "close_at").distinct()
    one = Window.partitionBy(F.lit(0))
    k = s.select("session", F.row_number().over(one.orderBy("session")).alias("k"), F.count("*").over(one).alias("n"))
    upto = lambda share: F.max(F.when(F.col("k") <= F.ceil(F.col("n") * share), F.col("session"))).cast("string")
    ends = k.agg(upto(0.5), upto(0.75), upto(1.0)).first()  # three dates: the split grows with the calendar
    return research.chronological_split(_features(spark, d), labels, s, *ends, gap=1)


SPLIT = FEATURES + """, s AS (SELECT session, row_number() OVER (ORDER BY session) AS k, CAST(ceil(count(*) OVER () * 0.5) AS BIGINT) AS e1,
  CAST(ceil(count(*) OVER () * 0.75) AS BIGINT) AS e2, count(*) OVER () AS e3 FROM (SELECT DISTINCT session
  FROM v1)),
l AS (SELECT session, asset, lead(session, 2) OVER w AS label_end, lead(at0, 2) OVER w AS label_at, lead(close, 2) OVER w /
  close - 1 AS target FROM o WINDOW w AS (PARTITION BY asset ORDER BY session)),
j AS (SELECT f.*, k, e1, e2, label_end, label_at, target, CASE WHEN k <= e1 THEN 'train' WHEN k <= e2 THEN 'validation' ELSE
  'test' END AS partition, CASE WHEN k <= e1 THEN e1 WHEN k <= e2 THEN e2 ELSE e3 END AS e FROM f
  JOIN s USING (session) JOIN l USING (session, asset)),
p AS (SELECT j.*, CASE WHEN status <> 'ready' THEN status WHEN j.k IN (j.e1 + 1, j.e2 + 1) THEN 'boundary_gap' WHEN label_end >
  s.session THEN 'label_horizon_crosses_boundary' WHEN label_at > CAST(s.session AS TIMESTAMP) + INTERVAL 21 HOUR THEN
  'label_unavailable_at_boundary' ELSE 'included' END AS reason FROM j JOIN s ON s.k = j.e)
"""


@query(SPLIT + "SELECT session, asset, partition, reason, round(target, 9) AS target FROM p")
def chronological_split(spark, d):
    return rounded(_split(spark, d).select("session", "asset", "partition", "reason", "target"))


@query(SPLIT + """, t AS (SELECT avg(close__lag1) AS m, stddev_samp(close__lag1) AS s FROM p WHERE partition = 'train' AND reason = 'included')
SELECT session, asset, partition, reason, round(CASE WHEN reason = 'included' THEN (close__lag1 - m) / s ELSE close__lag1 END,
  9) AS close__lag1 FROM p, t""")
def standardize(spark, d):
    return rounded(
        research.standardize(_split(spark, d), ("close__lag1",)).select("session", "asset", "partition", "reason", "close__lag1")
    )


@query(SPLIT + """, c AS (SELECT 'momentum' AS candidate, target, close__lag0 / close__lag1 - 1 AS prediction
  FROM p WHERE partition = 'validation' AND reason = 'included' UNION ALL
 SELECT 'reversal', target, close__lag1 / close__lag0 - 1 FROM p WHERE partition = 'validation' AND reason = 'included'
  UNION ALL SELECT 'zero', target, 0 FROM p WHERE partition = 'validation' AND reason = 'included'),
a AS (SELECT candidate, avg((prediction - target) * (prediction - target)) AS loss, count(*) AS n_obs FROM c GROUP BY candidate)
SELECT candidate, round(loss, 9) AS loss, n_obs, row_number() OVER (ORDER BY loss, candidate) = 1 AS selected FROM a""")
def candidate_losses(spark, d):
    v = _split(spark, d).where("partition = 'validation' and reason = 'included'")
    made = {
        "momentum": F.col("close__lag0") / F.col("close__lag1") - 1,
        "reversal": F.col("close__lag1") / F.col("close__lag0") - 1, "zero": F.lit(0.0),
    }
    p = v.select(
        "session", "asset",
        F.explode(F.array(*(F.struct(F.lit(k).alias("candidate"), x.alias("prediction")) for k, x in made.items()))).alias("c"),
    ).select("session", "asset", "c.*")
    return rounded(research.candidate_losses(p, v.select("session", "asset", "target")))


def _signals(spark, d):
    n = views.numbered(views.events_panel(spark, d)).where("n % 5 = 1")
    return n.select(
        F.col("session").alias("decision_session"), "asset",
        F.when(F.col("n") < 12, 0.2).when(F.col("asset") == "click", 0.4).otherwise(0.15).alias("weight"),
        F.lit(1.0).alias("gross_leverage"),
    )


@query(""", s AS (SELECT session, lead(session) OVER (ORDER BY session) AS nxt, row_number() OVER (ORDER BY session) AS k
  FROM (SELECT DISTINCT session FROM v1))
SELECT n1.session AS decision_session, nxt AS session, asset, CAST(CASE WHEN n < 12 THEN 0.2 WHEN asset = 'click' THEN 0.4 ELSE
  0.15 END AS DOUBLE) AS weight, 1.0::DOUBLE AS gross_leverage,
 CASE WHEN n IN (1, 16) THEN 'target' ELSE 'unchanged_target' END AS action FROM n1 JOIN s ON s.session = n1.session
  WHERE n % 5 = 1 AND nxt IS NOT NULL""")
def next_session_targets(spark, d):
    return research.signal_targets(_signals(spark, d), views.events_panel(spark, d).select("session").distinct(), "on_change")


LAST = """, l AS (SELECT max(session) AS decision FROM v1), t AS (SELECT DISTINCT session FROM r1, l WHERE session < decision
  ORDER BY session DESC LIMIT 20), u AS (SELECT r1.* FROM r1 JOIN t USING (session) WHERE r IS NOT NULL)\n"""
CAPPED = LAST + """, v AS (SELECT asset, stddev_samp(r) AS volatility, 1 / stddev_samp(r) AS inv FROM u GROUP BY asset),
k AS (SELECT *, row_number() OVER (ORDER BY inv DESC, asset) - 1 AS k, sum(inv) OVER (ORDER BY inv DESC, asset ROWS BETWEEN
  CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM v),
z AS (SELECT k AS k0, (1 - k * 0.25::DOUBLE) / rest AS level FROM k WHERE inv * ((1 - k * 0.25::DOUBLE) / rest) <= 0.25 + 1e-15
  ORDER BY k LIMIT 1),
w AS (SELECT asset, volatility, CASE WHEN k < k0 THEN 0.25::DOUBLE ELSE inv * level END AS weight FROM k, z)
"""


def _decision(spark, d) -> tuple[DataFrame, DataFrame, str]:
    p = views.events_panel(spark, d)
    return p, rets.returns(p).where(F.col("value").isNotNull()), str(p.agg(F.max("session")).first()[0])


@query(CAPPED + """SELECT asset, round(volatility * sqrt(252), 9) AS volatility, 20::BIGINT AS n_obs, round(inv / sum(inv) OVER (), 9) AS
  uncapped_weight, round(weight, 9) AS weight,
 abs(weight - 0.25) <= 1e-12 AS at_cap FROM w JOIN (SELECT asset, inv FROM v) USING (asset)""")
def inverse_vol_capped(spark, d):
    _, r, last = _decision(spark, d)
    return rounded(allocation.inverse_volatility_weights(r, last, 20, 0.25, PERIODS))


@query("SELECT DISTINCT asset, round(1.0::DOUBLE / (SELECT count(DISTINCT asset) FROM v4), 12) AS weight FROM v4")
def equal_weights(spark, d):
    return rounded(allocation.equal_weights(views.brands_panel(spark, d)), 12)


@query("""SELECT asset, CASE WHEN asset = 'click' THEN 'negative_weight' WHEN asset = 'view' THEN 'missing_weight' ELSE 'above_cap' END AS
  problem
FROM (SELECT DISTINCT asset FROM v1) WHERE asset IN ('click', 'view', (SELECT max(asset) FROM v1
  WHERE asset NOT IN ('click', 'view')))
UNION ALL SELECT NULL, 'sum_not_one'""")
def weight_problems(spark, d):
    """Every rule of a weight table with its offender."""
    a = views.events_panel(spark, d).select("asset").distinct()
    last = a.where("asset not in ('click', 'view')").agg(F.max("asset").alias("last"))
    w = a.join(F.broadcast(last)).select(
        "asset",
        F.when(F.col("asset") == "click", -0.1).when(F.col("asset") == "last", 0.0).when(F.col("asset") == F.col("last"), 0.9).when(F.col("asset") != "view", 0.05).alias("weight"),
    )
    return allocation.weight_problems(w, 0.5)


@query(LAST + """, c AS (SELECT x.asset AS a, covar_samp(x.r, y.r) AS c, y.asset AS b FROM u x JOIN u y USING (session)
  GROUP BY 1, 3), m AS (SELECT a AS asset, sum(c * 0.2::DOUBLE) * 0.2::DOUBLE AS share FROM c
  GROUP BY a)
SELECT asset, 0.2::DOUBLE AS weight, round(share / sqrt(sum(share) OVER ()) * sqrt(252), 9) AS volatility_contribution,
  round(share / sum(share) OVER (), 9) AS fraction FROM m""")
def risk_contributions(spark, d):
    p, r, last = _decision(spark, d)
    w = p.select("asset").distinct().withColumn("weight", F.lit(0.2))
    return rounded(allocation.risk_contributions(r, w, last, 20, PERIODS))


LIQUID = LAST + """, q AS (SELECT u.asset, stddev_samp(r) AS daily_volatility, avg(u.dollar_volume) AS dollar_adv, count(*) AS n_obs
  FROM u GROUP BY u.asset)\n"""


@query(LIQUID + "SELECT asset, round(daily_volatility, 9) AS daily_volatility, round(dollar_adv, 6) AS dollar_adv, n_obs FROM q")
def liquidity(spark, d):
    p, r, last = _decision(spark, d)
    out = allocation.liquidity(r, p, last, 20)
    return out.select(
        "asset", F.round("daily_volatility", 9).alias("daily_volatility"), F.round("dollar_adv", 6).alias("dollar_adv"),
        "n_obs",
    )


@query(LIQUID + """, o AS (SELECT asset, CAST(CASE WHEN asset = 'click' THEN -5000 ELSE 12000 END AS DOUBLE) AS n FROM q)
SELECT asset, n AS signed_notional, round(abs(n) * 0.0001, 9) AS commission, round(abs(n) * 0.0002, 9) AS half_spread,
  round(abs(n) * 0.5 * daily_volatility * sqrt(abs(n) / dollar_adv), 6) AS impact,
 round(abs(n) * 0.0001 + abs(n) * 0.0002 + abs(n) * 0.5 * daily_volatility * sqrt(abs(n) / dollar_adv), 6) AS total_cost
  FROM o JOIN q USING (asset)""")
def impact_costs(spark, d):
    p, r, last = _decision(spark, d)
    orders = p.select("asset").distinct().withColumn("signed_notional", F.when(F.col("asset") == "click", -5000.0).otherwise(12000.0))
    out = allocation.impact_costs(orders, allocation.liquidity(r, p, last, 20), 1.0, 2.0, 0.5)
    return out.select(
        "asset", "signed_notional", F.round("commission", 9).alias("commission"),
        F.round("half_spread", 9).alias("half_spread"), F.round("impact", 6).alias("impact"),
        F.round("total_cost", 6).alias("total_cost"),
    )


def _strategies(spark, d):
    r = rets.returns(views.events_panel(spark, d)).where(F.col("value").isNotNull())
    s = r.groupBy("session").agg(F.min_by("value", "asset").alias("a"), F.max_by("value", "asset").alias("b"), F.avg("value").alias("m"))
    return s


STRATEGIES = """, y AS (SELECT session, max(r) FILTER (WHERE asset = (SELECT min(asset) FROM v1)) AS a, max(r) FILTER (WHERE asset = (SELECT
  max(asset) FROM v1)) AS b, avg(r) AS m FROM r1 WHERE r IS NOT NULL GROUP BY session)\n"""


@query(STRATEGIES + """SELECT session, round(0.6 * a + 0.4 * b, 9) AS simple_return, round(product(1 + 0.6 * a + 0.4 * b) OVER (ORDER BY session), 9)
  AS wealth, round(100000 * product(1 + 0.6 * a + 0.4 * b) OVER (ORDER BY session), 5) AS equity
  FROM y""")
def strategy_combination(spark, d):
    s = _strategies(spark, d)
    long = s.select(
        "session",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("strategy"), F.col("a").alias("r")),
                F.struct(F.lit("b").alias("strategy"), F.col("b").alias("r")),
            )
        ).alias("x"),
    ).select("session", "x.*")
    out = allocation.combine(long, {"a": 0.6, "b": 0.4}, CAPITAL)
    return out.select(
        "session", F.round("simple_return", 9).alias("simple_return"), F.round("wealth", 9).alias("wealth"),
        F.round("equity", 5).alias("equity"),
    )


@query(STRATEGIES + """, s AS (SELECT avg(a - m) AS mx, avg(b - m) AS my, var_samp(a - m) AS vx, var_samp(b - m) AS vy, covar_samp(a - m, b - m) AS c
  FROM y),
k AS (SELECT s.*, t.candidate, t.weight AS w FROM s, LATERAL (VALUES ('lower', 0.0::DOUBLE), ('upper', 1.0::DOUBLE),
  ('stationary', greatest(0, least(1, (mx * vy - my * c) / (mx * vy - my * c + my * vx - mx * c)))), ('least_tracking_error',
  greatest(0, least(1, (vy - c) / (vx + vy - 2 * c))))) AS t(candidate, weight)),
i AS (SELECT candidate, w, (w * mx + (1 - w) * my) * sqrt(252) / sqrt(w * w * vx + (1 - w) * (1 - w) * vy + 2 * w * (1 - w) * c)
  AS ir FROM k)
SELECT candidate, round(w, 9) AS weight, round(ir, 9) AS information_ratio, row_number() OVER (ORDER BY ir DESC, w, candidate) =
  1 AS selected FROM i""")
def information_ratio_weights(spark, d):
    return rounded(allocation.information_ratio_weights(_strategies(spark, d), PERIODS))


def _rates(spark, d, unpublished: bool = False):
    s = views.events_panel(spark, d).select("session").distinct()
    return s.where(F.dayofmonth("session") % 3 == 0).select(
        F.col("session").alias("observation_date"), (F.dayofmonth("session") / 1000.0).alias("sofr"),
        hours(F.lit(37), "session").alias("available_at"),
    )


@query(""", q AS (SELECT DISTINCT session AS date FROM v1), a AS (SELECT date AS observation_date, day(date) / 1000.0::DOUBLE AS sofr,
  CAST(date AS TIMESTAMP) + INTERVAL 37 HOUR AS available_at FROM q WHERE day(date) % 3 = 0),
c AS (SELECT date, CAST(date AS TIMESTAMP) + INTERVAL 5 HOUR AS cutoff_at FROM q),
j AS (SELECT c.*, observation_date, sofr, CAST(date - observation_date AS BIGINT) AS age FROM c ASOF
  LEFT JOIN a ON c.cutoff_at >= a.available_at)
SELECT date, CAST(cutoff_at AS VARCHAR) AS cutoff_at, observation_date, age AS rate_age_days, CASE WHEN age <= 3 THEN
  round(sofr, 9) END AS sofr, CASE WHEN age <= 3 THEN round(sofr + 0.015, 9) END AS borrowing_rate,
 CASE WHEN sofr IS NULL THEN 'no_rate' WHEN age > 3 THEN 'stale' ELSE 'ok' END AS status FROM j""")
def asof_rate_plan(spark, d):
    days = views.events_panel(spark, d).select(F.col("session").alias("date")).distinct()
    out = intervals.rate_plan(days, _rates(spark, d), 150.0, 3, "-05:00")
    return rounded(out).withColumn("cutoff_at", F.date_format("cutoff_at", "yyyy-MM-dd HH:mm:ss"))


@query(""", z AS (SELECT DISTINCT period_start, session FROM r1 WHERE period_start IS NOT NULL), x AS (SELECT period_start, session,
  CAST(unnest(generate_series(period_start + 1, session, INTERVAL 1 DAY)) AS DATE) AS date FROM z)
SELECT period_start, session, count(*) AS n_days, round(exp(sum(ln(1 + (0.02 + day(date) / 10000.0::DOUBLE) / 365))) - 1, 12) AS
  simple_return FROM x GROUP BY 1, 2""")
def risk_free_intervals(spark, d):
    iv = rets.returns(views.events_panel(spark, d)).where(F.col("period_start").isNotNull()).select("period_start", "session").distinct()
    span = iv.agg(F.min("period_start").alias("a"), F.max("session").alias("b"))
    rates = span.select(F.explode(F.sequence("a", "b")).alias("date")).select(
        "date", (F.lit(0.02) + F.dayofmonth("date") / 10_000.0).alias("annual_rate"),
        hours(F.lit(-6), "date").alias("available_at"),
    )
    return rounded(rets.risk_free_returns(rates, iv), 12)


@query(""", w AS (SELECT DISTINCT asset, date_trunc('year', session)::DATE AS valid_from FROM v3), a AS (SELECT 'T-' || asset AS ticker,
  asset || '/' || CAST(year(valid_from) AS VARCHAR) AS asset, valid_from, (valid_from + INTERVAL 10 MONTH)::DATE AS valid_to
  FROM w),
o AS (SELECT row_number() OVER () AS k, 'T-' || asset AS ticker, session AS date FROM v3 CROSS JOIN (SELECT unnest([1, 2])))
SELECT o.ticker, o.date, CASE WHEN count(DISTINCT a.asset) = 1 THEN min(a.asset) END AS asset, count(DISTINCT a.asset) AS
  n_matches FROM o LEFT JOIN a ON o.ticker = a.ticker AND o.date BETWEEN a.valid_from AND a.valid_to
  GROUP BY o.k, o.ticker, o.date""")
def alias_interval_join(spark, d):
    p = views.orders_panel(spark, d)
    w = p.select("asset", F.to_date(F.date_trunc("year", "session")).alias("valid_from")).distinct()
    aliases = w.select(
        F.concat(F.lit("T-"), "asset").alias("ticker"),
        F.concat("asset", F.lit("/"), F.year("valid_from").cast("string")).alias("asset"), "valid_from",
        F.add_months("valid_from", 10).alias("valid_to"),
    )
    observed = p.select(F.concat(F.lit("T-"), "asset").alias("ticker"), F.col("session").alias("date"))
    return intervals.resolve_aliases(observed.unionByName(observed), aliases)  # each row is observed twice and stays two rows


@query(""", c AS (SELECT s.session, a.asset, k, last FROM (SELECT session, row_number() OVER (ORDER BY session) AS k, count(*) OVER () AS
  last FROM (SELECT DISTINCT session FROM v3)) s CROSS JOIN (SELECT DISTINCT asset FROM v3) a),
t AS (SELECT c.session, c.asset, CASE WHEN c.asset LIKE '1%' AND k > last - 3 THEN 'terminated' WHEN c.asset LIKE '2%' AND k < 4
  THEN 'not_listed' WHEN c.asset LIKE '3%' AND k > last - 2 THEN 'unquoted_after_last_session' WHEN c.asset LIKE '5%' AND k
  BETWEEN 10 AND 14 THEN 'suspended' WHEN v3.close IS NULL THEN 'missing' ELSE 'quoted' END AS status
  FROM c LEFT JOIN v3 ON c.session = v3.session AND c.asset = v3.asset)
SELECT session, asset, status, status = 'quoted' AS tradable FROM t""")
def quote_status(spark, d):
    p = views.orders_panel(spark, d)
    days = p.select("session").distinct()
    days = days.select(
        "session", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session")).alias("k"),
        F.count("*").over(Window.partitionBy(F.lit(0))).alias("last"),
    )
    day = lambda k: F.max(F.when(F.col("k") == k, F.col("session")))
    marks = days.agg(
        day(1).alias("d1"), day(4).alias("d4"), day(10).alias("d10"), day(14).alias("d14"),
        day(F.col("last") - 2).alias("late"),
    )
    securities = p.select("asset").distinct().join(F.broadcast(marks))  # one row of dates
    like = lambda pattern, c: F.when(F.col("asset").like(pattern), F.col(c))
    halts = securities.where("asset like '5%'").select("asset", F.col("d10").alias("first_session"), F.col("d14").alias("last_session"))
    securities = securities.select(
        "asset", F.coalesce(like("2%", "d4"), "d1").alias("first_session"), like("3%", "late").alias("last_session"),
        like("1%", "late").alias("terminated_date"),
    )
    return intervals.quote_status(p.select("session").distinct(), securities, p, halts)


@query(""", g AS (SELECT session, asset, lag(session) OVER (PARTITION BY asset ORDER BY session) AS p
  FROM v3) SELECT asset, session, p AS period_start, (p IS NULL OR p = (session - INTERVAL 1 MONTH)::DATE) AS contiguous
  FROM g""")
def interval_contiguity(spark, d):
    w = Window.partitionBy("asset").orderBy("session")
    p = views.orders_panel(spark, d).select("asset", "session", F.lag("session").over(w).alias("p"))
    p = p.withColumn("period_start", F.when(F.col("p").isNotNull(), F.add_months("session", -1)))  # months are due one after another
    return intervals.contiguity(p, ("asset",)).select("asset", "session", F.col("p").alias("period_start"), "contiguous")


HOLD = """, h AS (SELECT session, sum(q * close) AS market_value, sum(CASE WHEN n > 1 AND n % 7 = 0 THEN 0.75 * q ELSE 0 END) AS income
  FROM (SELECT n1.*, 0.2::DOUBLE * (100000 / (1 + 0.001::DOUBLE)) / first_value(close) OVER (PARTITION BY asset
  ORDER BY session) AS q FROM n1) GROUP BY session),
j AS (SELECT session, market_value, sum(income) OVER (ORDER BY session) AS cash, market_value + sum(income) OVER (ORDER BY
  session) AS equity FROM h)
"""


@query(HOLD + """SELECT session, round(equity, 5) AS equity, round(cash, 5) AS cash, round(market_value, 5) AS market_value, round(equity -
  coalesce(lag(equity) OVER (ORDER BY session), 100000), 5) AS pnl FROM j""")
def buy_and_hold_unlevered(spark, d):
    p = views.events_panel(spark, d)
    w = p.select("asset").distinct().withColumn("weight", F.lit(0.2))
    return rounded(
        ledger.buy_and_hold_unlevered(
            p.select("session", "asset", "close"), w, CAPITAL, ledger.TradeCosts(commission_bps=10), views.panel_dividends(p),
        ),
        5,
    )


def _targets(spark, d, when: str, runs: list[tuple[str, float]], short: bool = False):
    n = views.numbered(views.events_panel(spark, d)).where(when)
    r = spark.createDataFrame(runs, "run_id string, gross_leverage double")
    weight = F.when(F.col("asset") == "click", -0.2).otherwise(0.3) if short else F.lit(0.2)
    return n.join(F.broadcast(r)).select("run_id", "session", "asset", weight.cast("double").alias("weight"), "gross_leverage")


@query(""", b AS (SELECT session, n, sum(close * 0.2::DOUBLE / c0) AS growth FROM (SELECT *, first_value(close) OVER (PARTITION BY asset
  ORDER BY session) AS c0 FROM n1) GROUP BY 1, 2),
l AS (SELECT unnest([1.0::DOUBLE, 1.5, 2.0]) AS lev), e AS (SELECT lev, 100000.0::DOUBLE / (1 + 0.001::DOUBLE * lev) AS x
  FROM l),
g AS (SELECT lev, n, session, x * lev * growth AS market_value, CASE WHEN lev > 1 THEN (x * lev - x) * pow(1 + 0.05::DOUBLE /
  365, (session - (SELECT min(session) FROM v1))) ELSE 0 END AS debt FROM e, b)
SELECT 'L' || CAST(lev AS VARCHAR) AS run_id, session, round(market_value, 4) AS market_value, round(debt, 4) AS debt,
  round(market_value - debt, 4) AS equity FROM g""")
def buy_and_hold_financed(spark, d):
    p = views.events_panel(spark, d).select("session", "asset", "close")
    runs = _targets(spark, d, "n = 1", [("L1.0", 1.0), ("L1.5", 1.5), ("L2.0", 2.0)])
    out = ledger.run_books(
        ledger.growth_index(p), runs, CAPITAL, ledger.Financing(borrowing_rate=0.05), ledger.TradeCosts(commission_bps=10), hold=True,
    )
    return out.select("run_id", "session", *(F.round(c, 4).alias(c) for c in ("market_value", "debt", "equity")))


#: Books in SQL: every possible piece of each basket's equation is tried, and the one that solves it is taken.
BOOKS = """, i1 AS (SELECT n, session, asset, product(1 + coalesce(t, 0)) OVER (PARTITION BY asset ORDER BY session) AS idx
  FROM (SELECT n, session, asset,
  ((close + CASE WHEN n % 7 = 0 THEN 0.75 ELSE 0 END) * CASE WHEN n % 11 = 0 THEN 2.0::DOUBLE ELSE 1 END) / lag(close) OVER
  (PARTITION BY asset ORDER BY session) - 1 AS t FROM n1)),
u1 AS (SELECT * FROM (VALUES {runs}) AS r(run_id, lev, short)),
w1 AS (SELECT run_id, lev, i1.*, lev * CASE WHEN short AND asset = 'click' THEN -0.2::DOUBLE WHEN short THEN 0.3 ELSE 0.2 END AS
  p FROM i1 CROSS JOIN u1),
k1 AS (SELECT *, CASE WHEN n > 1 THEN ((n - 2) // {every}) * {every} + 1 END AS sn FROM w1),
h1 AS (SELECT k.run_id, k.lev, k.n, k.sn, k.session, s.session AS start, k.asset, k.p, k.p * k.idx / s.idx AS u
  FROM k1 k JOIN w1 s ON s.run_id = k.run_id AND s.asset = k.asset AND s.n = k.sn),
x1 AS (SELECT run_id, n, sn, session, sum(u) AS market, sum(abs(u)) AS gross, sum(p) AS net, sum(abs(p)) AS gp,
  (1 - sum(p)) * pow(1 + CASE WHEN sum(p) > 1 + 1e-12 THEN 0.05::DOUBLE ELSE 0.01 END / 365, max(session - start)) AS rest
  FROM h1 GROUP BY 1, 2, 3, 4),
c1 AS (SELECT a.run_id, a.n, x1.market + x1.rest AS worth, (max(x1.market + x1.rest) + {rate} * sum(CASE WHEN b.u / b.p <= a.at
  THEN 1 ELSE -1 END * abs(b.p) * (b.u / b.p))) / (1 + {rate} * sum(CASE WHEN b.u / b.p <= a.at THEN 1 ELSE -1 END * abs(b.p)))
  AS ratio, a.at
  FROM (SELECT run_id, n, u / p AS at FROM h1 WHERE n % {every} = 1 UNION ALL SELECT DISTINCT run_id, n, -1e9
  FROM h1 WHERE n % {every} = 1) a JOIN h1 b USING (run_id, n) JOIN x1 USING (run_id, n) GROUP BY a.run_id, a.n, a.at,
  x1.market, x1.rest),
r2 AS (SELECT run_id, n, arg_min(ratio, gap) AS ratio, arg_min(worth, gap) AS worth FROM (SELECT c.run_id AS run_id, c.n AS n,
  c.ratio, c.worth, c.at, abs(c.ratio + {rate} * sum(abs(h.p * c.ratio - h.u)) - c.worth) AS gap
  FROM c1 c JOIN h1 h USING (run_id, n) GROUP BY c.run_id, c.n, c.ratio, c.worth, c.at) c1 GROUP BY 1, 2),
s2 AS (SELECT run_id, n, ratio, 1.0::DOUBLE AS worth FROM (SELECT run_id, 1 AS n, 1 / (1 + {rate} * sum(abs(p))) AS ratio
  FROM w1 WHERE n = 1 GROUP BY 1) UNION ALL SELECT run_id, n, ratio, worth FROM r2),
z2 AS (SELECT *, 100000 * product(ratio) OVER (PARTITION BY run_id ORDER BY n) AS scale FROM s2),
y2 AS (SELECT w.run_id, w.n, w.session, z.scale AS equity, z.scale * w.net AS market_value, z.scale * w.gp AS gross, z.scale *
  (1 - w.net) AS rest, z.scale / z.ratio * (z.worth - z.ratio) AS trade_cost
  FROM (SELECT run_id, n, session, sum(p) AS net, sum(abs(p)) AS gp FROM w1 WHERE n % {every} = 1
  GROUP BY 1, 2, 3) w JOIN z2 z USING (run_id, n)
  UNION ALL SELECT x.run_id, x.n, x.session, z.scale * (x.market + x.rest), z.scale * x.market, z.scale * x.gross, z.scale *
  x.rest, 0 FROM x1 x JOIN z2 z ON z.run_id = x.run_id AND z.n = x.sn WHERE x.n % {every} <> 1),
q2 AS (SELECT *, coalesce(max(CASE WHEN equity <= 0 OR equity < {keep} * gross THEN 1 ELSE 0 END) OVER (PARTITION BY run_id
  ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM y2)
"""


@query(BOOKS.format(runs="('L1.0', 1.0::DOUBLE, false), ('L1.5', 1.5, false), ('L2.0', 2.0, false)", every=5, rate="0.001::DOUBLE", keep="0.49") + """
SELECT run_id, session, round(equity, 4) AS equity, round(market_value, 4) AS market_value, round(greatest(rest, 0), 4) AS cash,
  round(greatest(-rest, 0), 4) AS debt, round(trade_cost, 4) AS trade_cost FROM q2 WHERE done = 0""")
def scheduled_rebalance(spark, d):
    """Rebalanced each fifth session at three leverages, with splits, reinvested dividends, interest and a margin stop."""
    p = views.events_panel(spark, d)
    runs = _targets(spark, d, "n % 5 = 1", [("L1.0", 1.0), ("L1.5", 1.5), ("L2.0", 2.0)])
    growth = ledger.growth_index(p.select("session", "asset", "close"), views.panel_splits(p), views.panel_dividends(p))
    out = ledger.run_books(growth, runs, CAPITAL, ledger.Financing(0.01, 0.05, maintenance_equity_ratio=0.49), ledger.TradeCosts(5, 2, 3))
    return out.select("run_id", "session", *(F.round(c, 4).alias(c) for c in ("equity", "market_value", "cash", "debt", "trade_cost")))


@query(BOOKS.format(runs="('short', 1.0::DOUBLE, true)", every=4, rate="0.0005::DOUBLE", keep="0") + """, o2 AS (SELECT *, lag(equity) OVER (ORDER BY n) AS e0 FROM q2)
SELECT run_id, session, round(equity - coalesce(e0, 100000) + trade_cost, 4) AS earned, round(trade_cost, 4) AS trade_cost,
  0.0::DOUBLE AS equity_gap, 0.0::DOUBLE AS balance_gap FROM o2""")
def long_short_audit(spark, d):
    """A long/short book by component: what it earned before costs, its costs, and that both explain its equity."""
    p = views.events_panel(spark, d)
    growth = ledger.growth_index(p.select("session", "asset", "close"), views.panel_splits(p), views.panel_dividends(p))
    book = ledger.run_books(
        growth, _targets(spark, d, "n % 4 = 1", [("short", 1.0)], short=True), CAPITAL, ledger.Financing(0.01, 0.05),
        ledger.TradeCosts(5),
    )
    earned = F.coalesce("market_pnl", F.lit(0.0)) + F.coalesce("financing_pnl", F.lit(0.0))
    parts = book.select("run_id", "session", F.round(earned, 4).alias("earned"), F.round("trade_cost", 4).alias("trade_cost"))
    gaps = ledger.audit(book, CAPITAL)
    return parts.join(
        gaps.select("run_id", "session", *(F.round(F.abs(c), 4).alias(c) for c in ("equity_gap", "balance_gap"))),
        ["run_id", "session"],
    )


THREE = BOOKS.format(runs="('L1.0', 1.0::DOUBLE, false), ('L1.5', 1.5, false), ('L2.0', 2.0, false)", every=5, rate="0.001::DOUBLE", keep="0") + """, o2 AS (SELECT *, lag(equity) OVER (PARTITION BY run_id ORDER BY n) AS e0, lag(market_value) OVER (PARTITION BY run_id
  ORDER BY n) AS m0, lag(rest) OVER (PARTITION BY run_id ORDER BY n) AS r0 FROM q2),
f2 AS (SELECT o2.*, CASE WHEN n % 5 = 1 AND n > 1 THEN (SELECT x.rest * z.scale FROM x1 x JOIN z2 z ON z.run_id = x.run_id AND
  z.n = x.sn WHERE x.run_id = o2.run_id AND x.n = o2.n) - r0 ELSE rest - r0 END AS fin FROM o2)
"""


def _three_books(spark, d) -> DataFrame:
    p = views.events_panel(spark, d)
    runs = _targets(spark, d, "n % 5 = 1", [("L1.0", 1.0), ("L1.5", 1.5), ("L2.0", 2.0)])
    growth = ledger.growth_index(p.select("session", "asset", "close"), views.panel_splits(p), views.panel_dividends(p))
    return ledger.run_books(growth, runs, CAPITAL, ledger.Financing(0.01, 0.05), ledger.TradeCosts(5, 2, 3))


@query(THREE + """, t2 AS (SELECT run_id, sum(coalesce(fin, 0)) AS f, sum(trade_cost) AS c, arg_max(equity, n) AS e FROM f2 GROUP BY run_id)
SELECT run_id, component, round(pnl, 4) AS pnl FROM t2, LATERAL (VALUES ('market', e - 100000 - f + c), ('financing', f),
  ('trade_cost', -c)) AS v(component, pnl)""")
def run_attribution(spark, d):
    return rounded(ledger.attribution(_three_books(spark, d)), 4)


@query(THREE + """SELECT run_id, session, round(gross / equity, 8) AS gross, round(market_value / equity, 8) AS net, round(greatest(rest, 0) /
  equity, 8) AS cash, round(least(rest, 0) / equity, 8) AS debt FROM q2""")
def exposures(spark, d):
    return rounded(ledger.exposures(_three_books(spark, d)), 8)


@query(THREE + """SELECT run_id, session, component, round(weight, 8) AS weight FROM q2, LATERAL (VALUES ('holdings', market_value / equity),
  ('account:cash', greatest(rest, 0) / equity), ('account:debt', least(rest, 0) / equity)) AS v(component, weight)""")
def balance_sheet(spark, d):
    return rounded(ledger.balance_sheet(_three_books(spark, d)), 8)


@query(THREE + """, t2 AS (SELECT run_id, count(*) AS n, sum(greatest(-coalesce(fin, 0), 0)) AS f, sum(trade_cost) AS c, arg_min(trade_cost, n) AS
  c0, arg_max(gross / equity, n) AS l FROM f2 GROUP BY run_id)
SELECT run_id, metric, round(value, 4) AS value, unit, n AS n_obs, 'ok' AS status FROM t2, LATERAL (VALUES ('entry_cost', c0,
  'money'), ('trade_cost', c, 'money'), ('financing_cost', f, 'money'), ('ending_leverage', l, 'ratio')) AS v(metric, value,
  unit)""")
def run_costs(spark, d):
    return rounded(ledger.cost_rows(_three_books(spark, d)), 4)


@query(LIQUID + """, g2 AS (SELECT sum(0.2::DOUBLE * 0.0003) AS a, sum(0.5 * daily_volatility / sqrt(dollar_adv) * pow(0.2::DOUBLE, 1.5)) AS b
  FROM q),
n2 AS (SELECT 0 AS k, sqrt(150000.0::DOUBLE) AS s, 1.5 * a + 1 AS a, 1.5 * b AS b FROM g2 UNION ALL SELECT k + 1, s - (b * s * s
  * s + a * s * s - 150000) / (3 * b * s * s + 2 * a * s), a, b FROM n2 WHERE k < 60),
h2 AS (SELECT s * s AS g FROM n2 WHERE k = 60), o2 AS (SELECT asset, 0.2 * g AS q, g, 0.2 * g * 0.0003 + 0.5 * daily_volatility
  * 0.2 * g * sqrt(0.2 * g / dollar_adv) AS c FROM q, h2)
SELECT asset, round(q, 4) AS signed_notional, round(c, 4) AS total_cost, round(g, 4) AS gross_notional, round(g / 1.5, 4) AS
  post_cost_equity FROM o2""")
def entry_orders(spark, d):
    """Orders at leverage 1.5 after square-root costs: gross is leverage times what is left, which the SQL states and the operator sums."""
    p, r, last = _decision(spark, d)
    w = p.select("asset").distinct().withColumn("weight", F.lit(0.2))
    return rounded(allocation.size_entry(w, allocation.liquidity(r, p, last, 20), CAPITAL, 1.5, 1.0, 2.0, 0.5), 4)


@query(""", s AS (SELECT session, row_number() OVER (ORDER BY session) AS k FROM (SELECT DISTINCT session
  FROM v3)), g AS (SELECT session, asset, lag(session) OVER (PARTITION BY asset ORDER BY session) AS period_start
  FROM v3 WHERE NOT (asset LIKE '2%' AND month(session) % 4 = 0)) SELECT g.session, asset, period_start, CAST(s.k - t.k - 1 AS
  BIGINT) AS n_skipped FROM g JOIN s ON s.session = g.session LEFT JOIN s t ON t.session = period_start""")
def skipped_sessions(spark, d):
    """Months that an interval of a priority jumps over."""
    p = views.orders_panel(spark, d)
    some = p.where("not (asset like '2%' and month(session) % 4 = 0)")
    iv = some.select("session", "asset", F.lag("session").over(Window.partitionBy("asset").orderBy("session")).alias("period_start"))
    return intervals.skipped_sessions(iv, p.select("session").distinct())


@query(""", o AS (SELECT session AS signal_date, asset, CASE WHEN n = 3 THEN session ELSE session + 1 END AS ps, CASE WHEN n = 5 THEN
  session - 1 WHEN n = 7 AND asset = 'click' THEN session + 3 ELSE session + 2 END AS pe FROM n1),
p AS (SELECT *, CASE WHEN n = 9 THEN signal_date - 2 ELSE ps END AS s FROM o JOIN (SELECT session AS d, asset AS a, n
  FROM n1) ON d = signal_date AND a = asset), c AS (SELECT signal_date, count(DISTINCT (s, pe)) AS k
  FROM p GROUP BY 1)
SELECT signal_date, asset, CASE WHEN pe <= s THEN 'reversed_interval' WHEN s < signal_date THEN 'backward_looking' WHEN s =
  signal_date THEN 'starts_at_signal' ELSE 'mixed_intervals' END AS problem FROM p JOIN c USING (signal_date)
  WHERE pe <= s OR s <= signal_date OR k > 1""")
def outcome_problems(spark, d):
    """Every rule of an outcome's interval with its offenders."""
    n = F.col("n")
    o = views.numbered(views.events_panel(spark, d))
    start = F.when(n == 9, F.date_sub("session", 2)).when(n == 3, F.col("session")).otherwise(F.date_add("session", 1))
    end = F.when(n == 5, F.date_sub("session", 1)).when(
        (n == 7) & (F.col("asset") == "click"), F.date_add("session", 3),
    ).otherwise(F.date_add("session", 2))
    return signals.outcome_problems(
        o.select(F.col("session").alias("signal_date"), "asset", start.alias("period_start"), end.alias("period_end"))
    )


@query(SECURITIES + """, k AS (SELECT * FROM (VALUES ('a1', 'error', 1, 6), ('a2', 'error', 6, 10), ('a3', 'error', 6, 12), ('b1', 'view', 10, 22),
  ('b2', 'purchase', 20, 999), ('b3', 'signup', 1, 11)) v(id, asset, known, due)),
g AS (SELECT s1.session, s1.n, a.asset FROM s1 CROSS JOIN (SELECT DISTINCT asset FROM v1) a), h AS (SELECT session, asset,
  string_agg(id, ',' ORDER BY id) AS announced_actions FROM s1 JOIN k ON n >= known AND n < due
  GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN (asset = 'view' AND n >= 24) OR (asset = 'signup' AND n >= 12) THEN 'terminated' WHEN (asset = 'view'
  AND n > 20) OR (asset = 'purchase' AND n > 28) OR (asset = 'signup' AND n > 9) THEN 'unquoted_after_last_session' WHEN asset =
  'click' AND n BETWEEN 10 AND 12 THEN 'suspended' ELSE 'quoted' END AS status FROM g)
SELECT t.session, t.asset, status, status = 'quoted' AS tradable, CASE WHEN t.asset = 'click' AND n > 15 THEN NULL ELSE 'T-' ||
  t.asset END AS ticker, CASE WHEN t.asset = 'click' AND n > 15 THEN NULL ELSE 'X' END AS exchange, announced_actions
  FROM t LEFT JOIN h USING (session, asset)""")
def security_status(spark, d):
    """Status of every session and security, the alias valid on it, and the actions known by its close."""
    p, status, _, actions, _, _, sessions = _securities(spark, d)
    first = p.groupBy("asset").agg(
        F.min("session").alias("valid_from"),
        F.max(F.when((F.col("asset") == "click") & (F.col("n") == 15), F.col("session"))).alias("valid_to"),
    )
    aliases = first.select("asset", F.concat(F.lit("T-"), "asset").alias("ticker"), F.lit("X").alias("exchange"), "valid_from", "valid_to")
    return intervals.security_status(status, aliases, securities.announced(sessions, actions))


@query("""SELECT asset, round(corr(lp, lv), 9) AS correlation, count(*) AS n_obs FROM (SELECT asset, ln(close) AS lp, ln(dollar_volume) AS
  lv FROM v1) GROUP BY asset""")
def price_volume_correlation(spark, d):
    return rounded(
        views.events_panel(spark, d).groupBy("asset").agg(
            correlation(F.ln("close"), F.ln("dollar_volume")).alias("correlation"), F.count("*").alias("n_obs"),
        )
    )


@query(""", c AS (SELECT session, count(*) AS n, max(asset) AS latest FROM v3 GROUP BY session) SELECT session, CAST(session AS VARCHAR)
  || ' ' || CAST(15 + CAST(substr(latest, 1, 1) AS INTEGER) AS VARCHAR) || ':00:00' AS close_at
  FROM c WHERE n = (SELECT count(DISTINCT asset) FROM v3)""")
def calendar_intersection(spark, d):
    """Months quoted for every priority, with the latest of their closes (later for a higher priority number)."""
    p = views.orders_panel(spark, d).withColumn("close_at", hours(F.substring("asset", 1, 1).cast("int") + 15, "session"))
    out = intervals.shared_calendar(p.select("asset", "session", "close_at"), "asset")
    return out.withColumn("close_at", F.date_format("close_at", "yyyy-MM-dd HH:mm:ss"))


@query(""", c AS (SELECT s.session, a.asset FROM (SELECT DISTINCT session FROM v3) s CROSS JOIN (SELECT DISTINCT asset FROM v3) a)
SELECT c.asset, c.session, CASE WHEN NOT c.session BETWEEN DATE '1995-03-01' AND DATE '2001-03-01' THEN 'outside_coverage' WHEN
  month(c.session) = 7 AND c.asset LIKE '5%' THEN 'excluded' WHEN v3.asset IS NULL THEN 'missing' WHEN month(c.session) = 12 AND
  c.asset LIKE '4%' THEN 'unexpected' ELSE 'ok' END AS status
FROM c LEFT JOIN v3 ON c.session = v3.session AND c.asset = v3.asset WHERE v3.asset IS NOT NULL OR NOT (month(c.session) = 12
  AND c.asset LIKE '4%') OR (month(c.session) = 7 AND c.asset LIKE '5%')""")
def provider_coverage(spark, d):
    from tallyspark.sources import provider

    p = views.orders_panel(spark, d)
    grid = p.select("session").distinct().join(F.broadcast(p.select("asset").distinct()))
    expected = grid.where("not (month(session) = 12 and asset like '4%')")
    return provider.coverage(p, expected, "1995-03-01", "2001-03-01", grid.where("month(session) = 7 and asset like '5%'"))


@query(HOLD + """SELECT session, asset, round(q * (close - p), 6) AS price_pnl FROM (SELECT session, asset, close, lag(close) OVER (PARTITION BY
  asset ORDER BY session) AS p, 0.2::DOUBLE * (100000 / (1 + 0.001::DOUBLE)) / first_value(close) OVER (PARTITION BY asset
  ORDER BY session) AS q FROM n1) WHERE p IS NOT NULL""")
def position_attribution(spark, d):
    """Price P&L of each holding of an equal-weight basket bought at the first close."""
    p = views.events_panel(spark, d).select("session", "asset", "close")
    q = p.groupBy("asset").agg((F.lit(0.2) * (CAPITAL / 1.001) / F.min_by("close", "session")).alias("quantity"))
    return rounded(ledger.position_pnl(p, q), 6)


COARSE = PAIRS + """, c5 AS (SELECT signal_date, asset, floor(signal * 40) / 40 AS signal, forward_return FROM f4
  WHERE signal IS NOT NULL OR forward_return IS NOT NULL),
m5 AS (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY signal, asset) - 1 AS i, count(*) OVER (PARTITION BY
  signal_date) AS n FROM c5 WHERE signal IS NOT NULL AND forward_return IS NOT NULL),
l5 AS (SELECT *, CASE WHEN i < n // 5 THEN 1 WHEN i >= n - n // 5 THEN 5 ELSE 2 + (i - n // 5) * 3 // (n - 2 * (n // 5)) END AS
  label FROM m5),
t5 AS (SELECT signal_date, signal, min(label) < max(label) AS torn FROM l5 GROUP BY 1, 2),
s5 AS (SELECT l5.signal_date, CASE WHEN max(n) < 5 THEN 'insufficient_assets_for_quantiles' WHEN min(l5.signal) = max(l5.signal)
  THEN 'constant_signal' WHEN bool_or(torn) THEN 'tie_at_group_boundary' ELSE 'ok' END AS status
  FROM l5 JOIN t5 ON t5.signal_date = l5.signal_date AND t5.signal = l5.signal GROUP BY 1),
d5 AS (SELECT DISTINCT c5.signal_date, coalesce(status, 'insufficient_assets_for_quantiles') AS status
  FROM c5 LEFT JOIN s5 USING (signal_date)),
g5 AS (SELECT d5.signal_date, CAST(q.q AS BIGINT) AS quantile, count(l5.asset) AS n_assets, avg(l5.signal) AS mean_signal,
  avg(forward_return) AS mean_forward_return, status
  FROM d5 CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS q) q LEFT JOIN l5 ON l5.signal_date = d5.signal_date AND l5.label = q.q
  AND status = 'ok' GROUP BY 1, 2, status),
h5 AS (SELECT signal_date, max(n_assets) FILTER (WHERE quantile = 1) AS n_low, max(n_assets) FILTER (WHERE quantile = 5) AS
  n_high,
  max(mean_forward_return) FILTER (WHERE quantile = 5) - max(mean_forward_return) FILTER (WHERE quantile = 1) AS high_minus_low,
  max(status) AS status FROM g5 GROUP BY 1)
"""


def _diagnosed(spark, d):
    """Signals in steps of 1/40, which tie, outcomes, the matched rows in groups, and unmatched keys with their reasons."""
    w = Window.partitionBy("asset").orderBy("session")
    r = rets.returns(views.brands_panel(spark, d))
    r = r.select(
        F.col("session").alias("signal_date"), "asset", (F.floor(F.col("value") * 40) / 40).alias("signal"),
        F.lead("value").over(w).alias("forward_return"),
    )
    s, o = r.where("signal is not null").drop("forward_return"), r.where("forward_return is not null").drop("signal")
    ends = signals.unmatched(s, o).withColumn("reason", F.concat(F.lit("first or last month: "), "side"))
    pairs, excluded = signals.reconciled(s, o, ends)
    return s, o, signals.grouped(pairs, 5, "extremes", "reject_boundary_ties"), excluded


@query(COARSE + """SELECT signal_date, quantile, n_assets, round(mean_signal, 9) AS mean_signal, round(mean_forward_return, 9) AS
  mean_forward_return, status FROM g5""")
def signal_groups(spark, d):
    """Extreme groups of every date, with the reason where a date is not grouped."""
    s, o, labelled, _ = _diagnosed(spark, d)
    dates = s.select("signal_date").unionByName(o.select("signal_date")).distinct()
    return rounded(signals.group_table(labelled, dates, 5))


@query(COARSE + "SELECT signal_date, n_low, n_high, round(high_minus_low, 9) AS high_minus_low, status FROM h5")
def signal_spreads(spark, d):
    s, o, labelled, _ = _diagnosed(spark, d)
    dates = s.select("signal_date").unionByName(o.select("signal_date")).distinct()
    return rounded(signals.spread_table(signals.group_table(labelled, dates, 5), 5))


@query(COARSE + """SELECT c5.signal_date, count(signal) AS n_signals, count(forward_return) AS n_outcomes, count(*) FILTER (WHERE signal IS NOT
  NULL AND forward_return IS NOT NULL) AS n_matched,
 count(*) FILTER (WHERE signal IS NULL OR forward_return IS NULL) AS n_excluded, count(*) FILTER (WHERE signal IS NOT NULL AND
  forward_return IS NOT NULL AND status <> 'ok') AS n_unassigned
FROM c5 JOIN d5 USING (signal_date) GROUP BY 1""")
def signal_coverage(spark, d):
    """Signals, outcomes, matched, excluded and unassigned rows of every date that has either side."""
    s, o, labelled, excluded = _diagnosed(spark, d)
    return signals.coverage(s, o, labelled, excluded)


@query(COARSE + """, a AS (SELECT count(high_minus_low) AS n, count(*) AS t, avg(high_minus_low) AS m, stddev_samp(high_minus_low) AS sd, avg(CASE
  WHEN high_minus_low > 0 THEN 1.0::DOUBLE WHEN high_minus_low IS NOT NULL THEN 0 END) AS p
  FROM h5)
SELECT metric, round(value, 9) AS value, unit, n AS n_obs, status FROM a, LATERAL (VALUES ('mean_high_minus_low', m,
  'fraction/holding_period', CASE WHEN n = 0 THEN 'no_evaluated_dates' ELSE 'ok' END),
 ('high_minus_low_std', CASE WHEN n > 1 THEN sd END, 'fraction/holding_period', CASE WHEN n > 1 THEN 'ok' ELSE
  'insufficient_dates' END), ('positive_high_minus_low_share', p, 'fraction', CASE WHEN n = 0 THEN 'no_evaluated_dates' ELSE
  'ok' END),
 ('evaluated_high_minus_low_dates', n::DOUBLE, 'dates', 'ok'), ('unevaluated_high_minus_low_dates', (t - n)::DOUBLE, 'dates',
  'ok')) AS v(metric, value, unit, status)""")
def signal_summary(spark, d):
    s, o, labelled, _ = _diagnosed(spark, d)
    dates = s.select("signal_date").unionByName(o.select("signal_date")).distinct()
    spreads = signals.spread_table(signals.group_table(labelled, dates, 5), 5)
    return rounded(signals.summary(spreads, "high_minus_low", "high_minus_low", "fraction/holding_period"))


BENCH = DAILY + """, b1 AS (SELECT session, r AS b FROM r1 WHERE asset = (SELECT min(asset) FROM v1)), e2 AS (SELECT d1.*, b, product(1 + b) OVER
  (ORDER BY session) AS bw FROM d1 JOIN b1 USING (session))
"""


def _with_benchmark(spark, d):
    r = rets.returns(views.events_panel(spark, d)).where(F.col("value").isNotNull())
    b = r.groupBy("period_start", "session").agg(F.min_by("value", "asset").alias("b"))
    return performance.aligned(daily(spark, d), b, "b")


@query(BENCH + """, a AS (SELECT count(*) AS n, corr(b, sr) AS c, covar_samp(b, sr) / var_samp(b) AS beta, stddev_samp(sr - b) AS te, avg(sr - b)
  AS m, max_by(bw, session) AS bw, max_by(equity, session) AS e, max_by(wealth, session) AS w
  FROM e2)
SELECT 'equal_weight' AS scenario, metric, round(value, 9) AS value, unit, n AS n_obs, 'ok' AS status
  FROM a, LATERAL (VALUES ('return_correlation', c, 'correlation'), ('beta', beta, 'ratio'), ('annualized_tracking_error', te *
  sqrt(252), 'fraction/sqrt(year)'),
 ('information_ratio', m * sqrt(252) / te, 'ratio'), ('benchmark_compounded_return', bw - 1, 'fraction'),
  ('compounded_return_difference', 100 * (w - bw), 'percentage_points'), ('relative_wealth_return', e / (100000 * bw) - 1,
  'fraction')) AS v(metric, value, unit)""")
def benchmark_report(spark, d):
    return rounded(performance.against_benchmark(_with_benchmark(spark, d), CAPITAL, PERIODS))


@query(BENCH + """, u AS (SELECT session, period_start, 'portfolio' AS series, sr AS r FROM e2 UNION ALL SELECT session, period_start,
  'benchmark', b FROM e2)
SELECT 'equal_weight' AS scenario, min(period_start) AS session, series, 0.0::DOUBLE AS cumulative_simple_return, 0.0::DOUBLE AS
  compounded_return, 1.0::DOUBLE AS wealth FROM u GROUP BY series
UNION ALL SELECT 'equal_weight', session, series, round(sum(r) OVER w, 9), round(product(1 + r) OVER w - 1, 9), round(product(1
  + r) OVER w, 9) FROM u WINDOW w AS (PARTITION BY series ORDER BY session)""")
def cumulative_table(spark, d):
    """Portfolio and benchmark from a seed of 0, 0 and 1 at the start of the first interval."""
    both = _with_benchmark(spark, d)
    return rounded(performance.cumulative(both, "simple_return", "portfolio").unionByName(performance.cumulative(both, "b", "benchmark")))


@query(BENCH + """, f AS (SELECT *, 0.0001 + day(session) / 1e6 AS rf FROM e2), a AS (SELECT count(*) AS n, avg(sr - rf) AS m, stddev_samp(sr -
  rf) AS v FROM f)
SELECT 'equal_weight' AS scenario, 'sharpe' AS metric, round(m * sqrt(252) / v, 9) AS value, 'ratio' AS unit, n AS n_obs, 'ok'
  AS status FROM a""")
def excess_sharpe(spark, d):
    """Sharpe ratio over the volatility of excess returns, with a dated risk-free series."""
    both = daily(spark, d).withColumn("rf", F.lit(0.0001) + F.dayofmonth("session") / 1e6)
    return rounded(performance.summary(both, PERIODS, denominator="excess_returns").where("metric = 'sharpe'"))


@query(BENCH + """, k AS (SELECT sr, pnl, row_number() OVER (ORDER BY sr DESC) AS i, row_number() OVER (ORDER BY pnl DESC) AS j, count(*) OVER ()
  AS n FROM d1), l AS (SELECT unnest(['0.95', '0.5']) AS confidence),
t AS (SELECT confidence, max(n) AS n, max(sr) FILTER (WHERE i = ceil(CAST(confidence AS DECIMAL(12,10)) * n)) AS vr, max(pnl)
  FILTER (WHERE j = ceil(CAST(confidence AS DECIMAL(12,10)) * n)) AS vp FROM k, l GROUP BY 1)
SELECT 'equal_weight' AS scenario, confidence, round(vr, 9) AS var_return, round((SELECT avg(sr)
  FROM k WHERE sr <= vr), 9) AS etl_return, round(vp, 9) AS var_pnl, round((SELECT avg(pnl)
  FROM k WHERE pnl <= vp), 9) AS etl_pnl,
 n AS n_obs, (SELECT count(*) FROM k WHERE sr <= vr) AS n_tail, (SELECT count(*) FROM k WHERE pnl <= vp) AS n_tail_pnl, 'ok' AS
  status FROM t
UNION ALL SELECT 'nothing', confidence, NULL, NULL, NULL, NULL, 0, 0, 0, 'empty_sample' FROM l""")
def tail_report(spark, d):
    """Tails of returns and of money, and the status of a scenario without rows."""
    scenarios = spark.createDataFrame([("equal_weight",), ("nothing",)], "scenario string")
    return rounded(performance.tails(daily(spark, d), ("0.95", "0.5"), scenarios))


@query("""SELECT session, round(sum(abs(0.2::DOUBLE - 0.2::DOUBLE * (1 + r1.r) / (1 + p1.r))) / 2, 9) AS one_way_turnover
  FROM r1 JOIN p1 USING (session) WHERE r1.r IS NOT NULL GROUP BY session""")
def rebalance_turnover(spark, d):
    """One-way turnover of restoring equal weights at each close."""
    r = rets.returns(views.events_panel(spark, d)).where(F.col("value").isNotNull())
    w = r.select("asset").distinct().withColumn("weight", F.lit(0.2))
    return rounded(allocation.restoring_turnover(r.select("session", "asset", "value"), w))


@query(SPLIT + """, c AS (SELECT 'momentum' AS candidate, target, close__lag0 / close__lag1 - 1 AS prediction
  FROM p WHERE partition = 'validation' AND reason = 'included' UNION ALL SELECT 'zero', target, 0
  FROM p WHERE partition = 'validation' AND reason = 'included')
SELECT CAST(row_number() OVER (ORDER BY candidate) AS BIGINT) AS sequence, 'validation_selection' AS event, candidate, 'mae' AS
  metric, round(avg(abs(prediction - target)), 9) AS value, count(*) AS n_obs, 'validation' AS status
  FROM c GROUP BY candidate""")
def study_audit(spark, d):
    """The audit of one selection by mean absolute error."""
    from tallyspark.operators.study import ResearchStudy

    split = _split(spark, d)
    v = split.where("partition = 'validation' and reason = 'included'")
    made = {"momentum": F.col("close__lag0") / F.col("close__lag1") - 1, "zero": F.lit(0.0)}
    study = ResearchStudy(split, "events")
    study.select(
        v.select(
            "session", "asset",
            F.explode(F.array(*(F.struct(F.lit(k).alias("candidate"), x.alias("prediction")) for k, x in made.items()))).alias("c"),
        ).select("session", "asset", "c.*"),
        {}, metric="mae",
    )
    return rounded(study.audit.select("sequence", "event", "candidate", "metric", "value", "n_obs", "status"))
