"""Portfolio books in closed form: windows, joins and grouped sums over all runs at once.

A book of scheduled baskets looks path-dependent, as each basket is bought with what the last one left. But between
two baskets everything scales with the equity after the first: holdings grow by the growth of their assets, cash and
debt by their rates, and the costs of the next basket are proportional too. So each span between baskets is
valued for one unit of equity, each basket's ratio of equity after to equity before is solved for one unit, and
the running product of these ratios gives the equity of every span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.lineage import small

from tallyspark.operators.returns import returns


@dataclass(frozen=True)
class Financing:
    """Annual rates of cash, of debt and of lent shares by calendar day (the last on the value of what is sold short at the
    previous close), and the share of equity in the holdings below which a run stops."""

    cash_rate: float = 0.0
    borrowing_rate: float = 0.0
    day_count: int = 365
    maintenance_equity_ratio: float | None = None
    stock_borrow_rate: float = 0.0

    def __post_init__(self):
        ratio = self.maintenance_equity_ratio
        if min(self.cash_rate, self.borrowing_rate, self.stock_borrow_rate) < 0 or self.day_count not in (360, 365):
            raise ValueError("rates must not be negative and day_count must be 360 or 365")
        if ratio is not None and not 0 < ratio <= 1:
            raise ValueError("maintenance_equity_ratio must be in (0, 1]")


@dataclass(frozen=True)
class TradeCosts:
    """Costs of a trade in basis points of its notional."""

    commission_bps: float = 0.0
    half_spread_bps: float = 0.0
    impact_bps: float = 0.0

    def __post_init__(self):
        if min(self.commission_bps, self.half_spread_bps, self.impact_bps) < 0:
            raise ValueError("costs must not be negative")

    @property
    def rate(self) -> float:
        return (self.commission_bps + self.half_spread_bps + self.impact_bps) / 10_000


def buy_and_hold_unlevered(
    panel: DataFrame, weights: DataFrame, capital: float, costs: TradeCosts, dividends: DataFrame | None = None,
) -> DataFrame:
    """session, equity, cash, market_value, pnl of a basket bought at the first close without debt (closed form).

    Gross notional is ``capital / (1 + sum w k)``, so costs are paid out of the capital. Dividends accrue at the ex
    date to holdings from before it and are cash from then on.
    """
    entry = panel.agg(F.min("session").alias("entry"))
    p = panel.join(F.broadcast(entry)).join(small(weights), "asset")
    gross = capital / (1 + costs.rate)  # weights sum to one
    by_asset = Window.partitionBy("asset").orderBy("session")
    p = p.withColumn("quantity", F.col("weight") * gross / F.first("close").over(by_asset))
    p = p.withColumn("value", F.col("quantity") * F.col("close"))
    if dividends is not None:
        d = dividends.groupBy("asset", F.col("ex_session").alias("session")).agg(F.sum("cash_per_share").alias("cash"))
        p = p.join(d, ["asset", "session"], "left").withColumn(
            "income",
            F.when(F.col("session") > F.col("entry"), F.coalesce("cash", F.lit(0.0)) * F.col("quantity")).otherwise(0.0),
        )
    else:
        p = p.withColumn("income", F.lit(0.0))
    day = p.groupBy("session").agg(F.sum("value").alias("market_value"), F.sum("income").alias("income"), F.lit(1).alias("run"))
    run = Window.partitionBy("run").orderBy("session")
    day = day.withColumn("cash", F.sum("income").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    day = day.withColumn("equity", F.col("market_value") + F.col("cash"))
    return day.select(
        "session", "equity", "cash", "market_value",
        (F.col("equity") - F.coalesce(F.lag("equity").over(run), F.lit(capital))).alias("pnl"),
    )


def growth_index(panel: DataFrame, splits: DataFrame | None = None, dividends: DataFrame | None = None) -> DataFrame:
    """session, asset, index: the growth of one unit of each asset since its first session; dividends buy more of their payer at the ex close."""
    r = returns(panel, splits=splits, dividends=dividends)
    run = Window.partitionBy("asset").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("session", "asset", F.product(1 + F.coalesce("value", F.lit(0.0))).over(run).alias("index"))


def _after_costs(before: DataFrame, targets: DataFrame, rate: float) -> DataFrame:
    """run_id, session, ratio, cost: what is left of one unit when a basket replaces what is held, and what it costs.

    ``before`` has (run_id, session, asset, unit, worth): holdings and equity for one unit at the last basket. The ratio
    solves ratio + rate * sum |p ratio - u| = worth, where p is the new basket for one unit and u what is held. The left
    side is linear between the points u / p; the last point at which it is not above ``worth`` gives the piece.
    """
    p = targets.select("run_id", "session", "asset", (F.col("weight") * F.col("gross_leverage")).alias("p"))
    keys = ["run_id", "session"]
    by = Window.partitionBy(*keys)
    d = before.select(*keys, "asset", "unit", "worth").join(p, [*keys, "asset"], "full")
    d = d.withColumn("worth", F.max("worth").over(by)).where("worth is not null")  # the first basket has nothing before it
    d = d.fillna(0.0, ["p", "unit"]).withColumn("b", F.try_divide("unit", "p"))
    q = F.abs("p")
    d = d.withColumn("fixed", rate * F.sum(F.when(F.col("p") == 0, F.abs("unit")).otherwise(0.0)).over(by))
    upto = by.orderBy(F.col("b").asc_nulls_last(), "asset").rowsBetween(Window.unboundedPreceding, 0)
    held, moved = F.when(F.col("p") != 0, q).otherwise(0.0), F.when(F.col("p") != 0, q * F.col("b")).otherwise(0.0)
    # the sums of p and p b over points at or below each point, and over all
    d = d.withColumn("p0", F.sum(held).over(upto)).withColumn("b0", F.sum(moved).over(upto)).withColumn("p1", F.sum(held).over(by)).withColumn("b1", F.sum(moved).over(by))
    slope = lambda x, y: 1 + rate * (2 * x - y)
    level = lambda x, y: F.col("worth") - F.col("fixed") + rate * (2 * x - y)
    at_point = F.col("b") * slope(F.col("p0"), F.col("p1")) <= level(F.col("b0"), F.col("b1"))
    a = d.groupBy(*keys).agg(
        F.max_by(F.struct("p0", "b0"), F.when(at_point & (F.col("p") != 0), F.struct("b", "p0"))).alias("piece"),
        F.max("p1").alias("p1"), F.max("b1").alias("b1"), F.max("worth").alias("worth"), F.max("fixed").alias("fixed"),
    )
    x, y = F.coalesce("piece.p0", F.lit(0.0)), F.coalesce("piece.b0", F.lit(0.0))
    ratio = level(y, F.col("b1")) / slope(x, F.col("p1"))
    return a.select(*keys, ratio.alias("ratio"), (F.col("worth") - ratio).alias("cost"))


def _less_borrow_fees(day: DataFrame, base: DataFrame, financing: Financing) -> DataFrame:
    """``day`` with the fees of lent shares, and the interest that they cost, taken from ``rest``."""
    entered = base.groupBy("run_id", "start").agg(F.sum(F.greatest(-F.col("p"), F.lit(0.0))).alias("first_short"))
    span = Window.partitionBy("run_id", "start").orderBy("session")
    d = day.join(entered, ["run_id", "start"])
    days = F.datediff("session", F.coalesce(F.lag("session").over(span), F.col("start")))
    fee = F.coalesce(F.lag("short").over(span), F.col("first_short")) * days * (financing.stock_borrow_rate / financing.day_count)
    d = d.withColumn("fee", fee / F.col("grown"))
    paid = F.sum("fee").over(span.rowsBetween(Window.unboundedPreceding, 0)) * F.col("grown")
    return d.withColumn("rest", F.col("rest") - paid).drop("fee", "first_short")


def run_books(growth: DataFrame, targets: DataFrame, capital: float, financing: Financing, costs: TradeCosts, hold: bool = False) -> DataFrame:
    """run_id, session, equity, market_value, gross, cash, debt, trade_cost, market_pnl, financing_pnl of every run and session.

    ``growth`` is a ``growth_index``; ``targets`` has (run_id, session, asset, weight, gross_leverage): the basket bought at
    that close, with weights that may be negative, for gross_leverage times the equity left after costs. Values are
    after the trades of their session. A run ends with the first session at which equity is below the maintenance share
    of its gross holdings, or gone. With ``hold`` only the first basket of each run is bought, and held to the end.
    """
    keys, rate = ["run_id", "session"], costs.rate
    p, basket = F.col("weight") * F.col("gross_leverage"), Window.partitionBy("run_id", "session")
    if hold:
        first = F.min("session").over(Window.partitionBy("run_id"))
        targets = targets.withColumn("first", first).where("session = first").drop("first")
    bought = targets.withColumn("net", F.sum(p).over(basket)).withColumn("gross_p", F.sum(F.abs(p)).over(basket))
    dates = bought.groupBy(*keys).agg(F.first("net").alias("net"), F.first("gross_p").alias("gross_p"))
    days = growth.select("session").distinct()
    runs = targets.groupBy("run_id").agg(F.min("session").alias("first"))
    calendar = days.join(small(runs), F.col("session") >= F.col("first")).drop("first")  # each session once for each run
    earlier = Window.partitionBy("run_id").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    spans = calendar.join(dates.select(*keys, F.col("session").alias("basket")), keys, "left")
    spans = spans.withColumn("start", F.last("basket", ignorenulls=True).over(earlier)).where("start is not null")

    base = bought.join(growth, ["session", "asset"])
    base = base.select("run_id", F.col("session").alias("start"), "asset", (p / F.col("index")).alias("units"), p.alias("p"), "net")
    held = spans.join(base, ["run_id", "start"]).join(growth, ["session", "asset"])
    rest = 1 - F.col("net")
    yearly = F.when(rest < 0, financing.borrowing_rate).otherwise(financing.cash_rate) / financing.day_count
    unit, grown = F.col("units") * F.col("index"), F.pow(1 + yearly, F.datediff("session", "start"))
    held = held.select(*keys, "start", "basket", "asset", unit.alias("unit"), (rest * grown).alias("rest"), grown.alias("grown"))
    day = held.groupBy(*keys, "start").agg(
        F.sum("unit").alias("market"), F.sum(F.abs("unit")).alias("gross"), F.first("rest").alias("rest"), F.first("grown").alias("grown"),
        F.sum(F.greatest(-F.col("unit"), F.lit(0.0))).alias("short"),
    )
    if financing.stock_borrow_rate:
        day = _less_borrow_fees(day, base, financing)
    day = day.withColumn("worth", F.col("market") + F.col("rest"))

    steps = dates.withColumnRenamed("session", "start")
    if hold:
        steps = steps.withColumns({"ratio": F.lit(None).cast("double"), "cost": F.lit(None).cast("double")})
    else:
        before = held.where("basket is not null")
        if financing.stock_borrow_rate:
            before = before.join(day.select(*keys, "worth"), keys)
        else:
            before = before.withColumn("worth", F.sum("unit").over(basket) + F.col("rest"))
        solved = _after_costs(before, targets, rate).withColumnRenamed("session", "start")
        steps = steps.join(solved, ["run_id", "start"], "left")
    entry = 1 / (1 + rate * F.col("gross_p"))  # the first basket is bought with money alone
    steps = steps.withColumn("cost", F.coalesce("cost", 1 - entry)).withColumn("ratio", F.coalesce("ratio", entry))
    order = Window.partitionBy("run_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("scale", capital * F.product("ratio").over(order)).withColumn(
        "paid", F.col("scale") / F.col("ratio") * F.col("cost"),
    )

    x = F.col("scale")
    along = day.drop("short", "grown").join(steps.select("run_id", "start", "scale"), ["run_id", "start"]).select(
        *keys, (x * F.col("worth")).alias("worth"), (x * F.col("market")).alias("market"), (x * F.col("gross")).alias("gross"), (x * F.col("rest")).alias("rest")
    )
    after = steps.select(
        "run_id", F.col("start").alias("session"), x.alias("a_worth"), (x * F.col("net")).alias("a_market"), (x * F.col("gross_p")).alias("a_gross"),
        (x * (1 - F.col("net"))).alias("a_rest"), "paid",
    )
    d = along.join(after, keys, "full")
    now = lambda c: F.coalesce(f"a_{c}", c)
    prior = Window.partitionBy("run_id").orderBy("session")
    lost = now("worth") <= 0
    if financing.maintenance_equity_ratio is not None:
        lost = lost | (now("worth") < financing.maintenance_equity_ratio * now("gross"))
    d = d.withColumn(
        "over", F.max(F.when(lost, 1).otherwise(0)).over(prior.rowsBetween(Window.unboundedPreceding, -1)),
    ).where("coalesce(over, 0) = 0")
    return d.select(
        *keys, now("worth").alias("equity"), now("market").alias("market_value"), now("gross").alias("gross"),
        F.greatest(now("rest"), F.lit(0.0)).alias("cash"), F.greatest(-now("rest"), F.lit(0.0)).alias("debt"), F.coalesce("paid", F.lit(0.0)).alias("trade_cost"),
        (
            F.col("market") - F.lag(now("market")).over(prior)
        ).alias("market_pnl"), (F.col("rest") - F.lag(now("rest")).over(prior)).alias("financing_pnl"),
    )


def audit(books: DataFrame, capital: float) -> DataFrame:
    """run_id, session, equity_gap, balance_gap: equity less the capital and all P&L and costs up to then, and less its parts."""
    run = Window.partitionBy("run_id").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    gained = F.coalesce("market_pnl", F.lit(0.0)) + F.coalesce("financing_pnl", F.lit(0.0)) - F.col("trade_cost")
    d = books.withColumn("due", F.lit(float(capital)) + F.sum(gained).over(run))
    parts = F.col("market_value") + F.col("cash") - F.col("debt")
    return d.select(
        "run_id", "session", (F.col("equity") - F.col("due")).alias("equity_gap"),
        (F.col("equity") - parts).alias("balance_gap"),
    )


def position_pnl(panel: DataFrame, quantities: DataFrame) -> DataFrame:
    """session, asset, price_pnl: what each close added to a holding of (asset, quantity) since the close before."""
    held = panel.join(quantities, "asset").withColumn("before", F.lag("close").over(Window.partitionBy("asset").orderBy("session")))
    return held.where(F.col("before").isNotNull()).select(
        "session", "asset", (F.col("quantity") * (F.col("close") - F.col("before"))).alias("price_pnl")
    )


def attribution(books: DataFrame) -> DataFrame:
    """run_id, component, pnl: what the market, financing and trade costs added to each run; they sum to its P&L."""
    parts = [
        ("market", F.coalesce("market_pnl", F.lit(0.0))), ("financing", F.coalesce("financing_pnl", F.lit(0.0))),
        ("trade_cost", -F.col("trade_cost")),
    ]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("component"), v.alias("pnl")) for n, v in parts))).alias("p")
    return books.select("run_id", rows).groupBy("run_id", "p.component").agg(F.sum("p.pnl").alias("pnl"))


def exposures(books: DataFrame) -> DataFrame:
    """run_id, session, gross, net, cash, debt: each over equity, debt negative; null where equity is gone."""
    over = lambda c: F.when(F.col("equity") > 0, F.col(c) / F.col("equity"))
    return books.select(
        "run_id", "session", over("gross").alias("gross"), over("market_value").alias("net"), over("cash").alias("cash"),
        (-over("debt")).alias("debt"),
    )


def balance_sheet(books: DataFrame) -> DataFrame:
    """run_id, session, component, weight: holdings, cash and (negative) debt as parts of equity; they sum to one."""
    e = exposures(books)
    rows = F.array(
        *(F.struct(F.lit(n).alias("component"), F.col(c).alias("weight")) for n, c in (("holdings", "net"), ("account:cash", "cash"), ("account:debt", "debt")))
    )
    return e.select("run_id", "session", F.explode(rows).alias("p")).select("run_id", "session", "p.*")


def cost_rows(books: DataFrame) -> DataFrame:
    """run_id, metric, value, unit, n_obs, status: what entry and financing cost, all trade costs, and the leverage at the end."""
    a = books.groupBy("run_id").agg(
        F.count("*").alias("n"), F.min_by("trade_cost", "session").alias("entry"), F.sum("trade_cost").alias("trades"),
        F.sum(F.greatest(-F.coalesce("financing_pnl", F.lit(0.0)), F.lit(0.0))).alias("financing"),
        F.max_by(F.when(F.col("equity") > 0, F.col("gross") / F.col("equity")), "session").alias("leverage"),
    )
    gone = F.when(F.col("leverage").isNull(), "nonpositive_equity").otherwise("ok")
    rows = [
        ("entry_cost", "entry", "money", F.lit("ok")), ("trade_cost", "trades", "money", F.lit("ok")),
        ("financing_cost", "financing", "money", F.lit("ok")), ("ending_leverage", "leverage", "ratio", gone),
    ]
    structs = [F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(u).alias("unit"), F.col("n").alias("n_obs"), s.alias("status")) for m, c, u, s in rows]
    return a.select("run_id", F.explode(F.array(*structs)).alias("m")).select("run_id", "m.*")
