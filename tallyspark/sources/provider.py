"""Provider chart responses: decoded JSON text to daily bars, with raw closes and coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.lineage import small

CHART = (
    "struct<meta:struct<symbol:string,exchangeTimezoneName:string>,timestamp:array<long>,"
    "indicators:struct<quote:array<struct<close:array<double>,volume:array<long>>>,adjclose:array<struct<adjclose:array<double>>>>,"
    "events:struct<splits:map<string,struct<date:long,numerator:double,denominator:double>>,dividends:map<string,struct<date:long,amount:double>>>>"
)
#: What a provider's volumes are: shares as traded, shares after later splits, or not known.
VOLUME_BASES = ("raw", "split_adjusted", "unknown")


def _local(seconds, zone):
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone))


def _charts(responses: DataFrame, column: str) -> DataFrame:
    c = responses.select(F.from_json(column, CHART).alias("c"))
    return c.select(F.col("c.meta.symbol").alias("symbol"), F.col("c.meta.exchangeTimezoneName").alias("zone"), "c.timestamp", "c.indicators", "c.events")


def chart_bars(responses: DataFrame, column: str = "body", first: str | None = None, last: str | None = None) -> DataFrame:
    """symbol, session, close, adjusted_close, volume: one row for each bar, its date in the exchange's time zone; nulls are kept.

    With ``first`` and ``last`` only bars of these local dates, both included, as providers pad what they are asked for.
    """
    d, q = _charts(responses, column), F.get("indicators.quote", 0)
    given = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))  # noqa: E731  a series that is absent has nulls
    bars = F.arrays_zip(
        F.col("timestamp").alias("t"), given(q["close"], "double").alias("close"),
        given(F.get("indicators.adjclose", 0)["adjclose"], "double").alias("adjusted"), given(q["volume"], "long").alias("volume"),
    )
    d = d.select("symbol", "zone", F.explode(bars).alias("b"))
    d = d.select("symbol", _local("b.t", F.col("zone")).alias("session"), F.col("b.close").alias("close"), F.col("b.adjusted").alias("adjusted_close"), F.col("b.volume").alias("volume"))
    return d if first is None else d.where(F.col("session").between(first, last))


def chart_events(responses: DataFrame, column: str = "body") -> DataFrame:
    """symbol, session, kind (split or dividend), value: the ratio of shares after to before, or the cash of a share.

    Providers key events by a time; both maps are opened beside each other and dated in the exchange's time zone.
    """
    d = _charts(responses, column)
    ratio = F.try_divide(F.col("e.numerator"), F.col("e.denominator"))
    splits = d.select("symbol", "zone", F.explode(F.map_values("events.splits")).alias("e")).select("symbol", _local("e.date", F.col("zone")).alias("session"), F.lit("split").alias("kind"), ratio.alias("value"))
    cash = d.select("symbol", "zone", F.explode(F.map_values("events.dividends")).alias("e")).select("symbol", _local("e.date", F.col("zone")).alias("session"), F.lit("dividend").alias("kind"), F.col("e.amount").alias("value"))
    return splits.unionByName(cash)


def bar_problems(bars: DataFrame) -> DataFrame:
    """symbol, session, problem of bars that cannot be used: repeated_session, missing_close, bad_close, missing_volume, bad_volume."""
    bars, c, v = bars.withColumn("n", F.count("*").over(Window.partitionBy("symbol", "session"))), F.col("close"), F.col("volume")
    rules = {
        "repeated_session": F.col("n") > 1, "missing_close": c.isNull(), "bad_close": F.isnan(c) | (c <= 0) | (c == float("inf")), "missing_volume": v.isNull(), "bad_volume": v < 0,
    }
    found = F.array_compact(F.array(*(F.when(broken, F.lit(rule)) for rule, broken in rules.items())))
    return bars.select("symbol", "session", F.explode(found).alias("problem")).distinct()


def event_problems(events: DataFrame, splits: DataFrame, dividends: DataFrame) -> DataFrame:
    """symbol, session, kind, problem where a provider's events and the tables of actions disagree.

    ``splits``: asset, effective_session, ratio; ``dividends``: asset, ex_session, cash_per_share (several of a day add up). Problems:
    ``not_in_table``, ``not_at_provider``, ``value_differs`` and ``bad_value`` for a ratio or an amount that is not positive.
    """
    keys = ["symbol", "session", "kind"]
    ours = splits.select(F.col("asset").alias("symbol"), F.col("effective_session").alias("session"), F.lit("split").alias("kind"), F.col("ratio").alias("stated"))
    ours = ours.unionByName(dividends.select(F.col("asset").alias("symbol"), F.col("ex_session").alias("session"), F.lit("dividend").alias("kind"), F.col("cash_per_share").alias("stated")))
    total = lambda c: F.when(F.first("kind") == "split", F.product(c)).otherwise(F.sum(c))
    ours = ours.groupBy(*keys).agg(total("stated").alias("stated"))
    theirs = events.groupBy(*keys).agg(total("value").alias("value"), F.count_if(F.coalesce(F.col("value") <= 0, F.lit(True))).alias("bad"))
    d = theirs.join(ours, keys, "full_outer")
    off = F.abs(F.col("value") - F.col("stated")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("stated"))
    problem = F.when(F.col("bad") > 0, "bad_value").when(F.col("stated").isNull(), "not_in_table").when(F.col("bad").isNull(), "not_at_provider").when(off, "value_differs")
    return d.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def split_factors(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """symbol, session, factor: raw over split-adjusted close, the product of the ratios of all later splits of a symbol.

    A running product from the last bar back, so bars and splits are joined once.
    """
    s = splits.groupBy(F.col("asset").alias("symbol"), F.col("effective_session").alias("session")).agg(F.product("ratio").alias("ratio"))
    later = Window.partitionBy("symbol").orderBy(F.desc("session")).rowsBetween(Window.unboundedPreceding, -1)
    d = bars.select("symbol", "session").distinct().join(s, ["symbol", "session"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    return d.select("symbol", "session", F.coalesce(F.product("ratio").over(later), F.lit(1.0)).alias("factor"))


def factor_problems(factors: DataFrame, bars: DataFrame, splits: DataFrame) -> DataFrame:
    """symbol, session, problem of supplied factors against the products of splits: missing, unexpected, bad_factor or differs."""
    mine = split_factors(bars, splits).withColumnRenamed("factor", "product")
    d = mine.join(factors.select("symbol", "session", "factor", F.lit(True).alias("given")), ["symbol", "session"], "full_outer")
    f = F.col("factor")
    problem = (
        F.when(F.col("given").isNull(), "missing").when(F.col("product").isNull(), "unexpected").when(f.isNull() | F.isnan(f) | (f <= 0), "bad_factor")
        .when(F.abs(f - F.col("product")) > 1e-9 * F.col("product"), "differs")
    )
    return d.select("symbol", "session", problem.alias("problem")).where(F.col("problem").isNotNull())


def raw_bars(bars: DataFrame, factors: DataFrame, volume_basis: str) -> DataFrame:
    """symbol, session, close (as traded), share_volume, dollar_volume: what was traded, from split-adjusted bars.

    ``volume_basis`` states what volumes are; of unknown ones neither shares nor dollars can be told, and both are null.
    """
    if volume_basis not in VOLUME_BASES:
        raise ValueError(f"volume_basis must be one of {VOLUME_BASES}")
    d = raw_closes(bars, factors.select("symbol", "session", "factor"), keep=True)
    shares = {"raw": F.col("volume").cast("double"), "split_adjusted": F.col("volume") / F.col("factor"), "unknown": F.lit(None).cast("double")}[volume_basis]
    return d.select("symbol", "session", F.col("raw_close").alias("close"), shares.alias("share_volume"), (shares * F.col("raw_close")).alias("dollar_volume"))


def raw_closes(bars: DataFrame, factors: DataFrame, keep: bool = False) -> DataFrame:
    """``bars`` with raw_close = close * factor of the (symbol, session); bars without a factor raise."""
    d = bars.join(factors, ["symbol", "session"], "left").withColumn("raw_close", F.col("close") * F.col("factor"))
    if bad := d.where("factor is null or factor <= 0").limit(5).collect():
        raise ValueError(f"every bar needs one positive factor, first offenders {[(r.symbol, r.session) for r in bad]}")
    return d if keep else d.drop("factor")


def coverage(observed: DataFrame, expected: DataFrame, first: str, last: str, exclusions: DataFrame | None = None) -> DataFrame:
    """asset, session, status: ok, missing, unexpected, outside_coverage or excluded."""
    o = observed.select("asset", "session").distinct().withColumn("o", F.lit(True))
    d = o.join(expected.select("asset", "session").distinct().withColumn("e", F.lit(True)), ["asset", "session"], "full_outer")
    if exclusions is not None:
        d = d.join(small(exclusions.select("asset", "session").distinct().withColumn("x", F.lit(True))), ["asset", "session"], "left")
    else:
        d = d.withColumn("x", F.lit(None).cast("boolean"))
    status = F.when(
        ~F.col("session").between(first, last), "outside_coverage",
    ).when(F.col("x"), "excluded").when(F.col("o").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("ok")
    return d.select("asset", "session", status.alias("status"))
