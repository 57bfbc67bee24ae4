"""Returns of securities across gaps, distributions and acquisitions, and what was announced about them.

Statuses of a return: first_observation, quote_gap, ok, supplied_mark_valuation, unvalued_distribution, and for the last
row of an acquired security acquisition_consideration, unvalued_consideration or consideration_after_coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.lifecycle import cash_amount


def known_values(prices: DataFrame, marks: DataFrame) -> DataFrame:
    """session, asset, value, marked: a quote where there is one, else a supplied mark."""
    q = prices.select("session", "asset", F.col("close").alias("value"), F.lit(False).alias("marked"))
    m = marks.join(prices, ["session", "asset"], "left_anti").select(
        "session", "asset", F.col("mark").alias("value"), F.lit(True).alias("marked"),
    )
    return q.unionByName(m)


def security_returns(
    status: DataFrame, prices: DataFrame, splits: DataFrame, dividends: DataFrame, actions: DataFrame, legs: DataFrame, marks: DataFrame
) -> DataFrame:
    """session, asset, period_start, price_return, total_return, status.

    ``status`` is a table of ``intervals.quote_status``; ``actions`` has (action_id, action_type, source_asset, effective_date),
    ``legs`` (action_id, asset, units_per_source_share, and the columns of ``cash_amount``). The total return
    reinvests dividends and distributed securities at the close; a suspension or a spell without quotes starts
    anew with ``quote_gap``. Acquired securities end with one row for the consideration, on the first session on or after
    the effective date.
    """
    by_asset = Window.partitionBy("asset").orderBy("session")
    days = status.where("status in ('quoted', 'suspended', 'unquoted_after_last_session')").join(
        prices.select("session", "asset", "close"), ["session", "asset"], "left",
    )
    gaps = F.sum(F.when(F.col("status") != "quoted", 1).otherwise(0)).over(by_asset.rowsBetween(Window.unboundedPreceding, 0))
    q = days.withColumn("gaps", gaps).where("status = 'quoted'")
    q = q.withColumn("period_start", F.lag("session").over(by_asset)).withColumn("prior", F.lag("close").over(by_asset))
    q = q.withColumn("gap", F.col("gaps") > F.lag("gaps").over(by_asset)).drop("status", "gaps")
    ratio = splits.select("asset", F.col("effective_session").alias("session"), "ratio")
    cash = dividends.groupBy("asset", F.col("ex_session").alias("session")).agg(F.sum("cash_per_share").alias("cash"))
    q = q.join(ratio, ["asset", "session"], "left").join(cash, ["asset", "session"], "left")
    q = q.withColumn("ratio", F.coalesce("ratio", F.lit(1.0))).withColumn("cash", F.coalesce("cash", F.lit(0.0)))

    worth = known_values(prices, marks).select(F.col("session").alias("v_session"), F.col("asset").alias("v_asset"), "value", "marked")
    given = actions.where("action_type = 'distribution'").join(legs, "action_id").select(
        F.col("source_asset").alias("asset"), "effective_date", F.col("asset").alias("leg_asset"), "units_per_source_share"
    )
    spans = q.where("prior is not null and not gap").select("asset", "session", "period_start", "ratio")
    met = spans.join(given, "asset").where("period_start < effective_date and effective_date <= session")
    met = met.join(worth, (F.col("leg_asset") == F.col("v_asset")) & (F.col("session") == F.col("v_session")), "left")
    extra = met.groupBy("asset", "session").agg(
        F.sum(F.col("units_per_source_share") * F.col("value") / F.col("ratio")).alias("extra"),
        F.max(F.col("value").isNull()).alias("unvalued"), F.max(F.coalesce("marked", F.lit(False))).alias("by_mark"),
    )
    q = q.join(extra, ["asset", "session"], "left")
    note = (
        F.when(F.col("prior").isNull(), "first_observation")
        .when(F.col("gap"), "quote_gap")
        .when(F.col("unvalued"), "unvalued_distribution")
        .when(F.col("by_mark"), "supplied_mark_valuation")
        .otherwise("ok")
    )
    q = q.withColumn("note", note)
    held = F.col("note").isin("ok", "supplied_mark_valuation", "unvalued_distribution")
    total = (F.col("close") + F.col("cash") + F.coalesce("extra", F.lit(0.0))) * F.col("ratio") / F.col("prior") - 1
    rows = q.select(
        "session", "asset", F.when(F.col("note") != "first_observation", F.col("period_start")).alias("period_start"),
        F.when(held, F.col("close") / F.col("prior") - 1).alias("price_return"),
        F.when(held & (F.col("note") != "unvalued_distribution"), total).alias("total_return"), F.col("note").alias("status"),
    )
    return rows.unionByName(_considerations(status, prices, actions, legs, worth))


def _considerations(status: DataFrame, prices: DataFrame, actions: DataFrame, legs: DataFrame, worth: DataFrame) -> DataFrame:
    """The last row of each acquired security that was ever quoted."""
    last = status.where("status = 'quoted'").join(prices, ["session", "asset"]).groupBy("asset").agg(
        F.max("session").alias("period_start"), F.max_by("close", "session").alias("prior")
    )
    deals = actions.where("action_type = 'acquisition'").select(
        "action_id", F.col("source_asset").alias("asset"), "effective_date",
    ).join(last, "asset")
    days = status.select(F.col("session").alias("day")).distinct()
    settle = deals.join(days, F.col("day") >= F.col("effective_date"), "left").groupBy(*deals.columns).agg(F.min("day").alias("settle"))
    parts = settle.join(legs.withColumnRenamed("asset", "leg_asset"), "action_id")
    parts = parts.join(worth, (F.col("leg_asset") == F.col("v_asset")) & (F.col("settle") == F.col("v_session")), "left")
    paid = F.when(F.col("leg_type") == "cash", cash_amount()).otherwise(F.col("units_per_source_share") * F.col("value"))
    a = parts.groupBy("asset", "period_start", "prior", "effective_date", "settle").agg(
        F.sum(paid).alias("paid"), F.max(paid.isNull()).alias("unvalued"),
    )
    note = F.when(
        F.col("settle").isNull(), "consideration_after_coverage",
    ).when(F.col("unvalued"), "unvalued_consideration").otherwise("acquisition_consideration")
    return a.select(
        F.coalesce("settle", "effective_date").alias("session"), "asset", "period_start", F.lit(None).cast("double").alias("price_return"),
        F.when(note == "acquisition_consideration", F.col("paid") / F.col("prior") - 1).alias("total_return"), note.alias("status"),
    )


def announced(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """session, asset, announced_actions: what was known by the session's close and is not yet effective, by id.

    Actions of a security are few beside its sessions: each is matched to the sessions between its announcement and its
    effective date, and nothing else.
    """
    a = actions.select("action_id", F.col("source_asset").alias("asset"), "announced_at", "effective_date")
    known = (F.col("announced_at") <= F.col("close_at")) & (F.col("session") < F.col("effective_date"))
    d = a.join(F.broadcast(sessions.select("session", "close_at")), known)
    return d.groupBy("session", "asset").agg(F.concat_ws(",", F.sort_array(F.collect_list("action_id"))).alias("announced_actions"))


def quote_gaps(status: DataFrame) -> DataFrame:
    """asset, first_session, last_session, n_sessions, reason of each spell in which a listed security has no quote."""
    by_asset = Window.partitionBy("asset").orderBy("session")
    changed = F.when(F.col("status").eqNullSafe(F.lag("status").over(by_asset)), 0).otherwise(1)
    spells = status.withColumn("spell", F.sum(changed).over(by_asset.rowsBetween(Window.unboundedPreceding, 0)))
    spells = spells.where("status not in ('quoted', 'not_listed', 'terminated')").groupBy("asset", "spell", F.col("status").alias("reason"))
    return spells.agg(
        F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count("*").alias("n_sessions"),
    ).drop("spell")
