"""Security lifecycle: rules as violating rows, and the cash amounts of action legs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cash_amount() -> Column:
    """Cash of a leg for one source share: the fixed part and what accrued by day."""
    days = F.datediff("accrual_end", "accrual_start")
    return F.coalesce("cash_per_source_share", F.lit(0.0)) + F.coalesce(F.col("accrual_per_day") * days, F.lit(0.0))


def _overlaps(df: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Rows that start before an earlier row of their key has ended; an open end overlaps everything later."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.col(last), F.lit("9999-12-31").cast("date"))
    return df.withColumn("__before", F.max(end).over(w)).where(F.col(first) <= F.col("__before")).drop("__before")


def violations(securities: DataFrame, suspensions: DataFrame, aliases: DataFrame, actions: DataFrame, legs: DataFrame) -> DataFrame:
    """rule, key, message of every row that breaks a lifecycle rule; empty if the tables are sound."""
    known = securities.select("asset")
    kinds = ("equity", "warrant", "right", "fund")
    rules = [
        (
            "security_type", securities.where(~F.col("security_type").isin(*kinds)), "asset",
            f"security_type must be one of {', '.join(kinds)}",
        ),
        (
            "security_dates", securities.where("last_session < first_session or terminated_date < first_session"), "asset",
            "last session and termination follow the first session",
        ),
        ("termination_after_quotes", securities.where("terminated_date <= last_session"), "asset", "termination follows the last session"),
        ("suspension_dates", suspensions.where("last_session < first_session"), "asset", "a suspension ends on or after its first session"),
        (
            "suspension_overlap", _overlaps(suspensions, "asset", "first_session", "last_session"), "asset",
            "suspensions of an asset do not overlap",
        ),
        ("suspension_asset", suspensions.join(known, "asset", "left_anti"), "asset", "suspended assets are securities"),
        ("alias_dates", aliases.where("valid_to < valid_from"), "asset", "an alias ends on or after its start"),
        (
            "alias_overlap",
            _overlaps(aliases.withColumn("listing", F.concat_ws("@", "ticker", "exchange")), "listing", "valid_from", "valid_to"),
            "listing", "a ticker names one asset at a time",
        ),
        ("alias_asset", aliases.join(known, "asset", "left_anti"), "asset", "aliased assets are securities"),
        ("action_unique", actions.groupBy("action_id").count().where("count > 1"), "action_id", "action ids are unique"),
        (
            "action_asset", actions.join(known, actions["source_asset"] == known["asset"], "left_anti"), "action_id",
            "source assets are securities",
        ),
        (
            "action_announced", actions.where(F.to_date("announced_at") > F.col("effective_date")), "action_id",
            "an action is announced by its effective date",
        ),
        ("action_record", actions.where("record_date > effective_date"), "action_id", "the record date is not after the effective date"),
        ("action_has_legs", actions.join(legs, "action_id", "left_anti"), "action_id", "every action has a leg"),
        ("leg_action", legs.join(actions, "action_id", "left_anti"), "leg_id", "every leg belongs to an action"),
        (
            "leg_cash", legs.where("leg_type = 'cash' and cash_per_source_share is null and accrual_per_day is null"), "leg_id",
            "a cash leg states an amount",
        ),
        (
            "leg_security",
            legs.where("leg_type = 'security' and (asset is null or units_per_source_share is null or units_per_source_share <= 0)"),
            "leg_id", "a security leg states an asset and positive units",
        ),
        (
            "leg_accrual",
            legs.where("accrual_per_day is not null and (accrual_start is null or accrual_end is null or accrual_end < accrual_start)"),
            "leg_id", "an accrual has an ordered start and end",
        ),
    ]
    parts = [rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(message).alias("message")) for rule, rows, key, message in rules]
    return reduce(DataFrame.unionByName, parts)


#: Columns of the lifecycle tables; those named after the bar may be null.
TABLES = {
    "securities": "asset string, security_type string, first_session date, unquoted_valuation string, source string | last_session date, terminated_date date",
    "suspensions": "asset string, first_session date, last_session date, reason string, source string",
    "aliases": "asset string, ticker string, exchange string, valid_from date, source string | valid_to date",
    "corporate_actions": "action_id string, action_type string, source_asset string, announced_at timestamp, effective_date date, entitlement_basis string, "
    "classification_source string | record_date date, provider_label string",
    "action_legs": "action_id string, leg_id string, leg_type string, due_date date | asset string, units_per_source_share double, cash_per_source_share double, "
    "accrual_per_day double, accrual_start date, accrual_end date, fraction_policy string, cash_in_lieu_price double",
    "warrants": "asset string, underlying_asset string, units_per_warrant double, exercise_price double, exercisable_from date, expiry_date date, exercise_style string, "
    "settlement string, source string",
    "valuation_marks": "session date, asset string, mark double, method string, source string",
}


def action_inputs(spark, **tables) -> dict[str, DataFrame]:
    """Typed lifecycle tables from lists of row dictionaries: absent nullable fields are null, others and unknown ones raise."""
    out = {}
    for name, spec in TABLES.items():
        needed, _, nullable = (p.strip() for p in spec.partition("|"))
        names = lambda part: {c.split()[0] for c in part.split(",") if c.strip()}
        for row in tables.get(name, ()):
            unknown, missing = set(row) - names(needed) - names(nullable), names(needed) - set(row)
            if unknown or missing:
                raise ValueError(f"{name} row has unknown fields {sorted(unknown)} or lacks {sorted(missing)}")
        schema = ", ".join(filter(None, (needed, nullable)))
        columns = [c.split()[0] for c in schema.split(",")]
        out[name] = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in tables.get(name, ())], schema)
    return out


def market_violations(t: dict[str, DataFrame]) -> DataFrame:
    """rule, key of every row that breaks a rule between tables: quotes, warrants, actions and their legs, and marks.

    ``t`` has the tables of TABLES and prices (session, asset, close), sessions (session), splits (action_id, asset,
    effective_session), dividends (action_id, asset, ex_session) and status (a table of ``quote_status``). The rules of
    single tables are those of ``violations``.
    """
    sec, act, legs, war = t["securities"], t["corporate_actions"], t["action_legs"], t["warrants"]
    days, splits, divs = t["sessions"].select("session"), t["splits"], t["dividends"]
    info = sec.select(F.col("asset").alias("i_asset"), "security_type", "last_session", "terminated_date", "unquoted_valuation")
    of = lambda d, c: d.join(info, d[c] == F.col("i_asset"), "left")
    source, leg = of(act, "source_asset"), legs.join(
        act.select("action_id", "source_asset", "effective_date", "action_type", "announced_at"), "action_id",
    )
    kinds = act.join(
        legs.groupBy("action_id").agg(
            F.count_if(F.col("leg_type") == "cash").alias("cash"), F.count_if(F.col("leg_type") == "security").alias("secs"),
            F.count("*").alias("n"),
        ),
        "action_id",
    )
    child, held = of(leg.where("leg_type = 'security'"), "asset"), of(t["valuation_marks"], "asset")
    ids = splits.select("action_id").unionByName(divs.select("action_id")).unionByName(act.select("action_id"))
    buys, gives, deal = F.col("action_type").isin(
        "cash_acquisition", "stock_acquisition",
    ), F.col("action_type") == "distribution", F.col("entitlement_basis")
    marks = held.join(t["status"].select("session", "asset", "status"), ["session", "asset"], "left")
    quote = t["status"].join(t["prices"].select("session", "asset", "close"), ["session", "asset"], "left")
    split_at = splits.select(F.col("asset").alias("s_asset"), "effective_session")
    div_at = divs.select(F.col("asset").alias("d_asset"), "ex_session")
    last = act.where(buys).groupBy("source_asset").agg(F.count("*").alias("n"), F.max("effective_date").alias("end"))
    within = F.col("effective_session").between(F.col("effective_date"), F.col("due_date"))
    rules = [
        ("valuation_choice", sec.where("unquoted_valuation not in ('none', 'supplied_mark')"), "asset"),
        ("terminated_without_last_session", sec.where("terminated_date is not null and last_session is null"), "asset"),
        ("priced_asset_unknown", t["prices"].join(sec, "asset", "left_anti"), "asset"),
        ("suspension_not_a_session", t["suspensions"].join(days, F.col("first_session") == F.col("session"), "left_anti"), "asset"),
        ("quote_not_expected", quote.where("status <> 'quoted' and status <> 'missing' and close is not null"), "asset"),
        ("quote_missing", quote.where("status = 'missing'"), "asset"),
        ("alias_of_asset_overlaps", _overlaps(t["aliases"], "asset", "valid_from", "valid_to"), "asset"),
        ("split_after_termination", of(splits, "asset").where("effective_session >= terminated_date"), "action_id"),
        ("dividend_after_termination", of(divs, "asset").where("ex_session >= terminated_date"), "action_id"),
        ("dividend_of_no_equity", of(divs, "asset").where("security_type <> 'equity'"), "action_id"),
        ("warrant_without_terms", sec.where("security_type = 'warrant'").join(war, "asset", "left_anti"), "asset"),
        ("terms_without_warrant", of(war, "asset").where("coalesce(security_type, '') <> 'warrant'").select("asset"), "asset"),
        ("warrant_underlying", of(war, "underlying_asset").where("coalesce(security_type, '') <> 'equity'").select(war["asset"]), "asset"),
        ("warrant_settlement", war.where("settlement <> 'physical'"), "asset"),
        ("warrant_style", war.where("exercise_style not in ('american', 'european')"), "asset"),
        ("warrant_terms", war.where("not (units_per_warrant > 0 and exercise_price >= 0)"), "asset"),
        ("warrant_dates", war.where("exercisable_from > expiry_date"), "asset"),
        ("warrant_termination", of(war, "asset").where("not (terminated_date <=> date_add(expiry_date, 1))"), "asset"),
        (
            "warrant_underlying_split",
            war.join(
                split_at,
                (F.col("underlying_asset") == F.col("s_asset")) & (F.col("effective_session") <= F.col("expiry_date")),
                "left_semi",
            ),
            "asset",
        ),
        ("action_id_repeated", ids.groupBy("action_id").count().where("count > 1"), "action_id"),
        ("action_type", act.where("action_type not in ('cash_acquisition', 'stock_acquisition', 'distribution')"), "action_id"),
        ("action_source", source.where("coalesce(security_type, '') <> 'equity'"), "action_id"),
        ("record_date_entitlement", act.where("entitlement_basis = 'record_date'"), "action_id"),
        ("leg_type", legs.where("leg_type not in ('cash', 'security')"), "leg_id"),
        ("acquisition_basis", act.where(buys & (deal != "effective_date")), "action_id"),
        ("acquisition_termination", source.where(buys & ~F.col("terminated_date").eqNullSafe(F.col("effective_date"))), "action_id"),
        ("acquired_twice", last.where("n > 1"), "source_asset"),
        ("cash_acquisition_legs", kinds.where("action_type = 'cash_acquisition' and (secs > 0 or cash = 0)"), "action_id"),
        ("stock_acquisition_legs", kinds.where("action_type = 'stock_acquisition' and secs = 0"), "action_id"),
        ("distribution_basis", act.where(gives & ~deal.isin("ex_date", "due_bill")), "action_id"),
        (
            "distribution_record_date",
            act.where(
                gives & (
                    F.col("record_date").isNull() | ((deal == "ex_date") & (F.col("record_date") < F.col("effective_date"))) | (
                        (deal == "due_bill") & (F.col("record_date") >= F.col("effective_date"))
                    )
                )
            ),
            "action_id",
        ),
        ("distribution_legs", kinds.where("action_type = 'distribution' and (cash > 0 or secs = 0)"), "action_id"),
        ("distribution_after_termination", source.where(gives & (F.col("terminated_date") <= F.col("effective_date"))), "action_id"),
        (
            "action_at_split",
            act.join(
                split_at, (F.col("source_asset") == F.col("s_asset")) & (F.col("effective_date") == F.col("effective_session")),
                "left_semi",
            ),
            "action_id",
        ),
        ("actions_conflict", act.groupBy("source_asset", "effective_date").count().where("count > 1"), "source_asset"),
        (
            "termination_without_deal",
            sec.where(
                "security_type = 'equity' and terminated_date is not null"
            ).join(last, sec["asset"] == last["source_asset"], "left_anti"),
            "asset",
        ),
        ("action_after_acquisition", act.join(last, "source_asset").where("effective_date > end"), "action_id"),
        ("leg_due_early", leg.where("due_date < effective_date"), "leg_id"),
        (
            "cash_leg_with_security",
            leg.where("leg_type = 'cash' and (asset is not null or units_per_source_share is not null or fraction_policy is not null)"),
            "leg_id",
        ),
        ("cash_leg_negative", leg.where("leg_type = 'cash' and coalesce(cash_per_source_share, -1) < 0"), "leg_id"),
        (
            "accrual_incomplete",
            leg.where("(accrual_per_day is null) <> (accrual_start is null) or (accrual_per_day is null) <> (accrual_end is null)"),
            "leg_id",
        ),
        ("accrual_after_effect", leg.where("accrual_end > effective_date"), "leg_id"),
        ("security_leg_asset", child.where("i_asset is null or asset <=> source_asset"), "leg_id"),
        ("security_leg_with_cash", child.where("cash_per_source_share is not null or accrual_per_day is not null"), "leg_id"),
        ("fraction_policy", child.where("coalesce(fraction_policy, '') not in ('fractional', 'cash_in_lieu')"), "leg_id"),
        (
            "cash_in_lieu_price",
            child.where("(coalesce(fraction_policy, '') = 'cash_in_lieu') <> (cash_in_lieu_price is not null) or cash_in_lieu_price <= 0"),
            "leg_id",
        ),
        ("delivery_after_termination", child.where("terminated_date <= due_date"), "leg_id"),
        ("delivery_across_split", child.join(split_at, (F.col("asset") == F.col("s_asset")) & within, "left_semi"), "leg_id"),
        (
            "delivery_across_dividend",
            child.where("due_date > effective_date").join(
                div_at,
                (F.col("asset") == F.col("d_asset")) & F.col("ex_session").between(F.col("effective_date"), F.col("due_date")),
                "left_semi",
            ),
            "leg_id",
        ),
        ("mark_not_declared", held.where("coalesce(unquoted_valuation, '') <> 'supplied_mark'"), "asset"),
        ("mark_beside_quote", marks.where("status is null or status in ('quoted', 'terminated')"), "asset"),
        ("mark_value", held.where("mark < 0 or (mark = 0 and security_type <> 'warrant')"), "asset"),
    ]
    return reduce(
        DataFrame.unionByName,
        [rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")) for rule, rows, key in rules],
    ).distinct()
