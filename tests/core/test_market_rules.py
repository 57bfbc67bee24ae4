"""Each rule between the lifecycle tables, with a row that breaks it, and a sound market that breaks none."""

import datetime as dt

import pytest

from tallyspark.operators import intervals, lifecycle

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
AT = lambda n: dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=n)


def security(asset, kind="equity", last=None, end=None, valuation="none"):
    return {
        "asset": asset, "security_type": kind, "first_session": D(0), "last_session": last, "terminated_date": end,
        "unquoted_valuation": valuation, "source": "x",
    }


def action(name, kind, source, at, basis, record=None):
    return {
        "action_id": name, "action_type": kind, "source_asset": source, "announced_at": AT(0), "effective_date": D(at),
        "entitlement_basis": basis, "record_date": record, "classification_source": "x",
    }


def leg(name, deal, kind, due, **more):
    return {"action_id": deal, "leg_id": name, "leg_type": kind, "due_date": D(due)} | more


def warrant(asset, under="A", units=1.0, style="american", settlement="physical", first=1, expiry=8):
    return {
        "asset": asset, "underlying_asset": under, "units_per_warrant": units, "exercise_price": 5.0,
        "exercisable_from": D(first), "expiry_date": D(expiry), "exercise_style": style, "settlement": settlement,
        "source": "x",
    }


def market(spark, securities, prices, splits=(), dividends=(), **tables):
    t = lifecycle.action_inputs(spark, securities=securities, **tables)
    t["sessions"] = spark.createDataFrame([(D(i),) for i in range(10)], "session date")
    t["prices"] = spark.createDataFrame(prices, "session date, asset string, close double")
    t["splits"] = spark.createDataFrame(list(splits), "action_id string, asset string, effective_session date")
    t["dividends"] = spark.createDataFrame(list(dividends), "action_id string, asset string, ex_session date")
    t["status"] = intervals.quote_status(t["sessions"], t["securities"], t["prices"], t["suspensions"])
    return t


def quotes(**last):
    return [(D(i), a, 10.0) for a, n in last.items() for i in range(n)]


def test_a_sound_market_breaks_no_rule(spark):
    t = market(
        spark, [
            security("A"), security("B", last=D(5), end=D(6)), security("W", "warrant", D(8), D(9), "supplied_mark"),
        ], quotes(A=10, B=6, W=9),
        corporate_actions=[action("b", "cash_acquisition", "B", 6, "effective_date"), action("d", "distribution", "A", 3, "ex_date", D(4))],
        action_legs=[
            leg("l1", "b", "cash", 7, cash_per_source_share=4.0),
            leg("l2", "d", "security", 3, asset="W", units_per_source_share=0.5, fraction_policy="fractional"),
        ],
        warrants=[warrant("W")],
    )
    assert lifecycle.market_violations(t).collect() == []


def test_every_rule_names_its_offender(spark):
    t = market(
        spark,
        [
            security("A"), security("B", last=D(5), end=D(6)), security("C", end=D(9)), security("E", last=D(4), end=D(5)), security("F", "fund", valuation="guess"), security("G", "warrant"), security("H", last=D(7), end=D(8)),
            security(
                "W", "warrant", D(8), D(9), "supplied_mark",
            ), security("V", "warrant", D(8), D(10)), security("M", valuation="supplied_mark", last=D(6)), security("S"),
        ],
        quotes(A=10, B=8, C=9, E=5, F=10, G=10, H=8, W=9, V=9, M=7, S=9, X=1),
        splits=[("s1", "A", D(2)), ("s2", "B", D(7)), ("b", "S", D(4))],
        dividends=[("v1", "B", D(7)), ("v2", "F", D(2)), ("v3", "S", D(6))],
        suspensions=[{"asset": "A", "first_session": D(40), "last_session": D(41), "reason": "r", "source": "x"}],
        aliases=[{"asset": "A", "ticker": t, "exchange": "X", "valid_from": D(0), "valid_to": None, "source": "x"} for t in ("p", "q")],
        corporate_actions=[
            action("b", "cash_acquisition", "B", 6, "ex_date"), action(
                "b2", "cash_acquisition", "B", 3, "effective_date",
            ), action("k", "stock_acquisition", "H", 8, "effective_date"), action("x", "merger", "A", 2, "record_date"),
            action(
                "d1", "distribution", "A", 5, "effective_date",
            ), action("d2", "distribution", "A", 5, "ex_date", D(4)), action("d3", "distribution", "B", 9, "due_bill", D(9)), action("d4", "distribution", "F", 3, "ex_date", D(3)),
        ],
        action_legs=[
            leg(
                "l1", "b", "security", 2, asset="B", units_per_source_share=1.0, cash_per_source_share=1.0,
            ), leg("l2", "k", "cash", 8, asset="A", cash_per_source_share=-1.0), leg("l3", "x", "bonds", 2),
            leg("l4", "d1", "cash", 5, cash_per_source_share=1.0, accrual_per_day=1.0, accrual_end=D(7)), leg(
                "l5", "d2", "security", 9, asset="E", units_per_source_share=1.0, fraction_policy="cash_in_lieu",
            ),
            leg(
                "l6", "d4", "security", 6, asset="S", units_per_source_share=1.0, fraction_policy="fractional",
            ), leg("l7", "d3", "security", 9, asset="S", units_per_source_share=1.0, fraction_policy="fractional"),
        ],
        warrants=[warrant("W", "F", 0.0, "bermudan", "cash", 9, 8), warrant("V", "A"), warrant("A")],
        valuation_marks=[{"session": D(3), "asset": a, "mark": m, "method": "m", "source": "x"} for a, m in (("A", 1.0), ("M", 0.0))],
    )
    got = {(r.rule, r.key) for r in lifecycle.market_violations(t).collect()}
    want = {
        ("valuation_choice", "F"), ("terminated_without_last_session", "C"), ("priced_asset_unknown", "X"), ("suspension_not_a_session", "A"), ("quote_not_expected", "B"), ("quote_missing", "S"),
        ("alias_of_asset_overlaps", "A"), ("split_after_termination", "s2"), ("dividend_after_termination", "v1"), ("dividend_of_no_equity", "v2"), ("warrant_without_terms", "G"), ("terms_without_warrant", "A"),
        ("warrant_underlying", "W"), ("warrant_settlement", "W"), ("warrant_style", "W"), ("warrant_terms", "W"), ("warrant_dates", "W"), ("warrant_termination", "V"), ("warrant_underlying_split", "V"), ("action_id_repeated", "b"),
        ("action_type", "x"), ("action_source", "d4"), ("record_date_entitlement", "x"), ("leg_type", "l3"), ("acquisition_basis", "b"), ("acquisition_termination", "b2"), ("acquired_twice", "B"), ("cash_acquisition_legs", "b"),
        ("stock_acquisition_legs", "k"), ("distribution_basis", "d1"), ("distribution_record_date", "d2"), ("distribution_legs", "d1"), ("distribution_after_termination", "d3"), ("action_at_split", "x"), ("actions_conflict", "A"),
        ("termination_without_deal", "E"), ("action_after_acquisition", "d3"), ("leg_due_early", "l1"), ("cash_leg_with_security", "l2"), ("cash_leg_negative", "l2"), ("accrual_incomplete", "l4"), ("accrual_after_effect", "l4"),
        ("security_leg_asset", "l1"), ("security_leg_with_cash", "l1"), ("fraction_policy", "l1"), ("cash_in_lieu_price", "l5"), ("delivery_after_termination", "l5"), ("delivery_across_split", "l6"),
        ("delivery_across_dividend", "l6"), ("mark_not_declared", "A"), ("mark_beside_quote", "A"), ("mark_value", "M"),
    }
    assert want <= got, want - got
    assert len({r for r, _ in want}) == 52


def test_rows_with_other_fields_are_refused(spark):
    with pytest.raises(ValueError, match="unknown fields"):
        lifecycle.action_inputs(spark, securities=[security("A") | {"colour": "red"}])
    with pytest.raises(ValueError, match="lacks"):
        lifecycle.action_inputs(spark, aliases=[{"asset": "A"}])
