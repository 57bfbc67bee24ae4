"""Study audit, lifecycle rules, dividend reinvestment and stock-borrow fees."""

import datetime as dt
import math

import numpy as np
import pytest

from tallyspark.operators import ledger, lifecycle
from tallyspark.operators.study import ResearchStudy

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_a_study_tests_its_choice_once(spark):
    split = spark.createDataFrame(
        [(D(0), "A", 1.0, "validation", "included"), (D(1), "A", 2.0, "test", "included")],
        "session date, asset string, target double, partition string, reason string",
    )
    p = lambda day, **c: spark.createDataFrame([(D(day), "A", k, v) for k, v in c.items()], "session date, asset string, candidate string, prediction double")
    s = ResearchStudy(split, "s1")
    with pytest.raises(ValueError):
        s.evaluate_test(p(1, a=1.0))
    assert s.select(p(0, a=1.1, b=3.0), {}) == "a"
    with pytest.raises(ValueError):
        s.evaluate_test(p(1, b=2.0))
    assert math.isclose(s.evaluate_test(p(1, a=2.5)), 0.25)
    later = ResearchStudy(split, "s1", s.rows)
    with pytest.raises(ValueError):
        later.evaluate_test(p(1, a=2.5))
    later.evaluate_test(p(1, a=2.5), reuse="exploratory")
    assert [r.status for r in later.audit.orderBy("sequence").collect()] == ["validation", "validation", "final_test", "exploratory"]
    with pytest.raises(ValueError):
        s.select(p(0, a=1.1), {})


def test_lifecycle_rules_name_their_offenders(spark):
    sec = spark.createDataFrame(
        [("A", "equity", D(0), D(9), D(10)), ("B", "bond", D(5), D(2), None)],
        "asset string, security_type string, first_session date, last_session date, terminated_date date",
    )
    sus = spark.createDataFrame(
        [("A", D(1), D(3)), ("A", D(3), D(4)), ("Z", D(1), D(0))], "asset string, first_session date, last_session date",
    )
    ali = spark.createDataFrame(
        [("A", "T", "X", D(0), None), ("B", "T", "X", D(5), None)],
        "asset string, ticker string, exchange string, valid_from date, valid_to date",
    )
    act = spark.createDataFrame(
        [("a1", "A", dt.datetime(2024, 1, 9), D(4), D(5)), ("a2", "Q", dt.datetime(2024, 1, 1), D(4), D(4))],
        "action_id string, source_asset string, announced_at timestamp, effective_date date, record_date date",
    )
    leg = spark.createDataFrame(
        [("a1", "l1", "cash", None, None, None, None, None, None), ("zz", "l2", "security", "A", 1.0, None, None, None, None)],
        "action_id string, leg_id string, leg_type string, asset string, units_per_source_share double, cash_per_source_share double, accrual_per_day double, accrual_start date, accrual_end date",
    )
    got = {(r.rule, r.key) for r in lifecycle.violations(sec, sus, ali, act, leg).collect()}
    assert got == {
        ("security_type", "B"), ("security_dates", "B"), ("suspension_dates", "Z"), ("suspension_overlap", "A"), ("suspension_asset", "Z"), ("alias_overlap", "T@X"), ("action_asset", "a2"),
        ("action_announced", "a1"), ("action_record", "a1"), ("action_has_legs", "a2"), ("leg_action", "l2"), ("leg_cash", "l1"),
    }


def test_reinvested_dividends_and_borrow_fees(spark):
    closes = [(100.0, 50.0), (99.0, 50.0), (100.0, 50.0), (110.0, 50.0)]
    p = spark.createDataFrame(
        [(D(i), a, c) for i, (x, y) in enumerate(closes) for a, c in (("A", x), ("B", y))],
        "session date, asset string, close double",
    )
    div = spark.createDataFrame([("A", D(1), D(2), 1.0)], "asset string, ex_session date, pay_date date, cash_per_share double")
    t = lambda w: spark.createDataFrame([("r", D(0), a, x, 1.0) for a, x in w.items()], "run_id string, session date, asset string, weight double, gross_leverage double")
    book = lambda growth, w, fin: [r.equity for r in ledger.run_books(growth, t(w), 100.0, fin, ledger.TradeCosts()).orderBy("session").collect()]
    assert np.allclose(
        book(ledger.growth_index(p, dividends=div), {"A": 1.0}, ledger.Financing()), [100, 100, 100 * 100 / 99, 110 * 100 / 99],
    )
    fees = book(ledger.growth_index(p), {"A": 0.0, "B": -1.0}, ledger.Financing(stock_borrow_rate=0.365))
    assert np.allclose(fees, [100, 99.9, 99.8, 99.7])
