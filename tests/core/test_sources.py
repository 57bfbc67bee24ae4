"""Snapshots, results with an identity, provider charts and the chart data source."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyspark.contracts import ContractError
from tallyspark.sources import chart_source, provider, snapshots

DAY = lambda k: dt.date(2024, 1, 8) + dt.timedelta(days=k)


def test_saving_reads_once_and_cleans_up(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 0.5).alias("x")).repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    slow = df.mapInArrow(counted, df.schema)
    made = snapshots.save_snapshot({"t": slow, "empty": df.limit(0)}, {"a": 1}, f"file://{tmp_path}/s")
    assert seen.value == 100  # one pass
    tables, metadata = snapshots.load_snapshot(spark, f"file://{tmp_path}/s")
    assert metadata == {"a": 1} and tables["t"].count() == 100 and len(made) == 64
    assert {tuple(r) for r in snapshots.observed_rows(spark, f"file://{tmp_path}/s").collect()} == {("t", 100), ("empty", 0)}
    assert snapshots.save_snapshot({"t": df.orderBy(F.desc("id")), "empty": df.limit(0)}, {"a": 1}, f"file://{tmp_path}/again") == made
    with pytest.raises(ContractError, match="exists"):
        snapshots.save_snapshot({"t": df}, {}, f"file://{tmp_path}/s")
    bad = df.withColumn("x", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        snapshots.save_snapshot({"t": df, "bad": bad}, {}, f"file://{tmp_path}/half")
    assert not os.path.exists(tmp_path / "half") and os.path.exists(tmp_path / "s" / "t")


def test_results_carry_their_identity(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    parent = snapshots.identified({"t": df}, {"unit": "USD"})
    child = snapshots.identified({"t": df.where("k = 1")}, {}, parent)
    assert snapshots.checked(child, parent) is child and snapshots.checked(parent) is parent
    assert snapshots.identified({"t": df.repartition(2)}, {"unit": "USD"}).snapshot_id == parent.snapshot_id
    other = snapshots.identified({"t": df}, {"unit": "EUR"})
    with pytest.raises(ContractError, match="other inputs"):
        snapshots.checked(child, other)
    with pytest.raises(ContractError, match="changed"):
        snapshots.checked(snapshots.Identified({"t": df.where("k = 2")}, parent.metadata, parent.snapshot_id))
    with pytest.raises(ContractError, match="changed"):
        snapshots.checked(snapshots.Identified(parent.tables, {"unit": "EUR"}, parent.snapshot_id))
    with pytest.raises(ContractError, match="identity is needed"):
        snapshots.checked({"t": df})


def chart(symbol, closes, splits=None, dividends=None, zone="America/New_York", volume=None):
    at = lambda k: int(dt.datetime(2024, 1, 8 + k, 21, tzinfo=dt.UTC).timestamp())
    return {
        "meta": {"symbol": symbol, "exchangeTimezoneName": zone}, "timestamp": [at(k) for k, _ in closes],
        "indicators": {"quote": [{"close": [c for _, c in closes], "volume": volume or [100] * len(closes)}], "adjclose": [{"adjclose": [c for _, c in closes]}]},
        "events": {"splits": {str(at(k)): {"date": at(k), "numerator": a, "denominator": b} for k, (a, b) in (splits or {}).items()}, "dividends": {str(at(k)): {"date": at(k), "amount": a} for k, a in (dividends or {}).items()}},
    }


def test_charts_events_factors_and_volumes(spark):
    bodies = [chart("A", [(0, 5.0), (1, 5.5), (2, 6.0), (3, 3.5)], {2: (2, 1), 3: (3, 1)}, {1: 0.25}), chart("B", [(0, 1.0), (1, None), (1, 2.0), (2, -1.0), (3, 4.0)], volume=[1, 2, 3, None, -5]), chart("T", [(0, 9.0)], zone="Asia/Tokyo")]
    responses = spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    bars, events = provider.chart_bars(responses), provider.chart_events(responses)
    assert {r.session for r in bars.where("symbol = 'T'").collect()} == {DAY(1)}  # the evening there is the next day
    assert provider.chart_bars(responses, first=str(DAY(1)), last=str(DAY(2))).where("symbol = 'A'").count() == 2
    assert {tuple(r) for r in events.collect()} == {("A", DAY(2), "split", 2.0), ("A", DAY(3), "split", 3.0), ("A", DAY(1), "dividend", 0.25)}
    problems = {(r.session, r.problem) for r in provider.bar_problems(bars.where("symbol = 'B'")).collect()}
    assert problems == {(DAY(1), "repeated_session"), (DAY(1), "missing_close"), (DAY(2), "bad_close"), (DAY(2), "missing_volume"), (DAY(3), "bad_volume")}
    splits = spark.createDataFrame([("A", DAY(2), 2.0), ("A", DAY(3), 3.0)], "asset string, effective_session date, ratio double")
    a = bars.where("symbol = 'A'")
    factors = provider.split_factors(a, splits)
    assert [r.factor for r in factors.orderBy("session").collect()] == [6.0, 6.0, 3.0, 1.0]
    for basis, want in (("raw", [(30.0, 100.0), (33.0, 100.0), (18.0, 100.0), (3.5, 100.0)]), ("split_adjusted", [(30.0, 100 / 6), (33.0, 100 / 6), (18.0, 100 / 3), (3.5, 100.0)]), ("unknown", [(30.0, None), (33.0, None), (18.0, None), (3.5, None)])):
        assert [(r.close, r.share_volume) for r in provider.raw_bars(a, factors, basis).orderBy("session").collect()] == want
    with pytest.raises(ValueError, match="volume_basis"):
        provider.raw_bars(a, factors, "guess")
    with pytest.raises(ValueError, match="one positive factor"):
        provider.raw_bars(a, factors.where(F.col("factor") > 2), "raw")
    given = factors.withColumn("factor", F.when(F.col("session") == F.lit(DAY(0)), 5.0).when(F.col("session") == F.lit(DAY(1)), -1.0).otherwise(F.col("factor"))).where(F.col("session") != F.lit(DAY(2)))
    given = given.unionByName(spark.createDataFrame([("A", DAY(9), 1.0)], "symbol string, session date, factor double"))
    assert {(r.session, r.problem) for r in provider.factor_problems(given, a, splits).collect()} == {(DAY(0), "differs"), (DAY(1), "bad_factor"), (DAY(2), "missing"), (DAY(9), "unexpected")}
    dividends = spark.createDataFrame([("A", DAY(1), 0.1), ("A", DAY(1), 0.15), ("A", DAY(2), 1.0)], "asset string, ex_session date, cash_per_share double")
    off = splits.withColumn("ratio", F.col("ratio") + (F.col("effective_session") == F.lit(DAY(3))).cast("int"))
    assert {(r.session, r.kind, r.problem) for r in provider.event_problems(events, off, dividends).collect()} == {(DAY(3), "split", "value_differs"), (DAY(2), "dividend", "not_at_provider")}


def test_chart_source_retries_within_bounds(spark, tmp_path):
    body = chart("A", [(0, 5.0), (1, 5.5)])
    answers = {"fine": [[200, body]], "busy": [[429, ""], [503, ""], [200, body]], "down": [[500, ""]], "lost": [None, [200, body]], "gone": [[404, ""], [200, body]]}
    for name, a in answers.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(a))
    spark.dataSource.register(chart_source.ChartSource)
    read = spark.read.format("provider_chart").options(assets=",".join(answers), first="2024-01-08", last="2024-01-17", window_days="5", folder=str(tmp_path), backoff_seconds="0.01", transport="tallyspark.sources.chart_source:replay")
    df = read.load()
    assert df.rdd.getNumPartitions() == 10
    got = {r.asset: (r.status, r.http_status, r.attempts, round(r.waited, 3), r.error) for r in df.where(F.col("first") == "2024-01-08").collect()}
    assert got == {
        "fine": ("ok", 200, 1, 0.0, None), "busy": ("ok", 200, 3, 0.03, None), "down": ("failed", 500, 3, 0.03, "http status 500"), "lost": ("ok", 200, 2, 0.01, None), "gone": ("failed", 404, 1, 0.0, "http status 404"),
    }
    bars = provider.chart_bars(df.where("status = 'ok' and asset = 'busy'"))
    assert {(r.symbol, r.session, r.close) for r in bars.collect()} == {("A", DAY(0), 5.0), ("A", DAY(1), 5.5)}
    assert chart_source.windows(DAY(0), DAY(9), 4) == [(DAY(0), DAY(3)), (DAY(4), DAY(7)), (DAY(8), DAY(9))]
    for options, said in (({"assets": "a,a"}, "different"), ({"assets": "a", "max_attempts": "0"}, "max_attempts")):
        with pytest.raises(ValueError, match=said):
            chart_source.ChartReader(options)
    with pytest.raises(ValueError, match="first must not"):
        chart_source.windows(DAY(1), DAY(0), 3)
