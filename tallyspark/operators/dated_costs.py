"""Cost parameters by decision date: each execution is bound to the parameters of exactly its decision, if they could be known then."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.lineage import small


def binding_problems(executions: DataFrame, models: DataFrame, sessions: DataFrame) -> DataFrame:
    """decision, asset, rule of what keeps executions from being bound.

    ``executions``: session, decision, asset; ``models``: decision, asset, daily_volatility, dollar_adv, sample_start, sample_end, available_at; ``sessions``:
    session, close_at. Decisions of executions and models must be the same set; every asset of a decision needs its parameters,
    once, and sound ones; a sample lies on sessions strictly before its decision, and is available between the close
    of its last session and that of the decision.
    """
    e, m = executions.select("session", "decision", "asset"), models
    wanted, given = e.where("decision is not null").select("decision").distinct(), m.select("decision").distinct()
    k = small(sessions.select("session", "close_at"))
    at = lambda d, c, name: d.join(k.select(F.col("session").alias(c), F.col("close_at").alias(name)), c, "left")
    dated = at(at(at(m.join(wanted, "decision", "left_semi"), "sample_start", "start_close"), "sample_end", "end_close"), "decision", "decision_close")
    rule = lambda d, name: d.select("decision", "asset", F.lit(name).alias("rule"))
    alone = F.lit(None).cast("string").alias("asset")
    parts = [
        rule(e.where("decision is null").select("decision", "asset").distinct(), "execution_without_decision"),
        rule(wanted.join(given, "decision", "left_anti").select("decision", alone), "decision_without_model"),
        rule(given.join(wanted, "decision", "left_anti").select("decision", alone), "model_without_decision"),
        rule(e.join(given, "decision", "left_semi").select("decision", "asset").distinct().join(m, ["decision", "asset"], "left_anti"), "asset_without_parameters"),
        rule(m.groupBy("decision", "asset").count().where("count > 1"), "repeated_parameters"),
        rule(m.where("daily_volatility is null or daily_volatility < 0 or dollar_adv is null or dollar_adv <= 0"), "unusable_parameters"),
        rule(dated.where("start_close is null or end_close is null"), "sample_off_sessions"),
        rule(dated.where("sample_end < sample_start"), "sample_reversed"),
        rule(dated.where("sample_end >= decision"), "sample_not_before_decision"),
        rule(dated.where("decision_close is null"), "decision_off_sessions"),
        rule(dated.where("available_at is null or available_at < end_close"), "available_before_sample_ends"),
        rule(dated.where("available_at > decision_close"), "available_after_decision"),
    ]
    return reduce(DataFrame.unionByName, parts)


def bound_costs(executions: DataFrame, models: DataFrame, sessions: DataFrame) -> DataFrame:
    """``executions`` (session, decision, asset and whatever else) with the parameters of their decision; ValueError where a rule is broken."""
    if bad := binding_problems(executions, models, sessions).orderBy("decision", "asset", "rule").limit(5).collect():
        raise ValueError(f"cost models do not bind, first offenders {[tuple(map(str, r)) for r in bad]}")
    return executions.join(models.select("decision", "asset", "daily_volatility", "dollar_adv", "sample_start", "sample_end", "available_at"), ["decision", "asset"])


def dated_impact(bound: DataFrame, commission_bps: float, half_spread_bps: float, coefficient: float) -> DataFrame:
    """``bound`` (with signed_notional) with commission, half_spread, impact (square-root law) and total_cost of each execution."""
    q = F.abs("signed_notional")
    d = bound.withColumn("commission", q * (commission_bps / 1e4)).withColumn("half_spread", q * (half_spread_bps / 1e4))
    d = d.withColumn("impact", q * coefficient * F.col("daily_volatility") * F.sqrt(q / F.col("dollar_adv")))
    return d.withColumn("total_cost", F.col("commission") + F.col("half_spread") + F.col("impact"))
