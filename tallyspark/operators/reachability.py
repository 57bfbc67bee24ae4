"""Assets that a portfolio can come to hold: the closure over action legs and warrants, as semi-naive rounds of joins.

Runs are closed side by side: a row stands for an asset and up to 64 runs, one bit each, so an edge is met once for all
runs that reach it in the same round. A round follows only the bits that the round before has added, and one aggregate
merges what it finds with what is known, so cycles end. There are as many rounds as the longest shortest path has steps.
Each round is cut from its lineage.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.lineage import cut, small

#: The bit of a run among those of its block, and whether ``marks`` has it.
BIT = "shiftleft(1L, bit)"
MARKED = f"(marks & {BIT}) <> 0"


class Closure(NamedTuple):
    """``runs``: run, block, bit. ``reached``: block, asset, marks, a bit for each run of the block that reaches the asset.

    ``rounds``: block, asset, depth, marks, the same by the round in which a bit was set.
    """

    runs: DataFrame
    reached: DataFrame
    rounds: DataFrame


def holding_edges(actions: DataFrame, legs: DataFrame, warrants: DataFrame | None = None) -> DataFrame:
    """source, target: whoever holds the source may come to hold the target, by a security leg or by exercise."""
    e = actions.select("action_id", F.col("source_asset").alias("source")).join(
        legs.where("leg_type = 'security'").select("action_id", F.col("asset").alias("target")), "action_id"
    ).select("source", "target")
    if warrants is not None:
        e = e.unionByName(warrants.select(F.col("asset").alias("source"), F.col("underlying_asset").alias("target")))
    return e.where("source is not null and target is not null").distinct()


def numbered_runs(runs: DataFrame) -> DataFrame:
    """run, block, bit: places of the distinct runs, the same for any partitioning. A block has about 48 runs, 64 at most."""
    runs = runs.select("run").distinct()
    n = runs.count() // 48 + 1
    lot = F.pmod(F.xxhash64("run"), F.lit(n))
    out = runs.withColumn("lot", lot).withColumn("place", F.row_number().over(Window.partitionBy("lot").orderBy("run")) - 1)
    return cut(out.select("run", F.expr(f"lot + {n}L * (place div 64)").alias("block"), F.expr("place % 64").alias("bit")))


def _any(marks: str) -> Column:
    return F.bit_or(F.expr(marks)).alias("marks")


def closure(edges: DataFrame, starts: DataFrame) -> Closure:
    """What the start sets (run, asset) reach, and in how many steps at least, with a bit for each run.

    The start set itself has depth 0, whether or not it has edges. Repeated starts and edges count once.
    """
    edges = cut(edges.select("source", "target").distinct())
    runs = numbered_runs(starts)
    at = starts.select(F.col("run").alias("of"), "asset").join(small(runs), F.col("of").eqNullSafe(F.col("run")))
    known = cut(at.groupBy("block", "asset").agg(_any(BIT)).withColumn("fresh", F.col("marks")))
    rounds, none = [], F.lit(0).cast("long")
    while not (fresh := known.where("fresh <> 0")).isEmpty() or not rounds:
        rounds.append(fresh.select("block", "asset", F.lit(len(rounds)).alias("depth"), F.col("fresh").alias("marks")))
        found = fresh.join(edges, F.col("asset") == F.col("source")).select("block", F.col("target").alias("asset"), none.alias("marks"), "fresh")
        both = found.unionByName(known.withColumn("fresh", none)).groupBy("block", "asset").agg(_any("marks"), F.bit_or("fresh").alias("met"))
        known = cut(both.selectExpr("block", "asset", "marks | met AS marks", "met & ~marks AS fresh"))
    return Closure(runs, known.drop("fresh"), reduce(DataFrame.unionByName, rounds))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """run, asset, depth: every asset that a run's start set (run, asset) reaches, and in how many steps at least."""
    c = closure(edges, starts)
    return c.rounds.join(small(c.runs), "block").where(MARKED).select("run", "asset", "depth")


def effective_actions(reach: DataFrame, actions: DataFrame, spans: DataFrame) -> DataFrame:
    """run, action_id, effective_date: actions of reachable sources that take effect after a run's entry, up to its end."""
    a = actions.select("action_id", F.col("source_asset").alias("asset"), "effective_date")
    d = reach.join(a, "asset").join(F.broadcast(spans.select("run", "entry", "end")), "run")  # one row for each run
    return d.where((F.col("effective_date") > F.col("entry")) & (F.col("effective_date") <= F.col("end"))).select("run", "action_id", "effective_date")


def effective_summary(c: Closure, actions: DataFrame, spans: DataFrame) -> DataFrame:
    """run, n_actions, first_effective, last_effective of ``effective_actions``, without a row for each run and action.

    The runs in which a date is effective are bits too: the actions of an asset meet its runs in one row. Runs without
    such actions have no row. Dates times runs are met once, so this is for runs of a study, not for millions of them.
    """
    place = c.runs.join(spans.select(F.col("run").alias("of"), "entry", "end"), F.col("of") == F.col("run"))
    a = actions.select("action_id", F.col("source_asset").alias("asset"), "effective_date")
    days = a.select("effective_date").distinct().join(small(place), (F.col("effective_date") > F.col("entry")) & (F.col("effective_date") <= F.col("end")))
    live = small(cut(days.groupBy("block", "effective_date").agg(F.bit_or(F.expr(BIT)).alias("live"))))
    a = a.join(small(live.select("effective_date").distinct()), "effective_date", "left_semi")
    hits = c.reached.join(a, "asset").join(live, ["block", "effective_date"])
    hits = cut(hits.selectExpr("block", "action_id", "effective_date", "marks & live AS marks").where("marks <> 0"))
    each = hits.groupBy("block", "action_id").agg(_any("marks")).groupBy("block", "marks").agg(F.count("action_id").alias("n"))
    dates = hits.groupBy("block", "effective_date").agg(_any("marks"))
    by_run = lambda df: df.join(small(c.runs), "block").where(MARKED).groupBy("block", "bit", "run")
    counted, dated = by_run(each).agg(F.sum("n").alias("n_actions")), by_run(dates).agg(F.min("effective_date").alias("first_effective"), F.max("effective_date").alias("last_effective"))
    return counted.join(dated.drop("run"), ["block", "bit"]).select("run", "n_actions", "first_effective", "last_effective")


def short_successors(shorts: DataFrame, effective: DataFrame, actions: DataFrame, legs: DataFrame) -> DataFrame:
    """run, asset, depth: shorts (run, asset) and what they come to owe, by the legs of the actions effective in their run.

    An edge holds in the runs that have its action, so (run, asset) pairs are the nodes here.
    """
    live = effective.select("run", "action_id").distinct().join(actions.select("action_id", F.col("source_asset").alias("source")), "action_id")
    live = live.join(legs.where("leg_type = 'security'").select("action_id", F.col("asset").alias("target")), "action_id").where("target is not null")
    pair = lambda c: F.struct("run", F.col(c).alias("asset"))
    out = reachable(live.select(pair("source").alias("source"), pair("target").alias("target")), shorts.select("run", pair("asset").alias("asset")))
    return out.select("run", F.col("asset.asset").alias("asset"), "depth")
