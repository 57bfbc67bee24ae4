"""Order statistics without sorting a group: radix selection by bucket counts.

Doubles are ordered as 64-bit numbers (``exact.ordinal``). Each of four rounds counts, for every group, the values by their
next 16 bits among those that share the bits found so far, with partial counts in each task, and picks the bucket that
holds the wanted rank. A window sees bucket counts only, at most 65,536 for a rank, never values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.exact import ordinal
from tallyspark.lineage import cut, small

DIGIT = 16


def select_ranks(values: DataFrame, ranks: DataFrame, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """keys, level, value: the value of ``rank`` (one-based, from the smallest) of each row of ``ranks`` (keys, level, rank).

    Ties count each. Null values are passed over; a rank beyond the group has no row.
    """
    d = cut(values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), ordinal(F.col(value)).alias("__o")))
    t = ranks.select(*keys, "level", F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("prefix"))
    for bits in range(64 - DIGIT, -1, -DIGIT):
        first = bits == 64 - DIGIT
        prefix = F.lit(0).cast("long") if first else F.shiftright("__o", bits + DIGIT)
        wanted = small(t.select(*keys, "prefix").distinct())
        counts = d.withColumn("prefix", prefix).join(wanted, [*keys, "prefix"], "left_semi")
        counts = counts.groupBy(*keys, "prefix", F.shiftright("__o", bits).alias("digit")).agg(F.count("*").alias("n"))
        up_to = Window.partitionBy(*keys, "level").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        met = t.join(counts, [*keys, "prefix"]).withColumn("up_to", F.sum("n").over(up_to))
        met = met.where((F.col("up_to") >= F.col("rank")) & (F.col("up_to") - F.col("n") < F.col("rank")))
        t = cut(met.select(*keys, "level", (F.col("rank") - F.col("up_to") + F.col("n")).alias("rank"), F.col("digit").alias("prefix")))
    out = d.join(small(t.select(*keys, "level", F.col("prefix").alias("__o"))), [*keys, "__o"])
    return out.groupBy(*keys, "level").agg(F.min("__v").alias(value))


def tail_by_counts(daily: DataFrame, confidences: tuple[str, ...], keys: tuple[str, ...], value: str) -> DataFrame:
    """keys, confidence, threshold, tail_mean, n_tail as ``reports.tail_risk`` gives them, for groups of any size."""
    d = cut(daily.select(*keys, F.col(value).alias("v")))
    n = d.groupBy(*keys).agg(F.count("v").alias("n"))
    at = F.ceil(F.col("level").cast("decimal(12,10)") * F.col("n"))  # from the largest
    ranks = n.withColumn("level", F.explode(F.array(*map(F.lit, confidences)))).withColumn("rank", F.col("n") - at + 1)
    t = select_ranks(d, ranks, keys).select(*keys, F.col("level").alias("confidence"), F.col("v").alias("threshold"))
    out = d.join(small(t), list(keys)).where("v <= threshold").groupBy("confidence", *keys)
    return out.agg(F.max("threshold").alias("threshold"), F.avg("v").alias("tail_mean"), F.count("*").alias("n_tail"))
