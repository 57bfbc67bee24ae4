"""Exact sums of doubles: the same bits for any order and partitioning, rounded once.

A double is a whole number times a power of two. That number, shifted to one of the fixed multiples of BITS binary places
(a limb), is a decimal of at most 27 digits; decimals of a limb are added without rounding by Spark's own sum, with partial
sums in each task. What is left for a group is one whole number for each limb, at most 70 of them, which are put together
and rounded to the nearest double, ties to even. So large numbers that cancel leave what small ones add up to.

Nulls are passed over; a group of nulls alone is null. A NaN, or infinities of both signs, make NaN; one kind of
infinity makes itself; sums past the largest double are infinite. Up to 10^11 values of a group are sure to fit.
"""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BITS = 32
#: The smallest double is 2 to the power of -LOWEST.
LOWEST = 1074


def _shifted(x: Column, places: Column, left: bool = False) -> Column:
    return F.call_function("shiftleft" if left else "shiftright", x, places.cast("int"))


def _two_to(k: Column) -> Column:
    return F.pow(F.lit(2.0), k)


def whole(x: Column) -> tuple[Column, Column]:
    """The bigint m and the int p of a finite double: |x| = m * 2^p, m below 2^57.

    Two more places than a double has are taken, as a logarithm may be off by one near a power of two. Scaling is by two
    factors, so that neither overflows, and exact, as the scaled number is whole.
    """
    a = F.abs(x)
    up = F.least(F.lit(54) - F.floor(F.log2(a)).cast("int"), F.lit(LOWEST))
    half = F.floor(up / 2)
    return (a * _two_to(half) * _two_to(up - half)).cast("long"), -up


def ordinal(x: Column) -> Column:
    """A bigint that orders doubles as they are ordered; both zeros are 0."""
    m, p = whole(x)
    top = F.floor(F.log2(m.cast("double"))).cast("int")
    top = F.when(_shifted(m, top + 1) > 0, top + 1).when(_shifted(m, top) == 0, top - 1).otherwise(top)
    e = top + p  # the exponent of x
    fraction = F.when(top >= 52, _shifted(m, top - 52)).otherwise(_shifted(m, F.lit(52) - top, left=True))
    normal = F.shiftleft((e + 1022).cast("long"), 52) + fraction
    size = F.when(e < -1022, m).otherwise(normal)  # below the normal numbers p is -LOWEST
    return F.when(x == 0, F.lit(0).cast("long")).when(x < 0, -size).otherwise(size)


@F.pandas_udf(DoubleType())
def _rounded(limbs: pd.Series) -> pd.Series:
    def one(parts) -> float:
        total = sum(int(Decimal(p["total"])) << (BITS * p["limb"]) for p in parts if p["total"] is not None)
        try:
            return total / (1 << LOWEST)  # division of whole numbers rounds correctly
        except OverflowError:
            return math.inf if total > 0 else -math.inf

    return limbs.map(one)


def exact_sums(df: DataFrame, keys: tuple[str, ...], columns: dict[str, Column]) -> DataFrame:
    """keys and, for each named column, its exact sum; one row for each group, also for groups without a value."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("what"), c.cast("double").alias("x")) for n, c in columns.items())))
    d = df.select(*keys, each.alias("e")).select(*keys, "e.what", "e.x")
    x, inf = F.col("x"), float("inf")
    finite = ~F.isnan(x) & (F.abs(x) < inf) & (x != 0)
    m, p = whole(F.when(finite, x))
    place = p + LOWEST
    value = m.cast("decimal(20,0)") * _shifted(F.lit(1).cast("long"), F.pmod(place, F.lit(BITS)), left=True).cast("decimal(11,0)")
    d = d.select(
        *keys, "what", F.floor(place / BITS).cast("int").alias("limb"), F.when(x < 0, -value).otherwise(value).alias("value"),
        x.isNotNull().alias("known"), F.isnan(x).alias("nan"), (x == inf).alias("up"), (x == -inf).alias("down"),
    )
    flags = {n: F.max(n).alias(n) for n in ("known", "nan", "up", "down")}
    d = d.groupBy(*keys, "what", "limb").agg(F.sum("value").cast("string").alias("total"), *flags.values())
    d = d.groupBy(*keys, "what").agg(F.collect_list(F.when(F.col("limb").isNotNull(), F.struct("limb", "total"))).alias("limbs"), *flags.values())
    total = F.when(F.col("nan") | (F.col("up") & F.col("down")), F.lit(float("nan"))).when(F.col("up"), inf).when(F.col("down"), -inf).otherwise(F.col("sum"))
    d = d.withColumn("sum", _rounded("limbs")).withColumn("sum", F.when(F.col("known"), total))
    return d.groupBy(*keys).agg(*(F.max(F.when(F.col("what") == n, F.col("sum"))).alias(n) for n in columns))
