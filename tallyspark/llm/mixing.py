"""Mixing sources to target weights (4): a time-varying curriculum.

Every source gets a target number of words by water-filling: its weight's share of the budget, stopped
at ``max_epochs`` times its size, the excess reshared by weight. Over training time t in [0, 1] the source
is drawn at the rate ``target * (1 + slope * (2 t - 1))``; the integral of that rate is its cumulative
demand ``target * (t + slope * (t^2 - t))``. A source's documents stand in a fixed pseudo-random order (by
MD5 of the id, or of the text where that is null), repeated for each epoch; a document that starts after ``c`` words of its source is
assigned the time at which the demand reaches ``c``, by inverting that quadratic, and all documents are
range-sorted by position.

Running sums over a source take no single task: each source is cut into BUCKETS ranges of the order
key, whose totals are summed first, and the window inside a bucket sees only that bucket. The window
over sources sees one row for each source.

Edge cases: null text has size 0; a null source is a source of its own, ordered last; sources without
words have target 0; documents that are not taken have null positions; repeated rows count separately;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import NOT_SPACES, table, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Slopes of the sources' rate over training time in their order, repeating: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, share: float, weights=WEIGHTS, slopes=SLOPES, max_epochs: int = 2) -> DataFrame:
    """source, source_size, target, slope of each source, from rows of (source, size)."""
    one = Window.partitionBy(F.lit(0))
    pick = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), (F.col("rank") % len(values) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").isNull(), "source")) - 1)
    s = s.withColumn("weight", pick(weights, "double")).withColumn("slope", pick(slopes, "double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_cap = one.orderBy("full_at", "rank")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(one) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # levels rise until the first source that stays below its cap; that source's level holds for all later ones
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(one)["level"])
    s = s.withColumn("target", F.when(F.col("full_at") < F.col("level"), F.col("cap")).otherwise(F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "target", "slope")


def mix(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, slopes=SLOPES, max_epochs: int = 2, order_hex: int = 3) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, position, position_again; sorted by position.

    ``taken`` words of a document are used, repeats counted: whole copies, but for the one document at
    which a source's target is reached. ``position_again`` is the time of its last further copy.
    ``order_hex``: hexadecimal digits of the order key that make a bucket (3: 4,096 for each source).
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    d = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(NOT_SPACES)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
    )
    d = written(d.withColumn("bucket", F.substring("key", 1, order_hex)), "sizes")
    totals = d.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    plan = written(
        starts.join(
            source_targets(totals, share, weights, slopes, max_epochs).withColumnRenamed("source", "src"),
            F.col("source").eqNullSafe(F.col("src")),
        ).drop("src"),
        "plan",
    )
    plan = plan.select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), "ahead", "source_size", "target", "slope")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(plan, d["source"].eqNullSafe(plan["p_source"]) & (d["bucket"] == plan["p_bucket"]))
    goal, start, zero = F.floor("target"), F.col("ahead") + F.col("inside"), F.lit(0).cast("long")
    take = lambda k: F.greatest(zero, F.least(F.col("size"), goal - F.col("source_size") * k - start))

    def when(k):
        y = (F.col("source_size") * k + start) / goal
        t = 2 * y / ((1 - F.col("slope")) + F.sqrt((1 - F.col("slope")) * (1 - F.col("slope")) + 4 * F.col("slope") * y))
        return F.when(take(k) > 0, F.round(t, 9))

    taken, again = take(0), F.lit(None).cast("double")
    for k in range(1, max_epochs):
        taken, again = taken + take(k), F.coalesce(when(k), again)
    out = d.select(
        "doc_id", "size", "source", "source_size", "target", taken.alias("taken"), when(0).alias("position"),
        again.alias("position_again"), "key",
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "key", "doc_id").drop("key")


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), r AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS weight, CAST([-0.5, 0.0, 0.5][rank % 3 + 1] AS DOUBLE) AS slope,
         2.0::DOUBLE * source_size AS cap FROM r
), f AS (
  SELECT *, cap / weight AS full_at,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED
  PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), l AS (SELECT level FROM f WHERE level <= full_at ORDER BY full_at, rank LIMIT 1),
s AS (
  SELECT source, source_size, slope, CASE WHEN full_at < l.level THEN cap ELSE l.level * weight END AS target FROM f, l
), c AS (
  SELECT d.doc_id, d.size, d.source, s.source_size, s.target, s.slope, CAST(floor(s.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), t AS (
  SELECT *, greatest(0, least(size, goal - start)) AS first, greatest(0, least(size, goal - source_size - start)) AS second,
         start / goal::DOUBLE AS y, (source_size + start) / goal::DOUBLE AS z FROM c
)
SELECT doc_id, size, source, source_size, target, CAST(first + second AS BIGINT) AS taken,
       CASE WHEN first > 0 THEN round(2 * y / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * y)), 9) END AS
  position,
       CASE WHEN second > 0 THEN round(2 * z / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * z)), 9) END AS
  position_again
FROM t
"""
