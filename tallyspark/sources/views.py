"""Market views of the driver's tables, and deterministic corporate actions, rates and aliases for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, asset, close, dollar_volume: daily mean and sum of each event type's values (a complete panel)."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("session"), F.col("event_type").alias("asset"), "value")
    return e.groupBy("session", "asset").agg(
        (_money("value") / F.count("*").cast("double")).alias("close"), _money("value").alias("dollar_volume"),
    )


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order value of each priority; has gaps at small scale."""
    x = table(spark, sf_dir, "orders").select(
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("session"), F.col("o_orderpriority").alias("asset"),
        "o_totalprice",
    )
    return x.groupBy("session", "asset").agg((_money("o_totalprice") / F.count("*").cast("double")).alias("close"))


def brands_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean unit price of each brand: a wide cross-section."""
    x = table(spark, sf_dir, "lineitem").select(
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("session"), "l_partkey", "l_extendedprice", "l_quantity",
    )
    x = x.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset")), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("session", "asset").agg((_money("l_extendedprice") / _money("l_quantity")).alias("close"))


def numbered(panel: DataFrame) -> DataFrame:
    """``panel`` with ``n``, the one-based number of the session within its asset."""
    return panel.withColumn("n", F.row_number().over(Window.partitionBy("asset").orderBy("session")))


def panel_splits(panel: DataFrame) -> DataFrame:
    """A 2:1 split of every asset at each eleventh session."""
    return numbered(panel).where("n % 11 = 0").select("asset", F.col("session").alias("effective_session"), F.lit(2.0).alias("ratio"))


def panel_dividends(panel: DataFrame) -> DataFrame:
    """Two dividends of every asset at each seventh session, paid two days later."""
    d = numbered(panel).where("n % 7 = 0").select(
        "asset", F.col("session").alias("ex_session"), F.date_add("session", 2).alias("pay_date"),
        F.explode(F.array(F.lit(0.25), F.lit(0.5))).alias("cash_per_share"),
    )
    return d


#: The same views in SQL, as common table expressions v1, v3, v4 and n1.
SQL = """
v1 AS (
  SELECT CAST(ts AS DATE) AS session, event_type AS asset, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS
  DOUBLE) AS close,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS dollar_volume FROM events GROUP BY 1, 2
), v3 AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS session, o_orderpriority AS asset, CAST(sum(CAST(o_totalprice AS
  DECIMAL(18,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS close FROM orders GROUP BY 1, 2
), v4 AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS session, p_brand AS asset,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS
  close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), n1 AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY session) AS n FROM v1),
r1 AS (SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY session) - 1 AS r, lag(session) OVER (PARTITION BY asset
  ORDER BY session) AS period_start FROM v1),
p1 AS (SELECT session, min(period_start) AS period_start, avg(r) AS r FROM r1 WHERE r IS NOT NULL GROUP BY session)
"""
