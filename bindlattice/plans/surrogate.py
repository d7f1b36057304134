"""Sites from star-schema tables: parts are rows, the 25 nations are the panel of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str, row: str = "l_partkey") -> DataFrame:
    """row_id, col_id, dg, kd, bridge, seed_type (with nulls and seedless), position."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    seed_type = F.when(F.col("l_returnflag") == "R", None).when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "seedless").otherwise(F.col("l_returnflag"))
    return joined.select(
        F.col(row).alias("row_id"), F.col("n_name").alias("col_id"), (-F.col("l_extendedprice") / 997).alias("dg"), F.col("l_quantity").alias("kd"),
        F.col("l_linenumber").alias("bridge"), seed_type.alias("seed_type"), F.col("l_orderkey").alias("position"),
    )


SITES = """sites AS (
  SELECT l_partkey AS row_id, n_name AS col_id, -l_extendedprice / 997 AS dg, l_quantity AS kd, l_linenumber AS bridge, l_orderkey AS position,
    CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'seedless' ELSE l_returnflag END AS seed_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
PAIRS = SITES + """, pairs AS (
  SELECT row_id, col_id, avg(abs(dg)) AS w FROM sites WHERE seed_type IS DISTINCT FROM 'seedless' GROUP BY row_id, col_id
)"""
GRID = PAIRS + """, grid AS (
  SELECT r.row_id, c.col_id, coalesce(p.w, 0.0) AS w FROM (SELECT DISTINCT row_id FROM pairs) r CROSS JOIN (SELECT DISTINCT col_id FROM pairs) c
  LEFT JOIN pairs p ON p.row_id = r.row_id AND p.col_id = c.col_id
)"""
RESIDUAL = GRID + """, above AS (
  SELECT row_id, col_id, greatest(0.0, w - avg(w) OVER (PARTITION BY col_id)) AS a FROM grid
), residual AS (SELECT row_id, col_id, CASE WHEN a = 0 THEN 1e-6 ELSE a END AS v FROM above)"""
