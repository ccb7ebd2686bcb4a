"""Every query of the library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import more_queries, picture_queries, queries, run_queries, shape_queries, small_queries
from tessera.session import table


def feature_join_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer rows joined to prefixed order and line aggregates; missing values become 0."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    per_order = orders.groupBy("o_custkey").agg(
        F.count("*").alias("ORD_n"), F.round(F.sum("o_totalprice"), 2).alias("ORD_total")
    )
    per_line = (
        lines.join(orders.select("o_orderkey", "o_custkey"), lines.l_orderkey == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("l_quantity").alias("LINE_qty"), F.round(F.sum("l_extendedprice"), 2).alias("LINE_price"))
        .withColumnRenamed("o_custkey", "line_custkey")
    )
    return (
        customer.join(per_order, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(per_line, F.col("c_custkey") == F.col("line_custkey"), "left")
        .select("c_custkey", "c_nationkey", "c_acctbal", "ORD_n", "ORD_total", "LINE_qty", "LINE_price")
        .fillna(0)
        .orderBy("c_custkey")
    )


QUERIES = {"feature_join_impute": feature_join_impute, **queries.QUERIES, **picture_queries.QUERIES, **run_queries.QUERIES, **more_queries.QUERIES, **small_queries.QUERIES, **shape_queries.QUERIES}

ORACLES = {
    **queries.ORACLES,
    **picture_queries.ORACLES,
    **run_queries.ORACLES,
    **shape_queries.ORACLES,
    **more_queries.ORACLES,
    **small_queries.ORACLES,
    "feature_join_impute": """
        SELECT c_custkey, c_nationkey, c_acctbal,
               coalesce(o.n, 0)::BIGINT AS "ORD_n", coalesce(o.total, 0)::DOUBLE AS "ORD_total",
               coalesce(l.qty, 0)::DOUBLE AS "LINE_qty", coalesce(l.price, 0)::DOUBLE AS "LINE_price"
        FROM customer
        LEFT JOIN (SELECT o_custkey, count(*) n, round(sum(o_totalprice), 2) total FROM orders GROUP BY 1) o
               ON o.o_custkey = c_custkey
        LEFT JOIN (SELECT o_custkey, sum(l_quantity) qty, round(sum(l_extendedprice), 2) price
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey
        ORDER BY c_custkey""",
}
