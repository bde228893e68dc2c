"""Tables the registered queries share: cells of nations by fiscal year, from orders and from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import fiscal_year

REGISTRY: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) as a query, with the SQL that gives the same rows."""

    def add(f):
        REGISTRY[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table in few files over all cores, ahead of work that is heavy for each row; a table of enough partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with entity (nation) and year (fiscal, ending in March)."""
    t = lambda n: table(spark, sf_dir, n)
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("entity"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumn("year", fiscal_year(F.col("o_orderdate"), 3))


def order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2).alias(f"total_{s.lower()}")
    return orders_by_nation(spark, sf_dir).groupBy("entity", "year").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), status("F"), status("O"), status("P"))


def item_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by entity and year: the second source of the same measures."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    # Price and quantity are summed for each order first: the join then has one row an order.
    per_order = items.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("g"), F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q"))
    joined = orders_by_nation(spark, sf_dir).select("o_orderkey", "entity", "year").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("entity", "year").agg(F.round(F.sum("g"), 2).alias("gross"), F.round(F.sum("p"), 2).alias("price"), F.round(F.sum("q"), 2).alias("quantity"))


WITH_ORDERS = """
WITH o AS (
  SELECT orders.*, n_name AS entity, CAST(CASE WHEN month(o_orderdate) > 3 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
y AS (
  SELECT entity, year, count(*) AS orders, round(sum(o_totalprice), 2) AS total,
    round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS total_f,
    round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS total_o,
    round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS total_p
  FROM o GROUP BY 1, 2),
c AS (
  SELECT entity, year, 'total' AS field_id, total AS value FROM y UNION ALL SELECT entity, year, 'total_f', total_f FROM y
  UNION ALL SELECT entity, year, 'total_o', total_o FROM y UNION ALL SELECT entity, year, 'total_p', total_p FROM y)
"""
WITH_ITEMS = WITH_ORDERS.rstrip() + """,
i AS (
  SELECT entity, year, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS gross, round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 2) AS quantity
  FROM o JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
"""
