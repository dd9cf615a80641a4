"""General queries over the star schema. They show that joins, sets and windows of any kind run; Spark has them built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table


def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return items.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("rows"))


def nation_cube(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 2).alias("balance"))


def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


def top_orders_by_segment(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    best = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return joined.withColumn("n", F.row_number().over(best)).where("n <= 5").select("c_mktsegment", "o_orderkey", "o_totalprice", "n")


def supplier_or_customer_nations(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")), table(spark, d, "customer").select(F.col("c_nationkey").alias("key"))
    both, only = s.intersect(c).withColumn("kind", F.lit("both")), c.exceptAll(s).distinct().join(s, "key", "left_anti").withColumn("kind", F.lit("customer"))
    return both.unionByName(only)


def order_quartiles(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    tiled = table(spark, d, "orders").select("o_orderpriority", "o_totalprice", F.ntile(4).over(own).alias("quartile"))
    return tiled.groupBy("o_orderpriority", "quartile").agg(F.count("*").alias("orders"), F.round(F.max("o_totalprice"), 2).alias("most"))


def region_revenue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


QUERIES = {f.__name__: f for f in (revenue_rollup, nation_cube, customers_without_orders, top_orders_by_segment, supplier_or_customer_nations, order_quartiles, region_revenue)}
SQL = {
    "revenue_rollup": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS rows FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "nation_cube": "SELECT n_regionkey, c_mktsegment, count(*) AS customers, round(avg(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "top_orders_by_segment": "SELECT c_mktsegment, o_orderkey, o_totalprice, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey) WHERE n <= 5",
    "supplier_or_customer_nations": "SELECT DISTINCT c_nationkey AS key, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'both' ELSE 'customer' END AS kind FROM customer",
    "order_quartiles": "SELECT o_orderpriority, CAST(quartile AS INTEGER) AS quartile, count(*) AS orders, round(max(o_totalprice), 2) AS most FROM (SELECT *, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS quartile FROM orders) GROUP BY 1, 2",
    "region_revenue": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}
