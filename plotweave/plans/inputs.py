"""The tables that the queries run on, in the roles the operators expect, and the same as SQL.

Keys are customers. Transactions are finished orders (a sale that isn't closed has no price), of which those of the lowest
priority are main sales and the others count as parking; units are all order lines, parent rows are first lines, parking is
a returned line. The layer is the customers, with balance for area and market segment for type. Points have whole-number
coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = "addr_key"
ROW_KEY = ["addr_key", "price", "purpose", "day"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS tx_id", "o_custkey AS addr_key", "o_totalprice AS price", "o_orderpriority AS purpose", "o_orderpriority <> '5-LOW' AS parking", "date_format(o_orderdate, 'yyyy-MM') AS day")


TX = "tx AS (SELECT o_orderkey AS tx_id, o_custkey AS addr_key, o_totalprice AS price, o_orderpriority AS purpose, o_orderpriority <> '5-LOW' AS parking, strftime(o_orderdate, '%Y-%m') AS day FROM orders WHERE o_orderstatus = 'F')"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey AS addr_key", "l_returnflag AS purpose", "l_returnflag = 'R' AS parking", "l_linenumber = 1 AS parent", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


UN = "un AS (SELECT o_custkey AS addr_key, l_returnflag AS purpose, l_returnflag = 'R' AS parking, l_linenumber = 1 AS parent, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS addr_key", "c_acctbal AS area", "c_mktsegment AS type", "c_nationkey AS nation")


GEO = "geo AS (SELECT c_custkey AS addr_key, c_acctbal AS area, c_mktsegment AS type, c_nationkey AS nation FROM customer)"

MEASURES = ("pc1", "pc2", "cc", "bc", "fk")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five values per key: means for accessibility, sums for intermediation. Sums are of whole numbers, so their order doesn't matter."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("addr_key"))
        .agg(
            F.avg(F.col("l_quantity")).alias("pc1"),
            F.sum(F.col("l_quantity")).cast("double").alias("pc2"),
            F.avg(F.round(F.col("l_discount") * 100).cast("long")).alias("cc"),
            F.sum(F.round(F.col("l_extendedprice")).cast("long")).cast("double").alias("bc"),
            F.avg(F.round(F.col("l_tax") * 100).cast("long")).alias("fk"),
        )
    )


ME = "me AS (SELECT o_custkey AS addr_key, avg(l_quantity) AS pc1, CAST(sum(l_quantity) AS DOUBLE) AS pc2, avg(CAST(round(l_discount * 100) AS BIGINT)) AS cc, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS DOUBLE) AS bc, avg(CAST(round(l_tax * 100) AS BIGINT)) AS fk FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)"

#: Whole-number coordinates from keys, exact in any engine.
X, Y = "CAST(addr_key * 7919 % 10007 AS DOUBLE)", "CAST(addr_key * 104729 % 10009 AS DOUBLE)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir).selectExpr("addr_key AS id", f"{X} AS x", f"{Y} AS y", "area", "type")


PT = f"pt AS (SELECT c_custkey AS id, {X.replace('addr_key', 'c_custkey')} AS x, {Y.replace('addr_key', 'c_custkey')} AS y, c_acctbal AS area, c_mktsegment AS type FROM customer)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short straight segments: one per supplier and part, with whole-number ends."""
    return read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().selectExpr(
        "concat_ws('-', l_suppkey, l_partkey) AS seg", "CAST((l_suppkey * 7919 + l_partkey * 31) % 10007 AS DOUBLE) AS x1", "CAST((l_suppkey * 104729 + l_partkey * 17) % 10009 AS DOUBLE) AS y1", "CAST((l_suppkey * 7919 + l_partkey * 31) % 10007 + l_partkey % 701 - 350 AS DOUBLE) AS x2", "CAST((l_suppkey * 104729 + l_partkey * 17) % 10009 + l_suppkey * 13 % 601 - 300 AS DOUBLE) AS y2", "CAST(l_partkey % 97 AS DOUBLE) AS mass"
    )


SG = "sg AS (SELECT concat_ws('-', l_suppkey, l_partkey) AS seg, CAST((l_suppkey * 7919 + l_partkey * 31) % 10007 AS DOUBLE) AS x1, CAST((l_suppkey * 104729 + l_partkey * 17) % 10009 AS DOUBLE) AS y1, CAST((l_suppkey * 7919 + l_partkey * 31) % 10007 + l_partkey % 701 - 350 AS DOUBLE) AS x2, CAST((l_suppkey * 104729 + l_partkey * 17) % 10009 + l_suppkey * 13 % 601 - 300 AS DOUBLE) AS y2, CAST(l_partkey % 97 AS DOUBLE) AS mass FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))"
