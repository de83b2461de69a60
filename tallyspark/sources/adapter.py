"""Retail-shaped raw view over the TPC-H-like driver tables.

The reference's own CSV is not available, so the raw table (eleven text
columns) is derived from lineitem x orders x part. Missingness is
an arithmetic hash of the keys, so it is reproducible in any SQL engine:
about 5 % of rows lack quantity and total, another 5 % lack price, all of
those lack item, a third lack the discount flag, and one row in ten carries
stray blanks around the category. Customer (the bootstrap cluster) is the
order's customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["lineitem", "orders", "part"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def retail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions, all columns text, in source order (snake_case names).

    Only the needed columns are read (pruned at the Parquet scan). The
    lineitem-orders join is the large one and shuffles on the order key
    (which also spreads the row-level parsing over the shuffle partitions);
    the part join is left to AQE, which broadcasts it only when its measured
    size is under the broadcast threshold.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")

    # lineitem x orders is fact-to-fact: at scale neither side fits a
    # broadcast, so it is planned as a sort-merge join on the order key.
    base = (li.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
              .join(part, F.col("l_partkey") == F.col("p_partkey")))

    qty = F.col("l_quantity").cast("int")
    price = F.col("p_retailprice").cast("decimal(12,2)")
    ep = (F.col("l_extendedprice").cast("decimal(12,2)") * 100).cast("bigint")
    k = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17
         + F.col("l_partkey") * 7 + F.col("l_suppkey")) % 100
    kd = (F.col("l_orderkey") * 3 + F.col("l_linenumber") + F.col("l_partkey")) % 3
    brand = F.col("p_brand")
    s = lambda c: c.cast("string")

    return base.select(
        F.concat_ws("-", s(F.col("l_orderkey")), s(F.col("l_linenumber")), s(F.col("l_partkey")),
                    s(F.col("l_suppkey")), s(qty), s(ep)).alias("transaction_id"),
        F.concat(F.lit("CUST_"), s(F.col("o_custkey"))).alias("customer_id"),
        F.when(k % 10 == 3, F.concat(F.lit("  "), brand, F.lit(" "))).otherwise(brand).alias("category"),
        F.when(k < 10, F.lit("")).otherwise(F.concat(F.lit("Item_"), s(F.col("l_partkey")))).alias("item"),
        F.when((k >= 5) & (k < 10), F.lit("")).otherwise(s(price)).alias("price_per_unit"),
        F.when(k < 5, F.lit("")).otherwise(s(qty)).alias("quantity"),
        F.when(k < 5, F.lit("")).otherwise(s(price * qty)).alias("total_spent"),
        F.when(F.col("l_returnflag") == "A", "Cash").when(F.col("l_returnflag") == "N", "Credit Card")
         .otherwise("Digital Wallet").alias("payment_method"),
        F.when(F.col("l_linestatus") == "F", "In-store").otherwise("Online").alias("location"),
        s(F.to_date(F.col("l_shipdate"))).alias("transaction_date"),
        F.when(kd == 0, F.lit("")).when(F.col("l_discount") > 0, "True").otherwise("False")
         .alias("discount_applied"),
    )


# DuckDB text of the same view, used by the SQL oracles.
RAW_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR),
                 CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS VARCHAR)) AS transaction_id,
       concat('CUST_', CAST(o_custkey AS VARCHAR)) AS customer_id,
       CASE WHEN ((l_orderkey*31 + l_linenumber*17 + l_partkey*7 + l_suppkey) % 100) % 10 = 3
            THEN concat('  ', p_brand, ' ') ELSE p_brand END AS category,
       CASE WHEN (l_orderkey*31 + l_linenumber*17 + l_partkey*7 + l_suppkey) % 100 < 10 THEN ''
            ELSE concat('Item_', CAST(l_partkey AS VARCHAR)) END AS item,
       CASE WHEN (l_orderkey*31 + l_linenumber*17 + l_partkey*7 + l_suppkey) % 100 BETWEEN 5 AND 9 THEN ''
            ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS price_per_unit,
       CASE WHEN (l_orderkey*31 + l_linenumber*17 + l_partkey*7 + l_suppkey) % 100 < 5 THEN ''
            ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS quantity,
       CASE WHEN (l_orderkey*31 + l_linenumber*17 + l_partkey*7 + l_suppkey) % 100 < 5 THEN ''
            ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(l_quantity AS INT) AS VARCHAR) END AS total_spent,
       CASE l_returnflag WHEN 'A' THEN 'Cash' WHEN 'N' THEN 'Credit Card' ELSE 'Digital Wallet' END AS payment_method,
       CASE l_linestatus WHEN 'F' THEN 'In-store' ELSE 'Online' END AS location,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS transaction_date,
       CASE WHEN (l_orderkey*3 + l_linenumber + l_partkey) % 3 = 0 THEN ''
            WHEN l_discount > 0 THEN 'True' ELSE 'False' END AS discount_applied
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN part ON l_partkey = p_partkey
"""
