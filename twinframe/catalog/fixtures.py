"""Input tables of the catalog, once as DataFrames and once as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.hashing import rnd

ORDER_NUM = ["o_totalprice", "c_acctbal"]
ORDER_CAT = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
ORDER_COLS = ORDER_NUM + ORDER_CAT
PART_NUM = ["p_size", "p_retailprice"]
PART_CAT = ["p_brand", "p_type"]
PART_COLS = PART_NUM + PART_CAT


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer: two numbers, three categories, a unique key."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), *ORDER_COLS
    )


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_size").cast("long").alias("p_size"), "p_retailprice", *PART_CAT
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"),
        "c_acctbal",
        F.col("c_nationkey").cast("long").alias("c_nationkey"),
        "c_mktsegment",
    )


def pair(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The real and the synthetic half of a table, by hash of the row id."""
    side = rnd("pair", F.col("row_id"))
    return df.where(side < 0.5), df.where(side >= 0.5)


def with_nulls(df: DataFrame) -> DataFrame:
    """About a tenth of the cells of every column set to null, by hash."""
    return df.select(
        "row_id", *[F.when(rnd(c, F.col("row_id")) >= 0.1, F.col(c)).alias(c) for c in df.columns if c != "row_id"]
    )


def with_duplicates(df: DataFrame) -> DataFrame:
    """Adds second copies of about a twentieth of the rows, under new ids."""
    copies = df.where(rnd("dup", F.col("row_id")) < 0.05).withColumn("row_id", -F.col("row_id") - 1)
    return df.unionByName(copies)


def with_unseen(df: DataFrame, column: str, value: str) -> DataFrame:
    """One category renamed to a value the other side does not have."""
    return df.withColumn(column, F.when(F.col(column) == value, F.lit("UNSEEN")).otherwise(F.col(column)))


# The same tables in SQL.


def sql_rnd(seed: str, *ids: str) -> str:
    text = "'" + seed + "'" + "".join(f" || '|' || CAST({i} AS VARCHAR)" for i in ids)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


ORDER_FACTS = (
    "order_facts AS (SELECT o_orderkey AS row_id, o_totalprice, c_acctbal, o_orderstatus, o_orderpriority, "
    "c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"
)
PARTS = (
    "parts AS (SELECT p_partkey AS row_id, CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_brand, p_type FROM part)"
)
CUSTOMERS = (
    "customers AS (SELECT c_custkey AS row_id, c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
    "c_mktsegment FROM customer)"
)


def sql_pair(source: str) -> str:
    side = sql_rnd("pair", "row_id")
    return (
        f"real AS (SELECT * FROM {source} WHERE {side} < 0.5), "
        f"syn AS (SELECT * FROM {source} WHERE {side} >= 0.5)"
    )


def sql_nulls(source: str, columns: list[str], name: str = "holes") -> str:
    cells = ", ".join(f"CASE WHEN {sql_rnd(c, 'row_id')} >= 0.1 THEN {c} END AS {c}" for c in columns)
    return f"{name} AS (SELECT row_id, {cells} FROM {source})"


def sql_duplicates(source: str, columns: list[str], name: str = "doubled") -> str:
    cols = ", ".join(columns)
    return (
        f"{name} AS (SELECT row_id, {cols} FROM {source} UNION ALL "
        f"SELECT -row_id - 1, {cols} FROM {source} WHERE {sql_rnd('dup', 'row_id')} < 0.05)"
    )


def sql_unseen(source: str, columns: list[str], column: str, value: str, name: str) -> str:
    cells = ", ".join(f"CASE WHEN {c} = '{value}' THEN 'UNSEEN' ELSE {c} END AS {c}" if c == column else c for c in columns)
    return f"{name} AS (SELECT row_id, {cells} FROM {source})"


def sql_union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
