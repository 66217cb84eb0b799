"""Inputs of the risk engine read from the driver's star-schema tables.

The engine wants prices, point-in-time fundamentals, a registry with classifications, and holdings. The mapping: events are
a dense price panel (user: security, mean value: close, count: volume), lineitem a long gappy one (supplier: security),
orders are fundamentals (customer: security, total: market cap), customer with nation and region is the registry, and
lineitem by supplier and part is holdings. Money is summed in whole cents, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ric, date, close, volume), dense and 30 days long."""
    rows = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("ric"), F.to_date("ts").alias("date"))
    return rows.agg((F.sum(cents("value")) / (F.lit(100.0) * F.count("*"))).alias("close"), F.count("*").alias("volume"))


def long_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ric, date, close, volume), seven years with gaps."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("ric"), F.to_date("l_shipdate").alias("date"))
    quantity = F.sum(F.col("l_quantity").cast("long"))
    return rows.agg((F.sum(cents("l_extendedprice")) / (F.lit(100.0) * quantity)).alias("close"), quantity.alias("volume"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ric, as_of_date, seq, market_cap, status, priority); seq breaks ties."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("ric"), F.to_date("o_orderdate").alias("as_of_date"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("market_cap"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ric, ticker, sector, country, scope, balance)."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").cast("string").alias("ric"), F.col("c_name").alias("ticker"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("country"), F.col("r_name").alias("scope"), F.col("c_acctbal").alias("balance"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, ric, quantity): returned items are short."""
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("account"), F.col("l_partkey").cast("string").alias("ric")).agg(F.sum(signed).alias("quantity"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ric, name, sector, price): what holdings are of."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ric"), F.col("p_name").alias("name"), F.col("p_brand").alias("sector"), F.col("p_retailprice").alias("price"))


#: The same inputs for SQL.
SQL = """WITH prices AS (SELECT cast(user_id AS VARCHAR) ric, cast(ts AS DATE) date, sum(cast(round(value*100) AS BIGINT)) / (1e2*count(*)) AS close, count(*) volume FROM events GROUP BY 1, 2),
long_prices AS (SELECT cast(l_suppkey AS VARCHAR) ric, cast(l_shipdate AS DATE) date, sum(cast(round(l_extendedprice*100) AS BIGINT)) / (1e2*sum(cast(l_quantity AS BIGINT))) AS close, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) volume FROM lineitem GROUP BY 1, 2),
fundamentals AS (SELECT cast(o_custkey AS VARCHAR) ric, cast(o_orderdate AS DATE) as_of_date, o_orderkey seq, o_totalprice market_cap, o_orderstatus status, o_orderpriority priority FROM orders),
registry AS (SELECT cast(c_custkey AS VARCHAR) ric, c_name ticker, c_mktsegment sector, n_name country, r_name scope, c_acctbal balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
holdings AS (SELECT cast(l_suppkey AS VARCHAR) account, cast(l_partkey AS VARCHAR) ric, cast(sum(CASE WHEN l_returnflag = 'R' THEN -cast(l_quantity AS BIGINT) ELSE cast(l_quantity AS BIGINT) END) AS BIGINT) quantity FROM lineitem GROUP BY 1, 2),
parts AS (SELECT cast(p_partkey AS VARCHAR) ric, p_name AS name, p_brand sector, p_retailprice price FROM part)
"""
