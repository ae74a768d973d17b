"""Offers and store products from the driver's star schema, for the core's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import haystack, words
from ..operators import matching
from ..session import table


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer for each line item: sku, name, brand, supplier, price, qty, currency, description, date."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    currency = F.when(F.col("s_nationkey") % 3 == 0, "UAH").when(F.col("s_nationkey") % 3 == 1, "USD").otherwise("EUR")
    return rows.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("s_name").alias("supplier"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("bigint").alias("qty"), currency.alias("currency"), F.col("p_type").alias("description"), F.col("l_shipdate").cast("date").alias("date"),
    )


def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest offer of each supplier and sku."""
    return offers(spark, sf_dir).groupBy("supplier", "sku", "name", "description").agg(F.min("price").alias("price"))


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = price_list(spark, sf_dir)
    return rows.select("supplier", "sku", "name", "price", haystack("sku", "name", "description", none).alias("haystack"), words("sku", "name", "description").alias("tokens"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store products: store_id, sku, name, price, tags, tokens."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("store_id"), F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("sku"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.array(F.lower("p_type")).alias("tags"))
    return matching.token_sets(rows, matching.default_tokens("name", "sku", "tags"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier offers to match with the store: supplier, sku, name, price, tokens."""
    return matching.token_sets(price_list(spark, sf_dir), matching.default_tokens("name", "sku"))


#: The same in SQL; each query's text begins with it.
OFFERS_SQL = """
WITH offers AS (
    SELECT l_orderkey, l_linenumber, 'SKU-' || p_partkey AS sku, p_name AS name, p_brand AS brand, s_name AS supplier, l_extendedprice AS price,
           CAST(l_quantity AS BIGINT) AS qty, CASE s_nationkey % 3 WHEN 0 THEN 'UAH' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency, p_type AS description, CAST(l_shipdate AS DATE) AS date
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
price_list AS (SELECT supplier, sku, name, description, min(price) AS price FROM offers GROUP BY ALL)
"""
