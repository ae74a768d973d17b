"""Comparison of offers across suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, utrim, words
from .ranking import places

#: Ties of a price: supplier, sku, name.
ORDER = ("price", "supplier", "sku", "name")


def cheapest_by_sku(offers: DataFrame) -> DataFrame:
    """The cheapest offer of each sku, whatever its letter case; one combinable aggregate."""
    best = F.min(F.struct(*ORDER)).alias("o")
    return offers.where("sku IS NOT NULL").groupBy(F.lower("sku").alias("sku_key")).agg(best).select("sku_key", *(f"o.{c}" for c in ORDER))


def best_offers(offers: DataFrame) -> DataFrame:
    """Per sku: representative name (the cheapest offer's of the first supplier), best price and supplier, number of offers.

    Offers stay flat: the best is a minimum and the count a count, so no group is collected.
    """
    first = F.min(F.struct("supplier", "price", "sku", "name")).alias("f")
    g = offers.where("sku IS NOT NULL").groupBy(F.lower("sku").alias("sku_key")).agg(first, F.min(F.struct(*ORDER)).alias("b"), F.count("*").alias("n_offers"))
    return g.select("sku_key", F.col("f.sku").alias("sku"), F.col("f.name").alias("name"), F.col("b.price").alias("best_price"), F.col("b.supplier").alias("best_supplier"), "n_offers")


def compare_by_sku(offers: DataFrame, sku: str) -> DataFrame:
    """All offers of one sku by price, in a sort that spreads over partitions."""
    return offers.where(F.lower("sku") == sku.lower().strip()).select(*ORDER).orderBy(*ORDER)


def compare_by_name(offers: DataFrame, name: str, threshold: float = 0.75) -> DataFrame:
    """Per sku the cheapest offer among those whose name's words are similar enough to the given name's.

    Similarity is computed once for each distinct name.
    """
    names = offers.select("name").distinct().withColumn("similarity", jaccard(words("name"), words(F.lit(name)))).where(F.col("similarity") >= threshold)
    rows = offers.join(names, "name")
    return rows.where("sku IS NOT NULL").groupBy(F.lower("sku").alias("sku_key")).agg(F.max("similarity").alias("similarity"), F.min(F.struct(*ORDER)).alias("b"), F.count("*").alias("n_offers")).select("sku_key", "similarity", F.col("b.name").alias("name"), F.col("b.price").alias("best_price"), F.col("b.supplier").alias("best_supplier"), "n_offers")


def offers_for(offers: DataFrame, sku: Column) -> DataFrame:
    """All offers of one sku, whatever its letter case and outer blanks."""
    return offers.where(F.lower("sku") == F.lower(utrim(sku)))


def offer_lists(offers: DataFrame) -> DataFrame:
    """sku_key, place and the offer: each sku's offers from the cheapest on.

    The lists stay flat, a row for each offer, so that a sku of any number of offers is spread over tasks.
    """
    rows = offers.where("sku IS NOT NULL").select(F.lower("sku").alias("sku_key"), *ORDER)
    return places(rows, "sku_key", [F.col(c) for c in ORDER], name="offer_lists")


def union_lists(*lists: DataFrame) -> DataFrame:
    """All price lists as one, missing columns null."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
