"""Search in offers: exact words, substrings, fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fuzzy_score


def contains_keyword(keyword: str, text: Column, tokens: Column) -> Column:
    """The keyword within the text, or all of its words among the tokens; an empty keyword is nowhere."""
    import re

    k = keyword.lower().strip()
    if not k:
        return F.lit(False)
    parts = re.findall(r"\w+", k)
    every = F.size(F.array_except(F.array(*map(F.lit, parts)), tokens)) == 0 if parts else F.lit(False)
    return text.contains(k) | every


def search(offers: DataFrame, query: str, supplier: str | None = None, fuzzy: bool = False, limit: int = 20, threshold: float = 0.6, strict: bool = False) -> DataFrame:
    """The best offers for a query, with their score; offers: sku, name, price, supplier, haystack, tokens.

    Candidates share a word with the query or have it as sku; only if there are none is every offer one. That
    is a scalar subquery, the maximum of a flag: the offers are read twice and nothing is collected.
    strict: an equal sku counts for any supplier. The limit is the feature: a top-k without a full sort.
    """
    import re

    q = query.lower().strip()
    if not q:
        return offers.limit(0).withColumn("score", F.lit(0.0))
    parts = re.findall(r"\w+", q)
    mine = F.lit(True) if not supplier else F.lower("supplier") == supplier.lower()
    exact = F.lower("sku") == q
    share = F.arrays_overlap("tokens", F.array(*map(F.lit, parts))) if parts else F.lit(True)
    rows = offers.withColumn("cand", (mine & (share | exact)) | (exact if strict else F.lit(False))).where(mine | F.col("cand"))
    any_ = rows.agg(F.coalesce(F.max("cand"), F.lit(False))).scalar()
    rows = rows.where(F.col("cand") | ~any_)
    if fuzzy:
        # the score is computed once for each distinct text
        texts = rows.select("haystack", "tokens").distinct().withColumn("score", fuzzy_score(F.lit(q), "tokens", "haystack")).where(F.col("score") >= threshold)
        rows = rows.join(texts, ["haystack", "tokens"])
    else:
        rows = rows.where(contains_keyword(q, F.col("haystack"), F.col("tokens"))).withColumn("score", F.lit(1.0))
    return rows.drop("cand").orderBy(F.desc("score"), "price", "supplier", "sku", "name").limit(limit)
