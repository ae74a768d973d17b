"""Prices recorded in different currencies and scales, brought to one unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How currencies and their parts and multiples are written in English and Ukrainian.
CURRENCIES = {
    "UAH": r"uah|грн|гривн\p{L}*|гривень|₴|коп\p{L}*|kopiyk\p{L}*|kop",
    "EUR": r"eur\p{L}*|євро\p{L}*|€",
    "USD": r"usd|us ?\$|us ?dollars?|usc|us ?cents?|дол\p{L}*(?: ?сша)?|цент\p{L}* ?сша|\$",
    "PLN": r"pln|zł|zl|злот\p{L}*",
    "HUF": r"huf|ft|форинт\p{L}*|(?:hungarian ?)?forints?",
}
HUNDREDTH = r"коп|kop|cent|цент|usc|/ ?100"
THOUSAND = r"тис|thousand|x ?1000|kuah|kusd|keur"
_MULTIPLE = r"(?:тис\p{L}*|thousands? ?(?:of)?|k)"
_UNIT = rf"(?:{_MULTIPLE} ?)?(?:" + "|".join(CURRENCIES.values()) + r")(?: ?cents?)?"
#: What a text says of the price itself: the word price, what binds it, the unit.
_SAID = rf"(?iu)(?:ціна|ціну|ціни|prices?) ?(?:вказано|вказана|quoted|per ?piece|за ?шт\p{{L}}*)? ?(?:в|у|in)? ?({_UNIT})(?!\p{{L}}|\p{{N}})"
#: A unit alone in brackets or at a name's end after a comma.
_BRACKETS = rf"(?iu)[(\[][\s\p{{Z}}_]*({_UNIT})[.\s\p{{Z}}_]*[)\]]"


def _said(text: Column) -> Column:
    """The unit that a text names for the price itself, or an empty text; charges for other things don't count."""
    words = F.regexp_replace(text, r"[^\p{L}\p{N}$€₴]+", " ")
    return F.coalesce(F.nullif(F.regexp_extract(words, _SAID, 1), F.lit("")), F.regexp_extract(text, _BRACKETS, 1))


def _code(t: Column) -> Column:
    code = F.lit(None).cast("string")
    for c in reversed(list(CURRENCIES)):
        code = F.when(t.rlike(rf"(?u)(?<!\p{{L}})(?:тис\p{{L}}* ?|thousands? ?of ?|k)?(?:{CURRENCIES[c]})"), c).otherwise(code)
    return code


def with_unit(products: DataFrame, default: str = "USD") -> DataFrame:
    """products with unit_code, unit_factor (of the currency in one unit) and said ('currency', 'text', 'default').

    A filled currency decides, also where it names no known unit (the unit is then null); else what the name,
    the description or the sku (they may be exchanged) says of the price; else the default. Columns that bear the
    new ones' names are replaced.
    """
    filled = F.col("currency").isNotNull() & ~F.col("currency").rlike(r"^[\s\p{Z}]*$")
    text = F.concat_ws("\n", "name", "description", "sku")
    # one step a column, so that no expression is spelt out twice
    rows = products.withColumn("said", F.when(filled, "currency"))
    rows = rows.withColumn("__said", F.when(F.col("said").isNull(), _said(text)).otherwise(F.col("currency")))
    rows = rows.withColumn("__said", F.lower(F.regexp_replace("__said", r"[\s\p{Z}_.]+", " ")))
    rows = rows.withColumn("said", F.coalesce("said", F.when(F.col("__said") != "", "text").otherwise("default")))
    code = F.when(F.col("said") == "default", default).otherwise(_code(F.col("__said")))
    factor = F.when(F.col("__said").rlike(rf"(?u){HUNDREDTH}"), 0.01).when(F.col("__said").rlike(rf"(?u){THOUSAND}"), 1000.0).otherwise(1.0)
    # made by a generator: conditions on the unit stay above it and don't spell out its expressions again
    keep = [c for c in rows.columns if c not in ("__said", "unit_code", "unit_factor")]
    return rows.select(*keep, F.inline(F.array(F.struct(code.alias("unit_code"), factor.alias("unit_factor")))))


def rates(fx: DataFrame) -> DataFrame:
    """(code, rate): hryvnias for one of a currency."""
    return fx.where("currency_code IS NOT NULL AND nominal > 0").select(F.upper(F.trim("currency_code")).alias("code"), (F.col("rate_uah") / F.col("nominal")).alias("rate"))


def to_kopiykas(products: DataFrame, fx: DataFrame, default: str = "USD") -> DataFrame:
    """(product_id, uah_kop BIGINT): prices that aren't recorded in hryvnias, in kopiykas.

    Null prices and prices in hryvnias have no row, nor have units without a rate. No shuffle: the rates are a
    small fixed table. Repeated rows stay; an empty table gives an empty result.
    """
    rows = with_unit(products.select("product_id", "price", "currency", "name", "description", "sku"), default)
    rows = rows.where("price IS NOT NULL AND NOT isnan(price) AND NOT (unit_code = 'UAH' AND unit_factor = 1.0)")
    rows = rows.select("product_id", "price", F.col("unit_code").alias("code"), "unit_factor").join(F.broadcast(rates(fx)), "code")
    return rows.select("product_id", F.round(F.col("price") * F.col("unit_factor") * F.col("rate") * 100).cast("long").alias("uah_kop"))
