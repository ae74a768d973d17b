"""Channel export: staging columns, exclusion, projection, item columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy, utrim

# The staging columns in order.
STAGING = {
    "id_internal": "string", "sku": "string", "title_base": "string", "brand": "string", "model": "string", "device_type": "string", "category_norm": "string",
    "price": "double", "old_price": "double", "currency": "string", "stock_qty": "bigint", "availability": "string", "condition": "string", "warranty_months": "bigint",
    "barcode_gtin": "string", "mpn": "string", "color": "string", "material": "string", "compatibility": "string", "weight_g": "double", "size_mm_l": "double", "size_mm_w": "double",
    "size_mm_h": "double", "country_of_origin": "string", "description_html_base": "string", "images_main_url": "string", "images_extra_urls": "string", "product_url": "string",
    "tags": "string", "updated_at": "string", "channel_exclude": "string",
}
# The channel's columns in order; each the staging column or None where it is computed.
CHANNEL = {
    "ID": "id_internal", "Назва товару": None, "Ціна": "price", "Стара ціна": "old_price", "Валюта": None, "Стан товару": None, "Наявність": None, "Категорія": "category_norm",
    "Опис": "description_html_base", "Основне зображення": "images_main_url", "Додаткові зображення": "images_extra_urls", "Артикул": "sku", "Країна-виробник": "country_of_origin",
    "Гарантія": "warranty_months", "Наявність баркоду (ШК)": "barcode_gtin", "Бренд": "brand", "product_url": "product_url",
}
IN_STOCK, TO_ORDER, NEW = "В наявності", "Під замовлення", "Новий"


def staging(raw: DataFrame) -> DataFrame:
    """The staging columns in order; missing ones null, others dropped, present ones as they are."""
    have = {c.lower() for c in raw.columns}
    return raw.select(*(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in STAGING.items()))


def without_excluded(rows: DataFrame) -> DataFrame:
    return rows.where(~truthy("channel_exclude")) if "channel_exclude" in rows.columns else rows


def to_channel(rows: DataFrame) -> DataFrame:
    """Staging rows in the channel's columns."""
    text = lambda c: F.coalesce(utrim(F.col(c).cast("string")), F.lit(""))
    base = utrim(F.concat(text("brand"), F.lit(" "), text("model")))
    name = F.when(text("device_type") != "", utrim(F.concat(base, F.lit(" — "), text("device_type")))).otherwise(base)
    stock = F.coalesce("availability", F.lit(""))
    made = {"Назва товару": name, "Валюта": F.coalesce(F.nullif(text("currency"), F.lit("")), F.lit("UAH")), "Стан товару": F.lit(NEW), "Наявність": F.when(stock == "in_stock", IN_STOCK).when(stock == "preorder", TO_ORDER).otherwise(stock)}
    return rows.select(*((F.col(c) if c else made[to]).alias(to) for to, c in CHANNEL.items()))


def images(main: Column, extra: Column, most: int = 10) -> Column:
    """The main image and those of a packed list, `most` at most (a limit of the format); none without a main one."""
    more = F.filter(F.transform(F.split(F.coalesce(extra, F.lit("")), r"[,|]"), utrim), lambda x: x != "")
    return F.when(F.coalesce(utrim(main), F.lit("")) != "", F.slice(F.concat(F.array(utrim(main)), more), 1, most)).otherwise(F.array().cast("array<string>"))


def availability_flags(status: Column) -> tuple[Column, Column]:
    return F.when(status == IN_STOCK, "склад").when(status == TO_ORDER, "").otherwise("false"), F.coalesce(status == IN_STOCK, F.lit(False))


def xml_escape(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def number(c: Column) -> Column:
    return F.translate(c.cast("string"), ",", ".").try_cast("double")


def items(channel_rows: DataFrame) -> DataFrame:
    """The columns of the marketplace's items; rows without a price above zero go."""
    flag, stock = availability_flags(F.col("Наявність"))
    rows = channel_rows.withColumn("priceuah", number(F.col("Ціна"))).where("priceuah > 0")
    return rows.select(
        F.col("ID").alias("id"), images(F.col("Основне зображення"), F.col("Додаткові зображення")).alias("images"), flag.alias("available"), stock.alias("in_stock"), "priceuah",
        F.col("Назва товару").alias("name"), F.col("Бренд").alias("vendor"), F.col("Категорія").alias("category_id"), F.col("Артикул").alias("vendor_code"), F.col("Опис").alias("description"),
    )
