"""Bronze, silver and gold layers of supplier offers."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_blanks, utrim

#: Columns of a raw price file and their types in bronze.
BRONZE = {"sku": "string", "name": "string", "brand": "string", "price": "double", "qty": "bigint", "currency": "string"}


def bronze(raw: DataFrame, supplier: str | None = None, strict: bool = False) -> DataFrame:
    """The bronze columns by name (missing ones null), offers with a price above zero, normalised text.

    strict: a value that doesn't cast fails the read; else it becomes null. A `supplier` column is kept where
    no supplier is given. Filter and column choice reach the scan.
    """
    cast = lambda c, t: F.col(c).cast(t) if strict else F.col(c).try_cast(t)
    have = {c.lower() for c in raw.columns}
    keep = [F.lit(supplier).alias("supplier")] if supplier is not None else [F.col("supplier")] if "supplier" in have else [F.lit(None).cast("string").alias("supplier")]
    out = raw.select(*(cast(c, t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in BRONZE.items()), *keep).where("price > 0")
    return out.select(
        "sku", "name", "brand", "price", F.coalesce("qty", F.lit(0)).alias("qty"), F.lower(utrim("currency")).alias("currency"),
        F.lower(utrim("brand")).alias("brand_norm"), collapse_blanks("name").alias("name_clean"), "supplier",
    )


def silver(bronze_rows: DataFrame) -> DataFrame:
    """Offers with the product key pid_raw = brand_norm|name_clean, null if either is null."""
    pid = F.concat("brand_norm", F.lit("|"), "name_clean").alias("pid_raw")
    return bronze_rows.select("sku", "supplier", "brand_norm", "name_clean", F.col("price").cast("double").alias("price"), F.col("qty").cast("bigint").alias("qty"), "currency", pid)


def gold(silver_rows: DataFrame) -> DataFrame:
    """Per product key (null is one): distinct skus and suppliers, average, least and greatest price.

    Rows are first aggregated by (key, sku, supplier), map-side before the shuffle, so that the distinct counts
    expand those groups and not the rows, and a hot key is spread over its skus and suppliers.
    """
    each = silver_rows.groupBy("pid_raw", "sku", "supplier").agg(F.sum("price").alias("s"), F.count("price").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    g = each.groupBy("pid_raw").agg(F.count_distinct("sku").alias("sku_count"), F.count_distinct("supplier").alias("supplier_count"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("min_price"), F.max("hi").alias("max_price"))
    return g.select("pid_raw", "sku_count", "supplier_count", (F.col("s").cast("double") / F.col("n")).alias("avg_price"), "min_price", "max_price")


def bronze_folder(path: str, supplier: str, date: str, file: str) -> str:
    """Where one file's rows of a day lie; names are kept apart whatever their characters."""
    name = lambda s: quote(s, safe="").replace(".", "%2E")
    return f"{path}/supplier={name(supplier)}/date={date}/file={name(file)}"


def write_bronze(rows: DataFrame, path: str, supplier: str, date: str, file: str) -> None:
    """One file's rows, in place of those of the same supplier, day and file."""
    rows.drop("supplier").write.mode("overwrite").option("compression", "zstd").parquet(bronze_folder(path, supplier, date, file))


def read_bronze(spark, path: str) -> DataFrame:
    schema = "sku string, name string, brand string, price double, qty bigint, currency string, brand_norm string, name_clean string, supplier string, date string, file string"
    return spark.read.schema(schema).option("basePath", path).parquet(path).drop("date", "file")


def write_layer(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
