"""Stored price lists: a Parquet table by supplier, with list, load, save, delete and rename."""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import assignment_key, blank_to_null
from ..session import stored

SCHEMA = "sku string, name string, price double, currency string, description string, tags array<string>, extra map<string,string>, supplier string"


class Repository:
    """Price lists under one path. The supplier's exact name is the key; a list is read without the others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(sc._jsc.hadoopConfiguration()), where

    def load_all(self) -> DataFrame:
        fs, where = self._fs()
        if not fs.exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def suppliers(self) -> DataFrame:
        """(supplier), sorted; folder names suffice, no list is read."""
        return self.load_all().select("supplier").distinct().orderBy("supplier")

    def load(self, supplier: str) -> DataFrame:
        return self.load_all().where(F.col("supplier") == supplier)

    def save(self, offers: DataFrame) -> None:
        """Put the lists of the suppliers in `offers` in place of their stored ones; other suppliers' stay."""
        cols = [f.name for f in T._parse_datatype_string(SCHEMA).fields]
        rows = offers.select(*(F.col(c) if c in offers.columns else F.lit(None).alias(c) for c in cols)).withColumn("currency", F.coalesce("currency", F.lit("USD")))
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(SCHEMA).fields))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("supplier").parquet(self.path)

    def delete(self, supplier: str) -> bool:
        """Whether there was a list to delete."""
        fs, where = self._fs()
        gone = False
        for status in fs.listStatus(where) if fs.exists(where) else []:
            if status.isDirectory() and unquote(status.getPath().getName().removeprefix("supplier=")) == supplier:
                gone = fs.delete(status.getPath(), True) or gone
        return gone

    def rename(self, old: str, new: str) -> None:
        """Refuses a name that has a list already."""
        if self.load(new).limit(1).count():
            raise ValueError(f"{new} has a price list")
        self.save(stored(self.load(old).withColumn("supplier", F.lit(new)), "renamed"))
        self.delete(old)

    def clear(self) -> None:
        fs, where = self._fs()
        fs.delete(where, True)


def load_rules(text: str, default: dict[str, list[str]]) -> dict[str, list[str]]:
    """Keyword rules of a JSON text {"rules": [{"tag", "keywords"}]}; items without a tag go, none leaves the default."""
    rules = {r["tag"]: [k for k in r.get("keywords", []) if k] for r in json.loads(text).get("rules", []) if isinstance(r, dict) and r.get("tag")}
    return rules or default


# The rules that hold where no file of rules is.
DEFAULT_REGEX_RULES = [
    {"name": "GETMAN Liquid Silk Camera", "conditions": ["(?i)Liquid Silk Full Camera", "(?i)GETMAN"], "tags": ["Soft Case", "Чохол", "Camera Protective"]},
    {"name": "MagSafe chargers", "conditions": ["(?i)MagSafe", "(?i)charger"], "tags": ["Зарядка", "MagSafe"]},
]


def load_regex_rules(text: str | None) -> list[dict]:
    """Regular-expression rules of a JSON text; those without name, tags or conditions go; None (no file) gives the default ones."""
    if text is None:
        return DEFAULT_REGEX_RULES
    rows = json.loads(text).get("rules", [])
    return [{"name": r["name"], "conditions": list(r["conditions"]), "tags": list(r["tags"])} for r in rows if isinstance(r, dict) and r.get("name") and r.get("tags") and r.get("conditions")]


def saved_tags(rows: DataFrame) -> DataFrame:
    """(key, tags) of saved rows (seq, supplier, sku, name, tags); rows without a name go, of one key the latest counts."""
    rows = rows.where(blank_to_null("name").isNotNull()).withColumn("key", assignment_key(F.col("supplier"), F.col("sku"), F.col("name")))
    return rows.groupBy("key").agg(F.max_by("tags", "seq").alias("tags"))


def with_saved_tags(products: DataFrame, saved: DataFrame) -> DataFrame:
    """products with their saved tags added to tags."""
    none = F.array().cast("array<string>")
    rows = products.withColumn("key", assignment_key(F.col("supplier"), F.col("sku"), F.col("name"))).join(saved.withColumnRenamed("tags", "__saved"), "key", "left")
    return rows.withColumn("tags", F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("__saved", none)))).drop("__saved", "key")


def price_entries(meta: DataFrame) -> DataFrame:
    """(supplier, id, name, updated_at): the prices of each list's metadata; a list without any has one default entry."""
    entry = F.explode_outer("prices").alias("p")
    rows = meta.select("supplier", "price_name", "updated_at", entry)
    return rows.select("supplier", F.coalesce("p.id", F.lit("default")).alias("id"), F.coalesce("p.name", "price_name", "supplier").alias("name"), F.coalesce("p.updated_at", "updated_at").alias("updated_at"))
