"""Price lists from CSV, JSON, XML and spreadsheet files into one offers layout."""

from __future__ import annotations

import csv
import json
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, parse_price, split_tags, utrim
from ..session import stored

#: Fields of an offer that a file must have, and those it may have.
REQUIRED, OPTIONAL = ("sku", "name", "price"), ("currency", "description", "tags")
# Headers by which each field is known.
ALIASES = {
    "sku": ["sku", "артикул", "article", "код товару", "код", "товарний код", "vendorcode"],
    "name": ["name", "назва", "назва позиції", "найменування", "товар", "product"],
    "price": ["price", "ціна", "вартість", "cost", "цена"],
    "currency": ["currency", "валюта", "currencyid"],
    "description": ["description", "опис", "описання"],
    "tags": ["tags", "теги", "мітки"],
}
#: Headers of the bronze layer's further fields.
BRONZE_ALIASES = {"brand": ["brand", "бренд", "виробник"], "qty": ["qty", "кількість", "залишок"]}
#: Element names that stand for a record in XML, in order of preference.
RECORD_TAGS = ("product", "offer", "item", "position", "record", "entry", "row")
DELIMITERS = (",", ";", "\t", "|")


def resolve_headers(headers: list[str], overrides: dict[str, str] | None = None, aliases: dict[str, list[str]] = ALIASES, required: tuple[str, ...] = REQUIRED) -> dict[str, str]:
    """field -> header: overrides first, then aliases in alphabetical order, headers trimmed and in lower case.

    Raises ValueError if a required field has no header.
    """
    by_key: dict[str, str] = {}
    for h in headers:
        by_key.setdefault(h.strip().lower(), h)
    out = {f: by_key[h.strip().lower()] for f, h in (overrides or {}).items() if h and h.strip().lower() in by_key}
    for field, names in aliases.items():
        if field not in out and (hit := next((by_key[a] for a in sorted(names) if a in by_key), None)):
            out[field] = hit
    if missing := [f for f in required if f not in out]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return out


def _head(spark: SparkSession, path: str, n: int = 4096) -> str:
    """The first n characters of a file's first lines; Spark's readers stop there, whatever the file's size."""
    rows = spark.read.text(path).select(F.substring("value", 1, n).alias("v")).limit(64).collect()
    return "\n".join(r.v or "" for r in rows).removeprefix("\ufeff")[:n]


def guess_delimiter(sample: str) -> str:
    """The delimiter of a CSV sample: sniffed, else the most frequent of the usual ones, else a comma."""
    try:
        return csv.Sniffer().sniff(sample, "".join(DELIMITERS)).delimiter
    except csv.Error:
        return max(DELIMITERS, key=lambda d: (sample.count(d), -DELIMITERS.index(d)))


def to_offers(rows: DataFrame, supplier: str, overrides: dict[str, str] | None = None, currency: str = "USD") -> DataFrame:
    """Rows of text columns as offers: sku, name, price, currency, description, supplier, tags, extra, bad_price.

    Rows with a blank sku, name or price go; the other columns' non-blank cells fill `extra`. A price that
    can't be read leaves price null and its text in bad_price, so that loading and judging stay apart.
    """
    mapping = resolve_headers(rows.columns, overrides)
    c = lambda f: F.col(f"`{mapping[f]}`").cast("string") if f in mapping else F.lit(None).cast("string")
    others = [h for h in rows.columns if h not in mapping.values() and not h.startswith("_")]
    extra = F.create_map(*(x for h in others for x in (F.lit(h), utrim(F.col(f"`{h}`").cast("string"))))) if others else F.create_map().cast("map<string,string>")
    tags = F.array_sort(split_tags(c("tags")))
    out = rows.select(
        utrim(c("sku")).alias("sku"), utrim(c("name")).alias("name"), parse_price(c("price")).alias("price"), F.coalesce(blank_to_null(c("currency")), F.lit(currency)).alias("currency"),
        blank_to_null(c("description")).alias("description"), F.lit(supplier).alias("supplier"), tags.alias("tags"), F.map_filter(extra, lambda k, v: v.isNotNull() & (v != "")).alias("extra"), utrim(c("price")).alias("__price"),
    )
    out = out.where("coalesce(sku, '') <> '' AND coalesce(name, '') <> '' AND coalesce(__price, '') <> ''")
    return out.withColumn("bad_price", F.when(F.col("price").isNull(), F.col("__price"))).drop("__price")


def to_raw(rows: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Rows of text columns under the bronze layer's names: sku, name, brand, price, qty, currency, as text.

    Columns are found by name; one that the file lacks is null. A price that isn't a plain number is read as
    price texts are ("1 234,50"), so that it isn't lost.
    """
    aliases = {**{f: ALIASES[f] for f in ("sku", "name", "price", "currency")}, **BRONZE_ALIASES}
    mapping = resolve_headers(rows.columns, overrides, aliases, ())
    c = lambda f: F.col(f"`{mapping[f]}`").cast("string") if f in mapping else F.lit(None).cast("string")
    price = F.coalesce(c("price").try_cast("double"), parse_price(c("price")))
    return rows.select(c("sku").alias("sku"), c("name").alias("name"), c("brand").alias("brand"), price.alias("price"), c("qty").try_cast("double").try_cast("bigint").alias("qty"), c("currency").alias("currency"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text by header; quotes are doubled, records may span lines, a byte-order mark is skipped."""
    return spark.read.csv(path, header=True, sep=guess_delimiter(_head(spark, path)), multiLine=True, quote='"', escape='"', inferSchema=False, encoding="UTF-8")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A row for each object of the file's `products`, keys whatever their case, an inner `extra` spread out.

    A file is read as a stream, so that only a record has to fit into Spark's limit of one value. Where keys of a
    record differ only by case the first that is filled counts, then those of `extra`.
    """
    from .json_products import JsonProducts

    spark.dataSource.register(JsonProducts)
    paths = [r.path for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]  # names only
    items = stored(spark.read.format("json_products").option("paths", json.dumps(paths)).load(), "products")
    if bad := items.where("error IS NOT NULL").select("error").head():
        raise ValueError(bad.error)
    if items.isEmpty():
        raise ValueError("the file has no list 'products'")
    cell = lambda v: F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(F.try_variant_get(v, "$", "array<string>"), ";")), F.try_variant_get(v, "$", "string"))
    entries = lambda v: F.map_entries(F.variant_get(v, "$", "map<string,variant>"))
    is_inner = lambda e: (F.lower(e["key"]) == "extra") & F.schema_of_variant(e["value"]).startswith("OBJECT")
    own = entries(F.parse_json("item"))
    rows = items.where("item IS NOT NULL").select(own.alias("own"))
    inner = F.flatten(F.transform(F.filter("own", is_inner), lambda e: entries(e["value"])))
    both = F.concat(F.filter("own", lambda e: ~is_inner(e)), inner)
    cells = stored(rows.select(F.transform(both, lambda e: F.struct(F.lower(e["key"]).alias("k"), cell(e["value"]).alias("v"))).alias("cells")), "cells")
    names = [r.k for r in cells.select(F.explode("cells.k").alias("k")).distinct().orderBy("k").collect()]  # the file's columns
    first = lambda k: F.get(F.filter("cells", lambda c: (c["k"] == k) & c["v"].isNotNull()), F.lit(0))["v"]
    return cells.select(*(first(k).alias(k) for k in names))


def record_tag(spark: SparkSession, path: str) -> str:
    """The element that stands for a record: the first known name found, else the first element that repeats.

    All of the file's elements are counted where they lie; what comes back is a row for each name. The root
    itself can't be a record if it holds other elements.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.regexp_extract_all("value", F.lit(r"<([\p{L}_][^\s/>]*)"), F.lit(1))).alias("at", "tag"))
    names = lines.select(F.regexp_replace("tag", "^.*:", "").alias("name"), F.struct("line", "at").alias("place")).groupBy("name").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    seen = names.orderBy("place").select("name", "n").collect()
    low = {r.name.lower(): r.name for r in reversed(seen)}
    if known := next((low[t] for t in RECORD_TAGS if t in low), None):
        return known
    inner = seen[1:] or seen
    return next((r.name for r in inner if r.n > 1), inner[0].name if inner else "row")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record element; nested values become text."""
    tag = record_tag(spark, path)
    rows = spark.read.format("xml").options(rowTag=tag, attributePrefix="", valueTag="_text", ignoreNamespace="true", inferSchema="false").load(path)
    for f in rows.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            inner = f.dataType.elementType.typeName()
            c = F.array_join(F.transform(F.col(f"`{f.name}`"), lambda x: x.cast("string") if inner == "string" else F.coalesce(x["_text"], F.to_json(x)) if inner == "struct" and "_text" in [g.name for g in f.dataType.elementType.fields] else F.to_json(x)), ";")
            rows = rows.withColumn(f.name, c)
        elif kind == "struct":
            parts = [g.name for g in f.dataType.fields]
            if f.name.lower() == "extra":
                for g in parts:
                    rows = rows.withColumn(g, F.col(f"`{f.name}`.`{g}`").cast("string"))
                rows = rows.drop(f.name)
            elif "_text" in parts:
                rows = rows.withColumn(f.name, F.col(f"`{f.name}`._text"))
            elif len(parts) == 1 and f.dataType.fields[0].dataType.typeName() == "array":
                rows = rows.withColumn(f.name, F.array_join(F.col(f"`{f.name}`.`{parts[0]}`").cast("array<string>"), ";"))
            else:
                text = F.concat_ws("; ", *(F.concat(F.lit(f"{g}:"), F.col(f"`{f.name}`.`{g}`").cast("string")) for g in parts))
                rows = rows.withColumn(f.name, text if len(parts) > 1 else F.col(f"`{f.name}`.`{parts[0]}`").cast("string"))
    return rows


def _suffix(spark: SparkSession, path: str) -> str:
    """The suffix of a file, or of the first part of a folder of parts."""
    kind = os.path.splitext(urlparse(path).path)[1].lower()
    if kind:
        return kind
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []
    return next((os.path.splitext(n)[1].lower() for n in names if n[0] not in "_."), "")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A file's rows as text columns, by its suffix; a folder's parts are one file."""
    kind = _suffix(spark, path)
    if kind == ".csv":
        return read_csv(spark, path)
    if kind == ".json":
        return read_json(spark, path)
    if kind == ".xml":
        return read_xml(spark, path)
    if kind in (".xlsx", ".xlsm"):
        from .xlsx import XlsxDataSource

        spark.dataSource.register(XlsxDataSource)
        return spark.read.format("xlsx_sheet").load(path)
    raise ValueError(f"no reader for {kind or 'a file without suffix'}")


def load_offers(spark: SparkSession, path: str, supplier: str | None = None, overrides: dict[str, str] | None = None, currency: str = "USD") -> DataFrame:
    """The offers of a price list; the supplier is the file's name unless given."""
    return to_offers(read_rows(spark, path), supplier or os.path.splitext(os.path.basename(urlparse(path).path))[0], overrides, currency)


def preview(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    return read_rows(spark, path).limit(limit)


def load_batch(spark: SparkSession, jobs: list[tuple[str, str]]) -> tuple[DataFrame | None, list[tuple[str, str, str]]]:
    """All offers of (supplier, path) jobs and the jobs that failed with their reasons; one bad file doesn't stop the others."""
    done, failed = [], []
    for supplier, path in jobs:
        try:  # stored at once, so that a file that breaks while it is read fails here
            done.append(stored(load_offers(spark, path, supplier), "batch"))
        except Exception as e:  # a file's own trouble, of any kind, is reported as such
            failed.append((supplier, path, str(e).splitlines()[0]))
    out = None
    for df in done:
        out = df if out is None else out.unionByName(df)
    return out, failed
