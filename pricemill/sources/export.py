"""Exports: price lists and channel files, as folders of parts or as one named file."""

from __future__ import annotations

import csv
import os
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import channel
from ..session import shared_dir
from .xlsx import write_sheet

OFFER_COLUMNS = ("sku", "name", "price", "currency", "description", "supplier")


def flat_offers(offers: DataFrame) -> DataFrame:
    """Offers with tags joined by ";" and the keys of `extra`, sorted, as columns."""
    keys = [r.k for r in offers.select(F.explode(F.map_keys("extra")).alias("k")).distinct().orderBy("k").collect()]  # the export's columns
    taken = {c.lower() for c in (*OFFER_COLUMNS, "tags")}
    names = [k if k.lower() not in taken else f"extra_{k}" for k in keys]
    return offers.select(*OFFER_COLUMNS, F.array_join(F.array_sort("tags"), ";").alias("tags"), *(F.coalesce(F.col("extra")[k], F.lit("")).alias(n) for k, n in zip(keys, names)))


def _rows(df: DataFrame) -> Iterator[tuple]:
    """Rows one partition at a time: a single named file is written by the driver, which holds no more than that."""
    return map(tuple, df.toLocalIterator(prefetchPartitions=True))


def write_csv(df: DataFrame, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(("" if v is None else v for v in r) for r in _rows(df))


def write_xlsx(df: DataFrame, path: str, title: str = "Products") -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    write_sheet(path, df.columns, _rows(df), title)


def write_json(offers: DataFrame, path: str) -> None:
    """Executors write the records as parts of the shared folder, which are appended block by block: a partition may be of any size."""
    spark = offers.sparkSession
    folder = f"{shared_dir(spark)}/pricemill-{spark.sparkContext.applicationId}/export-{uuid.uuid4().hex}"
    offers.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).write.option("lineSep", ",\n").text(folder)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        f.write(b'{"products": [\n')
    start = os.path.getsize(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(conf)
    out = jvm.java.io.FileOutputStream(path, True)
    for part in sorted(x.getPath().getName() for x in fs.listStatus(where)):
        if part.startswith("part-"):
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source := fs.open(jvm.org.apache.hadoop.fs.Path(where, part)), out, conf, False)
            source.close()
    out.close()
    fs.delete(where, True)
    with open(path, "r+b") as f:
        f.truncate(max(start, os.path.getsize(path) - 2))  # the comma after the last record
        f.seek(0, os.SEEK_END)
        f.write(b"\n]}\n")


def _element(tag: str, c, keep_empty: bool = False):
    text = F.concat(F.lit(f"<{tag}>"), channel.xml_escape(c), F.lit(f"</{tag}>"))
    return text if keep_empty else F.when(F.coalesce(c.cast("string"), F.lit("")) != "", text)


def offer_xml(offers: DataFrame) -> DataFrame:
    """(xml): a <product> for each offer; optional children only where filled, extra keys sorted."""
    c = F.col
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(F.lit('<field name="'), channel.xml_escape(e["key"]), F.lit('">'), channel.xml_escape(e["value"]), F.lit("</field>"))), "")
    tags = F.array_join(F.transform(F.array_sort("tags"), lambda t: F.concat(F.lit("<tag>"), channel.xml_escape(t), F.lit("</tag>"))), "")
    box = lambda tag, x: F.when(x != "", F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")))
    parts = [*(_element(f, c(f), True) for f in ("sku", "name", "price", "currency")), _element("description", c("description")), _element("supplier", c("supplier")), box("tags", tags), box("extra", extra)]
    return offers.select(F.concat(F.lit("  <product>"), F.concat_ws("", *parts), F.lit("</product>")).alias("xml"))


def item_xml(items: DataFrame, selling_type: str = "r") -> DataFrame:
    """(xml): an <item> for each row of channel.items(), rendered on the executors."""
    c = F.col
    images = F.array_join(F.transform("images", lambda x: F.concat(F.lit("<image>"), channel.xml_escape(x), F.lit("</image>"))), "")
    price = F.when(c("priceuah") == float("inf"), "inf").otherwise(F.translate(F.format_number(F.round("priceuah", 2), 2), ",", ""))
    parts = [
        F.lit('    <item id="'), channel.xml_escape(c("id")), F.lit('" selling_type="'), channel.xml_escape(F.lit(selling_type)), F.lit('">'), images, _element("available", c("available"), True),
        _element("in_stock", c("in_stock"), True), _element("priceuah", price, True), _element("name", c("name"), True), _element("vendor", c("vendor"), True), _element("model", c("name"), True),
        _element("categoryId", c("category_id"), True), F.lit("<currencyId>UAH</currencyId>"), _element("vendorCode", c("vendor_code"), True), _element("description", c("description"), True), F.lit("</item>"),
    ]
    return items.select(F.concat(*parts).alias("xml"))


def _write_lines(df: DataFrame, path: str, first: list[str], last: list[str]) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in ['<?xml version="1.0" encoding="UTF-8"?>', *first])
        f.writelines(r.xml + "\n" for r in df.toLocalIterator())
        f.writelines(x + "\n" for x in last)


def write_offer_xml(offers: DataFrame, path: str) -> None:
    _write_lines(offer_xml(offers), path, ["<products>"], ["</products>"])


def write_market_xml(channel_rows: DataFrame, path: str, selling_type: str = "r") -> None:
    _write_lines(item_xml(channel.items(channel_rows), selling_type), path, ["<shop>", "  <items>"], ["  </items>", "</shop>"])


def export_offers(offers: DataFrame, path: str) -> None:
    """One file by its suffix."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".csv":
        write_csv(flat_offers(offers), path)
    elif kind == ".json":
        write_json(offers, path)
    elif kind == ".xlsx":
        write_xlsx(flat_offers(offers), path)
    elif kind == ".xml":
        write_offer_xml(offers, path)
    else:
        raise ValueError(f"no writer for {kind or 'a file without suffix'}")


def run_export(raw: DataFrame, out_dir: str, formats: list[str], name: str = "prom", selling_type: str = "r", now: datetime | None = None) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Staging, channel rows and the written paths; unknown formats raise ValueError before anything is written."""
    if name != "prom":
        raise ValueError(f"no channel {name}")
    if bad := [f for f in formats if f not in ("csv", "xlsx", "xml")]:
        raise ValueError(f"no format {', '.join(bad)}")
    staged = channel.without_excluded(channel.staging(raw))
    rows = channel.to_channel(staged)
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M")
    paths = {f: os.path.join(out_dir, f"{'priceua' if f == 'xml' else 'prom_export'}_{stamp}.{f}") for f in formats}
    for f, path in paths.items():
        {"csv": write_csv, "xlsx": write_xlsx}.get(f, lambda d, p: write_market_xml(d, p, selling_type))(rows, path)
    return staged, rows, paths
