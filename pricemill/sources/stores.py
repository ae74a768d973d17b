"""Small stores beside the price lists: synonyms, import templates, review states, saved tags, spreadsheets."""

from __future__ import annotations

import json
import os
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import upsert
from ..session import stored


def read_object(path: str) -> dict:
    """The JSON object of a file; a missing or broken file, or another value, is an empty one."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (FileNotFoundError, ValueError):
        return {}
    return data if isinstance(data, dict) else {}


def write_object(path: str, data: dict) -> None:
    """Put data in place of the file at once, so that a crash leaves the old or the new one."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.new", path)


class Synonyms:
    """Canonical word -> variants, in one JSON file; words are trimmed and in lower case."""

    def __init__(self, path: str):
        self.path, self.words = path, {k: list(v) for k, v in read_object(path).items() if isinstance(v, list)}

    def add(self, canonical: str, variant: str) -> None:
        """Blank words and variants that are there already change nothing."""
        c, v = canonical.strip().lower(), variant.strip().lower()
        if c and v and v not in self.words.get(c, []):
            self.words.setdefault(c, []).append(v)

    def delete(self, canonical: str, variant: str | None = None) -> None:
        """Without a variant the whole entry goes; so does an entry that loses its last variant."""
        c = canonical.strip().lower()
        left = [v for v in self.words.get(c, []) if variant and v != variant.strip().lower()]
        if left:
            self.words[c] = left
        else:
            self.words.pop(c, None)

    def save(self) -> None:
        write_object(self.path, self.words)


class Templates:
    """Column mappings by supplier, in one JSON file; a supplier's key is trimmed and in lower case."""

    def __init__(self, path: str):
        self.path = path

    @staticmethod
    def _clean(key: str, entry) -> dict | None:
        if not isinstance(entry, dict) or not isinstance(entry.get("column_mapping"), dict):
            return None
        mapping = {str(f): str(h) for f, h in entry["column_mapping"].items() if str(h)}
        return {"supplier": str(entry.get("supplier") or key), "column_mapping": mapping, "headers": [str(h) for h in entry.get("headers") or [] if str(h)]}

    def all(self) -> list[dict]:
        """Every readable template, by supplier."""
        kept = [t for k, e in read_object(self.path).items() if (t := self._clean(k, e))]
        return sorted(kept, key=lambda t: t["supplier"].lower())

    def get(self, supplier: str) -> dict | None:
        key = supplier.strip().lower()
        return self._clean(supplier, read_object(self.path).get(key))

    def save(self, supplier: str, mapping: dict[str, str], headers: list[str]) -> None:
        data = read_object(self.path)
        data[supplier.strip().lower()] = {"supplier": supplier, "column_mapping": dict(mapping), "headers": [str(h) for h in headers]}
        write_object(self.path, data)

    def delete(self, supplier: str) -> None:
        data = read_object(self.path)
        if data.pop(supplier.strip().lower(), None) is not None:
            write_object(self.path, data)


STATE = "group_id string, match_id string, status string"


class ReviewState:
    """(group_id, match_id, status): reviews as a Parquet table, edited by whole sets of pairs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self.path)

    def set(self, changes: DataFrame) -> None:
        """Changes in place of the stored states of their pairs; a null or empty status clears a pair."""
        cols = ["group_id", "match_id", "status"]
        rows = upsert(self.rows(), changes.select(*cols), cols[:2]).where("coalesce(status, '') <> ''")
        stored(rows, "review").write.mode("overwrite").option("compression", "zstd").parquet(self.path)

    def clear(self, pairs: DataFrame) -> None:
        self.set(pairs.select("group_id", "match_id", F.lit(None).cast("string").alias("status")))


def save_tags(rows: DataFrame, path: str) -> None:
    """sku, name, supplier and sorted current tags of the rows that have any, as JSON lines."""
    kept = rows.where(F.size("current") > 0).select("sku", "name", "supplier", F.array_sort("current").alias("tags"))
    kept.write.mode("overwrite").json(path)


class SheetService(Protocol):
    """What a spreadsheet service must offer; a client of the service is handed in, none is bundled."""

    def read(self, book: str, sheet: str) -> list[list[str]]: ...

    def write(self, book: str, sheet: str, rows: list[list[str]]) -> None: ...


def read_service(spark: SparkSession, service: SheetService, book: str, sheet: str) -> DataFrame:
    """A sheet's rows as text columns by its first row; short rows are filled with nulls, surplus cells go."""
    head, *rows = service.read(book, sheet) or [[]]
    n = len(head)
    return spark.createDataFrame([tuple((list(r) + [None] * n)[:n]) for r in rows], ", ".join(f"`{h}` string" for h in head))


def write_service(df: DataFrame, service: SheetService | None, book: str, sheet: str) -> bool:
    """Headers and all rows in place of the sheet's content; without a service nothing is written and False returned.

    A spreadsheet is written by the driver, a partition at a time; it holds what such a service can hold.
    """
    if service is None or not book:
        return False
    rows = ([None if v is None else str(v) for v in r] for r in df.toLocalIterator())
    service.write(book, sheet, [df.columns, *rows])
    return True
