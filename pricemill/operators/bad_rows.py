"""Rows that fail to parse: structural checks, invalid-value dictionaries, reasons."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# What may stand for a currency beside an amount.
CURRENCY_NAMES = [
    "₴", "$", "€", "£", "US$", "UAH", "USD", "EUR", "PLN", "HUF", "GBP", "CHF", "CZK",
    "грн", "грн.", "гривня", "гривні", "гривень", "дол", "дол.", "дол. США", "долар", "долари", "доларів", "доларів США", "євро", "euro", "euros", "zł", "zl", "злотий", "злоті", "злотих", "Ft", "форинт", "форинти", "форинтів",
]
_BLANK = r"[\s\p{Z}]*"
_SIGN = "[+\\-−]?"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "$.|()[]{}*+?^\\" else c for c in text)


_CURRENCY = "(?:" + "|".join(_quoted(c) for c in sorted(CURRENCY_NAMES, key=len, reverse=True)) + ")"
#: Digits, plain or in threes split by one mark (blank, no-break blanks, apostrophe, comma, point), and decimals after another mark.
_DIGITS = r"(?:[0-9]+(?:[.,][0-9]+)?|[0-9]{1,3}(?:[ \x{a0}\x{202f}\x{2009}][0-9]{3})+(?:[.,][0-9]+)?|[0-9]{1,3}(?:['’][0-9]{3})+(?:[.,][0-9]+)?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?)"
AMOUNT = rf"(?iu)^{_BLANK}(?:{_SIGN}{_BLANK}{_DIGITS}{_BLANK}{_CURRENCY}?|(?:{_SIGN}{_BLANK}{_CURRENCY}|{_CURRENCY}{_BLANK}{_SIGN}){_BLANK}{_DIGITS}){_BLANK}$"


def is_blank(c: Column) -> Column:
    """Null, or white space of any kind only."""
    return c.isNull() | c.rlike(r"^[\s\p{Z}\x1c-\x1f\x85]*$")


def amount_reason(c: Column) -> Column:
    """Why a text isn't exactly one amount: 'blank', 'not_an_amount'; null if it is one."""
    return F.when(is_blank(c), "blank").when(~c.rlike(AMOUNT), "not_an_amount")


def amount(c: Column) -> Column:
    """The value of a text that is one amount; null for others.

    The last comma or point is the decimal mark unless three digits follow it and it is the only kind of mark
    and either repeats or follows a number that could be grouped; then it groups.
    """
    digits = F.regexp_replace(F.translate(F.regexp_replace(c, r"(?<![0-9])[.,]|[.,](?![0-9])", ""), "−", "-"), r"[^0-9.,+\-]", "")
    grouped = digits.rlike(r"^[+-]?[0-9]{1,3}(?:(?:,[0-9]{3})+|(?:\.[0-9]{3})+)$")
    plain = F.when(grouped, F.regexp_replace(digits, "[.,]", "")).otherwise(F.translate(F.regexp_replace(digits, "[.,](?=.*[.,])", ""), ",", "."))
    return F.when(amount_reason(c).isNull(), plain.try_cast("double"))


def split_record(line: str, delimiter: str) -> list[str] | None:
    """Fields of a record, or None if a field that begins with a quote isn't closed directly before the delimiter or the end."""
    if '"' not in line:
        return line.split(delimiter)
    out, i, n = [], 0, len(line)
    while True:
        if line.startswith('"', i):
            j = i + 1
            while (j := line.find('"', j)) >= 0 and line.startswith('"', j + 1):
                j += 2
            if j < 0 or (j + 1 < n and line[j + 1] != delimiter):
                return None
            out.append(line[i + 1 : j].replace('""', '"'))
            if j + 1 == n:
                return out
            i = j + 2
        else:
            j = line.find(delimiter, i)
            if j < 0:
                return [*out, line[i:]]
            out.append(line[i:j])
            i = j + 1


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records cut by the quoting rules; one without a quote is split at once. One pass serves both, as the table is read once."""
    for b in batches:
        fields = [split_record(line, d or ",") for line, d in zip(b.column("raw_line").to_pylist(), b.column("delimiter").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("line_id"), b.column("file_id"), pa.array(fields, pa.list_(pa.string()))], names=["line_id", "file_id", "cells"])


def file_layouts(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, delimiter, n_columns, places MAP<STRING,INT>): where each known field stands in a file's records."""
    headers = files.select("file_id", "delimiter", F.expr("split(header_line, concat('\\\\Q', delimiter, '\\\\E'), -1)").alias("headers"))
    cells = headers.select("file_id", "delimiter", F.size("headers").alias("n_columns"), F.posexplode("headers").alias("place", "header"))
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}]+$", "")))
    known = aliases.select(key(F.col("alias_name")).alias("header"), "field").distinct()
    named = cells.withColumn("header", key(F.col("header"))).join(known, "header", "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "place"))))
    first = F.filter(pairs, lambda x: ~F.exists(pairs, lambda y: (y["field"] == x["field"]) & (y["place"] < x["place"])))
    return named.groupBy("file_id", "delimiter", "n_columns").agg(F.map_from_entries(first).alias("places"))


def load_records(lines: DataFrame, files: DataFrame, aliases: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(line_id, reason, price_raw and the fields): each record cut into its file's fields, with a structural reason.

    reason is 'quoting', 'column_count' or null. A null line counts as an empty one; a line of an unknown file
    has the reason 'column_count', as there is no header to agree with.
    """
    keep = keep or ["sku", "name", "price", "currency", "description", "brand", "qty"]
    layout = file_layouts(files, aliases)
    rows = lines.select("line_id", "file_id", F.coalesce("raw_line", F.lit("")).alias("raw_line")).join(files.select("file_id", "delimiter"), "file_id", "left")
    cut = rows.select("line_id", "file_id", "raw_line", "delimiter").mapInArrow(_split, "line_id long, file_id long, cells array<string>")
    cut = cut.join(layout.drop("delimiter"), "file_id", "left")
    reason = F.when(F.col("cells").isNull(), "quoting").when(F.col("n_columns").isNull() | (F.size("cells") != F.col("n_columns")), "column_count")
    cut = cut.withColumn("reason", reason)
    place = lambda f: F.when(F.col("reason").isNull() & F.col("places")[f].isNotNull(), F.col("cells")[F.col("places")[f]])
    return cut.select("line_id", "file_id", "reason", *(place(f).alias(f) for f in keep))


def judged_values(df: DataFrame, column: str, typed: Column, reason: Column) -> DataFrame:
    """(value, typed, why): the dictionary of a column's values, each distinct one cast and judged once."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.select("value", typed.alias("typed"), reason.alias("why"))


def invalid_values(df: DataFrame, column: str, reason: Column) -> DataFrame:
    """(value, why): the dictionary of a column's invalid values; each distinct value is cast once."""
    return judged_values(df, column, F.lit(None), reason).where("why IS NOT NULL").drop("typed")


def quantity_reason(c: Column) -> Column:
    """Why a quantity isn't a whole number: 'not_a_number', 'not_whole'; null if it is one or blank, which a quantity may be."""
    n = F.trim(c).try_cast("double")
    return F.when(~is_blank(c), F.when(n.isNull(), "not_a_number").when(F.trim(c).try_cast("long").isNull(), "not_whole"))


def judged_records(lines: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """load_records() with price_value and the first reason that holds: 'quoting', 'column_count', 'value' or null.

    The dictionary of prices, each cast and judged once, is joined to the sound rows; adaptive execution splits a
    price that many rows share. Rows with a structural reason have no price and don't enter the join.
    """
    rows = stored(load_records(lines, files, aliases), "records")
    sound, broken = rows.where("price IS NOT NULL"), rows.where("price IS NULL")
    prices = judged_values(sound, "price", amount(F.col("value")), amount_reason(F.col("value"))).withColumnsRenamed({"value": "price", "typed": "price_value"})
    sound = sound.join(prices, "price").withColumn("reason", F.coalesce("reason", F.when(is_blank(F.col("sku")) | is_blank(F.col("name")) | F.col("why").isNotNull(), "value"))).drop("why")
    return sound.unionByName(broken.withColumn("price_value", F.lit(None).cast("double")).withColumn("reason", F.coalesce("reason", F.lit("value"))))


def bad_records(lines: DataFrame, files: DataFrame, aliases: DataFrame, sample: DataFrame) -> DataFrame:
    """(tbl, row_key, reason): each bad record of price_line and each bad price of sample_raw.

    Empty tables give no rows; clashing column names in the inputs are not read.
    """
    lines_bad = judged_records(lines, files, aliases).where("reason IS NOT NULL").select(F.lit("price_line").alias("tbl"), F.col("line_id").cast("string").alias("row_key"), "reason")
    prices = sample.select(F.col("id_internal").alias("row_key"), F.col("price").cast("string").alias("price"))
    bad = invalid_values(prices, "price", amount_reason(F.col("value"))).withColumnRenamed("value", "price")
    sample_bad = prices.join(bad, "price", "left").where("price IS NULL OR why IS NOT NULL").select(F.lit("sample_raw").alias("tbl"), "row_key", F.lit("value").alias("reason"))
    return lines_bad.unionAll(sample_bad)


def valid_records(lines: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """The other records as typed rows: line_id, file_id, sku, name, price DOUBLE, currency, description, brand, qty BIGINT, qty_reason.

    A quantity that isn't a whole number doesn't make a record bad; qty is null there and qty_reason says why.
    """
    rows = stored(judged_records(lines, files, aliases).where("reason IS NULL"), "valid")
    known = judged_values(rows, "qty", F.trim("value").try_cast("long"), quantity_reason(F.col("value"))).withColumnsRenamed({"value": "__qty", "typed": "__typed", "why": "qty_reason"})
    rows = rows.join(known, F.col("qty") == F.col("__qty"), "left")
    return rows.select("line_id", "file_id", "sku", "name", F.col("price_value").alias("price"), "currency", "description", "brand", F.col("__typed").alias("qty"), "qty_reason")
