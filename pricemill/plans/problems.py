"""Queries of the core's data problems, with their parameters as in production."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bad_rows import amount, amount_reason, bad_records, invalid_values, valid_records
from ..operators.packed_fields import choose_dialects, unpack_fields
from ..operators.price_units import rates, to_kopiykas, with_unit
from ..operators.schema_drift import column_changes, consistent_rows, field_lifespans, type_lifespans
from ..operators.unit_hmm import decode_units
from ..session import table
from .problem_sql import SQL as SQL

LIST_FIELDS = ["images_extra_urls", "tags", "compatibility"]


def p1_found(spark, sf_dir):
    out = unpack_fields(table(spark, sf_dir, "sample_raw"), "id_internal", LIST_FIELDS)
    return out.withColumnRenamed("id", "id_internal")


def p1_dialects(spark, sf_dir):
    """How many fields of each kind are written in each dialect."""
    chosen = choose_dialects(table(spark, sf_dir, "sample_raw"), "id_internal", LIST_FIELDS)
    return chosen.groupBy("field", "dialect").agg(F.count("*").alias("n_fields"), F.sum(F.size("vals")).cast("long").alias("n_values"))


def _price_files(spark, sf_dir):
    return [table(spark, sf_dir, t) for t in ("price_line", "price_file", "column_alias")]


def p4_found(spark, sf_dir):
    return bad_records(*_price_files(spark, sf_dir), table(spark, sf_dir, "sample_raw"))


def p4_loaded(spark, sf_dir):
    return valid_records(*_price_files(spark, sf_dir))


def p4_sample_prices(spark, sf_dir):
    """Prices of sample_raw as numbers, null where they aren't one amount."""
    return table(spark, sf_dir, "sample_raw").select("id_internal", amount(F.col("price")).alias("price"))


def p4_invalid_values(spark, sf_dir):
    """The dictionary of invalid prices of sample_raw with reasons."""
    return invalid_values(table(spark, sf_dir, "sample_raw"), "price", amount_reason(F.col("value")))


def p5_found(spark, sf_dir):
    return to_kopiykas(table(spark, sf_dir, "product"), table(spark, sf_dir, "fx_rate"))


def p5_units(spark, sf_dir):
    """How many prices are recorded in each unit, and what says so."""
    rows = with_unit(table(spark, sf_dir, "product")).where("price IS NOT NULL")
    return rows.groupBy("unit_code", "unit_factor", "said").agg(F.count("*").alias("n"))


#: Kinds of goods, whose median price is the level that the model compares with.
KINDS = "(телефон|смартфон|phone|чохол|накладка|cover|case|кабель|cable|ssd|кава|coffee|монітор|дисплей|monitor|display|чайник|kettle|батарея|battery|bank)"


def p5_decoded(spark, sf_dir):
    """Units decoded by the hidden Markov model, a supplier being the device, beside the recorded ones.

    The model is fitted on the rows with a filled currency. A filled currency fixes the unit; where none is, the decoded unit shows what the method makes of the price.
    """
    rows = with_unit(table(spark, sf_dir, "product")).where("price > 0 AND NOT isnan(price)")
    rows = rows.withColumn("unit", F.concat_ws(" x ", "unit_code", F.col("unit_factor").cast("string"))).withColumn("kind", F.regexp_extract(F.lower(F.concat_ws(" ", "name", "sku")), KINDS, 1))
    fx = {r.code: r.rate for r in rates(table(spark, sf_dir, "fx_rate")).collect()}  # a small fixed table
    units = {f"{c} x {f}": x * f for c, x in sorted(fx.items()) for f in (0.01, 1.0, 1000.0)}
    worth = F.create_map(*(F.lit(x) for k, v in units.items() for x in (k, v)))
    level = rows.where("said = 'currency'").groupBy("kind").agg(F.percentile_approx(F.log(F.col("price") * worth[F.col("unit")]), 0.5, 1000).alias("level"))
    rows = rows.join(F.broadcast(level), "kind", "left")  # a row for each of KINDS
    fixed = F.when(F.col("said") == "currency", F.col("unit"))
    out = decode_units(rows, "product_id", F.col("supplier"), F.col("loaded_at"), F.col("price"), units, F.col("level"), fixed)
    return out.join(rows.select("product_id", F.col("unit").alias("recorded"), "said"), "product_id")


def _feeds(spark, sf_dir):
    return [table(spark, sf_dir, t) for t in ("import_template", "feed_row", "column_alias")]


def p7_found(spark, sf_dir):
    return column_changes(*_feeds(spark, sf_dir))


def p7_lifespans(spark, sf_dir):
    return field_lifespans(*_feeds(spark, sf_dir))


def p7_types(spark, sf_dir):
    return type_lifespans(*_feeds(spark, sf_dir))


def p7_rows(spark, sf_dir):
    rows = consistent_rows(*_feeds(spark, sf_dir))
    return rows.withColumns({c: F.to_json(c) for c in ("others", "unfit")})


QUERIES = {"p1_found": p1_found, "p1_dialects": p1_dialects, "p4_found": p4_found, "p4_loaded": p4_loaded, "p4_sample_prices": p4_sample_prices, "p4_invalid_values": p4_invalid_values, "p5_found": p5_found, "p5_units": p5_units, "p5_decoded": p5_decoded, "p7_found": p7_found, "p7_lifespans": p7_lifespans, "p7_types": p7_types, "p7_rows": p7_rows}
