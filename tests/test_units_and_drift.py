import json

import pytest

from pricemill.operators.price_units import to_kopiykas, with_unit
from pricemill.operators.schema_drift import column_changes, consistent_rows, field_lifespans

COLUMNS = "product_id long, price double, currency string, name string, description string, sku string, unit_code string"


def _products(spark, rows):
    return spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], COLUMNS)


def test_units(spark):
    rows = [
        (10.0, "USD", "x (грн)", None, None), (10.0, " ", "x", "Ціна в гривнях. Shipping 3 EUR", None), (10.0, None, "x", "Доставка 90 грн", None), (10.0, None, "x (коп.)", None, None),
        (2.0, "тис. грн", "x", None, None), (100.0, "HUF", "x", None, None), (50.0, "євроцент", "x", None, None), (None, "USD", "x", None, None), (1.0, "XYZ", "x", None, None), (3.0, None, None, None, "y price in thousands of UAH"),
        (7.0, "", "найкраща ціна 5 грн", None, None), (200.0, None, "x", "price quoted in US cents", None), (1.0, None, "x", "ціна, € Доставка 90 грн", None),
    ]
    fx = spark.createDataFrame([("UAH", 1, 1.0), ("USD", 1, 40.0), ("EUR", 1, 44.0), ("HUF", 100, 11.0)], "currency_code string, nominal long, rate_uah double")
    got = dict(map(tuple, to_kopiykas(_products(spark, rows), fx).collect()))
    assert got == {0: 40000, 2: 40000, 3: 10, 4: 200000, 5: 1100, 6: 2200, 9: 300000, 10: 28000, 11: 8000, 12: 4400}


def test_units_empty_and_long(spark):
    fx = spark.createDataFrame([("USD", 1, 40.0)], "currency_code string, nominal long, rate_uah double")
    assert to_kopiykas(_products(spark, []), fx).count() == 0
    rows = with_unit(_products(spark, [(1.0, None, "слово " * 50000 + "Ціна в гривнях", "x" * 300000, None)])).collect()
    assert (rows[0].unit_code, rows[0].said) == ("UAH", "text")


T = "template_id long, supplier string, column_mapping map<string,string>, headers array<string>, saved_at timestamp, field string"


def _drift(spark, versions, feed):
    from datetime import datetime

    t = spark.createDataFrame([(i, s, m, h, datetime(2024, 1, d), None) for i, s, m, h, d in versions], T)
    f = spark.createDataFrame([(n, i, n, p if p is None or isinstance(p, str) else json.dumps(p)) for n, (i, p) in enumerate(feed)], "row_id long, template_id long, row_no long, payload string")
    a = spark.createDataFrame([("sku", "Артикул"), ("sku", "code"), ("price", "Ціна"), ("tags", "tags")], "field string, alias_name string")
    return t, f, a


def test_changes(spark):
    versions = [(5, "A ", {"price": "Ціна"}, ["Артикул", "Ціна", "junk"], 1), (2, "a", {"qty": "Шт"}, [" АРТИКУЛ", "Шт", None], 3), (9, "a", {}, ["code", "Ціна"], 5), (4, "b", {"qty": "x"}, ["code"], 2), (7, "B", None, ["code"], 3)]
    feed = [(5, {"Артикул": "q", "Ціна": 5}), (2, {" АРТИКУЛ": 7, "Шт": None}), (9, {"code": 8, "Ціна": "5"}), (9, "not json"), (9, None), (9, "[1]")]
    tables = _drift(spark, versions, feed)
    got = {tuple(r) for r in column_changes(*tables).collect()}
    assert got == {(2, "price", "removed"), (2, "qty", "added"), (2, "sku", "retyped"), (9, "qty", "removed"), (9, "price", "added"), (9, "sku", "renamed")}
    spans = {(r.supplier_key, r.field, r.island, r.n_versions) for r in field_lifespans(*tables).collect()}
    assert ("a", "price", 2, 1) in spans and ("a", "sku", 1, 3) in spans and ("b", "sku", 1, 2) in spans


def test_consistent_rows(spark):
    tables = _drift(spark, [(1, "a", {"qty": "шт"}, ["code", "Ціна", "tags", "шт"], 1)], [(1, {"code": 7, "Ціна": "1 200,5 грн", "tags": ["x", "y"], "шт": "z"}), (1, "broken"), (3, {"code": 1})])
    rows = {r.row_id: r for r in consistent_rows(*tables).collect()}
    assert (rows[0].sku, rows[0].price, rows[0].tags, rows[0].others) == ("7", 1200.5, "x; y", {"qty": "z"})
    assert rows[1].sku is None and rows[2].sku is None and len(rows) == 3


def test_drift_empty(spark):
    tables = _drift(spark, [], [])
    assert column_changes(*tables).count() == 0
    assert consistent_rows(*tables).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p5_found", "p7_found"])
def test_queries_run(spark, sf, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, sf).count() > 0
