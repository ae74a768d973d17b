import pytest
from pyspark.sql import functions as F

from pricemill.operators.bad_rows import amount, amount_reason, bad_records, split_record, valid_records

GOOD = {"1200": 1200, "1 200,50": 1200.5, "1.200,50": 1200.5, "1,200.50": 1200.5, "−5": -5, "$12.5": 12.5, "12.5 $": 12.5, "1 200,50 грн.": 1200.5, "+7": 7, "0": 0, "1'234'567,8": 1234567.8, "грн 5": 5, "-$5": -5, "1 234": 1234, " 7\t": 7, "1.234.567": 1234567}
BAD = ["abc", "100-200", "1,2,3,4", "7100..5", "0x539", "4O3", "1 20", "5 5 $ 6", "NaN", "$", "12?", "2024-03-12", "$5 грн", "1 200 300,", "від 5"]


def test_amounts(spark):
    df = spark.createDataFrame([(t,) for t in [*GOOD, *BAD, "", "  ", None]], "t string")
    got = {r.t: (r.why, r.v) for r in df.select("t", amount_reason(F.col("t")).alias("why"), amount(F.col("t")).alias("v")).collect()}
    for t, v in GOOD.items():
        assert got[t] == (None, pytest.approx(v)), t
    for t in BAD:
        assert got[t] == ("not_an_amount", None), t
    assert got[""][0] == got["  "][0] == got[None][0] == "blank"


@pytest.mark.parametrize("line, cells", [('a,"b ""x"", c",d', ["a", 'b "x", c', "d"]), ('a,5" x 3",', ["a", '5" x 3"', ""]), ('a,"b', None), ('"a" b,c', None), ('"a "b" c",d', None), ("", [""]), ('""', [""]), ('"x\ny",z', ["x\ny", "z"]), (",", ["", ""])])
def test_records(line, cells):
    assert split_record(line, ",") == cells


def test_long_record():
    assert split_record('"' + '""' * 100000 + '",x', ",")[1] == "x"


def _tables(spark, lines):
    files = spark.createDataFrame([(1, ";", "Артикул;name;Ціна", 5), (2, "|", "price|sku|name", 6)], "file_id long, delimiter string, header_line string, reason int")
    aliases = spark.createDataFrame([("sku", " артикул"), ("sku", "sku"), ("name", "Name"), ("price", "ціна"), ("price", "price")], "field string, alias_name string")
    return spark.createDataFrame(lines, "line_id long, file_id long, raw_line string, price string"), files, aliases


def test_reasons(spark):
    lines = [(1, 1, "a;b;1,5", None), (2, 1, 'a;"b;1', None), (3, 1, "a;b", None), (4, 1, "a; ;1", None), (5, 2, "x|a|b", None), (6, 2, "2 €|a|b", None), (7, 1, None, None), (8, 9, "a;b;1", None), (9, 1, '"a"x;b', None), (1, 1, "a;b;1,5", None)]
    sample = spark.createDataFrame([("s1", "5"), ("s2", "abc"), ("s3", None), ("s4", "abc")], "id_internal string, price string")
    tables = _tables(spark, lines)
    got = {(r.tbl, r.row_key): r.reason for r in bad_records(*tables, sample).collect()}
    assert got == {("price_line", "2"): "quoting", ("price_line", "3"): "column_count", ("price_line", "4"): "value", ("price_line", "5"): "value", ("price_line", "7"): "column_count", ("price_line", "8"): "column_count", ("price_line", "9"): "quoting", ("sample_raw", "s2"): "value", ("sample_raw", "s3"): "value", ("sample_raw", "s4"): "value"}
    loaded = [(r.line_id, r.price) for r in valid_records(*tables).collect()]
    assert sorted(loaded) == [(1, 1.5), (1, 1.5), (6, 2.0)]


def test_empty(spark):
    sample = spark.createDataFrame([], "id_internal string, price string")
    assert bad_records(*_tables(spark, []), sample).count() == 0


def test_quantities_and_quotes_inside(spark):
    """A quantity that isn't whole keeps its record and says why; delimiters that are patterns elsewhere split plainly."""
    files = spark.createDataFrame([(1, "|", "sku|name|price|qty")], "file_id long, delimiter string, header_line string")
    aliases = spark.createDataFrame([(f, f) for f in ("sku", "name", "price", "qty")], "field string, alias_name string")
    lines = [(1, 1, "a|n|1|3"), (2, 1, "a|n|1|3.5"), (3, 1, "a|n|1|many"), (4, 1, "a|n|1| "), (5, 1, 'a|"n|m"|1|7'), (6, 1, 'a|n 5" x|1|8')]
    got = {r.line_id: (r.name, r.qty, r.qty_reason) for r in valid_records(spark.createDataFrame(lines, "line_id long, file_id long, raw_line string"), files, aliases).collect()}
    assert got == {1: ("n", 3, None), 2: ("n", None, "not_whole"), 3: ("n", None, "not_a_number"), 4: ("n", None, None), 5: ("n|m", 7, None), 6: ('n 5" x', 8, None)}
