"""Queries beside their SQL on the smallest tables: the same columns and the same rows."""

import glob
import os

import duckdb
import pytest

from pricemill.operators import matching
from pricemill.plans import catalogue

NAMES = ["import_bronze", "import_gold", "read_back_csv", "read_back_json", "read_back_xlsx", "read_back_xml", "market_xml", "repository_lists", "review_states", "catalogue_sheet", "event_log", "tag_board", "tag_review", "board_sort", "group_order", "leftover_order", "match_candidates", "offer_lists", "synonym_replace", "p4_loaded", "p7_types"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def _text(v) -> str:
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = df.select(*(f"`{c}`" for c in columns)).collect()
    assert rows
    assert sorted(tuple(map(_text, r)) for r in rows) == sorted(tuple(map(_text, r)) for r in want.fetchall())


def test_board_sorts_by_known_columns_only():
    with pytest.raises(ValueError):
        matching.board_order("weight")
