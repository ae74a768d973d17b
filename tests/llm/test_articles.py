import pytest

from pricemill.llm import articles
from pricemill.llm.articles import Brands, article_components, article_key, article_groups, parse, plain, same_article_pairs, trade_number, valid_gtin

BRANDS = Brands(["wexlario", "jorvello", "prandexo", "quentavi"])


def key(name, about=None, sku=None):
    return article_key(parse(sku, name, about, BRANDS))


@pytest.mark.parametrize(
    "a, b",
    [
        (("Смартфон Wexlario AB-1234S Lite", "1 ТБ. чорний колір. 8 ГБ ОЗП."), ("AB/1234s LITE phone 8GB RAM 1024 GB Jet Black", None)),
        (("Кабель Jorvello cd 1234 2 0,5 м Сірий 60Вт", None), ("Cable Jorvello CD-1234 2, 500 mm, Grey", "60 W")),
        (("Монітор Prandexo EF1234X 34″ 75Гц чорний", None), ("Display EF-1234X", "Brand: Prandexo. 86,4 см; 75 Hz; black")),
        (("Portable battery GH-1234 20 Ah 65W Red", None), ("Повербанк gh1234 20 000 мАг 65 Вт Червоний Акція!", None)),
        (("Чохол для Wexlario AB-1234S Quentavi KL-1234 Pro шкіряний Зелений", None), ("Cover for Йекларіо ab1234s Quentavi Hexor KL 1234 Pro leather Green", None)),
        (("Телефон MN-1234", "6 ГБ ОЗП", "MN1234-6-128-RED"), ("Phone MN-1234 red 128GB RAM 6 GB", None)),
        (("Електрочайник Vamazaro 1,7 л 2,2 кВт білого кольору", None), ("kettle vamazaro, 1700 ml (2200W) White", None)),
    ],
)
def test_same(a, b):
    assert key(*a) == key(*b) is not None


@pytest.mark.parametrize(
    "a, b",
    [
        ("SSD Wexlario AB-1234 Lite 1 TB", "SSD Wexlario AB-1234 1 TB"),
        ("SSD Wexlario AB-1234 1 TB", "SSD Wexlario AB-1234 2 TB"),
        ("SSD Wexlario AB-1234 2 2 TB", "SSD Wexlario AB-1234 2 TB"),
        ("Coffee AB-1234 200 g", "Coffee AB-1234 0.25 kg"),
        ("Case for AB-1234S KL-1234 TPU red", "Case for AB-1234T KL-1234 TPU red"),
    ],
)
def test_different(a, b):
    assert key(a) and key(b) and key(a) != key(b)


def test_incomplete_and_odd():
    assert key("Смартфон Wexlario AB-1234S", None) is None
    assert key(None, None) is None and key("", "x" * 100000) is None
    assert plain("30 А·год") == "30 агод"
    assert BRANDS.of("йекларіо") == "wexlario" and BRANDS.of("корвелло") == "jorvello" and BRANDS.of("чайник") is None


def test_trade_numbers():
    assert valid_gtin("4006381333931") and not valid_gtin("4006381333932") and not valid_gtin("123")
    assert trade_number("x EAN: 4006381333931") == "04006381333931" and trade_number("EAN 4006381333932") is None


def test_components(spark):
    full = "Смартфон Wexlario AB-1234S Lite 1 ТБ чорний 8 ГБ ОЗП"
    rows = [
        (1, "a-1", full, None, "s1"), (2, "b-1", "phone ab1234s lite 8GB RAM 1 TB black", "Brand: Wexlario", "s2"), (3, "c-1", full, None, None), (4, "a-1", full.replace(" ", ""), None, "s3"),
        (5, "d", "Смартфон Wexlario AB-1234S Lite 1 ТБ білий 8 ГБ ОЗП", None, "s4"), (6, None, None, None, "s5"), (7, full, "z-9", None, "s6"), (8, "a-9", full, None, "s1"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "product_id long, sku string, name string, description string, supplier string, component string")
    pairs = {tuple(r) for r in same_article_pairs(df).collect()}
    assert pairs == {(1, 2), (1, 4), (1, 7), (2, 4), (2, 7), (2, 8), (4, 7), (4, 8), (7, 8)}
    groups = {r.product_id: r.group_id for r in article_groups(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 7: 1, 8: 1}
    assert same_article_pairs(df.limit(0)).count() == 0


def test_two_brands_split(spark):
    rows = [(1, None, "SSD ZZ-1234 1 TB", "Brand: Wexlario", "a"), (2, None, "SSD ZZ-1234 1 TB", "Brand: Jorvello", "b"), (3, None, "SSD ZZ-1234 1024 GB", "Brand: Wexlario", "c"), (4, None, "SSD ZZ-1234 1 TB", None, "d")]
    df = spark.createDataFrame(rows, "product_id long, sku string, name string, description string, supplier string")
    assert {tuple(r) for r in same_article_pairs(df).collect()} == {(1, 3)}
    assert article_components(df).count() == 3


def _pairs(spark, rows):
    df = spark.createDataFrame(rows, "product_id long, sku string, name string, description string, supplier string")
    return {tuple(r) for r in same_article_pairs(df).collect()}


def test_listings_without_a_complete_one(spark):
    """No listing states the colour, or is of a known kind: a trade number or a copy joins them all the same."""
    ean = "EAN: 4006381333931"
    rows = [(1, "x-1", "Phone AB-1234 8 GB RAM 128 GB", ean, "a"), (2, "y-1", "Смартфон AB1234 128GB", ean, "b"), (3, "z-1", "Garden hose", "EAN 96385074", "a"), (4, "z-2", "Шланг садовий", "ean: 96385074", "b")]
    rows += [(5, "q-7", "Blue hammer", None, "a"), (6, "q 7", "BLUE hammer!", None, "b"), (7, None, None, None, "a"), (8, None, None, None, "b"), (9, None, "Hammer", None, "a"), (10, None, "Hammer", None, "b")]
    assert _pairs(spark, rows) == {(1, 2), (3, 4), (5, 6)}


def test_listing_over_an_incomplete_one(spark):
    """3 shares no identifier with 1, but 2 does with both."""
    ean = "EAN: 4006381333931"
    rows = [(1, "x-1", "SSD Wexlario AB-1234 1 TB", ean, "a"), (2, "y-1", "SSD Wexlario AB-1234", ean, "b"), (3, "y-1", "SSD Wexlario, AB-1234", None, "c"), (4, "y-1", "ssd wexlario ab 1234", "2 TB", "d")]
    assert _pairs(spark, rows[:3]) == {(1, 2), (1, 3), (2, 3)}
    assert _pairs(spark, rows) == {(1, 2), (3, 4)}  # the nearer complete listing has the copy


def test_guard_of_stated_properties(spark):
    ean = "EAN: 4006381333931"
    red, black = (1, "x-1", "Phone AB-1234 red", ean, "a"), (2, "y-1", "Phone AB-1234 black", ean, "b")
    assert _pairs(spark, [red, black]) == set()
    assert _pairs(spark, [red, black, (3, "z-1", "Phone AB-1234 black 8 GB RAM 128 GB", ean, "c")]) == {(2, 3)}
    other = (4, "q-1", "Phone AB-1234 red", "EAN 96385074", "c")
    assert _pairs(spark, [red, other, (5, "q-2", "Phone AB-1234", ean, "d")]) == {(1, 5)}


def test_edition_from_a_trade_number(spark):
    ean = "EAN: 4006381333931"
    rows = [(1, "x-1", "SSD AB-1234 Lite 1 TB", ean, "a"), (2, "x-2", "SSD AB-1234 1 TB", ean, "b"), (3, "y-1", "SSD AB-1234 1 TB", None, "c")]
    assert _pairs(spark, rows) == {(1, 2)}


def test_part_number_without_edition():
    """KEKANIGO-3-60-RED is 3 m long, not the third edition."""
    assert key("cable kekanigo", None, "KEKANIGO-3-60-RED") == key("Cable Kekanigo 3 m 60 W red") == "cable|kekanigo||3000|60|red"
    assert key("cable kekanigo", None, "KEKANIGO-3-2-60-RED") == "cable|kekanigo|3|2000|60|red"


def test_real_wording(spark):
    """Models that are neither codes nor coined names: what follows the brand, if two sellers name it so."""
    brand = "Brand: {}."
    rows = [
        (1, "1", "Samsung 990 PRO SSD 1TB", brand.format("Samsung"), "a"), (2, "x", "Накопичувач SSD Samsung 990 Pro, 1024 ГБ", None, "b"), (3, "y", "SSD Samsung 990 Pro 2TB", brand.format("Samsung"), "c"),
        (4, "1", "Apple iPhone 15 Pro 128GB Black smartphone", brand.format("Apple"), "a"), (5, "2", "Смартфон Apple iPhone 15 Pro, чорний, 128 ГБ", None, "b"), (6, "3", "Apple iPhone 15 128GB black phone", brand.format("Apple"), "c"),
        (7, "4", "Sony WH-1000XM5, black", brand.format("Sony"), "a"), (8, "5", "Навушники Sony WH-1000XM5 чорний колір", None, "b"), (9, "6", "Sony WH-1000XM5 blue", brand.format("Sony"), "c"),
        *((20 + i, f"z{i}", f"Thing {i}", brand.format(b), "d") for i, b in enumerate(["Samsung", "Samsung", "Apple", "Apple", "Sony", "Sony"])),
    ]
    assert _pairs(spark, rows) == {(1, 2), (4, 5), (7, 8)}


def test_equal_trade_numbers_join_whatever_the_wording(spark):
    a, b = "EAN: 4006381333931", "штрихкод 4006381333931"
    rows = [(1, "1", "Thing in a box", a, "a"), (2, "2", "Zovsim insha nazva", b, "b"), (3, "3", "Third", "EAN: 96385074", "c")]
    assert _pairs(spark, rows) == {(1, 2)}


def test_brands_beyond_the_book(spark, monkeypatch):
    """The book's size changes no result where brands are written in Latin letters."""
    rows = [(i, f"s{i}", f"SSD {b} 990 Pro 1TB", f"Brand: {b}" if i % 2 else None, f"shop{i}") for i, b in enumerate(["wexlario", "jorvello", "prandexo"] * 6)]
    want = _pairs(spark, rows)
    assert len(want) == 3 * 15
    monkeypatch.setattr(articles, "MOST_BRANDS", 1)
    assert _pairs(spark, rows) == want


def test_many_listings_of_one_seller(spark):
    """A seller's listings of one article meet other sellers' only."""
    rows = [(i, f"a{i}", "SSD Wexlario AB-1234 1 TB", None, "big") for i in range(300)] + [(900, "b", "SSD AB-1234 1024 GB", None, "small"), (5000, "c", "SSD AB-1234 1024 GB", None, None)]
    assert _pairs(spark, rows) == {(i, 900) for i in range(300)}
