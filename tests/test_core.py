import io
import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricemill.operators.model_matcher import Lexicon, model_pattern
from pricemill.functions import text as T
from pricemill.operators import channel, compare, matching, medallion, search, tagging
from pricemill.sources import export, ingest, manifest
from pricemill.sources.xlsx import read_sheet


def one(spark, c, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(c.alias("x")).first().x


@pytest.mark.parametrize("raw, value", [("1200", 1200), ("1 200,50", 1200.5), ("1.200,50", 1200.5), ("1,200.50", 1200.5), ("1,200,300", 1200300), ("1.200.300", 1200300), ("−5", -5), ("100-200", 100200), ("$12.5", 12.5), ("1 200,50 грн.", 120050), ("abc", None), ("1.2,3,4", None)])
def test_price_parse(spark, raw, value):
    assert one(spark, T.parse_price("t"), t=raw) == value


def test_text(spark):
    assert one(spark, T.words("a", "b"), a="Red ½ red", b="Чорний_1") == ["red", "½", "чорний_1"]
    assert one(spark, T.utrim("a"), a="  x \t") == "x"
    assert one(spark, T.split_tags("a"), a=" A;b ;;a") == ["a", "b"]
    assert one(spark, T.split_tags_keep_case("a"), a="One, one\ntwo;TWO") == ["One", "two"]
    assert one(spark, T.normalise_synonyms("a", {"phone": ["смартфон"]}), a=" Смартфон X ") == "phone x"
    assert one(spark, T.normalise_synonyms("a", {"phone": ["смартфон"]}, strict=True), a=" Смартфон X ") == "смартфон x"
    assert one(spark, T.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0
    assert [one(spark, T.truthy("a"), a=v) for v in ("Yes", "1.0", "0", "no", None)] == [True, True, False, False, False]
    assert one(spark, T.price_label("a"), a=1234567.5) == "1 234 567.50"
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    ages = [one(spark, T.age_label(F.lit(t).cast("timestamp"), now)) for t in ("2024-02-29 23:59:30", "2024-02-29 22:30:00", "2024-02-27 00:00:00", None)]
    assert ages == ["щойно", "1 год 30 хв тому", "3 дні тому", "—"]


def offers(spark):
    rows = [("ABC-001", "Lenovo ThinkPad X1", 1200.0, '14" business laptop', "a"), ("ABC-002", "Dell UltraSharp 27", 450.0, '27" monitor', "a"), ("ABC-001", "ThinkPad X1 Carbon Gen 9", 1150.0, "Lightweight ultrabook", "b"), ("ABC-003", "HP LaserJet Pro", 300.0, "Laser printer", "b")]
    return spark.createDataFrame(rows, "sku string, name string, price double, description string, supplier string")


def test_compare(spark):
    df = offers(spark)
    assert [r.price for r in compare.compare_by_sku(df, " abc-001").collect()] == [1150, 1200]
    best = {r.sku: (r.best_price, r.name) for r in compare.best_offers(df).collect()}
    assert best["ABC-001"] == (1150, "Lenovo ThinkPad X1") and best["ABC-003"][0] == 300


def test_keyword_tags(spark):
    rows = offers(spark).select("sku", "supplier", tagging.keyword_tags(F.concat_ws(" ", "name", "description"), tagging.KEYWORD_RULES).alias("t")).collect()
    assert {(r.sku, r.supplier): r.t for r in rows} == {("ABC-001", "a"): ["laptop"], ("ABC-001", "b"): ["laptop"], ("ABC-002", "a"): ["display"], ("ABC-003", "b"): ["printer"]}


def test_search(spark):
    none = F.array().cast("array<string>")
    df = offers(spark).select("*", T.haystack("sku", "name", "description", none).alias("haystack"), T.words("sku", "name", "description").alias("tokens"))
    assert [r.sku for r in search.search(df, "laser printer").collect()] == ["ABC-003"]
    assert [r.supplier for r in search.search(df, "ABC-001", supplier="B").collect()] == ["b"]
    assert [r.sku for r in search.search(df, "thinkpda", fuzzy=True).collect()] == ["ABC-001", "ABC-001"]
    assert search.search(df, " ").count() == 0
    case = spark.createDataFrame([("CASE-S23", "TPU чохол Bonbon Metal Style with MagSafe для Samsung Galaxy S23", 10.0, "s", None)], "sku string, name string, price double, supplier string, description string")
    case = case.select("*", T.haystack("sku", "name", "description", none).alias("haystack"), T.words("sku", "name").alias("tokens"))
    assert search.search(case, "Samsung S23").count() == 1


@pytest.mark.parametrize(
    "name, models, want, never",
    [
        ("TPU чохол Bonbon Metal Style with MagSafe для Samsung Galaxy S23", [("Samsung", "S23")], {"Samsung", "S23"}, None),
        ("Чохол для Xiaomi Redmi 10X 5G /10X Pro 5G", [("Xiaomi", "Redmi 10X 5G"), ("Xiaomi", "Redmi 10X Pro 5G"), ("Xiaomi", "Redmi 10")], {"Redmi 10X 5G", "Redmi 10X Pro 5G"}, "Redmi 10"),
        ("Чохол для Apple iPhone 15 Pro Max", [("Apple", "iPhone 15 Pro"), ("Apple", "iPhone 15 Pro Max")], {"iPhone 15 Pro Max"}, "iPhone 15 Pro"),
        ("Чохол Xiaomi Redmi Note 7 / Note 7 Pro / Note 7s", [("Xiaomi", "Redmi Note 7"), ("Xiaomi", "Redmi Note 7 Pro"), ("Xiaomi", "Redmi Note 7S")], {"Redmi Note 7", "Redmi Note 7 Pro", "Redmi Note 7S"}, None),
        ("Чохол Xiaomi Redmi Note 7 / Note 7 Pro", [("Xiaomi", "Pad 7 Pro"), ("Xiaomi", "Redmi Note 7 Pro")], {"Redmi Note 7 Pro"}, "Pad 7 Pro"),
    ],
)
def test_models(name, models, want, never):
    got = set(Lexicon([{"brand": b, "name": m, "tags": [b, m]} for b, m in models]).of(name))
    assert want <= got and never not in got


def test_model_pattern():
    p = re.compile(model_pattern("Samsung", "Galaxy S23 FE"), re.I)
    assert p.search("Samsung GalaxyS23FE") and p.search("Samsung Galaxy-S23 FE") and not p.search("Samsung Galaxy S23 FEX")


def test_layers(spark):
    raw = spark.createDataFrame([("1", " A  b c ", "12.5", None, " UAH "), ("2", "x", "0", "3", None), ("3", "x", None, "3", None), ("4", None, "bad", "1", None)], "sku string, name string, price string, qty string, currency string")
    rows = medallion.bronze(raw, "s").collect()
    assert [(r.name_clean, r.price, r.qty, r.currency, r.brand_norm, r.supplier) for r in rows] == [("A b c", 12.5, 0, "uah", None, "s")]
    silver = spark.createDataFrame([("1", "s", None, 2.0), ("2", "t", None, 4.0), ("1", "t", "b|n", 4.0)], "sku string, supplier string, pid_raw string, price double")
    assert {r.pid_raw: (r.sku_count, r.supplier_count, r.avg_price) for r in medallion.gold(silver).collect()} == {None: (2, 2, 3.0), "b|n": (1, 1, 4.0)}
    assert medallion.gold(silver.limit(0)).count() == 0


def test_matching_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(12)]
    store = [(i, f"S{i % 5}", " ".join(rnd.sample(vocab, 3)), 1.0) for i in range(12)]
    sup = [(f"sup{i % 3}", f"S{i % 7}", " ".join(rnd.sample(vocab, 3)), float(rnd.randint(1, 9))) for i in range(60)]
    s = matching.token_sets(spark.createDataFrame(store, "store_id long, sku string, name string, price double"), matching.default_tokens("name", "sku"))
    o = matching.token_sets(spark.createDataFrame(sup, "supplier string, sku string, name string, price double"), matching.default_tokens("name", "sku"))
    got = {(r.store_id, r["rank"]): (round(r.similarity, 9), r.price) for r in matching.top_matches(s, o, 0.3, 4).collect()}
    want = {}
    for i, k, n, _ in store:
        a = {*n.split(), k.lower()}
        scored = sorted((-(1.0 if x[1].lower() == k.lower() else len(a & b) / len(a | b)), x[3], x[0], x[1], x[2]) for x in sup for b in [{*x[2].split(), x[1].lower()}])
        for r, x in enumerate([x for x in scored if -x[0] >= 0.3][:4], 1):
            want[i, r] = (round(-x[0], 9), x[1])
    assert got == want


def test_state(spark):
    rows = spark.createDataFrame([("g", "m1", 1.0), ("g", "m2", 0.5), ("g", "m3", 0.5)], "group_id string, match_id string, similarity double")
    state = spark.createDataFrame([("g", "m3", "removed"), ("g", "gone", "confirmed")], "group_id string, match_id string, status string")
    assert {r.match_id: r.status for r in matching.with_state(rows, state).collect()} == {"m1": "confirmed", "m2": "pending"}
    assert [r.match_id for r in matching.prune_state(state, rows).collect()] == ["m3"]


def test_channel_and_market_xml(spark, tmp_path):
    from xml.etree import ElementTree

    cols = "id_internal string, brand string, model string, device_type string, price string, currency string, availability string, images_main_url string, images_extra_urls string, channel_exclude string"
    extra = ",".join(f"e{i}" for i in range(25))
    raw = spark.createDataFrame([("1", "Apple", "iPhone & X", "Смартфон", "123,45", "usd", "in_stock", "m", "a|b, c", None), ("2", None, "Galaxy", "", "200", None, "preorder", None, None, "0"), ("3", None, None, None, "0", None, None, None, None, None), ("4", "B", "M", None, "50", None, None, "m", extra, ""), ("5", "B", "M", None, "50", None, None, "m", None, "Yes")], cols)
    staged, rows, paths = export.run_export(raw, str(tmp_path), ["csv", "xml", "xlsx"], now=datetime(2024, 1, 2, 3, 4))
    got = {r.ID: r for r in rows.collect()}
    assert list(rows.columns) == list(channel.CHANNEL) and len(staged.columns) == 31
    assert (got["1"]["Назва товару"], got["2"]["Назва товару"], got["1"]["Валюта"], got["2"]["Валюта"]) == ("Apple iPhone & X — Смартфон", "Galaxy", "usd", "UAH")
    assert "5" not in got and got["1"]["Наявність"] == "В наявності"
    items = ElementTree.parse(paths["xml"]).findall(".//item")
    assert [len(i.findall("image")) for i in items] == [4, 0, 10]
    assert [(i.find("available").text, i.find("in_stock").text, i.find("priceuah").text) for i in items] == [("склад", "true", "123.45"), (None, "false", "200.00"), ("false", "false", "50.00")]
    assert items[0].find("name").text == "Apple iPhone & X — Смартфон"
    assert paths["csv"].endswith("prom_export_20240102_0304.csv")
    assert next(read_sheet(paths["xlsx"]))[:2] == ["ID", "Назва товару"]
    with pytest.raises(ValueError):
        export.run_export(raw, str(tmp_path), ["pdf"])


def test_market_xml_of_an_infinite_price(spark, tmp_path):
    """Written as the word that readers of numbers know, not as a sign that they fail on."""
    from pricemill.plans import file_queries

    rows = [("1", "1e400", "A"), ("2", "Infinity", "B"), ("3", "7", "C"), ("4", "2e15", "D")]
    raw = spark.createDataFrame(rows, "id_internal string, price string, brand string")
    _, _, paths = export.run_export(raw, str(tmp_path), ["xml"], now=datetime(2024, 1, 2, 3, 4))
    with open(paths["xml"], encoding="utf-8") as f:
        assert f.read().count("<priceuah>inf</priceuah>") == 2
    raw.write.parquet(str(tmp_path / "sample_raw.parquet"))
    assert [(r.id, r.priceuah) for r in file_queries.market_xml(spark, str(tmp_path)).collect()] == [("3", "7.00")]


def test_sources_round_trip(spark, tmp_path):
    csv = tmp_path / "acme.csv"
    csv.write_bytes('﻿Артикул;назва;ціна;Колір;tags\nA-1;"Two ""x""\nlines";1 200,50;red;B;x\nA-2;;5;;\nA-3;n;;;\nA-4;n;abc;;\n'.encode())
    got = {r.sku: r for r in ingest.load_offers(spark, str(csv)).collect()}
    assert set(got) == {"A-1", "A-4"} and got["A-1"].price == 1200.5 and got["A-1"].name == 'Two "x"\nlines' and got["A-1"].supplier == "acme" and got["A-1"].extra == {"Колір": "red"} and got["A-4"].bad_price == "abc"
    js = tmp_path / "j.json"
    js.write_text(json.dumps({"products": [{"SKU": 7, "Name": "n", "price": 5, "tags": ["x", "Y"], "extra": {"w": 1}}, "junk"]}))
    r = ingest.load_offers(spark, str(js)).collect()
    assert [(x.sku, x.price, x.tags, x.extra) for x in r] == [("7", 5.0, ["x", "y"], {"w": "1"})]
    xml = tmp_path / "x.xml"
    xml.write_text('<shop xmlns:a="u"><a:offer vendorCode="007"><name>n &amp; m</name><price>1,5</price><tags><tag>p</tag><tag>q</tag></tags><extra><w>1</w></extra></a:offer><a:offer vendorCode="8"><name>k</name><price>2</price></a:offer></shop>')
    got = {x.sku: x for x in ingest.load_offers(spark, str(xml)).collect()}
    assert got["007"].price == 1.5 and got["007"].tags == ["p", "q"] and got["007"].extra == {"w": "1"} and got["8"].name == "k"
    rows = ingest.load_offers(spark, str(js))
    for kind in ("csv", "json", "xml", "xlsx"):
        path = str(tmp_path / f"out.{kind}")
        export.export_offers(rows, path)
        back = ingest.load_offers(spark, path).collect()
        assert [(x.sku, x.name, x.price) for x in back] == [("7", "n", 5.0)], kind
    with pytest.raises(ValueError):
        ingest.load_offers(spark, str(tmp_path / "x.pdf"))
    all_, failed = ingest.load_batch(spark, [("s", str(csv)), ("t", str(tmp_path / "none.pdf"))])
    assert all_.count() == 2 and [f[0] for f in failed] == ["t"]


def test_json_list_is_read_as_a_stream(spark, tmp_path):
    """A list beyond the size of one Spark value is read whole; files that aren't JSON or hold no list are refused."""
    from pricemill.sources import json_products

    path = tmp_path / "long.json"
    with open(path, "w", encoding="utf-8") as f:
        f.write('\ufeff{"made": [{"sku": "no"}], "products": [')
        for i in range(140):
            f.write(("," if i else "") + json.dumps({"SKU": f"{i}", "sku": "second", "name": "}, {" + "ж" * 500000, "price": i + 1, "Extra": {"w": [1, "}"]}}, ensure_ascii=False))
        f.write('], "n": 1}')
    rows = ingest.load_offers(spark, str(path)).select("sku", "price", F.length("name").alias("n"), "extra").collect()
    assert sorted(map(tuple, rows)) == sorted((f"{i}", i + 1.0, 500004, {"w": "1;}"}) for i in range(140))
    text = '{"a": [1, {"products": [1]}], "products": [{"s": "x}\\"]", "p": 1.50}, "junk", 12, [1], {"u": "\\ud83d\\ude00é"}], "z": {"products": [{}]}}\n'
    for block in (1, 2, 3, 7, 64):
        json_products.BLOCK, before = block, json_products.BLOCK
        try:
            assert list(json_products.products(io.BytesIO(text.encode()))) == [None, '{"s": "x}\\"]", "p": 1.50}', '{"u": "\\ud83d\\ude00é"}']
        finally:
            json_products.BLOCK = before
    for bad in ("[]", '{"products": {"a": {"sku": 1}}}', '{"products": [{"sku": 1}', '{"products": [{"sku": 1} {"sku": 2}]}', '{"products": [{"sku": 1}]} x'):
        path.write_text(bad)
        with pytest.raises(ValueError, match="JSON|products"):
            ingest.read_rows(spark, str(path))


def test_headers():
    assert ingest.resolve_headers([" SKU", "Назва", "ціна", "x"], {"name": "X"}) == {"name": "x", "sku": " SKU", "price": "ціна"}
    with pytest.raises(ValueError):
        ingest.resolve_headers(["sku", "name"])
    assert ingest.resolve_headers(["id", "code", "sku", "name", "price"])["sku"] == "sku"
    assert ingest.resolve_headers(["Товарний код", "Товар", "Цена"]) == {"sku": "Товарний код", "name": "Товар", "price": "Цена"}
    assert ingest.guess_delimiter("a") == "," and ingest.guess_delimiter("a;b;c\n1;2;3\n") == ";"


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1")
    files = manifest.list_files(spark, str(tmp_path)).withColumn("supplier", F.lit("s"))
    assert manifest.to_import(files, files).count() == 0
    old = files.withColumn("content_hash", F.lit("other"))
    assert manifest.to_import(files, old).count() == 1
    assert manifest.registered(old, files).count() == 1


def test_stream(spark, tmp_path):
    from pricemill.streaming.bronze import load_new_files

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    raw = spark.createDataFrame([("1", "n", "2.5")], "sku string, name string, price string")
    for n in (1, 2):
        raw.write.mode("append").parquet(src)
        load_new_files(spark, src, raw.schema, "s", out, ck)
        assert spark.read.parquet(out).count() == n


def test_model_records(spark):
    data = json.dumps({"categories": [{"name": "C", "brands": [{"name": "B", "models": [{"name": "M 1"}, {"name": "N", "pattern": "n+", "tags": ["t"]}]}]}]})
    schema = "categories array<struct<name:string,brands:array<struct<name:string,models:array<struct<name:string,pattern:string,tags:array<string>>>>>>>"
    rows = tagging.model_records(spark.createDataFrame([(data,)], "j string").select(F.from_json("j", schema).alias("x")).select("x.*")).collect()
    assert [(r.name, r.pattern, r.tags) for r in rows] == [("M 1", model_pattern("B", "M 1"), ["C", "B", "M 1"]), ("N", "n+", ["t"])]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from pricemill import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


@pytest.mark.parametrize(
    "name, want",
    [
        ("Bo-Alpha7x!", ["Alpha 7x"]),
        ("alpha 7x and boalpha7x", ["Alpha 7x"]),
        ("Bo Alpha 7xl", []),
        ("Bo big Alpha and 7x", ["Alpha 7x"]),
        ("custom-99", ["C"]),
        ("", []),
        (None, []),
        ("x" * 50000 + " Bo Alpha 7x", ["Alpha 7x"]),
    ],
)
def test_model_mentions(name, want):
    models = [{"brand": "Bo", "name": "Alpha 7x", "tags": ["Alpha 7x"]}, {"brand": "Cy", "name": "C", "tags": ["C"], "pattern": r"custom-\d+"}, {"brand": "Cy", "name": "bad", "tags": ["bad"], "pattern": "("}]
    assert Lexicon(models).of(name) == want


def test_longest_mention():
    words = Lexicon([{"brand": "Bo", "name": "Alpha", "tags": []}, {"brand": "Bo", "name": "Alpha 7x", "tags": []}])
    assert words.longest("see Bo-Alpha 7X now") == "Bo-Alpha 7X" and words.longest("none") is None


def test_types_of_a_field(spark):
    from pricemill.operators.schema_drift import column_changes, type_lifespans

    versions = spark.createDataFrame([(i, " S ", f"2024-01-0{i}", ["Sku", "Price"] if i != 4 else ["Sku"], {}) for i in range(1, 6)], "template_id long, supplier string, saved_at string, headers array<string>, column_mapping map<string,string>")
    values = {1: "5", 2: "6", 3: '"x"', 5: "true"}
    feed = spark.createDataFrame([(i, i, json.dumps({"sku": "a"})[:-1] + f', "Price ": {v}}}') for i, v in values.items()] + [(9, 2, "broken"), (10, 2, "[1]")], "row_id long, template_id long, payload string")
    aliases = spark.createDataFrame([("sku", " SKU"), ("price", "price"), ("x", None)], "field string, alias_name string")
    got = {(r.field, r.type_island): (r.kind, r.first_template_id, r.last_template_id) for r in type_lifespans(versions, feed, aliases).collect()}
    assert got == {("sku", 1): ("string", 1, 5), ("price", 1): ("number", 1, 2), ("price", 2): ("string", 3, 3), ("price", 3): ("boolean", 5, 5)}
    changes = {tuple(r) for r in column_changes(versions, feed, aliases).collect()}
    assert changes == {(3, "price", "retyped"), (4, "price", "removed"), (5, "price", "added")}
    assert type_lifespans(versions, feed.limit(0), aliases.limit(0)).count() == 0
