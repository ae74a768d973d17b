import json

import pytest
from pyspark.sql import functions as F

from pricemill import cli
from pricemill.operators import model_catalogue as mc
from pricemill.sources import events, repository
from pricemill.sources.xlsx import read_sheet, write_sheet


def test_import_silver_gold(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("sku,name,price,brand\n1,Red ring,5,B\n2,x,bad,B\n3,y,0,B\n")
    (tmp_path / "b.csv").write_text("sku;name;price;brand\n1;Red  ring;7;b\n")
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"data_root": "data", "suppliers": [{"key": "a", "paths": ["a.csv"]}, {"key": "b", "paths": ["b.csv", "gone.csv"]}]}))
    conf = cli.load_config(str(config))
    done, same, failed = cli.run_import(spark, conf)
    assert (done, same, [f[0] for f in failed]) == (2, 0, ["b"])
    assert cli.run_import(spark, conf)[:2] == (0, 2)
    cli.build_silver(spark, conf["data_root"])
    cli.build_gold(spark, conf["data_root"])
    rows = spark.read.parquet(conf["data_root"] + "/gold/summary").collect()
    assert [(r.sku_count, r.supplier_count, r.min_price, r.max_price) for r in rows] == [(1, 2, 5.0, 7.0)]


def test_brands_quantities_and_headers(spark, tmp_path):
    """Two brands of one name are two products; a file with id and sku, another with headers in Ukrainian."""
    (tmp_path / "a.csv").write_text("id,sku,name,brand,price,qty,currency\n9,A1,Ring, Bo ,5.5,3,USD\n8,A2,Ring,Lo,\"1 200,50\",,uah\n")
    (tmp_path / "b.csv").write_text("Товар;Товарний код;Цена;Бренд;Кількість\nRing;B1;7;BO;4.0\n")
    conf = {"data_root": str(tmp_path / "data"), "suppliers": [{"key": "s.x/y", "paths": [str(tmp_path / "a.csv")]}, {"key": "t", "paths": [str(tmp_path / "b.csv")]}]}
    assert cli.run_import(spark, conf) == (2, 0, [])
    cli.build_silver(spark, conf["data_root"])
    got = {r.sku: (r.supplier, r.brand_norm, r.price, r.qty, r.currency, r.pid_raw) for r in spark.read.parquet(conf["data_root"] + "/silver/offers").collect()}
    assert got == {"A1": ("s.x/y", "bo", 5.5, 3, "usd", "bo|Ring"), "A2": ("s.x/y", "lo", 1200.5, 0, "uah", "lo|Ring"), "B1": ("t", "bo", 7.0, 4, None, "bo|Ring")}
    cli.build_gold(spark, conf["data_root"])
    assert {r.pid_raw: r.sku_count for r in spark.read.parquet(conf["data_root"] + "/gold/summary").collect()} == {"bo|Ring": 2, "lo|Ring": 1}


def test_edited_file_and_broken_run(spark, tmp_path, monkeypatch):
    """An edited file's rows replace its earlier ones; a run that breaks off keeps the files it finished."""
    from pricemill.operators import medallion
    from pricemill.sources import manifest

    for name, rows in (("a", "1,x,2\n2,y,3\n"), ("b", "3,z,4\n")):
        (tmp_path / f"{name}.csv").write_text("sku,name,price\n" + rows)
    conf = {"data_root": str(tmp_path / "data"), "suppliers": [{"key": "s", "paths": [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]}]}
    real = manifest.register

    def stops(files, book):
        if files.where("path LIKE '%b.csv'").count():
            raise KeyboardInterrupt  # after b's rows were written, before its entry
        real(files, book)

    monkeypatch.setattr(manifest, "register", stops)
    with pytest.raises(KeyboardInterrupt):
        cli.run_import(spark, conf)
    monkeypatch.setattr(manifest, "register", real)
    assert cli.run_import(spark, conf) == (1, 1, [])
    (tmp_path / "a.csv").write_text("sku,name,price\n1,x,2\n4,new,9\n")
    assert cli.run_import(spark, conf) == (1, 1, [])
    rows = medallion.read_bronze(spark, conf["data_root"] + "/bronze")
    assert sorted(r.sku for r in rows.collect()) == ["1", "3", "4"]
    assert manifest.known_files(spark, conf["data_root"] + "/manifest").count() == 2


def test_large_files_are_hashed_by_line(spark, tmp_path, monkeypatch):
    from pricemill.sources import manifest

    (tmp_path / "a.csv").write_text("1\n2\n2\n")
    (tmp_path / "b.csv").write_text("1\n2\n3\n")
    monkeypatch.setattr(manifest, "ONE_VALUE", 2)
    got = [r.content_hash for r in manifest.list_files(spark, str(tmp_path)).collect()]
    assert len(set(got)) == 2 and all(h.startswith("lines-3-") for h in got)


def test_configuration_without_a_yaml_package(tmp_path):
    text = "data_root: data  # here\nsuppliers:\n  - key: a\n    paths:\n      - x.csv\n      - 'y z.csv'\n  - key: b\n    paths: [q.csv, \"w.csv\"]\nexports:\n  on: true\n  n: 3\n  none:\n"
    assert cli.plain_yaml(text) == {"data_root": "data", "suppliers": [{"key": "a", "paths": ["x.csv", "y z.csv"]}, {"key": "b", "paths": ["q.csv", "w.csv"]}], "exports": {"on": True, "n": 3, "none": None}}
    (tmp_path / "c.yaml").write_text(text)
    assert cli.load_config(str(tmp_path / "c.yaml"))["suppliers"][1]["paths"] == [str(tmp_path / "q.csv"), str(tmp_path / "w.csv")]


def test_raw_source_falls_through(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cli.raw_source(spark, str(tmp_path))
    (tmp_path / "sample.csv").write_text("a\n1\n")
    assert cli.raw_source(spark, str(tmp_path), str(tmp_path / "sample.csv")).count() == 1
    (tmp_path / "export_raw.parquet").write_text("broken")
    (tmp_path / "export_raw.csv").write_text("a\n1\n2\n")
    assert cli.raw_source(spark, str(tmp_path), str(tmp_path / "sample.csv")).count() == 2


def test_record_element_of_a_long_file(spark, tmp_path):
    """The record's name is found wherever it begins, and without a known name the first element that repeats."""
    from pricemill.sources import ingest

    (tmp_path / "a.xml").write_text("<shop>" + "<note>x</note>\n" * 9000 + "<offer><vendorCode>1</vendorCode><name>n</name><price>2</price></offer></shop>")
    assert ingest.record_tag(spark, str(tmp_path / "a.xml")) == "offer"
    (tmp_path / "b.xml").write_text("<shop><head/><good><sku>1</sku></good><good><sku>2</sku></good></shop>")
    assert ingest.record_tag(spark, str(tmp_path / "b.xml")) == "good"


def test_stores(spark, tmp_path):
    from pricemill.sources import stores

    s = stores.Synonyms(str(tmp_path / "x" / "s.json"))
    for c, v in ((" Phone ", "Смартфон"), ("phone", "смартфон"), ("phone", "mobile"), ("", "x"), ("y", " ")):
        s.add(c, v)
    s.save()
    s = stores.Synonyms(s.path)
    assert s.words == {"phone": ["смартфон", "mobile"]}
    s.delete("PHONE", "mobile")
    assert s.words == {"phone": ["смартфон"]}
    s.delete("phone", "смартфон")
    assert s.words == {}
    t = stores.Templates(str(tmp_path / "t.json"))
    assert t.all() == [] and t.get("a") is None
    t.save(" Acme ", {"sku": "Code", "name": ""}, ["Code", ""])
    assert t.get("ACME") == {"supplier": " Acme ", "column_mapping": {"sku": "Code"}, "headers": ["Code"]} and len(t.all()) == 1
    t.delete("acme")
    assert t.all() == []
    r = stores.ReviewState(spark, str(tmp_path / "state"))
    assert r.rows().count() == 0
    r.set(spark.createDataFrame([("g", "m", "flagged"), ("g", "n", "confirmed")], stores.STATE))
    r.set(spark.createDataFrame([("g", "m", "removed")], stores.STATE))
    r.clear(spark.createDataFrame([("g", "n")], "group_id string, match_id string"))
    assert [tuple(x) for x in r.rows().collect()] == [("g", "m", "removed")]
    rows = spark.createDataFrame([("1", "n", "s", ["b", "a"]), ("2", "n", "s", [])], "sku string, name string, supplier string, current array<string>")
    stores.save_tags(rows, str(tmp_path / "tags"))
    assert [(x.sku, x.tags) for x in spark.read.json(str(tmp_path / "tags")).collect()] == [("1", ["a", "b"])]


def test_spreadsheet_service(spark):
    from pricemill.sources import stores

    class Service:
        sheets: dict = {}

        def read(self, book, sheet):
            return self.sheets[book, sheet]

        def write(self, book, sheet, rows):
            self.sheets[book, sheet] = rows

    df = spark.createDataFrame([("1", None), ("2", "x")], "a string, `b c` string")
    assert stores.write_service(df, Service(), "k", "t") and not stores.write_service(df, None, "k", "t")
    assert sorted(map(tuple, stores.read_service(spark, Service(), "k", "t").collect())) == [("1", None), ("2", "x")]


def test_whole_assignment(spark):
    from pricemill.operators import tagging

    rows = spark.createDataFrame([("s", "1", "Чохол Alpha 7x", None, ["Чохол"]), ("s", "2", "Power bank", "black", None), (None, None, None, None, None)], "supplier string, sku string, name string, description string, tags array<string>")
    saved = spark.createDataFrame([("s::2", ["Павербанк", "old"])], "assignment_key string, tags array<string>")
    got = {r.sku: r for r in tagging.build_assignments(rows, [{"brand": "Bo", "name": "Alpha 7x", "tags": ["Bo", "Alpha 7x"]}], [{"name": "r", "conditions": ["black"], "tags": ["Black"]}], saved, {"повербанк": ["power bank"]}).collect()}
    assert (got["1"].auto, got["1"].proposed, got["1"].category, got["1"].errors) == (["Alpha 7x", "Bo"], ["Alpha 7x", "Bo"], "Чохол", [tagging.NO_COLOUR])
    assert (got["2"].current, got["2"].selected, got["2"].category, got["2"].errors) == (["old", "Павербанк"], ["Black"], "Павербанк", [tagging.NO_BRAND])
    assert (got[None].current, got[None].proposed, got[None].category, got[None].errors) == ([], [], None, [])


def test_repository(spark, tmp_path):
    repo = repository.Repository(spark, str(tmp_path / "lists"))
    assert repo.suppliers().count() == 0
    rows = spark.createDataFrame([("1", "n", 2.0, "A b"), ("2", "m", 3.0, "a_b")], "sku string, name string, price double, supplier string")
    repo.save(rows)
    repo.save(rows.where("supplier = 'A b'").withColumn("price", F.lit(9.0)))
    assert [r.supplier for r in repo.suppliers().collect()] == ["A b", "a_b"]
    assert [(r.price, r.currency) for r in repo.load("A b").collect()] == [(9.0, "USD")] and repo.load("a_b").count() == 1
    with pytest.raises(ValueError):
        repo.rename("A b", "a_b")
    repo.rename("A b", "c/d")
    assert [r.supplier for r in repo.suppliers().collect()] == ["a_b", "c/d"]
    assert repo.delete("c/d") and not repo.delete("none")
    repo.clear()
    assert repo.load_all().count() == 0


def test_saved_tags_and_entries(spark):
    saved = spark.createDataFrame([(1, "s", "k", "n", ["a"]), (2, "s", "k", "n", ["b"]), (3, "s", "q", " ", ["c"])], "seq int, supplier string, sku string, name string, tags array<string>")
    products = spark.createDataFrame([("s", "k", "n", ["x"]), ("s", "z", "n", None)], "supplier string, sku string, name string, tags array<string>")
    got = {r.sku: r.tags for r in repository.with_saved_tags(products, repository.saved_tags(saved)).collect()}
    assert got == {"k": ["b", "x"], "z": []}
    meta = spark.createDataFrame([("s", "p", "t0", [("1", "one", "t1")]), ("t", None, "t2", None)], "supplier string, price_name string, updated_at string, prices array<struct<id:string,name:string,updated_at:string>>")
    assert {tuple(r) for r in repository.price_entries(meta).collect()} == {("s", "1", "one", "t1"), ("t", "default", "t", "t2")}


def test_events(spark, tmp_path):
    path = str(tmp_path / "e.jsonl")
    events.log_event(path, "one", n=1)
    with open(path, "a") as f:
        f.write("not json\n")
    with events.timed(path, "two"):
        pass
    rows = events.recent_events(spark, path, 5).collect()
    assert [r.event for r in rows] == ["two", "one"] and rows[1].fields == {"n": "1"} and "seconds" in rows[0].fields


def test_rules():
    assert repository.load_rules('{"rules": [{"tag": "a", "keywords": ["x"]}, {"keywords": ["y"]}]}', {}) == {"a": ["x"]}
    assert repository.load_rules('{"rules": []}', {"d": ["e"]}) == {"d": ["e"]}
    assert len(repository.load_regex_rules('{"rules": [{"name": "n", "tags": ["t"], "conditions": ["c"]}, {"name": "m"}]}')) == 1
    assert repository.load_regex_rules(None)[0]["tags"] == ["Soft Case", "Чохол", "Camera Protective"]
    c = ['a"b', "c+", "d\\\\w", "it's"]
    assert mc.conditions_of(mc.formula_of(c)) == c and mc.formula_of([]) == ""
    assert mc.conditions_of("=IF(AND(REGEXMATCH({{name}},'x\\'y'), regexmatch({{ name }}, \"\")))") == ["x'y"]


def test_catalogue(tmp_path):
    data = {"categories": [{"name": "Phones", "brands": [{"name": "BrandX", "models": [{"name": "Alpha", "tags": ["Special"]}, {"name": " "}]}]}, {"tags": []}]}
    assert mc.records(data)[0]["tags"] == ["Phones", "BrandX", "Alpha", "Special"]
    path = str(tmp_path / "m.xlsx")
    write_sheet(path, mc.SHEET, iter(mc.to_sheet(data)))
    headers, *rows = read_sheet(path)
    assert mc.from_sheet(headers, rows) == mc.normalised(data)
    assert mc.names(data) == ["Phones"] and mc.names(data, "phones", "BRANDX") == ["Alpha"] and mc.names(data, "none") == []
    with pytest.raises(ValueError, match="дублюється.*рядки 2, 3"):
        mc.from_sheet(mc.SHEET, rows + rows)
    with pytest.raises(ValueError):
        mc.from_sheet(["x"], rows)
    new = mc.edit(data, ["phones", "brandx"], "BrandY")
    assert mc.records(new)[0]["tags"][:3] == ["Phones", "BrandY", "Alpha"] and "BrandY" in mc.records(new)[0]["pattern"]
    assert mc.records(mc.edit(data, ["Phones", "BrandX", "Alpha"], None)) == []
    assert [r["name"] for r in mc.records(mc.edit(data, ["Phones", "BrandX", ""], "Beta"))] == ["Alpha", "Beta"]
    with pytest.raises(ValueError):
        mc.edit(data, ["Phones", "BrandX", ""], "alpha")
    assert mc.load("broken", data) == mc.normalised(data)
