"""Queries of the import pipeline, the file readers and writers, and the stores: each writes files and reads them back."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import functions as F

from .. import cli
from ..operators import channel, medallion, model_catalogue
from ..session import shared_dir, table
from ..sources import events, export, ingest, repository, stores
from .board_queries import _PRICE
from .offer_queries import _CHANNEL_SQL, _trim

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/pricemill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# --- the import pipeline, from files on


def _imported(spark, sf_dir) -> str:
    """The raw export as CSV files of one supplier for each category, with headers in Ukrainian, imported; the data folder."""
    root = _folder(spark, "import")
    raw = table(spark, sf_dir, "sample_raw").select(F.coalesce("category_norm", F.lit("none")).alias("category"), F.col("id_internal").alias("id"), F.col("price").alias("Ціна"), F.col("sku").alias("Артикул"), F.col("title_base").alias("Назва"), F.col("stock_qty").alias("Кількість"), F.col("brand").alias("Бренд"), F.col("currency").alias("Валюта"))
    keys = [r.category for r in raw.select("category").distinct().orderBy("category").collect()]  # the suppliers of the configuration
    raw.write.partitionBy("category").option("header", True).option("escape", '"').option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/in")
    config = {"data_root": f"{root}/data", "suppliers": [{"key": k, "paths": [f"{root}/in/category={k}"]} for k in keys]}
    done, same, failed = cli.run_import(spark, config)
    if failed or done != len(keys):
        raise RuntimeError(f"import: {failed}")
    return config["data_root"]


_IMPORT_SQL = f"""
WITH {_PRICE},
b AS (
    SELECT coalesce(category_norm, 'none') AS supplier, sku, title_base AS name, brand, coalesce(TRY_CAST(r.price AS DOUBLE), parsed.price) AS price, coalesce(stock_qty, 0) AS qty, lower({_trim("currency")}) AS currency,
           lower({_trim("brand")}) AS brand_norm, {_trim("regexp_replace(title_base, '[\\s\\v\\p{Z}]+', ' ', 'g')")} AS name_clean
    FROM sample_raw r JOIN parsed USING (id_internal)),
bronze AS (SELECT * FROM b WHERE price > 0)
"""


@query(_IMPORT_SQL + "SELECT supplier, sku, name, brand, price, qty, currency, brand_norm, name_clean FROM bronze")
def import_bronze(spark, sf_dir):
    return medallion.read_bronze(spark, f"{_imported(spark, sf_dir)}/bronze")


@query(_IMPORT_SQL + """SELECT brand_norm || '|' || name_clean AS pid_raw, count(DISTINCT sku) AS sku_count, count(DISTINCT supplier) AS supplier_count, round(avg(price), 4) AS avg_price, min(price) AS min_price, max(price) AS max_price FROM bronze GROUP BY ALL""")
def import_gold(spark, sf_dir):
    root = _imported(spark, sf_dir)
    cli.build_silver(spark, root)
    cli.build_gold(spark, root)
    return spark.read.parquet(f"{root}/gold/summary").withColumn("avg_price", F.round("avg_price", 4))


# --- readers and writers: the store's goods, written to one file of each kind and read again


def _offers(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    extra = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("Brand & <co>"), F.col("p_brand"))
    text = F.when(F.col("p_size") % 5 > 0, F.concat(F.col("p_type"), F.lit(' 5" x 3, "new"; a|b\nnext')))
    return part.select(F.concat(F.lit("SKU-"), "p_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.lit("UAH").alias("currency"), text.alias("description"), F.lit("store").alias("supplier"), F.array(F.lower("p_type"), F.lit("own")).alias("tags"), extra.alias("extra"))


_FILE_SQL = """
    SELECT 'SKU-' || p_partkey AS sku, p_name AS name, p_retailprice AS price, 'UAH' AS currency, CASE WHEN p_size % 5 > 0 THEN p_type || ' 5" x 3, "new"; a|b' || chr(10) || 'next' END AS description,
           array_to_string(list_sort(list_distinct([lower(p_type), 'own'])), '|') AS tags, CAST(p_size AS VARCHAR) AS size FROM part"""


def _read_back(spark, sf_dir, kind: str):
    """Named files are written by the driver: in a local session under the shared folder, which is a local one there."""
    path = urlparse(_folder(spark, "file")).path + f".{kind}"
    export.export_offers(_offers(spark, sf_dir), path)
    rows = ingest.load_offers(spark, f"file://{path}" if kind != "xlsx" else path, "store")
    size = F.coalesce(F.col("extra")["size"], F.col("extra")["field"]) if kind != "xml" else F.col("extra")["size"]
    return rows.select("sku", "name", "price", "currency", "description", F.array_join(F.array_sort("tags"), "|").alias("tags"), size.alias("size"))


@query(_FILE_SQL)
def read_back_csv(spark, sf_dir):
    return _read_back(spark, sf_dir, "csv")


@query(_FILE_SQL)
def read_back_json(spark, sf_dir):
    return _read_back(spark, sf_dir, "json")


@query(_FILE_SQL)
def read_back_xlsx(spark, sf_dir):
    return _read_back(spark, sf_dir, "xlsx")


@query("SELECT sku, name, price, currency, description, tags FROM (" + _FILE_SQL + ")")
def read_back_xml(spark, sf_dir):
    return _read_back(spark, sf_dir, "xml").drop("size")


@query(_CHANNEL_SQL + r""", i AS (SELECT *, TRY_CAST(replace("Ціна", ',', '.') AS DOUBLE) AS n FROM p)
    SELECT "ID" AS id, printf('%.2f', CAST(round(n, 2) AS DECIMAL(18, 2))) AS priceuah, CASE "Наявність" WHEN 'В наявності' THEN 'склад' WHEN 'Під замовлення' THEN NULL ELSE 'false' END AS available, CASE WHEN "Наявність" = 'В наявності' THEN 'true' ELSE 'false' END AS in_stock, nullif("Назва товару", '') AS name
    FROM i WHERE n > 0 AND n < 1e15""")
def market_xml(spark, sf_dir):
    """The marketplace file of the raw export, read back item by item."""
    rows = channel.to_channel(channel.without_excluded(channel.staging(table(spark, sf_dir, "sample_raw"))))
    path = urlparse(_folder(spark, "market")).path + ".xml"
    export.write_market_xml(rows, path)
    schema = "_id string, priceuah string, available string, in_stock string, name string"
    items = spark.read.schema(schema).option("rowTag", "item").xml(f"file://{path}")
    return items.where("cast(priceuah as double) < 1e15").select(F.col("_id").alias("id"), "priceuah", F.nullif("available", F.lit("")).alias("available"), "in_stock", F.nullif(F.trim("name"), F.lit("")).alias("name"))


# --- stores


@query("""SELECT CASE WHEN supplier = 'veltora' THEN 'Veltora & Co/2' ELSE supplier END AS supplier, count(*) AS n, count(sku) AS n_skus FROM product WHERE supplier IS NOT NULL AND supplier <> 'nevrira' GROUP BY ALL""")
def repository_lists(spark, sf_dir):
    """Stored lists after one was renamed and one deleted."""
    repo = repository.Repository(spark, _folder(spark, "lists"))
    repo.save(table(spark, sf_dir, "product").where("supplier IS NOT NULL").select("sku", "name", "price", "currency", "description", "supplier", "tags"))
    repo.rename("veltora", "Veltora & Co/2")
    repo.delete("nevrira")
    return repo.load_all().groupBy("supplier").agg(F.count("*").alias("n"), F.count("sku").alias("n_skus"))


@query("""SELECT 'group-' || p_type AS group_id, CAST(p_partkey AS VARCHAR) AS match_id, CASE WHEN p_size % 2 = 0 THEN 'flagged' ELSE 'confirmed' END AS status FROM part WHERE p_size % 3 <> 0""")
def review_states(spark, sf_dir):
    """Reviews set, then those of some sizes changed and of others cleared."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("group-"), "p_type").alias("group_id"), F.col("p_partkey").cast("string").alias("match_id"), "p_size")
    state = stores.ReviewState(spark, _folder(spark, "states"))
    state.set(part.withColumn("status", F.lit("confirmed")))
    state.set(part.where("p_size % 2 = 0").withColumn("status", F.lit("flagged")))
    state.clear(part.where("p_size % 3 = 0"))
    return state.rows()


@query(r"""
    WITH m AS (SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'Thrifty' ELSE p_type END AS category, p_brand AS brand, p_name AS name FROM part WHERE p_brand <> 'Brand#2')
    SELECT category, brand, name, array_to_string(list_sort([category, brand, name]), '|') AS tags FROM m""")
def catalogue_sheet(spark, sf_dir):
    """The catalogue of part, edited, in its sheet form and back: a category renamed, a brand deleted from each."""
    rows = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_name").distinct()
    tree: dict = {}
    for r in rows.collect():  # a configured catalogue, which the driver holds
        tree.setdefault(r.p_type, {}).setdefault(r.p_brand, []).append({"name": r.p_name})
    data = {"categories": [{"name": c, "brands": [{"name": b, "models": m} for b, m in bs.items()]} for c, bs in tree.items()]}
    for c in model_catalogue.names(data):
        if "Brand#2" in model_catalogue.names(data, c):
            data = model_catalogue.edit(data, [c, "Brand#2"], None)
    data = model_catalogue.edit(data, ["ECONOMY"], "Thrifty")
    data = model_catalogue.from_sheet(model_catalogue.SHEET, model_catalogue.to_sheet(data))
    flat = [(m["category"], m["brand"], m["name"], "|".join(sorted(m["tags"]))) for m in model_catalogue.records(data)]
    return spark.createDataFrame(flat, "category string, brand string, name string, tags string")


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY ALL")
def event_log(spark, sf_dir):
    """One logged event for each kind of the events, with its count."""
    path = urlparse(_folder(spark, "events")).path + ".jsonl"
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    for r in kinds.collect():  # a handful of kinds
        events.log_event(path, r.event_type, n=r.n)
    return events.recent_events(spark, path, 1000).select("event", F.col("fields")["n"].cast("long").alias("n"))
