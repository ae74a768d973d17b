"""Queries of the price-list operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import channel, compare, matching, medallion, schema_drift, search, tagging
from ..operators.model_matcher import match_models
from ..operators.ranking import places
from ..session import table
from .domain import OFFERS_SQL, offers, price_list, searchable, store, supply

QUERIES, SQL = {}, {}


def _trim(x: str) -> str:
    """SQL that trims white space of any kind."""
    return rf"regexp_replace({x}, '^[\s\v\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+|[\s\v\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+$', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- layers

_BRONZE_SQL = OFFERS_SQL + r"""
, bronze AS (
    SELECT l_orderkey, l_linenumber, sku, name, brand, price, coalesce(qty, 0) AS qty, lower(trim(currency)) AS currency, lower(trim(brand)) AS brand_norm,
           trim(regexp_replace(name, '\s+', ' ', 'g')) AS name_clean, supplier
    FROM offers WHERE price IS NOT NULL AND price > 0),
silver AS (SELECT sku, supplier, brand_norm, name_clean, price, qty, currency, brand_norm || '|' || name_clean AS pid_raw FROM bronze)
"""


@query(_BRONZE_SQL + "SELECT sku, name, brand, price, qty, currency, brand_norm, name_clean, supplier FROM bronze")
def bronze_normalize(spark, sf_dir):
    return medallion.bronze(offers(spark, sf_dir))


@query(_BRONZE_SQL + "SELECT * FROM silver")
def silver_offers(spark, sf_dir):
    return medallion.silver(medallion.bronze(offers(spark, sf_dir)))


@query(_BRONZE_SQL + """SELECT pid_raw, count(DISTINCT sku) AS sku_count, count(DISTINCT supplier) AS supplier_count, CAST(sum(CAST(price AS DECIMAL(15, 2))) AS DOUBLE) / count(*) AS avg_price, min(price) AS min_price, max(price) AS max_price
    FROM silver GROUP BY pid_raw""")
def gold_summary(spark, sf_dir):
    """Prices are summed as decimals, so the average doesn't depend on the order of rows."""
    rows = medallion.silver(medallion.bronze(offers(spark, sf_dir))).withColumn("price", F.col("price").cast("decimal(15,2)"))
    return medallion.gold(rows).withColumns({c: F.col(c).cast("double") for c in ("min_price", "max_price")})


# --- comparison


@query(OFFERS_SQL + """
    SELECT lower(sku) AS sku_key, (list(struct_pack(s := supplier, p := price, k := sku, n := name) ORDER BY supplier, price, sku, name)[1]).k AS sku,
           (list(struct_pack(s := supplier, p := price, k := sku, n := name) ORDER BY supplier, price, sku, name)[1]).n AS name,
           min(price) AS best_price, (list(supplier ORDER BY price, supplier, sku, name))[1] AS best_supplier, count(*) AS n_offers
    FROM offers GROUP BY lower(sku)""")
def best_offers(spark, sf_dir):
    return compare.best_offers(offers(spark, sf_dir))


@query(OFFERS_SQL + """
    SELECT price, supplier, sku, name FROM offers WHERE lower(sku) = 'sku-1'""")
def compare_by_sku(spark, sf_dir):
    return compare.compare_by_sku(offers(spark, sf_dir), "SKU-1")


_JACCARD = "len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
_WORDS = r"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


@query(OFFERS_SQL + f"""
    , n AS (SELECT name, {_WORDS.format(x="name")} AS a, {_WORDS.format(x="'red widget extra'")} AS b FROM (SELECT DISTINCT name FROM offers)),
    s AS (SELECT name, {_JACCARD.format(a="a", b="b")} AS similarity FROM n)
    SELECT lower(sku) AS sku_key, max(similarity) AS similarity, (list(name ORDER BY price, supplier, sku, name))[1] AS name, min(price) AS best_price,
           (list(supplier ORDER BY price, supplier, sku, name))[1] AS best_supplier, count(*) AS n_offers
    FROM offers JOIN s USING (name) WHERE similarity >= 0.5 GROUP BY lower(sku)""")
def compare_by_name(spark, sf_dir):
    return compare.compare_by_name(offers(spark, sf_dir), "red widget extra", 0.5)


@query(OFFERS_SQL + f"""
    , n AS (SELECT name, {_WORDS.format(x="name")} AS a, {_WORDS.format(x="'red widget'")} AS b FROM (SELECT DISTINCT name FROM offers)),
    s AS (SELECT name, {_JACCARD.format(a="a", b="b")} AS similarity FROM n)
    SELECT lower(sku) AS sku_key, max(similarity) AS similarity, (list(name ORDER BY price, supplier, sku, name))[1] AS name, min(price) AS best_price,
           (list(supplier ORDER BY price, supplier, sku, name))[1] AS best_supplier, count(*) AS n_offers
    FROM offers JOIN s USING (name) WHERE similarity >= 0.75 GROUP BY lower(sku)""")
def compare_by_close_name(spark, sf_dir):
    """At the threshold that holds where none is given."""
    return compare.compare_by_name(offers(spark, sf_dir), "Red  WIDGET")


@query(OFFERS_SQL + "SELECT lower(sku) AS sku_key, row_number() OVER (PARTITION BY lower(sku) ORDER BY price, supplier, sku, name)::INT AS place, supplier, price FROM offers")
def offer_lists(spark, sf_dir):
    """Each sku's offers in the order of their prices."""
    return compare.offer_lists(offers(spark, sf_dir)).select("sku_key", "place", "supplier", "price")


@query(OFFERS_SQL + "SELECT sku, supplier, price, qty FROM offers WHERE lower(sku) = 'sku-7'")
def offers_for(spark, sf_dir):
    return compare.offers_for(offers(spark, sf_dir), F.lit(" Sku-7 ")).select("sku", "supplier", "price", "qty")


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100, 0) AS INT) AS VARCHAR) || '%' AS label FROM lineitem")
def percent_labels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.percent_label("l_discount").alias("label"))


@query(OFFERS_SQL + """
    SELECT lower(sku) AS sku_key, min(price) AS price, (list(supplier ORDER BY price, supplier, sku, name))[1] AS supplier, (list(sku ORDER BY price, supplier, sku, name))[1] AS sku,
           (list(name ORDER BY price, supplier, sku, name))[1] AS name FROM offers GROUP BY lower(sku)""")
def cheapest_by_sku(spark, sf_dir):
    return compare.cheapest_by_sku(offers(spark, sf_dir))


@query(OFFERS_SQL + "SELECT sku, supplier, price, row_number() OVER (PARTITION BY supplier ORDER BY sku, price, name, description)::INT AS place FROM price_list")
def sorted_products(spark, sf_dir):
    """Each supplier's list in the order of sku and price."""
    rows = price_list(spark, sf_dir).select("sku", "supplier", "price", "name", "description")
    return places(rows, "supplier", [F.col(c) for c in ("sku", "price", "name", "description")]).drop("name", "description")


@query(OFFERS_SQL + """
    SELECT supplier, sku, price, NULL::VARCHAR AS store_sku FROM price_list UNION ALL SELECT NULL, 'SKU-' || p_partkey, p_retailprice, 'SKU-' || p_partkey FROM part""")
def all_lists(spark, sf_dir):
    own = store(spark, sf_dir).select("sku", "price", F.col("sku").alias("store_sku"))
    return compare.union_lists(price_list(spark, sf_dir).select("supplier", "sku", "price"), own)


@query(OFFERS_SQL + "SELECT 'SKU-' || p_partkey AS sku, min(o.price) AS least_price, count(o.sku) AS n_suppliers FROM part LEFT JOIN price_list o ON o.sku = 'SKU-' || p_partkey GROUP BY ALL")
def least_supplier_price(spark, sf_dir):
    mine = store(spark, sf_dir).select("sku")
    return mine.join(price_list(spark, sf_dir).withColumnRenamed("price", "p").withColumn("k", F.col("sku")).drop("sku"), F.col("sku") == F.col("k"), "left").groupBy("sku").agg(F.min("p").alias("least_price"), F.count("k").alias("n_suppliers"))


# --- text


@query(r"""
    WITH t AS (SELECT id_internal, replace(trim(regexp_replace(price, '[\s\p{Z}]+', '', 'g')), '−', '-') AS x FROM sample_raw),
    c AS (SELECT id_internal, regexp_replace(x, '[^0-9,.\-]', '', 'g') AS y FROM t),
    d AS (SELECT id_internal, CASE WHEN y LIKE '-%' THEN '-' ELSE '' END || replace(y, '-', '') AS z FROM c),
    e AS (SELECT id_internal, z, length(z) - length(replace(z, ',', '')) AS nc, length(z) - length(replace(z, '.', '')) AS np, instr(reverse(z), ',') AS rc, instr(reverse(z), '.') AS rp FROM d)
    SELECT id_internal, CASE WHEN NOT regexp_matches(z, '[0-9]') THEN NULL
        WHEN nc > 0 AND np > 0 AND rc < rp THEN TRY_CAST(replace(replace(z, '.', ''), ',', '.') AS DOUBLE)
        WHEN nc > 0 AND np > 0 THEN TRY_CAST(replace(z, ',', '') AS DOUBLE)
        WHEN nc = 1 THEN TRY_CAST(replace(z, ',', '.') AS DOUBLE) WHEN nc > 1 THEN TRY_CAST(replace(z, ',', '') AS DOUBLE)
        WHEN np > 1 THEN TRY_CAST(replace(z, '.', '') AS DOUBLE) ELSE TRY_CAST(z AS DOUBLE) END AS parsed
    FROM e""")
def price_parse(spark, sf_dir):
    return table(spark, sf_dir, "sample_raw").select("id_internal", T.parse_price("price").alias("parsed"))


@query(r"""
    SELECT product_id, len(list_distinct(regexp_extract_all(lower(concat_ws(' ', name, sku, description)), '[\p{L}\p{N}_]+'))) AS n_words,
           array_to_string(list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', name, sku, description)), '[\p{L}\p{N}_]+'))), ' ') AS words
    FROM product""")
def tokenize(spark, sf_dir):
    w = T.words("name", "sku", "description")
    return table(spark, sf_dir, "product").select("product_id", F.size(w).cast("long").alias("n_words"), F.array_join(F.array_sort(w), " ").alias("words"))


@query(r"""
    WITH t AS (SELECT product_id, sku, name, description, list_sort(tags) AS tags FROM product),
    b AS (SELECT product_id, [regexp_replace(x, '^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$', '', 'g') FOR x IN [sku, name, description]] AS p, array_to_string(tags, ' ') AS g FROM t)
    SELECT product_id, lower(array_to_string([x FOR x IN list_append(p, g) IF x IS NOT NULL AND x <> ''], ' ')) AS haystack FROM b""")
def haystacks(spark, sf_dir):
    return table(spark, sf_dir, "product").select("product_id", T.haystack("sku", "name", "description", "tags").alias("haystack"))


_SEARCH_SQL = OFFERS_SQL + r""", s AS (
    SELECT supplier, sku, name, price, lower(concat_ws(' ', sku, name, description)) AS h, regexp_extract_all(lower(concat_ws(' ', sku, name, description)), '[\p{L}\p{N}_]+') AS w FROM price_list)
"""


@query(_SEARCH_SQL + "SELECT supplier, sku, name, price FROM s WHERE contains(h, 'red widget') OR (list_contains(w, 'red') AND list_contains(w, 'widget'))")
def keyword_filter(spark, sf_dir):
    rows = searchable(spark, sf_dir)
    return rows.where(search.contains_keyword("red widget", F.col("haystack"), F.col("tokens"))).select("supplier", "sku", "name", "price")


@query(_SEARCH_SQL + """
    SELECT supplier, sku, name, price, 1.0::DOUBLE AS score FROM s WHERE contains(h, 'widget economy') OR (list_contains(w, 'widget') AND list_contains(w, 'economy'))
    ORDER BY price, supplier, sku, name LIMIT 20""")
def search_exact(spark, sf_dir):
    return search.search(searchable(spark, sf_dir), "widget economy").select("supplier", "sku", "name", "price", "score")


@query(_SEARCH_SQL + """
    SELECT supplier, sku, name, price, 1.0::DOUBLE AS score FROM s WHERE lower(supplier) = (SELECT lower(min(s_name)) FROM supplier) AND (contains(h, 'widget') OR list_contains(w, 'widget'))
    ORDER BY price, supplier, sku, name LIMIT 20""")
def search_supplier(spark, sf_dir):
    """The best offers of one supplier only."""
    first = table(spark, sf_dir, "supplier").agg(F.min("s_name")).first()[0]
    return search.search(searchable(spark, sf_dir), "Widget", supplier=first.upper()).select("supplier", "sku", "name", "price", "score")


@query()
def search_fuzzy(spark, sf_dir):
    return search.search(searchable(spark, sf_dir), "widgt ecnomy", fuzzy=True, threshold=0.5).select("supplier", "sku", "name", "price", F.round("score", 6).alias("score"))


@query(OFFERS_SQL + """
    SELECT supplier, sku, 'match::' || sha1(lower(trim(supplier)) || '||' || lower(trim(sku)) || '||' || lower(trim(name)))[1:16] AS match_id,
           'store::' || sha1(lower(trim(sku)))[1:16] AS group_id, supplier || '::' || sku AS assignment_key FROM price_list""")
def stable_ids(spark, sf_dir):
    c = F.col
    return price_list(spark, sf_dir).select("supplier", "sku", T.match_id(c("supplier"), c("sku"), c("name")).alias("match_id"), T.group_id(c("sku"), c("name")).alias("group_id"), T.assignment_key(c("supplier"), c("sku"), c("name")).alias("assignment_key"))


@query(r"""
    SELECT id_internal, array_to_string(list_sort(list_distinct([lower(trim(x, e' \t\n\r' || chr(160))) FOR x IN string_split(tags, ';') IF trim(x, e' \t\n\r' || chr(160)) <> ''])), '|') AS tags FROM sample_raw WHERE tags IS NOT NULL""")
def tag_split(spark, sf_dir):
    return table(spark, sf_dir, "sample_raw").where("tags IS NOT NULL").select("id_internal", F.array_join(F.array_sort(T.split_tags("tags")), "|").alias("tags"))


@query(f"""
    SELECT product_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), [x FOR x IN [lower({_trim("supplier")}), 'merged'] IF x <> '']))), '|') AS tags FROM product""")
def tag_merge(spark, sf_dir):
    return table(spark, sf_dir, "product").select("product_id", F.array_join(T.merge_tags(F.col("tags"), F.array("supplier", F.lit(" Merged "))), "|").alias("tags"))


@query("""
    WITH t AS (SELECT event_id, greatest(epoch(TIMESTAMP '2025-06-01') - floor(epoch(ts)), 0)::BIGINT AS s FROM events),
    u AS (SELECT event_id, s, s // 60 AS m, s // 3600 AS h, s // 86400 AS d, s // 86400 // 30 AS mo FROM t)
    SELECT event_id, CASE WHEN s < 60 THEN 'щойно' WHEN m < 60 THEN m || ' хв тому' WHEN h < 24 THEN h || ' год' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || ' хв' ELSE '' END || ' тому'
        WHEN d < 30 THEN d || ' ' || CASE WHEN d % 10 = 1 AND d % 100 <> 11 THEN 'день' WHEN d % 10 BETWEEN 2 AND 4 AND d % 100 NOT BETWEEN 12 AND 14 THEN 'дні' ELSE 'днів' END || ' тому'
        WHEN mo < 12 THEN mo || ' ' || CASE WHEN mo % 10 = 1 AND mo % 100 <> 11 THEN 'місяць' WHEN mo % 10 BETWEEN 2 AND 4 AND mo % 100 NOT BETWEEN 12 AND 14 THEN 'місяці' ELSE 'місяців' END || ' тому'
        ELSE (d // 360) || ' ' || CASE WHEN (d // 360) % 10 = 1 AND (d // 360) % 100 <> 11 THEN 'рік' WHEN (d // 360) % 10 BETWEEN 2 AND 4 AND (d // 360) % 100 NOT BETWEEN 12 AND 14 THEN 'роки' ELSE 'років' END || ' тому' END AS age
    FROM u""")
def relative_time(spark, sf_dir):
    now = F.lit("2025-06-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", T.age_label(F.col("ts").cast("timestamp"), now).alias("age"))


@query(OFFERS_SQL + "SELECT supplier, sku, replace(format('{:,.2f}', round(price, 2)), ',', ' ') AS label FROM price_list")
def price_labels(spark, sf_dir):
    return price_list(spark, sf_dir).select("supplier", "sku", T.price_label("price").alias("label"))


@query(f"SELECT product_id, {_trim('lower(name)')} AS name FROM product")
def synonym_normalize(spark, sf_dir):
    """Names without outer blanks, in the strict form: lower case only."""
    return table(spark, sf_dir, "product").select("product_id", T.normalise_synonyms("name", {"телефон": ["смартфон"]}, strict=True).alias("name"))


def _whole_word(x: str, word: str, by: str) -> str:
    """Twice, as two neighbours share the character between them."""
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){word}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1{by}\\2', 'g')"
    return x


@query(f"SELECT product_id, {_trim(_whole_word(_whole_word(_whole_word('lower(name)', 'смартфон', 'телефон'), 'smartphone', 'телефон'), 'power bank', 'павербанк'))} AS name FROM product")
def synonym_replace(spark, sf_dir):
    """Names with each variant of a word replaced by its canonical word."""
    synonyms = {"телефон": ["смартфон", " Smartphone "], "павербанк": ["power bank"]}
    return table(spark, sf_dir, "product").select("product_id", T.normalise_synonyms("name", synonyms).alias("name"))


# --- matching

_MATCH_SQL = OFFERS_SQL + f"""
, st AS (SELECT p_partkey AS store_id, 'SKU-' || p_partkey AS sku, p_name AS name, list_distinct(list_append(string_split(lower(p_name || ' SKU-' || p_partkey), ' '), lower(p_type))) AS a FROM part),
sets AS (SELECT DISTINCT sku, list_distinct(string_split(lower(name || ' ' || sku), ' ')) AS b FROM price_list),
pairs AS (SELECT store_id, st.sku AS store_sku, sets.sku, CASE WHEN st.sku = sets.sku THEN 1.0::DOUBLE ELSE {_JACCARD.format(a="a", b="b")} END AS similarity FROM st, sets WHERE st.sku = sets.sku OR list_has_any(a, b)),
good AS (SELECT * FROM pairs WHERE similarity >= 0.15),
cheap AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY price, supplier) AS r FROM price_list),
ranked AS (
    SELECT store_id, row_number() OVER (PARTITION BY store_id ORDER BY similarity DESC, price, supplier, o.sku, name) AS rank, supplier, o.sku, name, price, similarity
    FROM good JOIN cheap o ON good.sku = o.sku WHERE r <= 8),
top AS (SELECT * FROM ranked WHERE rank <= 8)
"""


@query(_MATCH_SQL + "SELECT store_id, count(*) AS n_sets, round(max(CASE WHEN store_sku = sku THEN 0 ELSE similarity END), 6) AS best_other FROM good GROUP BY store_id")
def match_candidates(spark, sf_dir):
    """How many offer texts each store product reaches and the best that isn't its own sku."""
    counts = matching.match_counts(store(spark, sf_dir), supply(spark, sf_dir))
    return counts.withColumn("best_other", F.round("best_other", 6))


def _top(spark, sf_dir):
    return matching.top_matches(store(spark, sf_dir), supply(spark, sf_dir))


@query(_MATCH_SQL + "SELECT store_id, rank::INT AS rank, supplier, sku, price, round(similarity, 6) AS similarity FROM top")
def match_topk(spark, sf_dir):
    return _top(spark, sf_dir).select("store_id", "rank", "supplier", "sku", "price", F.round("similarity", 6).alias("similarity"))


@query(_MATCH_SQL + "SELECT st.store_id, st.sku, top.rank::INT AS rank, top.sku AS match_sku, top.price AS match_price FROM st LEFT JOIN top ON st.store_id = top.store_id")
def match_board(spark, sf_dir):
    return matching.match_board(store(spark, sf_dir), _top(spark, sf_dir)).select("store_id", "sku", "rank", "match_sku", "match_price")


def _board_rows(spark, sf_dir):
    c = F.col
    return _top(spark, sf_dir).select("store_id", T.group_id(F.concat(F.lit("SKU-"), c("store_id")), F.lit(None).cast("string")).alias("group_id"), T.match_id(c("supplier"), c("sku"), c("name")).alias("match_id"), "rank", "price", F.round("similarity", 6).alias("similarity"))


def _state(rows):
    """A stored review of every third rank, and one of a pair that is gone."""
    status = F.when(F.col("rank") == 3, "removed").otherwise("flagged")
    return rows.where("rank % 3 = 0").select("group_id", "match_id", status.alias("status")).unionAll(rows.where("rank = 1").select("group_id", F.lit("match::gone").alias("match_id"), F.lit("confirmed").alias("status")))


_STATE_SQL = _MATCH_SQL + """
, board AS (
    SELECT store_id, 'store::' || sha1('sku-' || store_id)[1:16] AS group_id, 'match::' || sha1(lower(supplier) || '||' || lower(sku) || '||' || lower(name))[1:16] AS match_id,
           rank::INT AS rank, price, round(similarity, 6) AS similarity FROM top),
state AS (SELECT group_id, match_id, CASE WHEN rank = 3 THEN 'removed' ELSE 'flagged' END AS status FROM board WHERE rank % 3 = 0 UNION ALL SELECT group_id, 'match::gone', 'confirmed' FROM board WHERE rank = 1),
joined AS (SELECT b.*, coalesce(s.status, CASE WHEN similarity >= 0.999 THEN 'confirmed' ELSE 'pending' END) AS status FROM board b LEFT JOIN state s USING (group_id, match_id))
"""


@query(_STATE_SQL + "SELECT store_id, group_id, match_id, rank, similarity, status FROM joined WHERE status <> 'removed'")
def match_rows_state(spark, sf_dir):
    rows = _board_rows(spark, sf_dir)
    return matching.with_state(rows, _state(rows)).select("store_id", "group_id", "match_id", "rank", "similarity", "status")


@query(_STATE_SQL + "SELECT group_id, match_id, status FROM state SEMI JOIN board USING (group_id, match_id)")
def state_prune(spark, sf_dir):
    rows = _board_rows(spark, sf_dir)
    return matching.prune_state(_state(rows), rows).select("group_id", "match_id", "status")


@query("""SELECT product_id, row_number() OVER (PARTITION BY supplier ORDER BY nullif(trim(currency), '') DESC NULLS LAST, price ASC NULLS LAST, product_id DESC)::INT AS place FROM product""")
def row_sort(spark, sf_dir):
    """Rows of a supplier by currency descending and price, missing ones last either way."""
    rows = table(spark, sf_dir, "product").select("product_id", "supplier", "price", F.nullif(F.trim("currency"), F.lit("")).alias("currency"))
    return places(rows, "supplier", [F.col("currency").desc_nulls_last(), F.col("price").asc_nulls_last(), F.col("product_id").desc()]).select("product_id", "place")


# --- tags

_KEYWORD_SQL = "[" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{k}{chr(39)})' for k in words)} THEN '{tag}' END" for tag, words in tagging.KEYWORD_RULES.items()) + "]"


@query(f"""WITH x AS (SELECT product_id, lower(concat_ws(' ', name, description)) AS t FROM product) SELECT product_id, array_to_string(list_sort([k FOR k IN {_KEYWORD_SQL} IF k IS NOT NULL]), '|') AS tags FROM x""")
def keyword_tags(spark, sf_dir):
    return table(spark, sf_dir, "product").select("product_id", F.array_join(F.array_sort(tagging.keyword_tags(F.concat_ws(" ", "name", "description"), tagging.KEYWORD_RULES)), "|").alias("tags"))


_RULES = [{"name": "fast power", "conditions": ["power ?bank|повербанк", "65 ?(w|вт)"], "tags": ["fast", "power"]}, {"name": "glass", "conditions": ["glass|скло"], "tags": ["glass"]}]
_RULE_SQL = """
WITH x AS (SELECT product_id, coalesce(tags, []) AS tags, lower(concat_ws(' ', name, description)) AS t FROM product),
r AS (SELECT product_id, tags, list_concat(CASE WHEN regexp_matches(t, 'power ?bank|повербанк') AND regexp_matches(t, '65 ?(w|вт)') THEN ['fast', 'power'] ELSE [] END, CASE WHEN regexp_matches(t, 'glass|скло') THEN ['glass'] ELSE [] END) AS rule FROM x)
"""


def _ruled(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "product").select("product_id", F.coalesce("tags", none).alias("tags"), F.lower(F.concat_ws(" ", "name", "description")).alias("t"))
    return rows.withColumn("rule", tagging.rule_tags(F.col("t"), _RULES)).withColumn("auto", tagging.keyword_tags(F.col("t"), tagging.KEYWORD_RULES))


@query(_RULE_SQL + "SELECT product_id, array_to_string(list_sort(rule), '|') AS tags FROM r")
def rule_tags(spark, sf_dir):
    return _ruled(spark, sf_dir).select("product_id", F.array_join(F.array_sort("rule"), "|").alias("tags"))


@query(_RULE_SQL + f"""
, a AS (SELECT r.*, [k FOR k IN {_KEYWORD_SQL} IF k IS NOT NULL] AS auto FROM r JOIN x USING (product_id))
SELECT product_id, array_to_string(list_sort(list_distinct([k FOR k IN list_concat(auto, rule) IF NOT list_contains(tags, k)])), '|') AS proposed,
       array_to_string(list_sort([k FOR k IN rule IF NOT list_contains(tags, k)]), '|') AS selected, array_to_string(list_sort(list_distinct(list_concat(tags, rule))), '|') AS effective FROM a""")
def tag_assignment(spark, sf_dir):
    sets = tagging.assign(F.col("tags"), F.col("auto"), F.col("rule"))
    return _ruled(spark, sf_dir).select("product_id", *(F.array_join(c, "|").alias(n) for n, c in sets.items()))


_CLASS_SQL = "CASE " + " ".join(f"WHEN lower(tag) IN ({', '.join(f'{chr(39)}{w}{chr(39)}' for w in words)}) THEN '{name}'" for name, words in tagging.TAG_WORDS.items()) + " END"


@query(f"SELECT tag, {_CLASS_SQL} AS class, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM product) GROUP BY ALL")
def tag_classes(spark, sf_dir):
    return table(spark, sf_dir, "product").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).select("tag", tagging.tag_class(F.col("tag")).alias("class"), "n")


def _hierarchy(spark, sf_dir):
    """A three-level hierarchy out of part, a row for each category: type, brand, name."""
    part = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_name").distinct()
    models = part.groupBy("p_type", "p_brand").agg(F.array_sort(F.collect_list(F.struct(F.col("p_name").alias("name"), F.lit(None).cast("string").alias("pattern"), F.array().cast("array<string>").alias("tags")))).alias("models"))
    brands = models.groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct(F.col("p_brand").alias("name"), "models"))).alias("brands"))
    return brands.select(F.array(F.struct(F.col("p_type").alias("name"), "brands")).alias("categories"))


@query(r"""SELECT DISTINCT p_type AS category, p_brand AS brand, p_name AS name, '(?<![A-Za-z0-9])' || array_to_string(string_split(regexp_replace(p_brand || ' ' || p_name, '([^A-Za-z0-9_ ])', '\\\1', 'g'), ' '), '[\W_]*') || '(?![A-Za-z0-9])' AS pattern,
    p_type || '|' || p_brand || '|' || p_name AS tags FROM part""")
def model_records(spark, sf_dir):
    return tagging.model_records(_hierarchy(spark, sf_dir)).withColumn("tags", F.array_join("tags", "|"))


@query("SELECT lower(p_type) AS category, lower(p_brand) AS brand, lower(p_name) AS name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_models(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    return tagging.duplicate_models(rows)


#: Templates for the model query, as a configuration would list them.
TEMPLATES = [{"brand": b, "name": n, "tags": [b, n]} for b, n in (("Hestrova", "Delvo 0"), ("Tarqon", "Kivra"), ("Mostravi", "Jolta"), ("Fenzoro", "Gravo"), ("Dramelo", "Estra 14 Pro"))]


def _model_sql(brand: str, name: str) -> str:
    """Whether a name spells brand and model, or holds the model's words side by side, or (loosely) all words in order."""
    spelt = r"[\W_]*".join(f"{brand} {name}".lower().split())
    return rf"""regexp_matches(lower(name), '(^|[^a-z0-9]){spelt}($|[^a-z0-9])') OR contains(w, ' {name.lower()} ')"""


_MODELS_SQL = ", ".join(f"CASE WHEN {_model_sql(t['brand'], t['name'])} THEN ['{t['brand']}', '{t['name']}'] ELSE [] END" for t in TEMPLATES)
_LOOSE_SQL = " ".join(f"WHEN regexp_matches(w, ' {'( .*)? '.join((t['brand'] + ' ' + t['name']).lower().split())} ') THEN ['{t['brand']}', '{t['name']}']" for t in sorted(TEMPLATES, key=lambda t: (-len((t["brand"] + " " + t["name"]).split()), -len((t["brand"] + t["name"]).replace(" ", "")))))


@query(rf"""
    WITH x AS (SELECT product_id, name, ' ' || array_to_string(regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS w FROM product),
    m AS (SELECT product_id, flatten([{_MODELS_SQL}]) AS sure, CASE {_LOOSE_SQL} ELSE [] END AS loose FROM x),
    t AS (SELECT product_id, CASE WHEN len(sure) > 0 THEN sure ELSE loose END AS tags FROM m)
    SELECT product_id, array_to_string(list_sort(list_distinct(tags)), '|') AS model_tags FROM t WHERE len(tags) > 0""")
def model_match(spark, sf_dir):
    rows = table(spark, sf_dir, "product").select("product_id", "name")
    return match_models(rows, "name", TEMPLATES).where(F.size("model_tags") > 0).select("product_id", F.array_join("model_tags", "|").alias("model_tags"))


# --- channel export

_KEEP = ("id_internal", "sku", "brand", "model", "device_type", "price", "currency", "availability", "channel_exclude")


@query(f"SELECT {', '.join(_KEEP)}, NULL::VARCHAR AS images_main_url FROM sample_raw")
def staging_conform(spark, sf_dir):
    """Staging of a source that lacks a column and has one too many."""
    raw = table(spark, sf_dir, "sample_raw").drop("images_main_url").withColumn("surplus", F.lit(1))
    return channel.staging(raw).select(*_KEEP, "images_main_url")


_EXCLUDE_SQL = "coalesce(lower(trim(channel_exclude)) IN ('true', 'yes') OR TRY_CAST(trim(channel_exclude) AS DOUBLE) <> 0, false)"


@query(f"SELECT id_internal, channel_exclude FROM sample_raw WHERE NOT {_EXCLUDE_SQL}")
def exclude_filter(spark, sf_dir):
    return channel.without_excluded(channel.staging(table(spark, sf_dir, "sample_raw"))).select("id_internal", "channel_exclude")


_CHANNEL_SQL = f"""
WITH s AS (SELECT *, trim(coalesce(trim(brand), '') || ' ' || coalesce(trim(model), '')) AS base, coalesce(trim(device_type), '') AS dt FROM sample_raw WHERE NOT {_EXCLUDE_SQL}),
p AS (SELECT id_internal AS "ID", CASE WHEN dt <> '' THEN trim(base || ' — ' || dt) ELSE base END AS "Назва товару", price AS "Ціна", coalesce(nullif(trim(currency), ''), 'UAH') AS "Валюта", 'Новий' AS "Стан товару",
    CASE availability WHEN 'in_stock' THEN 'В наявності' WHEN 'preorder' THEN 'Під замовлення' ELSE coalesce(availability, '') END AS "Наявність", category_norm AS "Категорія", sku AS "Артикул", brand AS "Бренд",
    images_main_url AS main, images_extra_urls AS extra FROM s)
"""


@query(_CHANNEL_SQL + """SELECT "ID", "Назва товару", "Ціна", "Валюта", "Стан товару", "Наявність", "Категорія", "Артикул", "Бренд" FROM p""")
def channel_projection(spark, sf_dir):
    rows = channel.to_channel(channel.without_excluded(channel.staging(table(spark, sf_dir, "sample_raw"))))
    return rows.select("ID", "Назва товару", "Ціна", "Валюта", "Стан товару", "Наявність", "Категорія", "Артикул", "Бренд")


@query(_CHANNEL_SQL + r""", i AS (
    SELECT *, TRY_CAST(replace("Ціна", ',', '.') AS DOUBLE) AS n, [trim(x, e' \t\n\r' || chr(160)) FOR x IN regexp_split_to_array(coalesce(extra, ''), '[,|]') IF trim(x, e' \t\n\r' || chr(160)) <> ''] AS more FROM p)
    SELECT "ID" AS id, n AS priceuah, CASE "Наявність" WHEN 'В наявності' THEN 'склад' WHEN 'Під замовлення' THEN '' ELSE 'false' END AS available, "Наявність" = 'В наявності' AS in_stock,
           CASE WHEN coalesce(trim(main), '') <> '' THEN array_to_string(list_prepend(trim(main), more)[1:10], ' ') ELSE '' END AS images
    FROM i WHERE n > 0 AND n < 'infinity'::DOUBLE""")
def xml_items(spark, sf_dir):
    rows = channel.items(channel.to_channel(channel.without_excluded(channel.staging(table(spark, sf_dir, "sample_raw")))))
    return rows.where(F.col("priceuah") < float("inf")).select("id", "priceuah", "available", "in_stock", F.array_join("images", " ").alias("images"))


# --- manifests, headers, events


@query("""
    WITH old AS (SELECT * FROM price_file WHERE mtime < (SELECT median(mtime) FROM price_file))
    SELECT n.file_id, n.supplier, n.path FROM price_file n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.supplier = n.supplier AND o.path = n.path AND o.size = n.size AND o.mtime = n.mtime AND o.content_hash = n.content_hash)""")
def import_skip(spark, sf_dir):
    """Files that the manifest of the earlier half doesn't hold unchanged."""
    from ..sources.manifest import to_import

    files = table(spark, sf_dir, "price_file")
    half = files.agg(F.median("mtime")).scalar()
    return to_import(files, files.where(F.col("mtime") < half)).select("file_id", "supplier", "path")


@query("""
    WITH h AS (SELECT median(mtime) AS half FROM price_file), old AS (SELECT supplier, path, size FROM price_file, h WHERE mtime < half), new AS (SELECT supplier, path, size + 1 AS size FROM price_file, h WHERE NOT coalesce(mtime < half, false))
    SELECT supplier, path, size, 'old' AS run FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.supplier = old.supplier AND new.path = old.path) UNION ALL SELECT supplier, path, size, 'new' FROM new""")
def manifest_upsert(spark, sf_dir):
    """The manifest of the earlier half, updated by the later one."""
    files = table(spark, sf_dir, "price_file")
    half = files.agg(F.median("mtime")).scalar()
    old = files.where(F.col("mtime") < half).select("supplier", "path", "size", F.lit("old").alias("run"))
    new = files.where(~F.coalesce(F.col("mtime") < half, F.lit(False))).select("supplier", "path", (F.col("size") + 1).alias("size"), F.lit("new").alias("run"))
    return matching.upsert(old, new, ["supplier", "path"])


@query("""
    WITH h AS (SELECT file_id, generate_subscripts(string_split(header_line, delimiter), 1) - 1 AS place, unnest(string_split(header_line, delimiter)) AS header FROM price_file)
    SELECT file_id, field, min(place)::INT AS place FROM h JOIN (SELECT DISTINCT lower(trim(alias_name)) AS k, field FROM column_alias) ON k = lower(trim(header)) GROUP BY ALL""")
def header_mapping(spark, sf_dir):
    """Where each known field stands in each file."""
    from ..operators.bad_rows import file_layouts

    return file_layouts(table(spark, sf_dir, "price_file"), table(spark, sf_dir, "column_alias")).select("file_id", F.explode("places").alias("field", "place"))


@query("SELECT event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def events_tail(spark, sf_dir):
    """The latest 50 events; the limit is the feature, met by a top-k without a full sort."""
    rows = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return rows.select("event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT event_type, k, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL""")
def extra_keys(spark, sf_dir):
    """The keys of an open map, which an export turns into columns."""
    return table(spark, sf_dir, "events").select("event_type", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(f"SELECT template_id, len(headers) AS n_headers, lower({_trim('supplier')}) AS supplier_key FROM import_template")
def template_keys(spark, sf_dir):
    """Saved templates under the key of their supplier."""
    rows = table(spark, sf_dir, "import_template")
    return rows.select("template_id", F.size("headers").cast("long").alias("n_headers"), schema_drift.header_key(F.col("supplier")).alias("supplier_key"))
