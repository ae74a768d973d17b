"""Queries of the match board and the tag board over the catalogue's tables, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching, tagging
from ..operators.model_matcher import Lexicon
from ..operators.ranking import places
from ..session import stored, table
from .offer_queries import TEMPLATES, _MODELS_SQL, _LOOSE_SQL, _trim, _whole_word

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the match board: goods of sample_raw as the store's, listings of product as the suppliers'


def goods(spark, sf_dir):
    """Store products: what the raw export lists, named by kind, brand and model."""
    rows = table(spark, sf_dir, "sample_raw").select(F.col("id_internal").alias("store_id"), "sku", F.concat_ws(" ", "device_type", "brand", "model").alias("name"), T.parse_price("price").alias("price"), F.array_compact(F.array("category_norm")).alias("tags"))
    return matching.token_sets(rows, matching.default_tokens("name", "sku", "tags"))


def listings(spark, sf_dir):
    """Supplier offers: the listings, each under its id so that equal ones stay apart."""
    rows = table(spark, sf_dir, "product").select("supplier", "sku", F.coalesce("name", F.lit("")).alias("name"), F.when(~F.isnan("price"), F.col("price")).alias("price"))
    return matching.token_sets(rows, matching.default_tokens("name", "sku"))


def _reviews(rows, store):
    """Stored reviews of the second, third and fourth match of every store product."""
    status = F.when(F.col("rank") == 2, "removed").when(F.col("rank") == 3, "flagged").when(F.col("rank") == 4, "confirmed")
    keyed = rows.join(store.select("store_id", F.col("sku").alias("s"), F.col("name").alias("n")), "store_id")
    return keyed.select(T.group_id(F.col("s"), F.col("n")).alias("group_id"), T.match_id(F.col("supplier"), F.col("sku"), F.col("name")).alias("match_id"), status.alias("status")).where("status IS NOT NULL").groupBy("group_id", "match_id").agg(F.max("status").alias("status"))


_TOKENS = r"list_distinct([x FOR x IN regexp_split_to_array(lower(concat_ws(' ', name, sku)), '[\s\v\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+') IF x <> '']{more})"
_HASH = "sha1({x})[1:16]"
_ID = rf"concat_ws('||', nullif(lower({_trim('{a}')}), ''), nullif(lower({_trim('{b}')}), ''), nullif(lower({_trim('{c}')}), ''))"
_PRICE = r"""
praw AS (SELECT id_internal, replace(trim(regexp_replace(price, '[\s\p{Z}]+', '', 'g')), '−', '-') AS x FROM sample_raw),
pchars AS (SELECT id_internal, regexp_replace(x, '[^0-9,.\-]', '', 'g') AS y FROM praw),
psigned AS (SELECT id_internal, CASE WHEN y LIKE '-%' THEN '-' ELSE '' END || replace(y, '-', '') AS z FROM pchars),
pmarks AS (SELECT id_internal, z, length(z) - length(replace(z, ',', '')) AS nc, length(z) - length(replace(z, '.', '')) AS np, instr(reverse(z), ',') AS rc, instr(reverse(z), '.') AS rp FROM psigned),
parsed AS (
    SELECT id_internal, CASE WHEN NOT regexp_matches(z, '[0-9]') THEN NULL
        WHEN nc > 0 AND np > 0 AND rc < rp THEN TRY_CAST(replace(replace(z, '.', ''), ',', '.') AS DOUBLE)
        WHEN nc > 0 AND np > 0 THEN TRY_CAST(replace(z, ',', '') AS DOUBLE)
        WHEN nc = 1 THEN TRY_CAST(replace(z, ',', '.') AS DOUBLE) WHEN nc > 1 THEN TRY_CAST(replace(z, ',', '') AS DOUBLE)
        WHEN np > 1 THEN TRY_CAST(replace(z, '.', '') AS DOUBLE) ELSE TRY_CAST(z AS DOUBLE) END AS price
    FROM pmarks)"""
_BOARD_SQL = f"""
WITH {_PRICE},
st0 AS (SELECT id_internal AS store_id, sku, concat_ws(' ', device_type, brand, model) AS name, parsed.price, CASE WHEN category_norm IS NULL THEN [] ELSE [category_norm] END AS tags FROM sample_raw JOIN parsed USING (id_internal)),
st AS (SELECT *, list_distinct(list_concat({_TOKENS.format(more='')}, [lower(t) FOR t IN tags])) AS a,
    'store::' || sha1(lower(coalesce(nullif({_trim('sku')}, ''), nullif({_trim('name')}, ''), 'product')))[1:16] AS group_id FROM st0),
li0 AS (SELECT product_id, supplier, sku, coalesce(name, '') AS name, CASE WHEN NOT isnan(price) THEN price END AS price FROM product),
li AS (SELECT *, {_TOKENS.format(more='')} AS b,
    'match::' || sha1(concat_ws('||', lower(coalesce(nullif({_trim('supplier')}, ''), 'unknown')), nullif(lower({_trim('sku')}), ''), nullif(lower({_trim('name')}), '')))[1:16] AS match_id FROM li0),
inv_a AS (SELECT store_id, unnest(a) AS t FROM st), inv_b AS (SELECT product_id, unnest(b) AS t FROM li),
met AS (SELECT store_id, product_id, count(*) AS n FROM inv_a JOIN inv_b USING (t) GROUP BY ALL),
same AS (SELECT store_id, product_id FROM st JOIN li ON lower(st.sku) = lower(li.sku)),
scored AS (
    SELECT store_id, product_id, n::DOUBLE / (len(a) + len(b) - n) AS similarity FROM met JOIN st USING (store_id) JOIN li USING (product_id) WHERE NOT coalesce(lower(st.sku) = lower(li.sku), false)
    UNION ALL SELECT store_id, product_id, 1.0 FROM same),
good AS (SELECT * FROM scored WHERE similarity >= 0.15),
ranked AS (
    SELECT store_id, product_id, similarity, row_number() OVER (PARTITION BY store_id ORDER BY similarity DESC, price NULLS FIRST, supplier NULLS FIRST, sku NULLS FIRST, name NULLS FIRST) AS rank FROM good JOIN li USING (product_id)),
top AS (SELECT r.*, group_id, match_id, supplier, li.sku, li.name, li.price FROM ranked r JOIN st USING (store_id) JOIN li USING (product_id) WHERE rank <= 8),
reviews AS (SELECT group_id, match_id, max(CASE rank WHEN 2 THEN 'removed' WHEN 3 THEN 'flagged' ELSE 'confirmed' END) AS status FROM top WHERE rank IN (2, 3, 4) GROUP BY ALL),
left0 AS (SELECT *, CASE WHEN len(b) > 0 THEN array_to_string(list_sort(b), ' ') ELSE lower(name) END AS tokens_text FROM li WHERE product_id NOT IN (SELECT product_id FROM good) ),
left1 AS (SELECT * FROM left0 WHERE tokens_text IN (SELECT tokens_text FROM left0 GROUP BY ALL HAVING count(*) >= 2)),
rest AS (SELECT *, 'supplier::' || sha1(lower({_trim('tokens_text')}))[1:16] AS group_id FROM left1),
board0 AS (
    SELECT group_id, 'store' AS group_type, store_id, match_id, supplier, sku, name, price, similarity FROM top
    UNION ALL SELECT group_id, 'supplier-only', NULL, match_id, supplier, sku, name, price, 1.0 FROM rest),
board1 AS (SELECT b.*, coalesce(r.status, CASE WHEN similarity >= 0.999 THEN 'confirmed' ELSE 'pending' END) AS status FROM board0 b LEFT JOIN reviews r USING (group_id, match_id)),
board AS (
    SELECT * FROM board1 WHERE status <> 'removed'
    UNION ALL SELECT group_id, 'store', store_id, NULL, NULL, NULL, NULL, NULL, 0.0, 'pending' FROM st WHERE store_id NOT IN (SELECT store_id FROM top)),
rows AS (SELECT board.*, st.sku AS store_sku, st.name AS store_name, st.price AS store_price, st.tags AS store_tags FROM board LEFT JOIN st USING (store_id))
"""


def _board(spark, sf_dir):
    store, offers = goods(spark, sf_dir), listings(spark, sf_dir)
    r = matching.reach(store, offers, 0.15)
    matches = stored(matching.top_matches(store, offers, r=r), "matches")
    return matching.board_rows(store, offers, _reviews(matches, store), r=r, matches=matches)


@query(_BOARD_SQL + "SELECT group_id, group_type, store_id, match_id, supplier, sku, price, round(similarity, 6) AS similarity, status FROM rows")
def board_rows(spark, sf_dir):
    return _board(spark, sf_dir).select("group_id", "group_type", "store_id", "match_id", "supplier", "sku", "price", F.round("similarity", 6).alias("similarity"), "status")


@query(_BOARD_SQL + """SELECT 'all' AS filter, count(*) AS n FROM rows UNION ALL SELECT 'has_matches', count(*) FROM rows WHERE group_type = 'store' AND match_id IS NOT NULL
    UNION ALL SELECT 'no_matches', count(*) FROM rows WHERE group_type = 'store' AND match_id IS NULL UNION ALL SELECT 'supplier_only', count(*) FROM rows WHERE group_type = 'supplier-only'
    UNION ALL SELECT 'confirmed', count(*) FROM rows WHERE status = 'confirmed' UNION ALL SELECT 'pending', count(*) FROM rows WHERE status <> 'confirmed' UNION ALL SELECT 'near', count(*) FROM rows WHERE match_id IS NULL OR similarity >= 0.6""")
def match_filters(spark, sf_dir):
    """How many rows each filter of the board keeps."""
    named = matching.board_filters()
    kept = F.array_compact(F.array(*(F.when(c, n) for n, c in named.items())))
    counts = _board(spark, sf_dir).select(F.explode(kept).alias("filter")).groupBy("filter").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(n,) for n in named], "filter string")
    return names.join(counts, "filter", "left").select("filter", F.coalesce("n", F.lit(0)).alias("n"))


@query(_BOARD_SQL + "SELECT group_id, store_id, match_id, supplier FROM rows WHERE contains(lower(concat_ws(chr(10), store_sku, store_name, array_to_string(store_tags, ' '), sku, name, supplier)), 'galtimo')")
def board_search(spark, sf_dir):
    return _board(spark, sf_dir).where(matching.board_search(" Galtimo")).select("group_id", "store_id", "match_id", "supplier")


@query(_BOARD_SQL + """SELECT group_type, group_id, match_id, price, row_number() OVER (PARTITION BY group_type ORDER BY nullif(lower(supplier), '') DESC NULLS LAST, group_id DESC, coalesce(store_id, '') DESC, coalesce(match_id, '') DESC, coalesce(price, -1) DESC)::INT AS place FROM rows""")
def board_sort(spark, sf_dir):
    """The board's rows by supplier, descending, those without one last."""
    return places(_board(spark, sf_dir), "group_type", matching.board_order("supplier", True)).select("group_type", "group_id", "match_id", "price", "place")


@query(_BOARD_SQL + "SELECT CASE WHEN status = 'confirmed' THEN 'match-full' WHEN status = 'flagged' OR (match_id IS NOT NULL AND similarity < 0.45) THEN 'match-low' ELSE 'match-none' END AS shown, group_type, count(*) AS n FROM rows GROUP BY ALL")
def board_display(spark, sf_dir):
    return _board(spark, sf_dir).groupBy(matching.display_class().alias("shown"), "group_type").agg(F.count("*").alias("n"))


@query(_BOARD_SQL + """
    , g AS (SELECT group_id, group_type, store_sku, store_name, store_price, min(price) AS least,
        arg_min(lower(name), [lpad(CAST(CAST(round((2 - CASE WHEN group_type = 'store' THEN similarity ELSE 0 END) * 1e12) AS BIGINT) AS VARCHAR), 15, '0'), CASE WHEN group_type = 'store' THEN '' ELSE lower(name) END, CASE WHEN price IS NULL THEN '' ELSE lpad(CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), 18, '0') END, coalesce(supplier, ''), coalesce(lower(sku), '')]) AS first_name,
        arg_min(coalesce(lower(sku), ''), [CASE WHEN group_type = 'store' THEN '' ELSE lower(name) END, CASE WHEN price IS NULL THEN '' ELSE lpad(CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), 18, '0') END, coalesce(supplier, ''), coalesce(lower(sku), '')]) AS first_sku
        FROM rows GROUP BY group_id, group_type, store_id, store_sku, store_name, store_price)
    SELECT group_id, coalesce(lower(store_name), first_name, '') AS sort_name, CASE WHEN group_type = 'store' THEN coalesce(lower(store_sku), '') ELSE first_sku END AS sort_sku,
           CASE WHEN group_type = 'store' THEN coalesce(store_price, 'infinity'::DOUBLE) ELSE 'infinity'::DOUBLE END AS sort_price, coalesce(least, 'infinity'::DOUBLE) AS supplier_price FROM g""")
def group_order(spark, sf_dir):
    """The board's groups with what they are sorted by."""
    return matching.sorted_groups(_board(spark, sf_dir)).drop("supplier_name")


@query(_BOARD_SQL + "SELECT group_id, tokens_text, count(*) AS n_offers, min(lower(name)) AS first_name FROM rest GROUP BY ALL")
def supplier_only_groups(spark, sf_dir):
    """Listings that no store product reaches by sku or similarity, alike among themselves."""
    return matching.unmatched_groups(goods(spark, sf_dir), listings(spark, sf_dir))


@query(_BOARD_SQL + "SELECT group_id, name, price, row_number() OVER (PARTITION BY group_id ORDER BY lower(name), price NULLS FIRST, supplier NULLS FIRST, sku NULLS FIRST, name NULLS FIRST)::INT AS place FROM rest")
def leftover_order(spark, sf_dir):
    """Left-over listings of each group by name and price."""
    rows = matching.leftovers(goods(spark, sf_dir), listings(spark, sf_dir)).withColumn("low", F.lower("name"))
    return places(rows.select("group_id", "name", "low", "price", "supplier", "sku"), "group_id", [F.col(c) for c in ("low", "price", "supplier", "sku", "name")]).select("group_id", "name", "price", "place")


# --- the tag board

_CASES = [{"name": "case", "conditions": ["чохол|накладка|cover|case"], "tags": ["Чохол"]}, {"name": "bank", "conditions": ["павербанк"], "tags": ["Павербанк"]}, {"name": "dark", "conditions": ["чорн|black"], "tags": ["Black"]}]
_SYNONYMS = {"павербанк": ["повербанк", "power bank"]}
_NAMES = [t["name"] for t in TEMPLATES]


def _saved(spark, sf_dir):
    """Tags saved earlier: a brand for every supplier's goods without currency."""
    rows = table(spark, sf_dir, "product").where("currency IS NULL").select(T.assignment_key(F.col("supplier"), F.col("sku"), F.col("name")).alias("assignment_key"))
    return rows.distinct().withColumn("tags", F.array(F.lit("Kelmazi Lab")))


def _assignments(spark, sf_dir):
    rows = table(spark, sf_dir, "product").select("product_id", "supplier", "sku", "name", "description", "tags")
    return tagging.build_assignments(rows, TEMPLATES, _CASES, _saved(spark, sf_dir), _SYNONYMS)


_KEY = f"coalesce(nullif({_trim('supplier')}, ''), 'unknown') || '::' || coalesce(nullif({_trim('sku')}, ''), nullif({_trim('name')}, ''), '')"
_SYN = lambda x: _trim(_whole_word(_whole_word(f"lower(coalesce({x}, ''))", "повербанк", "павербанк"), "power bank", "павербанк"))
_RULES_SQL = "flatten([" + ", ".join(f"CASE WHEN regexp_matches(t, '{r['conditions'][0]}') THEN ['{r['tags'][0]}'] ELSE [] END" for r in _CASES) + "])"
_TAGS_SQL = rf"""
WITH k AS (SELECT product_id, coalesce(tags, []) AS tags, currency, {_KEY} AS key, {_SYN('name')} AS name, {_SYN('description')} AS about, sku AS raw_sku, name AS raw_name FROM product),
s AS (SELECT DISTINCT key FROM k WHERE currency IS NULL),
x AS (SELECT k.*, list_sort(list_distinct(list_concat(tags, CASE WHEN s.key IS NULL THEN [] ELSE ['Kelmazi Lab'] END))) AS cur,
    concat_ws(' ', nullif(name, ''), nullif(about, '')) AS t, ' ' || array_to_string(regexp_extract_all(name, '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS w FROM k LEFT JOIN s USING (key)),
m AS (SELECT *, flatten([{_MODELS_SQL}]) AS sure, CASE {_LOOSE_SQL} ELSE [] END AS loose, {_RULES_SQL} AS ruled FROM x),
a AS (SELECT *, list_sort(list_distinct(CASE WHEN len(sure) > 0 THEN sure ELSE loose END)) AS auto FROM m),
p AS (SELECT *, list_sort(list_distinct([y FOR y IN list_concat(auto, ruled) IF NOT list_contains(cur, y)])) AS proposed, list_sort([y FOR y IN ruled IF NOT list_contains(cur, y)]) AS selected FROM a),
e AS (SELECT *, list_distinct(list_concat(cur, proposed, selected)) AS every FROM p),
f AS (SELECT *, [y FOR y IN every IF lower(y) IN ('чохол', 'плівка', 'кабель', 'зарядка', 'навушники', 'павербанк')] AS types,
    len([y FOR y IN every IF lower(y) IN ({', '.join(f"'{n.lower()}'" for n in _NAMES)}) OR regexp_matches(y, '(?i)(^|[^\p{{L}}\p{{N}}_])(iphone|ipad|galaxy|s[0-9][0-9]?|note|redmi|mi|poco|pixel|nova|mate|magic|honor|oneplus|motorola|razr|xperia|realme|oppo|vivo|watch)($|[^\p{{L}}\p{{N}}_])')]) AS n_models,
    len([y FOR y IN every IF lower(y) IN ('black', 'blue', 'transparent', 'pink', 'red', 'white', 'green', 'yellow', 'purple', 'orange', 'gold', 'silver', 'gray', 'grey', 'brown', 'beige')]) AS n_colours,
    len([y FOR y IN every IF NOT lower(y) IN ('чохол', 'плівка', 'кабель', 'зарядка', 'навушники', 'павербанк', 'black', 'blue', 'transparent', 'pink', 'red', 'white', 'green', 'yellow', 'purple', 'orange', 'gold', 'silver', 'gray', 'grey', 'brown', 'beige', 'tpu', 'silicone', 'silicon', 'leather', 'metal', 'plastic', 'glass', 'carbon', 'camera protective', 'camera protection', 'magsafe', 'anti blue', 'matte', 'soft case')
        AND (lower(y) IN ('apple', 'samsung', 'xiaomi', 'redmi', 'realme', 'huawei', 'oppo', 'vivo', 'poco', 'oneplus', 'nokia', 'motorola', 'google', 'sony', 'getman', 'baseus') OR CASE WHEN trim(y) LIKE '% %' THEN NOT regexp_matches(trim(y), '(^|\s)[^\p{{Lu}}\s]') ELSE regexp_matches(trim(y), '^\p{{Lu}}..') END)]) AS n_brands FROM e)
"""


@query(_TAGS_SQL + r"""
    SELECT product_id, array_to_string(cur, '|') AS current, array_to_string(auto, '|') AS auto, array_to_string(proposed, '|') AS proposed, array_to_string(selected, '|') AS selected, list_min(types) AS category,
        array_to_string([y FOR y IN [CASE WHEN list_contains([lower(z) FOR z IN types], 'чохол') AND n_models = 0 THEN 'Відсутній тег моделі' END, CASE WHEN list_contains([lower(z) FOR z IN types], 'чохол') AND n_colours = 0 THEN 'Відсутній тег кольору' END,
            CASE WHEN list_contains([lower(z) FOR z IN types], 'павербанк') AND n_brands = 0 THEN 'Відсутній тег бренду' END] IF y IS NOT NULL], '|') AS errors FROM f""")
def tag_board(spark, sf_dir):
    """The whole assignment: saved tags, synonyms, models, rules, category and what is lacking."""
    rows = _assignments(spark, sf_dir)
    joined = [F.array_join(c, "|").alias(c) for c in ("current", "auto", "proposed", "selected", "errors")]
    return rows.select("product_id", "category", *joined)


@query(_TAGS_SQL + """
    , o AS (SELECT *, ['Black', 'kept'] AS old_selected FROM e),
    r AS (SELECT *, list_sort(list_distinct(list_concat(selected, [y FOR y IN old_selected IF list_contains(proposed, y)]))) AS again FROM o),
    q AS (SELECT *, list_sort(list_distinct(list_concat(again, [y FOR y IN auto IF list_contains(proposed, y)]))) AS pend FROM r)
    SELECT product_id, array_to_string(pend, '|') AS chosen, array_to_string(list_sort(list_distinct(list_concat(cur, pend))), '|') AS current, array_to_string(list_sort([y FOR y IN proposed IF NOT list_contains(pend, y)]), '|') AS proposed FROM q""")
def tag_review(spark, sf_dir):
    """A second run over reviewed products, then pending tags applied, then all chosen ones made current."""
    rows = _assignments(spark, sf_dir)
    old = F.array(F.lit("Black"), F.lit("kept"))
    again = tagging.rerun(F.col("proposed"), F.col("selected"), F.col("current"), old)["selected"]
    rows = rows.withColumn("selected", again).withColumn("selected", tagging.apply_pending(F.col("selected"), F.col("auto"), F.col("proposed")))
    done = tagging.commit(F.col("current"), F.col("proposed"), F.col("selected"))
    return rows.select("product_id", F.array_join("selected", "|").alias("chosen"), F.array_join(done["current"], "|").alias("current"), F.array_join(done["proposed"], "|").alias("proposed"))


@query(_TAGS_SQL + "SELECT product_id FROM e WHERE contains(lower(concat_ws(' ', nullif(raw_sku, ''), nullif(raw_name, ''), nullif(array_to_string(cur, ' '), ''), nullif(array_to_string(list_sort(proposed), ' '), ''))), 'black')")
def tag_search(spark, sf_dir):
    """Products of the tag board that a text is found in."""
    rows = _assignments(spark, sf_dir)
    return rows.where(tagging.board_text(F.col("sku"), F.col("name"), F.col("current"), F.col("proposed")).contains("black")).select("product_id")


@query("SELECT DISTINCT tag, lower(tag) IN ('чохол', 'плівка', 'кабель', 'зарядка', 'навушники', 'павербанк') AS is_type FROM (SELECT unnest(tags) AS tag FROM product)")
def type_tags(spark, sf_dir):
    return table(spark, sf_dir, "product").select(F.explode("tags").alias("tag")).distinct().select("tag", tagging.is_class(F.col("tag"), "type").alias("is_type"))


@query(r"""
    WITH x AS (SELECT product_id, name, lower(name) AS l FROM product WHERE name IS NOT NULL),
    f AS (SELECT product_id, [regexp_extract(name, '(?i)(^|[^a-z0-9])(' || p || ')($|[^a-z0-9])', 2) FOR p IN ['hestrova[\W_]*delvo[\W_]*0', 'tarqon[\W_]*kivra', 'mostravi[\W_]*jolta', 'fenzoro[\W_]*gravo', 'dramelo[\W_]*estra[\W_]*14[\W_]*pro']] AS found FROM x),
    g AS (SELECT product_id, [y FOR y IN found IF y <> ''] AS found FROM f)
    SELECT product_id, found[1] AS stretch FROM g WHERE len(found) = 1""")
def longest_model(spark, sf_dir):
    """The longest stretch of a name that one model is spelt with, of names that spell just one."""
    @F.pandas_udf("stretch string, n int")
    def longest(names: pd.Series) -> pd.DataFrame:
        words = Lexicon(TEMPLATES)
        return pd.DataFrame([(words.longest(x), len({m for *_, m in words.mentions(x or "")[0]})) for x in names], columns=["stretch", "n"])

    rows = table(spark, sf_dir, "product").where("name IS NOT NULL").select("product_id", longest("name").alias("x"))
    return rows.where("x.n = 1").select("product_id", "x.stretch")
