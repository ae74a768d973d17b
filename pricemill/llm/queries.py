"""Queries of the subpackage, their parameters as in production, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .articles import article_groups, same_article_pairs
from .bpe import encode_corpus
from .copies import bare, copies, copy_counts, order_free
from .lookalike import consistent_texts, same_looking_classes, same_looking_pairs
from .mixing import mix_sources, shares
from .topn import top_n_per_group

#: White space of any kind at either end.
_OUTER_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def p2_found(spark, sf_dir):
    offers = table(spark, sf_dir, "offer").where("price > 0 AND sku IS NOT NULL")
    sku = F.lower(F.regexp_replace("sku", _OUTER_BLANKS, ""))
    offers = offers.withColumn("sku_key", sku).where("sku_key <> ''")
    top = top_n_per_group(offers, 3, F.col("sku_key"), F.col("price"), -F.unix_micros(F.col("updated_at").cast("timestamp")), F.col("offer_id"))
    return top.select(F.col("g").alias("sku"), "rnk", F.col("id").alias("offer_id"))


def p3_found(spark, sf_dir):
    return same_article_pairs(table(spark, sf_dir, "product"))


def p3_groups(spark, sf_dir):
    return article_groups(table(spark, sf_dir, "product"))


def _p6(spark, sf_dir):
    rows = table(spark, sf_dir, "product").where("sku IS NOT NULL")
    return rows, order_free(bare("sku"), bare("name")), F.col("product_id")


def p6_found(spark, sf_dir):
    return copies(*_p6(spark, sf_dir))


def p6_counts(spark, sf_dir):
    return copy_counts(*_p6(spark, sf_dir))


def p9_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p9_shares(spark, sf_dir):
    return shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p8_ids(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents"))


def p10_found(spark, sf_dir):
    return same_looking_pairs(table(spark, sf_dir, "documents"))


def p10_classes(spark, sf_dir):
    return same_looking_classes(table(spark, sf_dir, "documents"))


def p10_texts(spark, sf_dir):
    return consistent_texts(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_groups": p3_groups, "p6_found": p6_found, "p6_counts": p6_counts, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_classes": p10_classes, "p10_texts": p10_texts}

# Looks in SQL, apart from the operator: every text is folded to Latin letters whatever its script, so nothing is decided by token.
_FOLD = {"АВСЕНІЈКМОРЅТХУасеһіјорѕхуѵԛԝԁ": "ABCEHIJKMOPSTXYacehijopsxyvqwd", "ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖϳορν": "ABCEHIJKMNOPTXYZjopv"}
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_FROM, _TO = "".join(_FOLD) + _WIDE, "".join(_FOLD.values()) + "".join(map(chr, range(0x21, 0x7F)))
_BARE = r"regexp_replace(text, '[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]', '', 'g')"
_LIGHT = f"replace({_BARE}, chr(13) || chr(10), chr(10))"
for _a, _b in (("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\u2011", "-"), ("\u2010", "-")):
    _LIGHT = f"replace({_LIGHT}, '{_a}', '{_b}')"
# accents are composed after the letters under them are folded
_FOLDED = "translate(" + _LIGHT + ", '" + _FROM.replace("'", "''") + "', '" + _TO.replace("'", "''") + "')"
for _a, _b in (("\u0457", "i\u0308"), ("\u0407", "I\u0308"), ("\u0451", "e\u0308"), ("\u0401", "E\u0308"), ("\u045e", "y\u0306"), ("\u040e", "Y\u0306")):
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"
_LOOK = rf"""regexp_replace(regexp_replace(regexp_replace(nfc_normalize({_FOLDED}), '[\t\v\f\r\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]', ' ', 'g'), ' +\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_LOOKS = f"WITH d AS (SELECT doc_id, text, {_LOOK} AS look FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, text, look FROM d WHERE look <> '')"

SQL = {
    "p10_found": _LOOKS + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_classes": _LOOKS + ", g AS (SELECT look, min(doc_id) AS class_id, count(*) AS n_docs, count(DISTINCT text) AS n_spellings FROM k GROUP BY look) SELECT doc_id, class_id, n_docs, n_spellings FROM k JOIN g USING (look) WHERE n_spellings > 1",
    "p2_found": r"""
        WITH o AS (
            SELECT lower(regexp_replace(sku, '^[\s\v\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\v\p{Z}\x{1c}-\x{1f}\x{85}]+$', '', 'g')) AS sku, offer_id, price, updated_at
            FROM offer WHERE sku IS NOT NULL AND price > 0 AND NOT isnan(price)),
        r AS (
            SELECT sku, row_number() OVER (PARTITION BY sku ORDER BY price, updated_at DESC NULLS LAST, offer_id) AS rnk, offer_id
            FROM o WHERE sku <> '')
        SELECT sku, rnk, offer_id FROM r WHERE rnk <= 3""",
    "p6_found": r"""
        WITH k AS (
            SELECT product_id, regexp_replace(lower(sku), '[^\p{L}\p{N}]+', '', 'g') AS a, coalesce(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g'), chr(1)) AS b
            FROM product WHERE sku IS NOT NULL),
        g AS (SELECT product_id, min(product_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS first_id FROM k)
        SELECT first_id, product_id AS copy_id FROM g WHERE first_id < product_id""",
    "p6_counts": r"""
        WITH k AS (
            SELECT product_id, regexp_replace(lower(sku), '[^\p{L}\p{N}]+', '', 'g') AS a, coalesce(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g'), chr(1)) AS b
            FROM product WHERE sku IS NOT NULL)
        SELECT min(product_id) AS first_id, count(*) AS n_rows FROM k GROUP BY least(a, b), greatest(a, b)""",
}
