"""The problems' queries in SQL, written apart from the operators, over whole tables."""

from __future__ import annotations

_TRIM = r"regexp_replace({x}, '^[\s\v\p{{Z}}\x{{FEFF}}]+|[\s\v\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


def _trim(x: str) -> str:
    return _TRIM.format(x=x)


# Fixed values, stated apart from the operator: what may stand for a currency beside an amount.
CURRENCY_NAMES = [
    "₴", "$", "€", "£", "US$", "UAH", "USD", "EUR", "PLN", "HUF", "GBP", "CHF", "CZK",
    "грн", "грн.", "гривня", "гривні", "гривень", "дол", "дол.", "дол. США", "долар", "долари", "доларів", "доларів США", "євро", "euro", "euros", "zł", "zl", "злотий", "злоті", "злотих", "Ft", "форинт", "форинти", "форинтів",
]

# --- 4: a record with a delimiter before it is a sequence of delimiter and field

_DELIMITERS = {",": ",", ";": ";", "|": r"\|", "\t": r"\t"}
_BLANK = r"[\s\v\p{Z}]*"
_NAMES = "(?:" + "|".join(n.replace("$", r"\$").replace(".", r"\.") for n in sorted(CURRENCY_NAMES, key=len, reverse=True)) + ")"
_NUMBER = r"(?:\d+(?:[.,]\d+)?|\d{1,3}(?:[ \x{a0}\x{202f}\x{2009}]\d{3})+(?:[.,]\d+)?|\d{1,3}(?:[''’]\d{3})+(?:[.,]\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,3}(?:\.\d{3})+(?:,\d+)?)"
_AMOUNT = rf"(?i){_BLANK}(?:[+−-]?{_BLANK}{_NUMBER}{_BLANK}{_NAMES}?|(?:[+−-]?{_BLANK}{_NAMES}|{_NAMES}{_BLANK}[+−-]?){_BLANK}{_NUMBER}){_BLANK}"


def _is_blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_full_match({x}, '[\\s\\v\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]*'))"


def _cut(d: str, pattern: str) -> str:
    field = rf'"[^"]*(?:""[^"]*)*"|[^"{pattern}][^{pattern}]*|'
    literal = "chr(9)" if d == "\t" else f"'{d}'"
    return f"""
    SELECT line_id, file_id, n, regexp_full_match({literal} || line, '(?s)(?:{pattern}(?:{field}))*') AS sound, regexp_extract_all({literal} || line, '(?s){pattern}({field})', 1) AS raw FROM l WHERE delimiter = {literal}"""


P4_FOUND = f"""
WITH l AS (SELECT line_id, file_id, delimiter, len(string_split(header_line, delimiter)) AS n, coalesce(raw_line, '') AS line FROM price_line JOIN price_file USING (file_id)),
cut AS ({" UNION ALL ".join(_cut(d, p) for d, p in _DELIMITERS.items())}),
h AS (SELECT file_id, generate_subscripts(string_split(header_line, delimiter), 1) AS place, unnest(string_split(header_line, delimiter)) AS header FROM price_file),
p AS (
    SELECT file_id, min(place) FILTER (field = 'sku') AS sku_at, min(place) FILTER (field = 'name') AS name_at, min(place) FILTER (field = 'price') AS price_at
    FROM h JOIN (SELECT DISTINCT lower({_trim("alias_name")}) AS k, field FROM column_alias) ON k = lower({_trim("header")}) GROUP BY file_id),
v AS (
    SELECT line_id, n, sound, raw, CASE WHEN raw[sku_at] LIKE '"%' THEN replace(raw[sku_at][2:-2], '""', '"') ELSE raw[sku_at] END AS sku,
           CASE WHEN raw[name_at] LIKE '"%' THEN replace(raw[name_at][2:-2], '""', '"') ELSE raw[name_at] END AS name,
           CASE WHEN raw[price_at] LIKE '"%' THEN replace(raw[price_at][2:-2], '""', '"') ELSE raw[price_at] END AS price
    FROM cut JOIN p USING (file_id)),
j AS (
    SELECT line_id, CASE WHEN NOT sound THEN 'quoting' WHEN len(raw) <> n THEN 'column_count'
        WHEN {_is_blank("sku")} OR {_is_blank("name")} OR {_is_blank("price")} OR NOT regexp_full_match(price, '{_AMOUNT}') THEN 'value' END AS reason FROM v)
SELECT 'price_line' AS tbl, CAST(line_id AS VARCHAR) AS row_key, reason FROM j WHERE reason IS NOT NULL
UNION ALL SELECT 'sample_raw', id_internal, 'value' FROM sample_raw WHERE {_is_blank("price")} OR NOT regexp_full_match(price, '{_AMOUNT}')"""

# --- 5

_UNITS = r"(?:тис\p{L}* ?|thousands? of |k)?(?:uah|грн|гривн\p{L}*|гривень|₴|коп\p{L}*|kopiyk\p{L}*|kop|eur\p{L}*|євро\p{L}*|€|usd|us ?\$|us ?dollars?|usc|us ?cents?|дол\p{L}*(?: ?сша)?|цент\p{L}* ?сша|\$|pln|zł|zl|злот\p{L}*|huf|ft|форинт\p{L}*|(?:hungarian ?)?forints?)(?: ?cents?)?"
P5_FOUND = f"""
WITH t AS (
    SELECT product_id, price, currency, lower(concat_ws(chr(10), name, description, sku)) AS t, trim(coalesce(currency, '')) <> '' AS filled FROM product WHERE price IS NOT NULL AND NOT isnan(price)),
w AS (SELECT *, regexp_replace(t, '[^\\p{{L}}\\p{{N}}$€₴]+', ' ', 'g') AS words FROM t),
s AS (
    SELECT *, regexp_extract(words || ' ', '(?:ціна|ціну|ціни|prices?) ?(?:вказано|вказана|quoted|per ?piece|за ?шт\\p{{L}}*)? ?(?:в|у|in)? ?({_UNITS})(?:[^\\p{{L}}\\p{{N}}])', 1) AS said,
        regexp_extract(t, '[(\\[][\\s_]*({_UNITS})[.\\s_]*[)\\]]', 1) AS bracket FROM w),
u AS (SELECT product_id, price, filled, regexp_replace(lower(CASE WHEN filled THEN currency WHEN said <> '' THEN said ELSE bracket END), '[\\s._]+', ' ', 'g') AS x FROM s),
k AS (
    SELECT product_id, price, CASE WHEN x = '' AND NOT filled THEN 'USD' WHEN regexp_matches(x, 'uah|грн|грив|₴|коп|kop') THEN 'UAH' WHEN regexp_matches(x, 'eur|євро|€') THEN 'EUR'
        WHEN regexp_matches(x, 'usd|us ?\\$|us ?dollar|usc|us ?cent|дол|сша|\\$') THEN 'USD' WHEN regexp_matches(x, 'pln|zł|zl|злот') THEN 'PLN' WHEN regexp_matches(x, 'huf|ft|форинт|forint') THEN 'HUF' END AS code,
        CASE WHEN regexp_matches(x, 'коп|kop|cent|цент|usc|/ ?100') THEN 0.01::DOUBLE WHEN regexp_matches(x, 'тис|thousand|x ?1000|kuah') THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM u)
SELECT product_id, CAST(round(price * factor * (rate_uah / nominal) * 100) AS BIGINT) AS uah_kop FROM k JOIN fx_rate ON code = currency_code WHERE NOT (code = 'UAH' AND factor = 1)"""

# --- 7: each version against the one before, field by field

P7_FOUND = f"""
WITH v AS (
    SELECT template_id, lower({_trim("supplier")}) AS s, headers, column_mapping, row_number() OVER (PARTITION BY lower({_trim("supplier")}) ORDER BY saved_at NULLS FIRST, template_id) AS n FROM import_template),
c AS (SELECT template_id, generate_subscripts(headers, 1) AS place, unnest(headers) AS raw FROM v),
m AS (SELECT template_id, e.key AS field, lower({_trim("e.value")}) AS header FROM (SELECT template_id, unnest(map_entries(column_mapping)) AS e FROM v)),
a AS (SELECT DISTINCT lower({_trim("alias_name")}) AS header, field FROM column_alias),
f AS (
    SELECT c.template_id, coalesce(a.field, m.field) AS field, arg_min(lower({_trim("raw")}), place) AS header
    FROM c LEFT JOIN a ON a.header = lower({_trim("raw")}) LEFT JOIN m ON m.template_id = c.template_id AND m.header = lower({_trim("raw")}) WHERE coalesce(a.field, m.field) IS NOT NULL GROUP BY ALL),
j AS (SELECT template_id, CAST(payload AS JSON) AS p FROM feed_row WHERE json_valid(payload)),
x AS (SELECT template_id, p, unnest(json_keys(p)) AS key FROM j),
y AS (
    SELECT template_id, lower({_trim("key")}) AS header, json_type(p -> ('$."' || replace(key, '"', '\\"') || '"')) AS kind FROM x),
t AS (
    SELECT template_id, header, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kind
    FROM (SELECT template_id, header, CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN kind = 'VARCHAR' THEN 'string' WHEN kind = 'ARRAY' THEN 'list' ELSE lower(kind) END AS kind FROM y WHERE kind <> 'NULL') GROUP BY ALL),
g AS (SELECT f.*, t.kind FROM f LEFT JOIN t USING (template_id, header)),
d AS (
    SELECT now.template_id, coalesce(b.field, g.field) AS field, b.header AS h0, g.header AS h1, b.kind AS k0, g.kind AS k1
    FROM v now JOIN v old ON now.s = old.s AND now.n = old.n + 1 JOIN (SELECT template_id AS o, field, header, kind FROM g) b ON b.o = old.template_id LEFT JOIN g ON g.template_id = now.template_id AND g.field = b.field
    UNION SELECT now.template_id, g.field, b.header, g.header, b.kind, g.kind
    FROM v now JOIN v old ON now.s = old.s AND now.n = old.n + 1 JOIN g ON g.template_id = now.template_id LEFT JOIN (SELECT template_id AS o, field, header, kind FROM g) b ON b.o = old.template_id AND b.field = g.field)
SELECT template_id, field, 'added' AS change_kind FROM d WHERE h0 IS NULL UNION ALL SELECT template_id, field, 'removed' FROM d WHERE h1 IS NULL
UNION ALL SELECT template_id, field, 'renamed' FROM d WHERE h0 <> h1 UNION ALL SELECT template_id, field, 'retyped' FROM d WHERE k0 <> k1"""

_PRICE = r"regexp_replace(regexp_replace(regexp_replace(replace(price, '−', '-'), '(^|[^0-9])[.,]', '\1', 'g'), '[.,]($|[^0-9])', '\1', 'g'), '[^0-9.,+\-]', '', 'g')"
P4_SAMPLE_PRICES = f"""
WITH d AS (SELECT id_internal, CASE WHEN regexp_full_match(price, '{_AMOUNT}') THEN {_PRICE} END AS d FROM sample_raw)
SELECT id_internal, CASE WHEN regexp_full_match(d, '[+-]?[0-9]{{1,3}}((,[0-9]{{3}})+|(\\.[0-9]{{3}})+)') THEN CAST(regexp_replace(d, '[.,]', '', 'g') AS DOUBLE)
    WHEN regexp_matches(d, '[.,]') THEN CAST(regexp_replace(regexp_extract(d, '^(.*)[.,]([0-9]+)$', 1), '[.,]', '', 'g') || '.' || regexp_extract(d, '^(.*)[.,]([0-9]+)$', 2) AS DOUBLE)
    ELSE CAST(d AS DOUBLE) END AS price FROM d"""
P4_INVALID_VALUES = f"""
SELECT DISTINCT price AS value, CASE WHEN {_is_blank("price")} THEN 'blank' ELSE 'not_an_amount' END AS why FROM sample_raw WHERE price IS NOT NULL AND ({_is_blank("price")} OR NOT regexp_full_match(price, '{_AMOUNT}'))"""
_FIELDS = ("sku", "name", "price", "currency", "description", "brand", "qty")
P4_LOADED = P4_FOUND.split("p AS (", 1)[0] + f"""p AS (
    SELECT file_id, {", ".join(f"min(place) FILTER (field = '{f}') AS {f}_at" for f in _FIELDS)}
    FROM h JOIN (SELECT DISTINCT lower({_trim("alias_name")}) AS k, field FROM column_alias) ON k = lower({_trim("header")}) GROUP BY file_id),
v AS (SELECT line_id, file_id, n, sound, raw, {", ".join(f"CASE WHEN raw[{f}_at] LIKE '{chr(34)}%' THEN replace(raw[{f}_at][2:-2], '{chr(34) * 2}', '{chr(34)}') ELSE raw[{f}_at] END AS {f}" for f in _FIELDS)} FROM cut JOIN p USING (file_id)),
g AS (SELECT * FROM v WHERE sound AND len(raw) = n AND NOT {_is_blank("sku")} AND NOT {_is_blank("name")} AND NOT {_is_blank("price")} AND regexp_full_match(price, '{_AMOUNT}')),
d AS (SELECT *, {_PRICE} AS d FROM g)
SELECT line_id, file_id, sku, name, CASE WHEN regexp_full_match(d, '[+-]?[0-9]{{1,3}}((,[0-9]{{3}})+|(\\.[0-9]{{3}})+)') THEN CAST(regexp_replace(d, '[.,]', '', 'g') AS DOUBLE)
    WHEN regexp_matches(d, '[.,]') THEN CAST(regexp_replace(regexp_extract(d, '^(.*)[.,]([0-9]+)$', 1), '[.,]', '', 'g') || '.' || regexp_extract(d, '^(.*)[.,]([0-9]+)$', 2) AS DOUBLE)
    ELSE CAST(d AS DOUBLE) END AS price, currency, description, brand, CASE WHEN regexp_full_match(qty, ' *[+-]?[0-9]+ *') THEN CAST(trim(qty) AS BIGINT) END AS qty,
    CASE WHEN {_is_blank("qty")} OR regexp_full_match(qty, ' *[+-]?[0-9]+ *') THEN NULL WHEN TRY_CAST(trim(qty) AS DOUBLE) IS NULL THEN 'not_a_number' ELSE 'not_whole' END AS qty_reason FROM d"""
P5_UNITS = P5_FOUND.rsplit("SELECT product_id, CAST", 1)[0].replace("SELECT product_id, price, CASE WHEN x = ''", "SELECT CASE WHEN filled THEN 'currency' WHEN x <> '' THEN 'text' ELSE 'default' END AS said, CASE WHEN x = ''") + "SELECT code AS unit_code, factor AS unit_factor, said, count(*) AS n FROM k GROUP BY ALL"

P7_LIFESPANS = P7_FOUND.split(",\nj AS (", 1)[0] + """,
i AS (SELECT s AS supplier_key, field, template_id, n, n - row_number() OVER (PARTITION BY s, field ORDER BY n) AS run FROM f JOIN v USING (template_id))
SELECT supplier_key, field, dense_rank() OVER (PARTITION BY supplier_key, field ORDER BY run) AS island, arg_min(template_id, n) AS first_template_id, arg_max(template_id, n) AS last_template_id, count(*) AS n_versions
FROM i GROUP BY supplier_key, field, run"""

P7_TYPES = P7_FOUND.split(",\nd AS (", 1)[0] + """,
ii AS (SELECT s AS supplier_key, g.field, g.kind, template_id, n, n - row_number() OVER w AS run, last_value(g.kind IGNORE NULLS) OVER (PARTITION BY s, g.field ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told
    FROM g JOIN v USING (template_id) WINDOW w AS (PARTITION BY s, g.field ORDER BY n)),
cc AS (SELECT *, CASE WHEN lag(run) OVER w IS DISTINCT FROM run OR (kind IS NOT NULL AND told IS NOT NULL AND kind <> told) THEN 1 ELSE 0 END AS turn FROM ii WINDOW w AS (PARTITION BY supplier_key, field ORDER BY n)),
l AS (SELECT *, sum(turn) OVER (PARTITION BY supplier_key, field ORDER BY n) AS type_island FROM cc)
SELECT supplier_key, field, CAST(type_island AS BIGINT) AS type_island, max(kind) AS kind, arg_min(template_id, n) AS first_template_id, arg_max(template_id, n) AS last_template_id, count(*) AS n_versions FROM l GROUP BY supplier_key, field, type_island"""

SQL = {"p7_types": P7_TYPES, "p4_found": P4_FOUND, "p4_loaded": P4_LOADED, "p4_sample_prices": P4_SAMPLE_PRICES, "p4_invalid_values": P4_INVALID_VALUES, "p5_found": P5_FOUND, "p5_units": P5_UNITS, "p7_found": P7_FOUND, "p7_lifespans": P7_LIFESPANS}
