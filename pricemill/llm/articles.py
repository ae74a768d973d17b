"""Listings of the same article: identifiers and properties, reliable keys, guarded components."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .copies import bare, order_free

# Words of the kinds of goods, colours, materials, editions and units in both languages.
KINDS = [
    ("case", r"чохол|накладка|cover|case(?! of)"),
    ("powerbank", r"повербанк|павербанк|портативна батарея|power ?bank|portable battery"),
    ("cable", r"кабель|cable"),
    ("ssd", r"ssd|solid state drive"),
    ("coffee", r"кава|coffee"),
    ("monitor", r"монітор|дисплей|monitor|display"),
    ("kettle", r"чайник|електрочайник|kettle"),
    ("phone", r"телефон|смартфон|smartphone|phone"),
]
COLOURS = {"black": "чорн|black|blk", "white": "біл(?!ьш)|white|wht", "grey": "сір|grey|gray|gry", "red": "червон|red|red", "green": "зелен|green|grn", "blue": "син|blue|blu"}
MATERIALS = {"tpu": "tpu|тпу|термополіуретан", "leather": "шкір|leather|lea", "glass": "скло|glass|gla"}
EDITIONS = {"lite": "lite", "lit": "lite", "pro": "pro", "max": "max", "mini": "mini", "min": "mini", "2": "2", "3": "3"}
#: unit -> (property, factor to the property's unit)
UNITS = {
    "гб": ("gb", 1), "gb": ("gb", 1), "тб": ("gb", 1024), "tb": ("gb", 1024),
    "вт": ("w", 1), "w": ("w", 1), "квт": ("w", 1000), "kw": ("w", 1000),
    "гц": ("hz", 1), "hz": ("hz", 1),
    "маг": ("mah", 1), "mah": ("mah", 1), "агод": ("mah", 1000), "ah": ("mah", 1000),
    "мм": ("mm", 1), "mm": ("mm", 1), "см": ("mm", 10), "cm": ("mm", 10), "м": ("mm", 1000), "m": ("mm", 1000),
    "мл": ("ml", 1), "ml": ("ml", 1), "л": ("ml", 1000), "l": ("ml", 1000),
    "г": ("g", 1), "g": ("g", 1), "кг": ("g", 1000), "kg": ("g", 1000),
    "дюймів": ("inch", 1), "дюйма": ("inch", 1), "дюйм": ("inch", 1), "inch": ("inch", 1), "in": ("inch", 1), "\"": ("inch", 1),
}
#: Properties that tell articles of a kind apart; a listing that states all of them is complete.
PROPERTIES = {"phone": ("ram", "gb", "colour"), "case": ("material", "colour", "for"), "cable": ("mm", "w", "colour"), "ssd": ("gb",), "coffee": ("g",), "monitor": ("inch", "hz", "colour"), "kettle": ("ml", "w", "colour"), "powerbank": ("mah", "w", "colour")}
#: The order in which a maker's part number lists properties after model and edition.
PART_NUMBER = {"phone": ("ram", "gb", "colour"), "case": ("material", "colour"), "cable": ("m", "w", "colour"), "ssd": ("gb",), "coffee": ("g",), "monitor": ("inch", "hz", "colour"), "kettle": ("l", "w", "colour"), "powerbank": ("mah", "w", "colour")}

#: What tells goods of other kinds apart.
OTHER = ("mah", "gb", "w", "hz", "mm", "ml", "g", "inch", "colour", "material")


def _of_kind(kind: str) -> tuple[str, ...]:
    return PROPERTIES.get(kind, OTHER)


_KIND = re.compile(r"(?<![^\W\d_])(?:" + "|".join(f"(?P<{k}>{p})" for k, p in KINDS) + ")")
_KIND_ORDER = {k: n for n, (k, _) in enumerate(KINDS)}
_COLOUR = [(c, re.compile("|".join(rf"(?<![^\W_]){w}" + r"(?![^\W_])" * (w == "red") for w in p.split("|")[:-1]))) for c, p in COLOURS.items()]
_MATERIAL = [(m, re.compile("|".join(rf"(?<![^\W_]){w}" for w in p.split("|") if w not in ("lea", "gla")))) for m, p in MATERIALS.items()]
_NUMBER = re.compile(r"(?<![\w.,])(\d{1,3}(?:[ ,]000)+|\d+(?:[.,]\d+)?)[\s_\-\"'«»()\[\]/*]*(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![^\W_])")
_RAM = re.compile(r"(?:(?<![\w.,])(\d+)[^\w\n]*(?:gb|гб)[^\w\n]*)?(?:ram|озп)(?:[^\w\n]*(\d+)[^\w\n]*(?:gb|гб))?")
_CODE = r"(?<![^\W_])[a-z]{2}[\s\-/_.]?\d{4}[a-z]?(?![^\W_])"
_NAME = r"(?<![^\W_])(?:[b-df-hj-np-tv-z][aeiou]){4}(?![^\W_])"
_MODEL = re.compile(f"({_CODE}|{_NAME})")
_BARE_NUMBER = re.compile(r"(?<![\w.,-])\d+(?:[.,]\d+)?[\s-]?$")
_EDITION = re.compile(r"[\s\-/_.,;:*\"'«»()\[\]]*(lite|pro|max|mini|[23])(?![^\W_]|[.,]\d)")
_UNIT_NEXT = re.compile(r"[\s\-_\"'«»()\[\]/*]*(?:" + "|".join(sorted((re.escape(u) for u in UNITS), key=len, reverse=True)) + r")(?![^\W_])")
_PART = re.compile(r"^\W*([a-z]{2}\d{4}[a-z]?|(?:[b-df-hj-np-tv-z][aeiou]){4})((?:-[a-z0-9.]+)+)\W*$")
_BRAND = re.compile(r"(?<![^\W_])(?:бренд|brand) ([^\W\d_]+)")
_WORD = re.compile(r"[^\W\d_]{4,}")
#: Where a name's wording after the brand stops to name the model: other letters than Latin, a mark, a quantity.
_NAMED = re.compile(r"(?:[\s-]*(?![\d.,]+ ?(?:" + "|".join(sorted((re.escape(u) for u in UNITS), key=len, reverse=True)) + r")(?![^\W_]))[a-z0-9][a-z0-9.+-]*(?<![.-]))+")
_PLAIN_WORDS = frozenset("for with and in of the new original edition colour color ram".split())

# Cyrillic letters in Latin, one for one.
_ROMAN = str.maketrans({"а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ь": "", "ю": "iu", "я": "ia"})


_NOISE = re.compile(r"[_«»'()\[\]*;:!|•…]+|(?<!\d)[.,]|[.,](?!\d)| [-/](?= )")


def plain(text: str | None) -> str:
    """Lower case, one kind of blank and inch sign; punctuation only where it is part of a word or number."""
    t = (text or "").replace("″", '"').replace("”", '"').replace("''", '"')
    t = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).lower())
    t = re.sub(r"[аa]\s?[·.*,/;_-]?\s?год(?![^\W_])", "агод", t)
    return re.sub(" +", " ", _NOISE.sub(" ", t)).strip()


def valid_gtin(digits: str) -> bool:
    """Whether 8, 12, 13 or 14 digits end in the check digit of a trade item number."""
    if len(digits) not in (8, 12, 13, 14) or not digits.isdigit() or not digits.isascii():
        return False
    d = [int(c) for c in reversed(digits)]
    return (sum(d[1::2]) * 3 + sum(d[2::2]) + d[0]) % 10 == 0


_GTIN_LABEL = re.compile(r"(?:gtin|ean|upc|штрихкод)\W*(\d{8}|\d{12,14})(?!\d)", re.I)


def trade_number(text: str) -> str | None:
    """A labelled, checksum-valid trade item number, as 14 digits."""
    for m in _GTIN_LABEL.finditer(text):
        if valid_gtin(m[1]):
            return m[1].zfill(14)
    return None


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1] if row[-1] <= most else most + 1


def _shortened(word: str, most: int = 2) -> set[str]:
    """The word without any `most` letters or fewer: words within that many edits share one of these."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Brands:
    """Finds a known brand in a word, also in Cyrillic letters: the one nearest within two edits of its Latin form."""

    def __init__(self, names: list[str]):
        self.names, self.seen, self.near = frozenset(names), {}, None

    def of(self, word: str) -> str | None:
        if word in self.names:
            return word
        if word.isascii():
            return None
        if word not in self.seen:
            if len(self.seen) > 1 << 17:
                self.seen.clear()
            self.seen[word] = self._nearest(word.translate(_ROMAN))
        return self.seen[word]

    def _nearest(self, latin: str) -> str | None:
        """The one nearest brand; none where two are equally near."""
        if self.near is None:
            self.near = {}
            for n in self.names:
                for w in _shortened(n):
                    self.near.setdefault(w, []).append(n)
        found = {n for w in _shortened(latin) for n in self.near.get(w, ())}
        near = sorted((d, n) for n in found if (d := _distance(latin, n, 2)) <= 2)[:2]
        return near[0][1] if near and (len(near) == 1 or near[0][0] < near[1][0]) else None


def _number(s: str) -> float:
    return float(re.sub(r"[ ,](?=000)", "", s).replace(",", ".")) if re.search(r"[ ,]000", s) else float(s.replace(",", "."))


def _text(x: float) -> str:
    return f"{x:.6g}"


def _parts(sku: str) -> dict[str, str] | None:
    """Model, edition and property values of a maker's part number."""
    if not (m := _PART.match(sku)):
        return None
    rest = m[2].lstrip("-").split("-")
    out = {"model": m[1]}
    if rest and rest[0] in EDITIONS and len(rest) > 1:
        out["edition"] = EDITIONS[rest.pop(0)]
    out["values"] = rest
    return out


def _from_part(kind: str, values: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    order = PART_NUMBER[kind]
    if len(values) != len(order):
        return out
    for p, v in zip(order, values):
        if p == "colour":
            c = next((c for c, w in COLOURS.items() if v[:3] == w.split("|")[-1]), None)
            if c:
                out[p] = c
        elif p == "material":
            c = next((m for m, w in MATERIALS.items() if v[:3] in (w.split("|")[-1], m)), None)
            if c:
                out[p] = c
        elif re.fullmatch(r"\d+(\.\d+)?", v):
            x = float(v)
            out[{"m": "mm", "l": "ml"}.get(p, p)] = _text(x * (1000 if p in ("m", "l") else 1))
    return out


def kind_of(text: str) -> str | None:
    """The kind of goods that a plain text names, the first of KINDS where it names several."""
    return min((m.lastgroup for m in _KIND.finditer(text)), key=_KIND_ORDER.__getitem__, default=None)


def named_model(name: str, brands: Brands) -> tuple[str, str] | None:
    """(brand, model) of a plain name whose maker is followed by what it calls the article, such as "galaxy s23 ultra".

    The wording ends before a quantity, a mark, a word in other letters, of a kind, colour or material, or a
    plain word. The last such place counts, as goods made for others name those first.
    """
    for m in reversed(list(_WORD.finditer(name))):
        brand = brands.of(m[0])
        if brand and (rest := _NAMED.match(name, m.end())):
            words = []
            for w in re.findall(r"[a-z0-9.+]+", rest[0]):
                if w in _PLAIN_WORDS or kind_of(w) or any(p.search(w) for _, p in (*_COLOUR, *_MATERIAL)):
                    break
                words.append(w)
            if words:
                return brand, "".join(words)
    return None


def parse(sku: str | None, name: str | None, description: str | None, brands: Brands, seen_brand: str | None = None) -> dict[str, str]:
    """kind, brand, model, edition and properties that a listing states; what it doesn't state is left out.

    kind is "other" where no known kind is named but a maker's model is. seen_brand: a rarer brand that the
    listing is known to name. A model is what looks like a maker's code or coined name, else what follows the brand.
    """
    sku, name, about = (sku or "").strip().lower(), plain(name), plain(description)
    kind = kind_of(name)
    if not (kind and _MODEL.search(name)) and (swapped := kind_of(plain(sku))):
        sku, name, kind = name.strip(), plain(sku), swapped
    out: dict[str, str] = {}
    if number := trade_number(f"{name} {about}"):
        out["gtin"] = number
    part = _parts(sku)
    named = None
    if not _MODEL.search(name) and not part and kind != "case":  # a case's wording names its phone first
        known = brands if seen_brand is None else Brands([seen_brand])
        named = named_model(name, known)
    if kind is None and named is None:
        return out
    kind = kind or "other"
    out["kind"] = kind
    if part and kind in PART_NUMBER and part.get("edition") in ("2", "3") and len(part["values"]) + 1 == len(PART_NUMBER[kind]):
        part["values"].insert(0, part.pop("edition"))  # the first property, not an edition
    models: list[re.Match] = []
    for m in _MODEL.finditer(name):
        # a number before it, unless of another model, makes two letters a unit
        if m[0][:2] not in UNITS or (models and not name[models[-1].end() : m.start()].strip(" -")) or not _BARE_NUMBER.search(name, 0, m.start()):
            models.append(m)
    if models:
        own = models[-1]
        out["model"] = re.sub(r"[\s\-/_.]", "", own[0])
        if (e := _EDITION.match(name, own.end())) and not (e[1] in "23" and _UNIT_NEXT.match(name, e.end())):
            out["edition"] = e[1]
        if kind == "case" and len(models) > 1:
            out["for"] = re.sub(r"[\s\-/_.]", "", models[0][0])
    elif named:
        out["brand"], out["model"] = named
        out["coined"] = "true"  # taken from free wording, so it needs a second seller
    elif part and kind != "case":
        out["model"] = part["model"]
        if "edition" in part:
            out["edition"] = part["edition"]
    if label := _BRAND.search(about):
        out["brand"] = brands.of(label[1]) or label[1]
    else:
        found = [b for w in _WORD.findall(name) if (b := brands.of(w))]
        if found and (kind != "case" or len(found) > 1):
            out["brand"] = found[-1]
        elif seen_brand and kind != "case":
            out["brand"] = seen_brand
    both = f"{name}\n{about}"
    if kind == "phone":
        for m in _RAM.finditer(both):
            sizes = sorted(float(x) for x in m.groups() if x)
            if sizes:  # between two sizes the word goes with the smaller
                out["ram"] = _text(sizes[0])
                if sizes[0] < sizes[-1]:
                    out["gb"] = _text(sizes[-1])
    rest = _RAM.sub(" ", both)
    for m in _NUMBER.finditer(rest):
        prop, factor = UNITS[m[2]]
        if prop == "mm" and kind == "monitor":
            prop, factor = "inch", factor / 25.4
        if prop in _of_kind(kind) and prop not in out:
            x = _number(m[1]) * factor
            out[prop] = _text(round(x) if prop in ("inch", "mm", "ml", "g", "w", "mah") else x)
    for key, table in (("colour", _COLOUR), ("material", _MATERIAL)):
        if key in _of_kind(kind) and (hits := [(m.start(), c) for c, p in table if (m := p.search(both))]):
            out[key] = min(hits)[1]
    if part and kind in PART_NUMBER and part["model"] == out.get("model"):
        for p, v in _from_part(kind, part["values"]).items():
            out.setdefault(p, v)
        if "edition" in part:
            out.setdefault("edition", part["edition"])
    return out


def article_key(a: dict[str, str]) -> str | None:
    """The reliable key: kind, model, edition and every property of the kind; None while one is missing.

    Goods of other kinds have no list of properties; their keys come of what the model's listings state.
    """
    if "model" not in a or "kind" not in a or a["kind"] not in PROPERTIES or any(p not in a for p in _of_kind(a["kind"])):
        return None
    return "|".join([a["kind"], a["model"], a.get("edition", ""), *(a[p] for p in _of_kind(a["kind"]))])


#: Words of sales talk at a name's end, which sellers add to a copied listing.
_TALK = re.compile(r"(?:\W+(?:b-stock|new|новинка|акція|знижка|оригінал|original))+\W*$")
#: Brands that go to the tasks at most, the most frequent ones; listings meet the others in a join.
MOST_BRANDS = 20_000


def brand_labels(products: DataFrame) -> DataFrame:
    """(b, n): Latin brand names that descriptions label as such, three times or more."""
    label = F.lower(F.regexp_extract("description", r"(?iu)(?:бренд|brand)\s*:\s*([a-z]{3,})", 1))
    return products.select(label.alias("b")).where("b <> ''").groupBy("b").agg(F.count("*").alias("n")).where("n >= 3")


def rare_brands(products: DataFrame, labels: DataFrame, book: list[str]) -> DataFrame:
    """(product_id, seen): the last brand beyond the book that a name holds, in Latin letters."""
    rest = labels.join(products.sparkSession.createDataFrame([(b,) for b in book], "b string"), "b", "left_anti")
    words = products.select("product_id", F.posexplode(F.regexp_extract_all(F.lower(F.coalesce("name", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))).alias("at", "b"))
    return words.join(rest, "b").groupBy("product_id").agg(F.max_by("b", "at").alias("seen"))


def parse_listings(products: DataFrame) -> DataFrame:
    """(product_id, supplier, key, brand, gtin, part, copy_key, name_key, stated, coined): what identifies each listing.

    key is article_key(); part is a maker's part number given as the sku; copy_key is a digest of sku and name, name_key
    of supplier and name, by letters and digits only and without sales talk at the name's end; stated holds
    "property=value" of all that tells articles apart, for a listing with a key also that it has no edition;
    coined tells whether the model is what follows the brand in free wording.
    """
    labels = stored(brand_labels(products), "brands")
    book = [r.b for r in labels.orderBy(F.desc("n"), "b").limit(MOST_BRANDS).collect()]
    rows = products.select(F.col("product_id").cast("long").alias("product_id"), F.col("supplier").cast("string").alias("supplier"), F.col("sku").cast("string").alias("sku"), F.col("name").cast("string").alias("name"), F.col("description").cast("string").alias("description"), order_free(bare("sku"), bare("name")).alias("copy"))
    # digests, as both keys go through several shuffles; the first letter tells whether sku and name are both there
    rows = rows.withColumn("copy_key", F.concat(F.when(F.col("copy").rlike("^[^\\x00\\x01]+\\x01[^\\x00\\x01]+$"), "b").otherwise("a"), F.md5("copy"))).drop("copy")
    if len(book) < MOST_BRANDS:
        rows = rows.withColumn("seen", F.lit(None).cast("string"))
    else:
        rows = rows.join(rare_brands(rows, labels, book), "product_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        brands = Brands(book)
        out_names = ["product_id", "supplier", "key", "brand", "gtin", "part", "copy_key", "name_key", "stated", "coined"]
        for b in batches:
            out = []
            for sku, name, about, supplier, seen in zip(*(b.column(c).to_pylist() for c in ("sku", "name", "description", "supplier", "seen"))):
                a = parse(sku, name, about, brands, seen)
                text = (sku if a.get("kind", "other") != "other" and kind_of(plain(name)) is None else name) or ""
                only = re.sub(r"[\W_]+", "", _TALK.sub("", text.lower()))
                part = (sku or "").strip().lower()
                key = article_key(a)
                told = {p: v for p, v in a.items() if p not in ("brand", "gtin", "coined")} | ({"edition": a.get("edition", "")} if key else {})
                if a.get("kind") == "case" and "for" not in a:  # the only model may be the phone's
                    told = {p: v for p, v in told.items() if p not in ("model", "edition")}
                out.append((key, a.get("brand"), a.get("gtin"), part if _PART.match(part) else None, hashlib.blake2b(f"{supplier}|{only}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if only else None, [f"{p}={v}" for p, v in told.items()], "coined" in a))
            key, brand, gtin, part, name_key, told, coined = zip(*out) if out else ([],) * 7
            text = lambda v: pa.array(v, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("product_id"), b.column("supplier"), text(key), text(brand), text(gtin), text(part), b.column("copy_key"), text(name_key), pa.array(told, pa.list_(pa.string())), pa.array(coined, pa.bool_())], names=out_names)

    return rows.mapInArrow(run, "product_id long, supplier string, key string, brand string, gtin string, part string, copy_key string, name_key string, stated array<string>, coined boolean")


def with_model_keys(listings: DataFrame) -> DataFrame:
    """listings, with keys also for models of which no listing states every property of its kind.

    A model that comes from free wording counts if two sellers or more give it so: run-together or chance wording
    is one seller's. A property that no listing of such a model states isn't one of it: there a listing's key is kind, model,
    edition and all that the model's listings state. Listings that leave one of those out keep no key, nor do
    those of a key with two trade numbers.
    """
    name = lambda t: F.substring_index(t, "=", 1)
    both = F.array_sort(F.filter("stated", lambda t: name(t).isin("kind", "model")))
    coined = listings.where("coined").select("product_id", "supplier", F.concat_ws("|", both).alias("m"))
    shared = coined.groupBy("m").agg(F.min("supplier").alias("lo"), F.max("supplier").alias("hi")).where("lo < hi").select("m")
    lone = coined.join(shared, "m", "left_anti").select("product_id", F.lit(True).alias("lone"))
    own = F.filter("stated", lambda t: ~name(t).isin("model", "edition") & (t != "kind=other"))
    listings = stored(listings.join(lone, "product_id", "left").withColumn("stated", F.when(F.col("lone"), own).otherwise(F.col("stated"))).withColumn("key", F.when(F.col("lone").isNull(), F.col("key"))).drop("lone", "coined"), "models")
    rows = listings.withColumn("m", F.when(F.size(both) == 2, F.array_join(both, "|")))
    whole = rows.where("key IS NOT NULL AND m IS NOT NULL").select("m").distinct()
    open_ = rows.where("key IS NULL AND m IS NOT NULL").join(whole, "m", "left_anti").select("product_id", "m", "stated")
    needed = open_.select("m", F.explode("stated").alias("t")).select("m", name("t").alias("p")).where("p <> 'edition'").distinct().groupBy("m").agg(F.count("*").alias("n"))
    found = open_.join(needed, "m").where(F.size(F.filter("stated", lambda t: name(t) != "edition")) == F.col("n"))
    keys = found.select("product_id", F.array_sort(F.when(F.exists("stated", lambda t: name(t) == "edition"), F.col("stated")).otherwise(F.concat("stated", F.array(F.lit("edition="))))).alias("own"))
    keys = stored(keys.withColumn("k", F.concat(F.lit("model|"), F.array_join("own", "|"))), "model_keys")
    numbers = listings.where("gtin IS NOT NULL").join(keys, "product_id").groupBy("k").agg(F.min("gtin").alias("lo"), F.max("gtin").alias("hi")).where("lo < hi").select("k")
    rows = listings.join(keys.join(numbers, "k", "left_anti"), "product_id", "left").withColumn("key", F.coalesce("key", "k")).drop("k")
    return rows.withColumn("stated", F.coalesce("own", "stated")).drop("own")


#: Identifiers from the most to the least reliable.
IDENTIFIERS = ("gtin", "copy_key", "name_key", "part")


def _edges(rows: DataFrame, *more: str) -> DataFrame:
    """(product_id, *more, place, value): each row's identifiers, place being that in IDENTIFIERS."""
    return rows.select("product_id", *more, F.posexplode(F.array(*IDENTIFIERS)).alias("place", "value")).where("value IS NOT NULL")


def _conflicting(rows: DataFrame, *group: str) -> DataFrame:
    """The groups of rows (with stated) that state two values of one property."""
    told = rows.select(*group, F.explode("stated").alias("t")).select(*group, F.substring_index("t", "=", 1).alias("p"), "t")
    return told.groupBy(*group, "p").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select(*group).distinct()


def _with_editions(rows: DataFrame) -> DataFrame:
    """Rows with a key; one without edition takes the key that differs in the edition alone, if an identifier leads to one such only."""
    base = F.concat_ws("|", F.filter("stated", lambda t: ~t.startswith("edition=")))
    full = rows.where("key IS NOT NULL").withColumn("base", F.array_join(F.array_sort(F.split(base, r"\|")), "|")).withColumn("bare", F.array_contains("stated", "edition="))
    both = full.groupBy("base").agg(F.min("bare").alias("lo"), F.max("bare").alias("hi")).where("lo <> hi").select("base")
    edges = stored(_edges(full.join(both, "base", "left_semi"), "base", "bare", "key"), "edition_edges")
    one = edges.where("NOT bare").groupBy("place", "value", "base").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo = hi")
    taken = edges.where("bare").join(one, ["place", "value", "base"]).groupBy("product_id").agg(F.min(F.struct("place", "lo")).alias("one"))
    return full.join(taken, "product_id", "left").select("product_id", F.coalesce("one.lo", "key").alias("key"))


def _reach(rows: DataFrame) -> DataFrame:
    """(product_id, key): rows with an article key and those that identifiers join to them, over any number of steps.

    In each step a row joins through its most reliable identifier whose joined rows are all of one article,
    unless it states another value of a property than that article.
    """
    told = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("stated").alias("of_key"))
    edges = stored(_edges(rows).join(_edges(rows.where("key IS NULL")).select("place", "value").distinct(), ["place", "value"], "left_semi"), "edges")
    joined = stored(_with_editions(rows), "joined")
    open_ = rows.where("key IS NULL").select("product_id", "stated")
    while True:
        one = edges.join(joined, "product_id").groupBy("place", "value").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo = hi").select("place", "value", F.col("lo").alias("key"))
        more = edges.join(open_.join(joined, "product_id", "left_anti"), "product_id").join(one, ["place", "value"]).join(told, "key")
        both = F.array_union("stated", "of_key")
        agree = F.size(F.array_distinct(F.transform(both, lambda t: F.substring_index(t, "=", 1)))) == F.size(both)
        more = stored(more.where(agree).groupBy("product_id").agg(F.min(F.struct("place", "key")).alias("one")).select("product_id", F.col("one.key").alias("key")), "reached")
        if more.isEmpty():
            return joined
        joined = joined.unionAll(more)


def _unkeyed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """(product_id, component): components of the rows that reach no article key, by least labels over their identifiers.

    An identifier counts if no joined row has it and its rows state no two values of a property, a trade or
    part number or a brand; a copy needs both sku and name, a seller's own wording a model. A component that
    states two such values is split: its rows meet only in their most reliable identifier.
    """
    more = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), c)) for c in ("brand", "gtin", "part")]
    rest = rows.join(joined, "product_id", "left_anti").withColumn("copy_key", F.when(F.col("copy_key").startswith("b"), F.col("copy_key")))
    rest = rest.withColumn("name_key", F.when(F.exists("stated", lambda t: t.startswith("model=")), F.col("name_key"))).withColumn("stated", F.concat("stated", F.array_compact(F.array(*more))))
    told = stored(rest.select("product_id", "stated"), "unkeyed")
    edges = stored(_edges(rest), "unkeyed_edges")
    if edges.isEmpty():
        return edges.select("product_id", F.lit("").alias("component"))
    taken = _edges(rows).join(edges.select("place", "value").distinct(), ["place", "value"], "left_semi").join(joined, "product_id").select("place", "value").distinct()
    clash = _conflicting(edges.join(told, "product_id"), "place", "value")
    edges = stored(edges.join(taken, ["place", "value"], "left_anti").join(clash, ["place", "value"], "left_anti"), "unkeyed_edges")
    labels = stored(edges.select("product_id", F.col("product_id").alias("label")).distinct(), "labels")
    while True:
        least = edges.join(labels, "product_id").groupBy("place", "value").agg(F.min("label").alias("label"))
        new = edges.join(least, ["place", "value"]).groupBy("product_id").agg(F.min("label").alias("label"))
        new = stored(new, "labels")
        if new.join(labels, ["product_id", "label"], "left_anti").isEmpty():
            break
        labels = new
    split = _conflicting(labels.join(told, "product_id"), "label").withColumn("split", F.lit(True))
    best = edges.groupBy("product_id").agg(F.min(F.struct("place", "value")).alias("best"))
    named = labels.join(split, "label", "left").join(best, "product_id")
    named = named.select("product_id", F.when(F.col("split"), F.concat_ws("|", F.lit("identifier"), "best.place", "best.value")).otherwise(F.concat_ws("|", F.lit("listing"), "label")).alias("component"))
    shared = named.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return named.join(shared, "component", "left_semi").select("product_id", "component")


def article_components(products: DataFrame) -> DataFrame:
    """(product_id, supplier, component STRING): listings of one article share the component.

    Listings that state everything meet in their article key; one that gives no edition takes another's
    through a shared identifier. One that doesn't state everything (cut or run-together wording) joins through
    identifiers, over other such listings too: trade number, copied sku and name, the supplier's own wording,
    maker's part number, in this order; guard: only if all joined listings with that identifier are of one
    article and it states nothing else than that article. Listings that reach none form components among
    themselves, guarded likewise. A component never holds two known brands: where an article key has
    several, it is split by brand and listings without one stay out. Listings that join nothing have no row.
    Every step is an aggregate or an equi-join on those keys. Null and empty fields state nothing.
    """
    listings = stored(with_model_keys(stored(parse_listings(products), "parsed")), "listings")
    joined = _reach(listings)
    rows = listings.drop("key").join(joined, "product_id").select("product_id", "supplier", "key", "brand")
    brands = rows.groupBy("key").agg(F.min("brand").alias("lo"), F.max("brand").alias("hi"))
    rows = rows.join(brands, "key")
    rows = rows.where("lo IS NULL OR lo = hi OR brand IS NOT NULL").select("product_id", "supplier", F.when(F.col("lo") < F.col("hi"), F.concat_ws("|", "key", "brand")).otherwise(F.col("key")).alias("component"))
    return rows.unionAll(listings.select("product_id", "supplier").join(_unkeyed(listings, joined), "product_id"))


def same_article_pairs(products: DataFrame) -> DataFrame:
    """(product_id_a, product_id_b), a < b: listings of one article by different, known suppliers.

    Pairs of sellers meet first, so that a seller's many listings of one article are not compared with each other.
    """
    rows = stored(article_components(products).where("supplier IS NOT NULL"), "components")
    sellers = rows.select("component", "supplier").distinct()
    two = sellers.withColumnRenamed("supplier", "sa").join(sellers.withColumnRenamed("supplier", "sb"), "component").where("sa < sb")
    a, b = (rows.select("component", F.col("supplier").alias(f"s{n}"), F.col("product_id").alias(n)) for n in "ab")
    pairs = two.join(a, ["component", "sa"]).join(b, ["component", "sb"])
    return pairs.select(F.least("a", "b").alias("product_id_a"), F.greatest("a", "b").alias("product_id_b"))


def article_groups(products: DataFrame) -> DataFrame:
    """(product_id, group_id, n_listings): each listing with the least id and the size of its article's group."""
    rows = article_components(products)
    groups = rows.groupBy("component").agg(F.min("product_id").alias("group_id"), F.count("*").alias("n_listings"))
    return rows.join(groups, "component").select("product_id", "group_id", "n_listings")
