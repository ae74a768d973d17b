"""Column functions on text: trimming, tokens, haystacks, hashes, tags, amounts of money."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

WORD = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Trim white space of any kind."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(utrim(c), F.lit(""))


def collapse_blanks(c: Column | str) -> Column:
    return utrim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def words(*parts: Column | str) -> Column:
    """Distinct words (letters, digits, underscore) of the parts in lower case, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *map(col, parts))), F.lit(WORD), F.lit(0)))


def blank_tokens(tags: Column | str | None, *parts: Column | str) -> Column:
    """Distinct tokens between blanks of the parts, and each tag unsplit, in lower case."""
    tokens = F.filter(F.split(F.lower(F.concat_ws(" ", *map(col, parts))), r"(?U)\s+"), lambda t: t != "")
    if tags is None:
        return F.array_distinct(tokens)
    return F.array_union(tokens, F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: F.lower(t)))


def haystack(sku: Column | str, name: Column | str, description: Column | str, tags: Column | str) -> Column:
    """The text that keyword searches look into; blanks are skipped."""
    return F.lower(F.concat_ws(" ", blank_to_null(sku), blank_to_null(name), blank_to_null(description), F.nullif(F.array_join(F.array_sort(col(tags)), " "), F.lit(""))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; 0 if either is empty or null."""
    same = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / total).otherwise(0.0)


def stable_hash(*parts: Column) -> Column:
    """16 hex digits that name the non-blank parts, whatever their case and outer blanks."""
    return F.substring(F.sha1(F.concat_ws("||", *(F.nullif(F.lower(utrim(p)), F.lit("")) for p in parts))), 1, 16)


def match_id(supplier: Column, sku: Column, name: Column) -> Column:
    return F.concat(F.lit("match::"), stable_hash(F.coalesce(blank_to_null(supplier), F.lit("unknown")), sku, name))


def group_id(sku: Column, name: Column) -> Column:
    return F.concat(F.lit("store::"), stable_hash(F.coalesce(blank_to_null(sku), blank_to_null(name), F.lit("product"))))


def assignment_key(supplier: Column, sku: Column, name: Column) -> Column:
    return F.concat(F.coalesce(blank_to_null(supplier), F.lit("unknown")), F.lit("::"), F.coalesce(blank_to_null(sku), blank_to_null(name), F.lit("")))


def split_tags(c: Column | str, pattern: str = ";") -> Column:
    """Tags between separators, trimmed, in lower case, distinct, in order."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), pattern), lambda t: F.lower(utrim(t)))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def split_tags_keep_case(c: Column | str) -> Column:
    """Tags between line feeds, commas or semicolons; the first spelling of each stays."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[\n,;]"), utrim), lambda t: t != "")
    return F.aggregate(parts, F.array().cast("array<string>"), lambda out, t: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(t)), out).otherwise(F.concat(out, F.array(t))))


def merge_tags(tags: Column, more: Column) -> Column:
    """Sorted union of tags and more, the latter trimmed and in lower case."""
    clean = F.filter(F.transform(F.coalesce(more, F.array().cast("array<string>")), lambda t: F.lower(utrim(t))), lambda t: t != "")
    return F.array_sort(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), clean))


def parse_price(c: Column | str) -> Column:
    """A price text as a number, tolerant of currency text; null where no number can be read.

    Blanks go and the Unicode minus becomes "-"; only digits, commas, points and one leading minus stay. Of a
    comma and a point the later is the decimal mark; a lone comma is one, several commas or points group.
    """
    clean = F.regexp_replace(F.translate(utrim(c), "−", "-"), r"[^0-9,.\-]", "")

    def value(t: Column) -> Column:
        comma, point = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
        n_comma, n_point = F.length(t) - F.length(F.translate(t, ",", "")), F.length(t) - F.length(F.translate(t, ".", ""))
        plain = (
            F.when((n_comma > 0) & (n_point > 0), F.when(comma < point, F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", "")))
            .when(n_comma == 1, F.translate(t, ",", "."))
            .when(n_comma > 1, F.translate(t, ",", ""))
            .when(n_point > 1, F.translate(t, ".", ""))
            .otherwise(t)
        )
        return F.when(t.rlike("[0-9]"), plain.try_cast("double"))

    # a step is bound to a name, so that its expression isn't spelt out at each use
    signed = F.transform(F.array(clean), lambda x: F.concat(F.when(x.startswith("-"), "-").otherwise(""), F.translate(x, "-", "")))
    return F.element_at(F.transform(signed, value), 1)


def price_label(c: Column | str) -> Column:
    """A price with two decimals and blanks between thousands."""
    return F.translate(F.format_number(F.round(col(c), 2), 2), ",", " ")


def percent_label(c: Column | str) -> Column:
    return F.concat(F.round(col(c) * 100, 0).cast("int").cast("string"), F.lit("%"))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Ukrainian word form for a count."""
    return F.when((n % 10 == 1) & (n % 100 != 11), one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def age_label(moment: Column, now: Column) -> Column:
    """How long ago, in Ukrainian: minutes, hours, days, months of 30 days, years of 12 such months."""
    s = F.greatest(F.unix_seconds(now) - F.unix_seconds(moment), F.lit(0))
    whole = lambda x, n: F.floor(x / n)
    m, h, d = whole(s, 60), whole(s, 3600), whole(s, 86400)
    mo, y = whole(d, 30), whole(d, 360)
    ago = F.lit(" тому")
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(" "), unit, ago)
    hours = F.concat(h.cast("string"), F.lit(" год"), F.when(m % 60 > 0, F.concat(F.lit(" "), (m % 60).cast("string"), F.lit(" хв"))).otherwise(""), ago)
    return (
        F.when(moment.isNull(), "—").when(s < 60, "щойно").when(m < 60, text(m, F.lit("хв"))).when(h < 24, hours)
        .when(d < 30, text(d, plural(d, "день", "дні", "днів"))).when(mo < 12, text(mo, plural(mo, "місяць", "місяці", "місяців"))).otherwise(text(y, plural(y, "рік", "роки", "років")))
    )


def normalise_synonyms(c: Column | str, synonyms: dict[str, list[str]], strict: bool = False) -> Column:
    """Lower case, each variant as a whole word replaced by its canonical word; strict leaves words alone."""
    out = F.lower(col(c))
    for canonical, variants in {} if strict else synonyms.items():
        for v in variants:
            if v.strip():
                out = F.regexp_replace(out, r"(?U)\b\Q" + v.strip().lower() + r"\E\b", canonical.lower())
    return utrim(out)


def truthy(c: Column | str) -> Column:
    """Whether a flag of any type says yes: true, 1, yes, numbers other than 0; null says no."""
    t = F.lower(utrim(col(c).cast("string")))
    return F.coalesce(t.isin("true", "yes") | (t.try_cast("double") != 0), F.lit(False))


@F.pandas_udf(DoubleType())
def fuzzy_score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Greatest matching-blocks ratio of a query against each token and the whole haystack."""
    from difflib import SequenceMatcher

    seen: dict[tuple[str, str], float] = {}

    def ratio(query: str, text: str) -> float:
        if (query, text) not in seen:
            if len(seen) > 1 << 16:
                seen.clear()
            seen[query, text] = SequenceMatcher(None, query, text).ratio()
        return seen[query, text]

    for query, tokens, text in batches:
        yield pd.Series([max([ratio(q, t) for t in ts if t] + ([ratio(q, h)] if h else []), default=0.0) for q, ts, h in zip(query, tokens, text)], dtype="float64")
