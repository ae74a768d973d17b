"""Schemas that drift between files: column lifespans, changes, one consistent table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Types of the consistent table's fields; the others are text.
FIELD_TYPES = {"price": "double", "qty": "bigint", "weight_g": "double", "warranty_months": "bigint", "channel_exclude": "boolean", "updated_at": "timestamp"}

#: Words for truth.
TRUE_WORDS, FALSE_WORDS = ["true", "1", "1.0", "yes", "так"], ["false", "0", "0.0", "no", "ні"]


def outer_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def header_key(c: Column) -> Column:
    """How headers and suppliers are compared: outer blanks off, lower case."""
    return F.lower(outer_trim(c))


def version_fields(templates: DataFrame, aliases: DataFrame) -> DataFrame:
    """(template_id, supplier_key, saved_at, fields ARRAY<STRUCT<field, header>>): the headers of each version that belong to a field.

    A known alias decides; a header that isn't one belongs to the field that this version's own mapping
    names it for (the first by name of several). Mapping entries whose header isn't in the file say nothing. Of
    several headers of one field the first in the file counts. The alias table, small by its nature, comes in as
    one map; each version is read within its row and nothing is shuffled.
    """
    keyed = aliases.where("alias_name IS NOT NULL AND field IS NOT NULL").groupBy(header_key(F.col("alias_name")).alias("header")).agg(F.min("field").alias("field"))
    known = keyed.agg(F.map_from_entries(F.collect_list(F.struct("header", "field")))).scalar()
    entries = F.transform(F.map_entries("column_mapping"), lambda e: F.struct(header_key(e["value"]).alias("header"), e["key"].alias("field")))
    t = templates.where("template_id IS NOT NULL").select("template_id", header_key(F.col("supplier")).alias("supplier_key"), "saved_at", F.transform("headers", header_key).alias("h"), F.coalesce(entries, F.array().cast("array<struct<header:string,field:string>>")).alias("m")).withColumn("known", known)
    own = lambda h: F.array_min(F.transform(F.filter("m", lambda e: e["header"] == h), lambda e: e["field"]))
    named = F.transform(F.filter("h", lambda h: h.isNotNull()), lambda h: F.struct(F.coalesce(F.col("known")[h], own(h)).alias("field"), h.alias("header")))
    t = t.select("template_id", "supplier_key", "saved_at", F.filter(named, lambda x: x["field"].isNotNull()).alias("x"))
    first = F.filter("x", lambda e, i: ~F.exists(F.slice("x", F.lit(1), i), lambda o: o["field"] == e["field"]))
    return t.select("template_id", "supplier_key", "saved_at", F.coalesce(first, F.array().cast("array<struct<field:string,header:string>>")).alias("fields"))


#: JSON types; a header's types are a set of bits, so that they combine before any shuffle.
KINDS = ("boolean", "list", "number", "object", "string")


def value_types(feed: DataFrame) -> DataFrame:
    """(template_id, header, kind): JSON type of each header's non-null values; several ones, sorted, with a bar between."""
    name = F.regexp_extract(F.schema_of_variant(F.col("value")), r"^[A-Z]+", 0)
    bit = F.when(name == "VOID", 0).when(name == "BOOLEAN", 1).when(name == "ARRAY", 2).when(name == "OBJECT", 8).when(name == "STRING", 16).otherwise(4)
    sets = _cells(feed).groupBy("template_id", "header").agg(F.bit_or(bit).alias("bits")).where("bits > 0")
    return sets.select("template_id", "header", F.array_join(F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(1 << n) > 0, k) for n, k in enumerate(KINDS)))), "|").alias("kind"))


def _cells(feed: DataFrame) -> DataFrame:
    """(row_id, template_id, header, value VARIANT) of each payload; one that isn't a JSON object has no cells."""
    spark = feed.sparkSession
    rows = feed.select("row_id", "template_id", F.try_parse_json("payload").alias("v")).where("v IS NOT NULL AND is_variant_null(v) = false AND schema_of_variant(v) LIKE 'OBJECT%'")
    cells = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return cells.select("row_id", "template_id", header_key(F.col("key")).alias("header"), "value")


def lifespans(templates: DataFrame, feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """The column catalogue: a row for each version and field of a supplier, with its neighbours in the field's life.

    supplier_key, field, template_id, version (1 for a supplier's first by saved_at, then template_id), header,
    kind, and before_*: the same field's row before it; island: number of the unbroken run of versions;
    type_island: number of the run of versions in which the field's type, where a version tells one, stays too.
    """
    kinds = value_types(feed).groupBy("template_id").agg(F.map_from_entries(F.collect_list(F.struct("header", "kind"))).alias("kinds"))
    t = version_fields(templates, aliases).join(kinds, "template_id", "left")
    t = t.withColumn("fields", F.transform("fields", lambda x: F.struct(x["field"].alias("field"), x["header"].alias("header"), F.col("kinds")[x["header"]].alias("kind")))).drop("kinds")
    order = Window.partitionBy("supplier_key").orderBy(F.col("saved_at").asc_nulls_first(), "template_id")
    t = t.select("supplier_key", "template_id", F.row_number().over(order).alias("version"), F.lead("template_id").over(order).alias("next_template_id"), "fields")
    rows = t.select("supplier_key", "template_id", "version", "next_template_id", F.inline("fields")).repartition("supplier_key", "field")
    life = Window.partitionBy("supplier_key", "field").orderBy("version")
    told = F.last("kind", ignorenulls=True).over(life.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("supplier_key", "field", "template_id", "version", "next_template_id", "header", "kind", *(F.lag(c).over(life).alias(f"before_{c}") for c in ("version", "header", "kind")), F.lead("version").over(life).alias("after_version"), told.alias("told"))
    starts = F.col("before_version").isNull() | (F.col("before_version") < F.col("version") - 1)
    turns = starts | F.coalesce(F.col("kind") != F.col("told"), F.lit(False))
    return rows.withColumn("island", F.sum(starts.cast("int")).over(life)).withColumn("type_island", F.sum(turns.cast("int")).over(life)).drop("told")


def column_changes(templates: DataFrame, feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(template_id, field, change_kind) against the supplier's previous version: added, removed, renamed, retyped.

    An island of a field's versions starts with 'added' (not in the first version) and ends with 'removed' in
    the version after it; within an island another header is 'renamed' and another type 'retyped' (a version
    without values tells no type). Order of headers, headers of no field and the mapping alone are no
    changes. Null suppliers are one supplier; null headers and unreadable payloads are left out; empty tables
    give no rows.
    """
    rows = stored(lifespans(templates, feed, aliases), "lifespans")
    goes_on = F.col("before_version") == F.col("version") - 1
    here = F.array_compact(
        F.array(
            F.when((F.col("version") > 1) & ~F.coalesce(goes_on, F.lit(False)), "added"),
            F.when(goes_on & (F.col("header") != F.col("before_header")), "renamed"),
            F.when(goes_on & (F.col("kind") != F.col("before_kind")), "retyped"),
        )
    )
    changes = rows.select("template_id", "field", F.explode(here).alias("change_kind"))
    ends = F.col("next_template_id").isNotNull() & (F.coalesce("after_version", F.lit(-1)) != F.col("version") + 1)
    return changes.unionAll(rows.where(ends).select(F.col("next_template_id").alias("template_id"), "field", F.lit("removed").alias("change_kind")))


def field_lifespans(templates: DataFrame, feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(supplier_key, field, island, first_template_id, last_template_id, n_versions): each unbroken life of a field."""
    rows = lifespans(templates, feed, aliases)
    return rows.groupBy("supplier_key", "field", "island").agg(F.min_by("template_id", "version").alias("first_template_id"), F.max_by("template_id", "version").alias("last_template_id"), F.count("*").alias("n_versions"))


def type_lifespans(templates: DataFrame, feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(supplier_key, field, type_island, kind, first_template_id, last_template_id, n_versions): each unbroken life of a field in one type.

    kind is null for a life in which no version has a value.
    """
    rows = lifespans(templates, feed, aliases)
    return rows.groupBy("supplier_key", "field", "type_island").agg(F.max("kind").alias("kind"), F.min_by("template_id", "version").alias("first_template_id"), F.max_by("template_id", "version").alias("last_template_id"), F.count("*").alias("n_versions"))


def consistent_rows(templates: DataFrame, feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """One table of all feed rows: row_id, template_id, supplier and a typed column for each field of the alias table.

    Values that don't fit a field's type are null there; `others` has the values of fields the alias table
    lacks and `unfit` the texts that didn't fit, both by field. Lists are joined by "; ".
    """
    fields = sorted(r.field for r in aliases.select("field").distinct().collect() if r.field)  # a small fixed table
    cells = _cells(feed).where("NOT is_variant_null(value)").join(version_fields(templates, aliases).select("template_id", F.inline("fields")), ["template_id", "header"])
    items = F.try_variant_get("value", "$", "array<string>")
    text = F.coalesce(F.when(F.schema_of_variant("value").startswith("ARRAY"), F.array_join(items, "; ")), F.try_variant_get("value", "$", "string"))
    pairs = F.array_sort(F.collect_list(F.struct("field", text.alias("text"))))
    unique = F.filter(pairs, lambda x, i: (i == 0) | (x["field"] != F.element_at(pairs, F.when(i == 0, 1).otherwise(i))["field"]))
    values = cells.groupBy("row_id").agg(F.map_from_entries(unique).alias("vals"))
    suppliers = templates.select("template_id", header_key(F.col("supplier")).alias("supplier"))
    rows = feed.select("row_id", "template_id").join(suppliers, "template_id", "left").join(values, "row_id", "left")

    def typed(f: str) -> Column:
        v, to = F.trim(F.col("vals")[f]), FIELD_TYPES.get(f)
        if to in ("double", "bigint"):
            # one number, grouped or not, perhaps with its unit
            v = F.regexp_extract(F.regexp_replace(v, r"[\s\p{Z}]", ""), r"^([+-]?[0-9]+(?:[.,][0-9]+)?)[^0-9]*$", 1)
            v = F.translate(v, ",", ".").try_cast("double")
            return (v if to == "double" else v.try_cast("bigint")).alias(f)
        if to == "boolean":
            v = F.lower(v)
            return F.when(v.isin(TRUE_WORDS), True).when(v.isin(FALSE_WORDS), False).alias(f)
        return (v.try_cast(to) if to else F.col("vals")[f]).alias(f)

    lacking = F.map_filter("vals", lambda k, v: ~k.isin(fields))
    out = rows.select("row_id", "template_id", "supplier", "vals", *(typed(f) for f in fields), lacking.alias("others"))
    bad = F.map_filter("vals", lambda k, v: F.coalesce(*(F.when(k == f, F.col(f).isNull()) for f in fields if f in FIELD_TYPES), F.lit(False)))
    return out.withColumn("unfit", bad).drop("vals")
