"""Store products against supplier offers: candidates, similarity, top matches, leftovers, review state."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_tokens, group_id, jaccard, match_id, stable_hash
from ..session import stored


def token_sets(df: DataFrame, tokens: Column) -> DataFrame:
    """df with tokens (sorted) and tokens_key, by which rows of one token set meet."""
    out = df.withColumn("tokens", F.array_sort(tokens))
    return out.withColumn("tokens_key", F.xxhash64("tokens"))


#: A token is hot if more pairs of sets than this would meet in it; hot tokens are joined by classes of sets.
HOT_PAIRS = 256


class Reach(NamedTuple):
    """Which token sets of two sides reach a similarity, without a row for each pair that only hot tokens join.

    Sets of one size that hold the same hot tokens are one class, and all pairs of two classes share the same
    hot tokens. near(): (a_class, b_class, similarity) from hot tokens alone; pairs: (a_key, b_key, similarity)
    of the sets that share a token that isn't hot, exact. A pair in both has the similarity of pairs.
    """

    a: DataFrame  # a_key, a_class
    b: DataFrame  # b_key, b_class
    a_hot: DataFrame  # a_class, n_a, hot_a, token, before_a: a row for each of the class's rarest hot tokens, with those before it
    b_hot: DataFrame
    pairs: DataFrame
    least: float

    def near(self, of_b: DataFrame | None = None) -> DataFrame:
        """Pairs of classes, made by each use and never stored, as they may be far more than sets. of_b: columns by b_class to go along.

        Both lists of hot tokens begin with the rarest, so the first token that two classes share is among the
        rarest of both: the pair is made there only (nothing before it is shared), which needs no shuffle.
        """
        b = self.b_hot if of_b is None else self.b_hot.join(of_b, "b_class")
        tasks = 4 * int(self.a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to compare
        rows = self.a_hot.repartition(tasks, "token").join(b.repartition(tasks, "token"), "token").where((F.col("n_b") >= F.col("n_a") * self.least - 1e-9) & (F.col("n_a") >= F.col("n_b") * self.least - 1e-9))
        rows = rows.where(~F.arrays_overlap("before_a", "before_b"))
        # generated, so that conditions on it don't compare the lists again
        rows = rows.withColumn("same", F.explode(F.array(F.size(F.array_intersect("hot_a", "hot_b")))))
        rows = rows.withColumn("similarity", F.col("same") / (F.col("n_a") + F.col("n_b") - F.col("same"))).where(F.col("similarity") >= self.least)
        return rows.drop("token", "n_a", "n_b", "hot_a", "hot_b", "before_a", "before_b", "same")


def reach(a: DataFrame, b: DataFrame, least: float) -> Reach:
    """Token sets of a and b (tokens, tokens_key) that share a token and reach the similarity, least > 0.

    Works on distinct sets, stored once. Tokens of one side only count in sizes. Other tokens meet by set
    where at most HOT_PAIRS pairs do, which bounds that join by the number of tokens. Hot tokens meet by
    class: to reach `least` a class of sets of size n must share ceil(least * n) of its hot tokens, so one of
    all but that many of its rarest, and sizes differ by the factor `least` at most. Shared tokens are
    numbered from the rarest on.
    """
    sets = {n: stored(x.select(F.col("tokens_key").alias("key"), "tokens").distinct(), f"sets_{n}") for n, x in (("a", a), ("b", b))}
    words = {n: x.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("word")) for n, x in sets.items()}
    freq = {n: x.groupBy("word").agg(F.count("*").alias(f"df_{n}")) for n, x in words.items()}
    shared = freq["a"].join(freq["b"], "word").select("word", (F.col("df_a") * F.col("df_b")).alias("meet"))
    shared = shared.repartitionByRange("meet", "word").sortWithinPartitions("meet", "word").select("word", (F.col("meet") > HOT_PAIRS).alias("hot"), F.monotonically_increasing_id().alias("token"))
    shared = stored(shared, "shared_tokens")

    members, hot, rare = {}, {}, {}
    for n, x in words.items():
        of_key = x.join(shared.where("hot"), "word").groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("token")).alias("hot"))
        members[n] = stored(of_key.select("key", "n", "hot", F.xxhash64("n", "hot").alias("class")), f"classes_{n}")
        c = members[n].groupBy("class").agg(F.first("n").alias("n"), F.first("hot").alias("hot")).withColumn("keep", F.size("hot") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1).where("keep > 0")
        hot[n] = stored(c.select(F.col("class").alias(f"{n}_class"), F.col("n").alias(f"n_{n}"), F.col("hot").alias(f"hot_{n}"), F.posexplode(F.slice("hot", F.lit(1), F.col("keep"))).alias("at", "token")).withColumn(f"before_{n}", F.slice(f"hot_{n}", F.lit(1), F.col("at"))).drop("at"), f"hot_{n}")
        rare[n] = x.join(shared.where("NOT hot").select("word"), "word").select(F.col("key").alias(f"{n}_key"), "word")

    pairs = rare["a"].join(rare["b"], "word").select("a_key", "b_key").distinct()
    for n in ("a", "b"):
        pairs = pairs.join(sets[n].select(F.col("key").alias(f"{n}_key"), F.col("tokens").alias(f"t_{n}")), f"{n}_key")
    pairs = pairs.select("a_key", "b_key", jaccard(F.col("t_a"), F.col("t_b")).alias("similarity")).where(F.col("similarity") >= least)
    sides = [members[n].select(F.col("key").alias(f"{n}_key"), F.col("class").alias(f"{n}_class")) for n in ("a", "b")]
    return Reach(*sides, hot["a"], hot["b"], stored(pairs, "pairs"), least)


def similar_sets(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a_key, b_key, similarity): every pair of token sets that shares a token and reaches the similarity.

    The output has a row for each pair; the other operators work on classes of sets and never expand them.
    """
    r = reach(a, b, least)
    by_class = r.near().join(r.a, "a_class").join(r.b, "b_class").select("a_key", "b_key", "similarity")
    return by_class.join(r.pairs, ["a_key", "b_key"], "left_anti").unionAll(r.pairs)


def match_counts(store: DataFrame, offers: DataFrame, least: float = 0.15) -> DataFrame:
    """(store_id, n_sets, best_other): how many offer texts (distinct sku and token set) each store product
    reaches, and the best similarity to a text that isn't of its own sku, 0 if there is none.

    Counts and best similarities are taken from classes; only a product whose own texts fill its best class
    looks at the further ones.
    """
    r = reach(store, offers, least)
    texts = stored(offers.select(F.col("tokens_key").alias("b_key"), F.lower("sku").alias("k")).distinct().join(r.b, "b_key", "left"), "texts")
    mine = stored(store.select("store_id", F.lower("sku").alias("own"), F.col("tokens_key").alias("a_key")).join(r.a, "a_key", "left"), "mine")
    classes = stored(r.near(), "near")
    near = stored(classes.join(texts.groupBy("b_class").agg(F.count("*").alias("w")), "b_class"), "near_counts")
    total = near.groupBy("a_class").agg(F.sum("w").alias("n"), F.max_by(F.struct("similarity", "b_class", "w"), F.struct("similarity", "b_class")).alias("best"))
    own = mine.join(texts, F.col("own") == F.col("k")).groupBy("store_id", "b_class").agg(F.count("*").alias("m"))

    of_class = mine.join(total, "a_class").join(own.withColumnRenamed("b_class", "c"), ["store_id"], "left").groupBy("store_id", "a_class", "n", "best")
    of_class = stored(of_class.agg(F.coalesce(F.max(F.when(F.col("c") == F.col("best.b_class"), F.col("m"))), F.lit(0)).alias("m")), "of_class")
    filled = of_class.where("m >= best.w").select("store_id", "a_class").join(near, "a_class").join(own, ["store_id", "b_class"], "left")
    others = filled.where("coalesce(m, 0) < w").select("store_id", F.lit(0).cast("long").alias("n"), "similarity")
    first = of_class.select("store_id", "n", F.when(F.col("m") < F.col("best.w"), F.col("best.similarity")).otherwise(0.0).alias("similarity"))
    by_pair = mine.join(r.pairs, "a_key").join(texts, "b_key").join(classes.select("a_class", "b_class", F.lit(True).alias("known")), ["a_class", "b_class"], "left")
    by_pair = by_pair.select("store_id", F.when(F.col("known"), 0).otherwise(1).cast("long").alias("n"), F.when(F.col("own") == F.col("k"), 0.0).otherwise(F.col("similarity")).alias("similarity"))
    rows = first.unionAll(others).unionAll(by_pair).groupBy("store_id").agg(F.sum("n").alias("n_sets"), F.max("similarity").alias("best_other"))
    return rows.where("n_sets > 0")


def top_matches(store: DataFrame, offers: DataFrame, least: float = 0.15, most: int = 8, r: Reach | None = None) -> DataFrame:
    """(store_id, rank, supplier, sku, name, price, similarity): the best offers of each store product.

    store: store_id, sku, tokens, tokens_key; offers: supplier, sku, name, price, tokens, tokens_key. An equal
    sku has similarity 1. Offers of one class of sets are alike to a store product but for price, unless they
    share a rarer token with it (r: their reach() at `least`, if it is known); so the `most` best of a class of store products over the cheapest `most` of
    each class of offers, those that share a rarer token and those of an equal sku hold all best offers.

    Offers are numbered in the order of ties (o), and only numbers are ranked. An offer that is p-th of a class
    that is r-th by similarity and its cheapest offer has r - 1 + p - 1 better ones at least.
    """
    order = ("price", "supplier", "sku", "name")

    def cheapest(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("p", F.row_number().over(Window.partitionBy(key).orderBy("o"))).where(F.col("p") <= most)

    r = r or reach(store, offers, least)
    cols = ["store_id", "b_key", "o", "similarity"]
    named = offers.select(*order, F.col("tokens_key").alias("b_key")).repartitionByRange(*order).sortWithinPartitions(*order)
    named = stored(named.withColumn("o", F.monotonically_increasing_id()), "offered")
    offered = named.select("o", "b_key", F.lower("sku").alias("k"))
    mine = store.select("store_id", F.lower("sku").alias("own"), F.col("tokens_key").alias("a_key"))
    in_class = stored(cheapest(offered.select("o", "b_key").join(r.b, "b_key"), "b_class"), "cheapest")
    rank = F.row_number().over(Window.partitionBy("a_class").orderBy(F.desc("similarity"), "first"))
    best = r.near(in_class.where("p = 1").select("b_class", F.col("o").alias("first"))).withColumn("r", rank).where(F.col("r") <= most)
    rank = F.row_number().over(Window.partitionBy("a_class").orderBy(F.desc("similarity"), "o"))
    by_class = best.join(in_class, "b_class").where(F.col("r") + F.col("p") <= most + 1).select("a_class", "b_key", "o", "similarity").withColumn("r", rank).where(F.col("r") <= most)
    by_class = stored(by_class.drop("r"), "by_class")
    other = ~F.coalesce(F.col("k") == F.col("own"), F.lit(False))
    rows = mine.join(r.a, "a_key").join(by_class, "a_class").join(offered.select("o", "k"), "o").where(other).select(*cols)
    rows = rows.unionAll(mine.join(r.pairs, "a_key").join(cheapest(offered, "b_key"), "b_key").where(other).select(*cols))
    same = mine.where("own IS NOT NULL").join(cheapest(offered.where("k IS NOT NULL"), "k"), F.col("own") == F.col("k")).withColumn("similarity", F.lit(1.0)).select(*cols)
    # one partitioning serves both windows: an offer's greatest similarity, and its rank
    rows = rows.unionAll(same).repartition("store_id").withColumn("g", F.max("similarity").over(Window.partitionBy("store_id", "b_key"))).where("similarity = g")
    rank = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("similarity"), "o"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= most).select("store_id", "o", "similarity", "rank")
    return rows.join(named.select("o", *order), "o").select("store_id", *order, "similarity", "rank")


def match_board(store: DataFrame, matches: DataFrame) -> DataFrame:
    """Each store product with its matches; those without one still have a row."""
    m = matches.select("store_id", F.col("rank"), F.col("supplier").alias("match_supplier"), F.col("sku").alias("match_sku"), F.col("price").alias("match_price"), "similarity")
    return store.select("store_id", "sku", "name", "price").join(m, "store_id", "left")


def leftovers(store: DataFrame, offers: DataFrame, least: float = 0.15, r: Reach | None = None) -> DataFrame:
    """The offers that no store product reaches, with group_id and tokens_text, where two or more have equal tokens.

    An offer is left over if neither its sku nor its token set reaches a store product. Anti joins on keys; group
    sizes are counted apart and joined back, so that a large group isn't gathered.
    """
    r = r or reach(store, offers, least)
    reached = r.b.join(r.near().select("b_class").distinct(), "b_class", "left_semi").select(F.col("b_key").alias("tokens_key")).unionAll(r.pairs.select("b_key")).distinct()
    skus = store.where("sku IS NOT NULL").select(F.lower("sku").alias("k")).distinct()
    left = offers.withColumn("k", F.lower("sku")).join(reached, "tokens_key", "left_anti").join(skus, "k", "left_anti")
    key = F.when(F.size("tokens") > 0, F.array_join("tokens", " ")).otherwise(F.lower("name"))
    left = stored(left.withColumn("tokens_text", key).drop("k"), "leftovers")
    large = left.groupBy("tokens_text").agg(F.count("*").alias("n")).where("n >= 2").select("tokens_text")
    return left.join(large, "tokens_text").withColumn("group_id", F.concat(F.lit("supplier::"), stable_hash(F.col("tokens_text"))))


def unmatched_groups(store: DataFrame, offers: DataFrame, least: float = 0.15) -> DataFrame:
    """(group_id, tokens_text, n_offers, first_name): groups of leftovers()."""
    return leftovers(store, offers, least).groupBy("group_id", "tokens_text").agg(F.count("*").alias("n_offers"), F.min(F.lower("name")).alias("first_name"))


def with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Match rows with their stored status; where none is stored, near-certain matches are confirmed and others pending; removed ones go."""
    out = rows.join(state.select("group_id", "match_id", F.col("status").alias("stored")), ["group_id", "match_id"], "left")
    status = F.coalesce("stored", F.when(F.col("similarity") >= 0.999, "confirmed").otherwise("pending"))
    return out.withColumn("status", status).drop("stored").where("status <> 'removed'")


def prune_state(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored states of pairs that still exist."""
    return state.join(rows.select("group_id", "match_id").distinct(), ["group_id", "match_id"], "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of the old ones with their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


BOARD = ["group_id", "group_type", "store_id", "store_sku", "store_name", "store_price", "store_tags", "match_id", "supplier", "sku", "name", "price", "similarity", "status"]


def board_rows(store: DataFrame, offers: DataFrame, state: DataFrame, least: float = 0.15, most: int = 8, r: Reach | None = None, matches: DataFrame | None = None) -> DataFrame:
    """The board's rows (BOARD): a store product's matches with their state, or itself where nothing matches, and leftovers.

    store: store_id, sku, name, price, tags, tokens, tokens_key. A row without match has match_id null,
    similarity 0 and the status 'pending'; leftovers have no store product and the similarity 1. Removed
    matches have no row. r and matches: reach() and top_matches() of the same sides, if they are known.
    """
    mine = store.select("store_id", group_id(F.col("sku"), F.col("name")).alias("group_id"), F.col("sku").alias("store_sku"), F.col("name").alias("store_name"), F.col("price").alias("store_price"), F.col("tags").alias("store_tags"))
    match = match_id(F.col("supplier"), F.col("sku"), F.col("name")).alias("match_id")
    r = r or reach(store, offers, least)
    matches = matches if matches is not None else stored(top_matches(store, offers, least, most, r), "matches")
    found = matches.join(mine, "store_id").select("*", match, F.lit("store").alias("group_type"))
    none = mine.join(matches.select("store_id"), "store_id", "left_anti").withColumns({"group_type": F.lit("store"), "match_id": F.lit(None), "supplier": F.lit(None), "sku": F.lit(None), "name": F.lit(None), "price": F.lit(None).cast("double"), "similarity": F.lit(0.0), "status": F.lit("pending")})
    rest = leftovers(store, offers, least, r).select("group_id", match, "supplier", "sku", "name", "price", F.lit("supplier-only").alias("group_type"), F.lit(1.0).alias("similarity"))
    rows = with_state(found.drop("rank").unionByName(rest, allowMissingColumns=True), state)
    return rows.select(*BOARD).unionByName(none.select(*BOARD))


def board_filters(least: float = 0.6) -> dict[str, Column]:
    """The board's filters as named conditions on its rows; `near` is that of the similarity slider."""
    of_store, status = F.col("group_type") == "store", F.col("status")
    matched = F.col("match_id").isNotNull()
    return {"all": F.lit(True), "has_matches": of_store & matched, "no_matches": of_store & ~matched, "supplier_only": ~of_store, "confirmed": status == "confirmed", "pending": ~status.isin("confirmed", "removed"), "near": ~matched | (F.col("similarity") >= least)}


def board_search(query: str) -> Column:
    """Whether a text is in one of a row's fields: store sku, name or tags, supplier's sku, name or the supplier; an empty text is in all."""
    q = query.strip().lower()
    fields = ["store_sku", "store_name", "sku", "name", "supplier"]
    texts = [*map(F.col, fields), F.array_join(F.array_sort("store_tags"), " ")]
    return F.lit(True) if not q else F.greatest(*(F.coalesce(F.lower(t).contains(q), F.lit(False)) for t in texts))


#: What the board can be sorted by.
SORTS = ("store_sku", "store_name", "store_tags", "store_price", "sku", "name", "supplier", "price", "similarity", "status")


def board_order(column: str, descending: bool = False) -> list[Column]:
    """A sort of the board's rows: missing values last either way, then the row's id in the same direction.

    Texts are compared in lower case, blank ones are missing; tags as one text. Any of SORTS, else ValueError.
    """
    if column not in SORTS:
        raise ValueError(f"no column {column}")
    c = F.array_join(F.array_sort("store_tags"), ", ") if column == "store_tags" else F.col(column)
    key = c if column in ("store_price", "price", "similarity") else F.nullif(F.lower(c), F.lit(""))
    ids = [F.coalesce("group_id", F.lit("")), F.coalesce("store_id", F.lit("")), F.coalesce("match_id", F.lit("")), F.coalesce("price", F.lit(-1.0))]
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), *(i.desc() if descending else i.asc() for i in ids)]


def display_class(low: float = 0.45) -> Column:
    """How a row is shown: confirmed ones 'match-full', flagged or weak matches 'match-low', others 'match-none'."""
    weak = F.col("match_id").isNotNull() & (F.col("similarity") < low)
    return F.when(F.col("status") == "confirmed", "match-full").when((F.col("status") == "flagged") | weak, "match-low").otherwise("match-none")


def sorted_groups(rows: DataFrame) -> DataFrame:
    """(group_id, name, sku, price, supplier_name, supplier_price), in the board's order of groups.

    The supplier's name is that of the best match, or in leftover groups of the first by name and price; a
    missing price counts as infinite. Combinable aggregates, then a sort over all partitions.
    """
    of_store = F.col("group_type") == "store"
    first = F.min(F.struct(F.when(of_store, -F.col("similarity")).otherwise(0.0).alias("s"), F.when(~of_store, F.lower("name")).alias("n"), "price", "supplier", F.lower("sku").alias("k"), F.lower("name").alias("name"))).alias("first")
    g = rows.groupBy("group_id", "group_type", "store_id", "store_sku", "store_name", "store_price").agg(F.min(F.when(F.col("match_id").isNotNull(), F.col("price"))).alias("least"), first)
    inf = F.lit(float("inf"))
    out = g.select(
        "group_id", F.coalesce(F.lower("store_name"), F.when(of_store, F.lit("")), "first.name", F.lit("")).alias("sort_name"), F.coalesce(F.lower("store_sku"), "first.k", F.lit("")).alias("sort_sku"),
        F.when(of_store, F.coalesce("store_price", inf)).otherwise(inf).alias("sort_price"), F.coalesce("first.name", F.lower("store_name"), F.lit("")).alias("supplier_name"), F.coalesce("least", inf).alias("supplier_price"),
    )
    return out.orderBy("sort_name", "sort_sku", "sort_price", "supplier_name", "supplier_price")


def default_tokens(name: Column | str, sku: Column | str, tags: Column | str | None = None) -> Column:
    return blank_tokens(tags, name, sku)
