import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricemill.operators import matching
from pricemill.operators.ranking import places
from pricemill.plans import offer_queries as q
from pricemill.plans.domain import store, supply


def _similarity(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_match_candidates_by_brute_force(spark, sf):
    """All pairs from the reference's similarity, 0.15, on."""
    offers = {(tuple(r.tokens), r.sku.lower()) for r in supply(spark, sf).select("tokens", "sku").collect()}
    want = Counter(s.store_id for s in store(spark, sf).select("store_id", "tokens").collect() for t, _ in offers if _similarity(s.tokens, t) >= 0.15)
    assert {r.store_id: r.n_sets for r in q.match_candidates(spark, sf).collect()} == dict(want)


def _write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_names_with_outer_blanks_and_null_suppliers(spark, tmp_path):
    rows = [(1, "\u00a0Phone\t", None, ["b"]), (2, "X", "S", None)]
    path = _write(spark, tmp_path, "product", rows, "product_id long, name string, supplier string, tags array<string>")
    assert {tuple(r) for r in q.synonym_normalize(spark, path).collect()} == {(1, "phone"), (2, "x")}
    assert {tuple(r) for r in q.tag_merge(spark, path).collect()} == {(1, "b|merged"), (2, "merged|s")}


def test_every_file_is_on_one_side(spark, tmp_path):
    rows = [("s", "a", 5, 1), ("s", "b", 7, 2), ("s", "a", 11, 3), ("s", "c", 13, 4)]
    path = _write(spark, tmp_path, "price_file", rows, "supplier string, path string, size long, mtime long")
    assert {tuple(r) for r in q.manifest_upsert(spark, path).collect()} == {("s", "b", 7, "old"), ("s", "a", 12, "new"), ("s", "c", 14, "new")}


def test_leftovers_by_brute_force(spark):
    goods = [(f"w{i % 7} w{i % 11} w{i % 13} t{i % 5}", f"s{i}") for i in range(30)]
    lists = [(f"w{i % 7 + i % 3 * 5} w{i % 11 + 9} u{i % 4}", f"s{i + 28}") for i in range(40)] * 2
    tokens = matching.default_tokens("name", "sku")
    shop = matching.token_sets(spark.createDataFrame(goods, "name string, sku string"), tokens)
    offers = matching.token_sets(spark.createDataFrame(lists, "name string, sku string"), tokens)
    sets = [r.tokens for r in shop.collect()]
    left = Counter(" ".join(r.tokens) for r in offers.collect() if r.sku not in {s for _, s in goods} and all(_similarity(r.tokens, s) < 0.15 for s in sets))
    assert 0 < len(left) < 38
    assert {r.tokens_text: r.n_offers for r in matching.unmatched_groups(shop, offers).collect()} == dict(left)


@pytest.mark.parametrize("least, hot", [(0.15, 0), (1 / 3, 3), (0.6, 3), (0.8, 0), (0.8, 256), (0.9, 0), (1.0, 3)])
def test_similar_sets_lose_nothing(spark, monkeypatch, least, hot):
    """Pairs of exactly the threshold too, whether tokens are hot or not; sets of up to 20 tokens."""
    monkeypatch.setattr(matching, "HOT_PAIRS", hot)
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(24)]
    sides = [[sorted(rnd.sample(vocab[: rnd.choice([6, 24])], rnd.randint(1, 6))) for _ in range(25)] + [sorted(vocab[:n]) for n in (5, 10, 20)] + [[]] for _ in "ab"]
    sides[1] += [sorted(vocab[:n] + [f"x{i}" for i in range(m)]) for n, m in ((4, 1), (8, 0), (9, 0), (16, 0), (18, 0))]
    a, b = (matching.token_sets(spark.createDataFrame([(t,) for t in side], "t array<string>"), F.col("t")).drop("t") for side in sides)
    key = {r.tokens_key: tuple(r.tokens) for d in (a, b) for r in d.collect()}
    got = {(key[r.a_key], key[r.b_key]): r.similarity for r in matching.similar_sets(a, b, least).collect()}
    want = {(tuple(x), tuple(y)): _similarity(x, y) for x in sides[0] for y in sides[1] if x and y and set(x) & set(y) and _similarity(x, y) >= least}
    assert got == want


def test_places_of_a_hot_group(spark):
    """Nulls are a group, a group of most rows is spread, ties are told apart by the last column."""
    rows = [(None if i % 10 == 9 else "hot" if i % 3 else "rare", i % 7, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, id int")
    got = {(r.g, r.id): r.place for r in places(df, "g", [F.col("x").desc_nulls_last(), F.col("id")]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[g, r[2]] = n
    assert got == want
    assert places(df.limit(0), "g", [F.col("id")]).count() == 0


def test_board(spark):
    tokens = matching.default_tokens("name", "sku", "tags")
    shop = matching.token_sets(spark.createDataFrame([("1", "A", "red ring", 5.0, ["t"]), ("2", "B", "odd", None, [])], "store_id string, sku string, name string, price double, tags array<string>"), tokens)
    lists = [("s", "a", "other", 1.0), ("s", "x", "red ring big", 2.0), ("t", "y", "red bolt", 3.0), ("t", "q", "lone pair", 4.0), ("u", "q", "lone pair", None), ("u", "z", "single", 1.0)]
    offers = matching.token_sets(spark.createDataFrame(lists, "supplier string, sku string, name string, price double"), matching.default_tokens("name", "sku"))
    state = matching.board_rows(shop, offers, spark.createDataFrame([], "group_id string, match_id string, status string"))
    rows = {(r.store_id, r.supplier, r.sku): r for r in state.collect()}
    assert {k: r.status for k, r in rows.items()} == {("1", "s", "a"): "confirmed", ("1", "s", "x"): "pending", ("1", "t", "y"): "pending", ("2", None, None): "pending", (None, "t", "q"): "confirmed", (None, "u", "q"): "confirmed"}
    review = spark.createDataFrame([(rows["1", "s", "x"].group_id, rows["1", "s", "x"].match_id, "flagged"), (rows["1", "t", "y"].group_id, rows["1", "t", "y"].match_id, "removed")], "group_id string, match_id string, status string")
    board = matching.board_rows(shop, offers, review)
    count = lambda c: board.where(c).count()
    assert {n: count(c) for n, c in matching.board_filters().items()} == {"all": 5, "has_matches": 2, "no_matches": 1, "supplier_only": 2, "confirmed": 3, "pending": 2, "near": 4}
    assert [count(matching.board_search(q)) for q in (" RING ", "t", "u", "", "none")] == [2, 3, 1, 5, 0]
    shown = {(r.store_id, r.sku): r.c for r in board.withColumn("c", matching.display_class()).collect()}
    assert shown["1", "x"] == "match-low" and shown["2", None] == "match-none" and shown["1", "a"] == "match-full"
    assert [(r.sort_name, r.supplier_price) for r in matching.sorted_groups(board).collect()] == [("lone pair", 4.0), ("odd", float("inf")), ("red ring", 1.0)]


def test_templates_of_any_supplier(spark, tmp_path):
    path = _write(spark, tmp_path, "import_template", [(1, ["a"], "\u00a0Торг\t"), (2, ["a", "b"], "X ")], "template_id long, headers array<string>, supplier string")
    assert {tuple(r) for r in q.template_keys(spark, path).collect()} == {(1, 1, "торг"), (2, 2, "x")}


def test_pairs_of_classes_are_made_once_and_never_stored(spark, monkeypatch):
    """The pairs of classes grow faster than the sets; stored or shuffled they took more disk than a job has."""
    names = []
    monkeypatch.setattr(matching, "HOT_PAIRS", 0)
    monkeypatch.setattr(matching, "stored", lambda df, name, f=matching.stored: (names.append(name), f(df, name))[1])
    tokens = matching.default_tokens("name", "sku")
    shop = matching.token_sets(spark.createDataFrame([(str(i), f"w{i % 5} w{i % 7} w{i % 3}", f"s{i}") for i in range(40)], "store_id string, name string, sku string"), tokens)
    offers = matching.token_sets(spark.createDataFrame([("x", f"w{i % 5} w{i % 4} v{i % 6}", f"s{i + 30}", float(i)) for i in range(40)], "supplier string, name string, sku string, price double"), tokens)
    r = matching.reach(shop, offers, 0.15)
    near = [(p.a_class, p.b_class) for p in r.near().collect()]
    assert len(near) == len(set(near)) > 100
    assert "Exchange hashpartitioning(a_class" not in r.near()._jdf.queryExecution().toString()
    sides = [[(x[0], x.tokens, x.sku) for x in df.collect()] for df in (shop.select("store_id", "tokens", "sku"), offers.select("price", "tokens", "sku"))]
    top = {}
    for a, s, k in sides[0]:
        scored = sorted((-(1.0 if k == m else _similarity(s, t)), b) for b, t, m in sides[1])
        top[a] = [(b, -x) for x, b in scored if -x >= 0.15][:8]
    got = {}
    for x in sorted(matching.top_matches(shop, offers, r=r).collect(), key=lambda x: x["rank"]):
        got.setdefault(x.store_id, []).append((x.price, x.similarity))
    assert got == {a: t for a, t in top.items() if t}
    matching.unmatched_groups(shop, offers).collect()
    assert "near" not in names
