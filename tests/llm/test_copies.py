import random

from pyspark.sql import functions as F

from pricemill.llm.copies import bare, copies, copy_counts, order_free


def brute(rows):
    norm = lambda s: "".join(c for c in s.lower() if c.isalnum())
    groups = {}
    for i, sku, name in rows:
        if sku is not None and i is not None:
            groups.setdefault(tuple(sorted((norm(sku), "\0" if name is None else norm(name)))), []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}, {min(g): len(g) for g in groups.values()}


def run(spark, rows, partitions):
    df = spark.createDataFrame([(*r, 1) for r in rows], "product_id long, sku string, name string, key long").where("sku IS NOT NULL")
    args = (df, order_free(bare("sku"), bare("name")), F.col("product_id"), partitions)
    return {tuple(r) for r in copies(*args).collect()}, {r.first_id: r.n_rows for r in copy_counts(*args).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    forms = [str.upper, str.lower, lambda s: s.replace(" ", "  "), lambda s: s.replace(" ", "-") + "!"]
    rows = []
    for i in range(600):
        sku, name = ("HOT-1", "hot item") if i % 3 == 0 else (f"S {rnd.randint(0, 60)}", rnd.choice(["Назва їх", "name b", "", None]))
        sku, name = rnd.choice(forms)(sku), None if name is None else rnd.choice(forms)(name)
        rows.append((i, None if i % 50 == 7 else sku, name) if name is None or rnd.random() < 0.7 else (i, name, sku))
    for partitions in (1, 3, 16):  # the hot key crosses partitions
        assert run(spark, rows, partitions) == brute(rows)


def test_edges(spark):
    assert run(spark, [], 3) == (set(), {})
    assert run(spark, [(1, "---", "!!!"), (2, "", "?"), (3, "x" * 100000, None), (4, "X" * 100000, None)], 2) == ({(1, 2), (3, 4)}, {1: 2, 3: 2})
