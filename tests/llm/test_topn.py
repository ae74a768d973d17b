import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricemill.llm import topn
from pricemill.llm.topn import LoserTree, merge_runs, top_n_per_group

COLUMNS = "sku string, price double, updated_at timestamp, offer_id long, g string"


def best(rows, n):
    out = {}
    key = lambda r: (r[1], -(r[2].timestamp() if r[2] else float("-inf")), r[3])
    for r in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[1] == r[1] and r[3] is not None), key=key):
        out.setdefault(r[0], []).append(r[3])
    return {(g, k): i for g, ids in out.items() for k, i in enumerate(ids[:n], 1)}


def run(spark, rows, n=3):
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS)
    out = top_n_per_group(df, n, F.col("sku"), F.col("price"), -F.unix_micros("updated_at"), F.col("offer_id"))
    return {(r.g, r.rnk): r.id for r in out.collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topn, "RUN_ROWS", 50)
    monkeypatch.setattr(topn, "BLOCK_ROWS", 20)
    rnd = random.Random(3)
    rows = [("hot" if i % 3 == 0 else rnd.choice(["a", "b", "", None, f"g{rnd.randint(0, 40)}"]), rnd.choice([1.0, 2.0, 2.5, None, float("nan")]), rnd.choice([None, datetime(2024, 1, rnd.randint(1, 9))]), i) for i in range(900)]
    assert run(spark, rows) == best(rows, 3)
    assert run(spark, rows, 1) == best(rows, 1)


def test_ties_repeats_and_empty(spark):
    rows = [("a", 1.0, None, 5), ("a", 1.0, None, 5), ("a", 1.0, datetime(2024, 1, 1), 9), ("a", 1.0, None, 2)]
    assert run(spark, rows) == {("a", 1): 9, ("a", 2): 2, ("a", 3): 5}
    assert run(spark, []) == {}
    long = "x" * 200000
    assert run(spark, [(long, 1.0, None, 1)]) == {(long, 1): 1}


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted((rnd.randint(0, 5), rnd.random(), 0, i * 100 + j) for j in range(rnd.randint(1, 20))) for i in range(k)]
    got = list(merge_runs([tuple(list(c) for c in zip(*r)) for r in runs], 4))
    want = {}
    for x in sorted(x for r in runs for x in r):
        want.setdefault(x[0], []).append(x[3])
    assert got == [(g, n, i) for g, ids in sorted(want.items()) for n, i in enumerate(ids[:4], 1)]
    tree = LoserTree([(3,), (1,), (2,)])
    assert [tree.winner, tree.replace((9,)), tree.replace((9,))] == [1, 2, 0]


def test_buckets_larger_than_a_block(monkeypatch):
    """A bucket of 400 times BLOCK_ROWS streams through: no more than two blocks' and a batch's rows are held at once."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(topn, "BLOCK_ROWS", 500)
    rnd = np.random.default_rng(5)
    n = 200_000
    g = np.where(rnd.random(n) < 0.4, 7000, rnd.integers(0, 9000, n))  # one group of two fifths of the rows
    run = rnd.integers(0, 300, n)
    order = np.lexsort((rnd.random(n), run, g))
    s1 = rnd.integers(0, 50, n).astype(float)
    g, run, s1 = g[order], run[order], s1[order]
    ids = np.arange(n)
    inner = np.lexsort((ids, s1, run, g))  # each run's rows of a group by score
    g, run, s1, ids = g[inner], run[inner], s1[inner], ids[inner]
    names = np.char.add("g", np.char.zfill(g.astype(str), 5))
    largest = 0

    def batches():
        for a in range(0, n, 250):
            x = slice(a, a + 250)
            yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(s1[x]), pa.array(np.zeros(len(ids[x]), np.int64)), pa.array(ids[x]), pa.array(run[x]), pa.array(ids[x])], names=["g", "s1", "s2", "id", "run", "pos"])

    real = pa.Table.from_batches

    class Counting:
        def __getattr__(self, name):
            return getattr(pa.Table, name)

        @staticmethod
        def from_batches(held):
            nonlocal largest
            t = real(held)
            largest = max(largest, t.num_rows)
            return t

    class Module:
        Table = Counting()

        def __getattr__(self, name):
            return getattr(pa, name)

    monkeypatch.setattr(topn, "pa", Module())
    got = [tuple(r.values()) for b in topn._merge_bucket(3)(batches()) for r in b.to_pylist()]
    want = {}
    for k, s, i in sorted(zip(names.tolist(), s1.tolist(), ids.tolist())):
        want.setdefault(k, []).append(i)
    assert got == [(k, r, i) for k in sorted(want) for r, i in enumerate(want[k][:3], 1)]
    assert largest <= 1250
