import numpy as np
from pyspark.sql import functions as F

from pricemill.operators.unit_hmm import decode_units, viterbi

UNITS = {"m": 1.0, "cm": 0.01, "km": 1000.0}
COLUMNS = "id long, device string, t long, v double, said string, level double"


def test_switches_are_found_from_jumps():
    rnd = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 2], 25)
    shifts = np.log(np.array(list(UNITS.values())))
    y = np.log(50) + np.cumsum(rnd.normal(0, 0.02, 100)) - shifts[truth]
    stated = np.full(100, -1)
    stated[0] = 0
    path = viterbi(y, shifts, np.full(3, 1 / 3), np.full(100, np.nan), stated, 0.95, 0.3, 0.3)
    assert (path == truth).all()


def test_table(spark):
    rows = [(i, "a", i, 50.0 if i < 10 else 5000.0, "m" if i == 0 else None, None) for i in range(20)] + [(99, None, 1, None, None, None), (100, None, 1, -1.0, None, None), (101, "b", None, 3.0, "km", None)]
    df = spark.createDataFrame(rows, COLUMNS)
    args = ("id", F.col("device"), F.col("t"), F.col("v"), UNITS)
    got = {r.id: r.decoded for r in decode_units(df, *args, F.lit(None), F.col("said"), (0.9, 0.3, 0.3)).collect()}
    assert got == {**{i: "m" for i in range(10)}, **{i: "cm" for i in range(10, 20)}, 101: "km"}
    assert decode_units(df.limit(0), *args).count() == 0


def test_fitted_on_labelled_rows_across_blocks(spark, monkeypatch):
    """Two devices with units of their own, one of them hot: held-out rows take their device's unit for their level."""
    from pricemill.operators import unit_hmm

    monkeypatch.setattr(unit_hmm, "BLOCK_ROWS", 64)
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(900):
        device, unit = ("hot", "cm" if i % 7 else "m") if i % 3 else ("b", "km")
        rows.append((i, device, i, float(50 * np.exp(rnd.normal(0, 0.05)) / UNITS[unit]), unit, float(np.log(50))))
    df = spark.createDataFrame(rows, COLUMNS)
    out = decode_units(df, "id", F.col("device"), F.col("t"), F.col("v"), UNITS, F.col("level"), F.col("said"), held_out=4)
    got = {r.id: r.decoded for r in out.collect()}
    assert len(got) == 900 and all(got[r[0]] == r[4] for r in rows)
