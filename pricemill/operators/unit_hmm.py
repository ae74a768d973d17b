"""Units of measured values by a hidden Markov model: a unit for each row of a device, decoded by Viterbi."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ranking import places


def viterbi(y: np.ndarray, shifts: np.ndarray, prior: np.ndarray, level: np.ndarray, stated: np.ndarray, stay: float, jump: float, spread: float) -> np.ndarray:
    """The likeliest state of each row.

    y: log values; shifts[k]: what state k adds to bring a value to the common unit; level: the expected log
    value in the common unit (NaN: unknown); stated: a known state or -1. A step costs the jump of the common
    value (divided by `jump`) and log((1 - stay) / others) for a switch; a row its distance from its level
    (divided by `spread`). Values that are NaN move nothing.
    """
    n, k = len(y), len(shifts)
    common = y[:, None] + shifts[None, :]
    emit = np.log(prior)[None, :] - np.nan_to_num(np.abs(common - level[:, None]) / spread, nan=0.0)
    known = np.flatnonzero(stated >= 0)
    emit[known] = -1e9
    emit[known, stated[known]] = 0.0
    switch = np.where(np.eye(k, dtype=bool), np.log(stay), np.log((1 - stay) / max(1, k - 1)))
    score, back = emit[0], np.zeros((n, k), np.int32)
    for t in range(1, n):
        step = score[:, None] + switch - np.nan_to_num(np.abs(common[t][None, :] - common[t - 1][:, None]) / jump, nan=0.0)
        back[t] = step.argmax(0)
        score = step[back[t], np.arange(k)] + emit[t]
    path = np.empty(n, np.int32)
    path[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


#: Rows of a device that are decoded as one sequence.
BLOCK_ROWS = 4096


class Fitted(NamedTuple):
    """What labelled rows tell of the model: probabilities and scales, and (device, prior ARRAY<DOUBLE>)."""

    stay: float
    jump: float
    spread: float
    common: list[float]
    priors: DataFrame


def fit(rows: DataFrame, shifts: np.ndarray) -> Fitted:
    """Estimates from the rows with a stated unit: rows hold device, block, order, row id, y, level, stated.

    stay: how often two neighbouring labelled rows share their unit; jump and spread: mean distance of a common
    value from its neighbour's and from its level; priors: each device's shares of the units, smoothed by ten
    rows at the shares of all devices. Sums and counts only; three numbers and a share for each unit come to the driver.
    """
    k = len(shifts)
    shift = F.array(*(F.lit(float(x)) for x in shifts))
    told = rows.where("stated >= 0").withColumn("common", F.col("y") + shift[F.col("stated")])
    w = Window.partitionBy("device", "block").orderBy("order", "id")
    near = told.select("stated", "common", "level", F.lag("stated").over(w).alias("s0"), F.lag("common").over(w).alias("c0"))
    means = near.agg(F.avg((F.col("stated") == F.col("s0")).cast("double")), F.avg(F.abs(F.col("common") - F.col("c0"))), F.avg(F.abs(F.col("common") - F.col("level")))).first()
    stay, jump, spread = means if means[0] is not None else (0.9, 2.0, 0.3)
    counts = told.groupBy("device", "stated").agg(F.count("*").alias("n"))
    total = {r.stated: r.n for r in counts.groupBy("stated").agg(F.sum("n").alias("n")).collect()}  # a row for each unit
    share = np.array([total.get(i, 0) + 0.5 for i in range(k)], float)
    share /= share.sum()
    by_unit = F.map_from_entries(F.collect_list(F.struct("stated", "n")))
    prior = F.transform(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(share))), lambda x: (F.coalesce(F.try_element_at("m", x["i"]), F.lit(0)) + 10 * x["p"]) / (F.col("t") + 10))
    priors = counts.groupBy("device").agg(by_unit.alias("m"), F.sum("n").alias("t")).select("device", prior.alias("prior"))
    bounded = lambda x, lo, hi: min(max(float(x if x is not None else lo), lo), hi)
    return Fitted(bounded(stay, 0.01, 0.999), bounded(jump, 0.05, 10.0), bounded(spread, 0.05, 10.0), share.tolist(), priors)


def decode_units(df: DataFrame, row_id: str, device: Column, order: Column, value: Column, units: dict[str, float], level: Column | None = None, stated: Column | None = None, fixed: tuple[float, float, float] | None = None, held_out: int = 0) -> DataFrame:
    """(row_id, decoded STRING): the unit of each row with a value above zero.

    units: unit -> how much of the common unit it is. `stated` fixes a row's unit where it is one of `units`; from
    those rows the model is fitted (fit()), unless `fixed` gives (stay, jump, spread). A device's rows are decoded
    in blocks of BLOCK_ROWS in their order, found without gathering the device, so that no device, however large, is
    held by one task. held_out n: of the stated rows one in n, by a hash of row_id, is neither fitted on nor fixed, which measures the
    model. Ties go to the unit named first; an empty table gives an empty result.
    """
    names = list(units)
    shifts = np.log(np.array([units[u] for u in names]))
    index = F.create_map(*(F.lit(x) for i, u in enumerate(names) for x in (u, i)))
    known = F.coalesce(index[stated] if stated is not None else F.lit(None), F.lit(-1)).cast("int")
    if held_out:
        known = F.when(F.pmod(F.xxhash64(row_id), F.lit(held_out)) == 0, -1).otherwise(known)
    rows = df.where(value > 0).select(F.col(row_id).alias("id"), F.coalesce(device.cast("string"), F.lit("")).alias("device"), order.alias("order"), F.log(value).alias("y"), (level if level is not None else F.lit(None)).cast("double").alias("level"), known.alias("stated"))
    rows = stored(places(rows, "device", [F.col("order"), F.col("id")]).withColumn("block", F.floor((F.col("place") - 1) / BLOCK_ROWS)).drop("place"), "sequences")
    if fixed is None:
        model = fit(rows, shifts)
        stay, jump, spread, common = model[:4]
        rows = rows.join(model.priors, "device", "left")
    else:
        (stay, jump, spread), common = fixed, [1 / len(names)] * len(names)
        rows = rows.withColumn("prior", F.lit(None).cast("array<double>"))
    kind = df.schema[row_id].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "id"])
        prior = pdf["prior"].iloc[0]
        path = viterbi(pdf["y"].to_numpy(float), shifts, np.array(common if prior is None else prior), pdf["level"].to_numpy(float), pdf["stated"].to_numpy(int), stay, jump, spread)
        return pd.DataFrame({row_id: pdf["id"].to_numpy(), "decoded": [names[i] for i in path]})

    return rows.groupBy("device", "block").applyInPandas(run, f"{row_id} {kind}, decoded string")
