"""Copies hidden by formatting: range partition, external sort, scan of adjacent runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

_COPY, _EDGE = 0, 1


def bare(c: Column | str) -> Column:
    """Lower case, letters and digits only; null becomes a character that no bare text has."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit("\u0000"))


def order_free(*parts: Column) -> Column:
    """One key of several fields that doesn't depend on which field holds which."""
    return F.array_join(F.array_sort(F.array(*parts)), "\u0001")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a sorted partition, then its edges: the first and the last run, which may go on elsewhere."""
    last = first = None
    runs = 0
    head: tuple | None = None

    def digest(key: str) -> bytes:
        return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def rows(kind: int, keys, firsts, copies) -> pa.RecordBatch:
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(copies, pa.int64())], names=["kind", "key", "first_id", "copy_id"])

    for b in batches:
        if not b.num_rows:
            continue
        key, ids = b.column(0), b.column(1).to_numpy()
        new = np.ones(len(ids), bool)
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or key[0].as_py() != last
        starts = np.where(new, np.arange(len(ids)), -1)
        at = np.maximum.accumulate(starts)
        firsts = np.where(at >= 0, ids[np.maximum(at, 0)], first if first is not None else 0)
        if head is None:
            head = (key[0].as_py(), int(ids[0]))
        copies = np.flatnonzero(~new)
        if len(copies):
            yield rows(_COPY, [digest(k) for k in key.take(pa.array(copies)).to_pylist()], firsts[copies], ids[copies])
        runs += int(new.sum())
        last, first = key[-1].as_py(), int(firsts[-1])
    if head is not None:
        edges = [head] if runs == 1 else [head, (last, first)]
        yield rows(_EDGE, [digest(k) for k, _ in edges], [i for _, i in edges], [i for _, i in edges])


def _runs(df: DataFrame, key: Column, row_id: Column, partitions: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, edges, first rows of the keys that span partitions) of the sorted rows."""
    rows = df.select(key.alias("key"), row_id.cast("long").alias("id")).where("key IS NOT NULL AND id IS NOT NULL")
    by = (F.col("key"), F.col("id"))
    rows = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    found = stored(rows.sortWithinPartitions("key", "id").mapInArrow(_scan, "kind int, key binary, first_id long, copy_id long"), "runs")
    edges = found.where(F.col("kind") == _EDGE)
    spans = edges.groupBy("key").agg(F.min("first_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    return found.where(F.col("kind") == _COPY), edges, spans


def copies(df: DataFrame, key: Column, row_id: Column, partitions: int | None = None) -> DataFrame:
    """(first_id BIGINT, copy_id BIGINT), first < copy: each row with the least id of the rows of its key.

    Rows are range-partitioned by (key, id), so a key with a third of all rows spreads over many partitions;
    each partition is sorted (with spill) and adjacent full keys are compared. A key that crosses partitions
    is the first or last run of each of them; those edges, two a partition at most, are joined back by
    broadcast to give all its rows one first id. Rows with a null key or id take no part; rows that share an
    id count as one each. An empty table gives an empty result; other columns are not read.
    """
    found, edges, spans = _runs(df, key, row_id, partitions)
    spans = F.broadcast(spans)  # at most two rows a partition
    inner = found.join(spans, "key", "left").select(F.coalesce("least", "first_id").alias("first_id"), "copy_id")
    cut = edges.join(spans, "key").where("first_id > least").select(F.col("least").alias("first_id"), F.col("copy_id"))
    return inner.unionAll(cut)


def copy_counts(df: DataFrame, key: Column, row_id: Column, partitions: int | None = None) -> DataFrame:
    """(first_id, n_rows BIGINT): one representative for each key and the exact number of its rows.

    As copies(); keys with one row have n_rows 1.
    """
    repeated = copies(df, key, row_id, partitions)
    ids = df.where(key.isNotNull() & row_id.isNotNull()).select(row_id.cast("long").alias("id"))
    # rows that aren't copies stand for their key; hot keys shrink in the map-side part of the aggregate
    n = ids.select(F.col("id").alias("first_id"), F.lit(1).alias("n")).unionAll(repeated.select("first_id", F.lit(1))).unionAll(repeated.select("copy_id", F.lit(-1)))
    return n.groupBy("first_id").agg(F.sum("n").cast("long").alias("n_rows")).where("n_rows > 0")
