"""Top N rows of every group by a sorted-run loser-tree merge."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows sorted at once when a run is formed; it bounds a Python worker's memory, not the result.
RUN_ROWS = 1 << 18
#: Rows that a merge holds at a time, about: whole groups, or the part of a large group that came since its last merge.
BLOCK_ROWS = 1 << 16

_KEYS = [("g", "ascending"), ("s1", "ascending"), ("s2", "ascending"), ("id", "ascending")]


class LoserTree:
    """Tournament tree over the heads of k sorted runs; an inner node holds the loser of its match."""

    def __init__(self, heads: list[tuple]):
        self.heads, self.k = heads, len(heads)
        self.tree = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if heads[b] < heads[a]:
                a, b = b, a
            winners[node], self.tree[node] = a, b
        self.winner = winners[1] if self.k > 1 else 0

    def replace(self, head: tuple) -> int:
        """Give the winning run its next head and return the run that wins now."""
        heads, tree, run = self.heads, self.tree, self.winner
        heads[run] = head
        node = (run + self.k) >> 1
        while node:
            if heads[tree[node]] < heads[run]:
                tree[node], run = run, tree[node]
            node >>= 1
        self.winner = run
        return run


def merge_runs(runs: list[tuple[list, list, list, list]], n: int) -> Iterator[tuple[int, int, int]]:
    """Multiway merge of runs of (group codes, s1, s2, ids), each sorted by all four.

    Yields (group code, rank, id) of the first n of each group; once a group has n, every run that
    shows more of it seeks to its next group by binary search.
    """
    end = (float("inf"),)
    at = [0] * len(runs)
    tree = LoserTree([(g[0], a[0], b[0], i[0]) for g, a, b, i in runs])
    group, rank, run = None, 0, tree.winner
    while True:
        head = tree.heads[run]
        if head is end:
            return
        codes, first, second, ids = runs[run]
        if head[0] != group:
            group, rank = head[0], 0
        if rank == n:
            at[run] = bisect_right(codes, group, at[run])
        else:
            rank += 1
            yield group, rank, head[3]
            at[run] += 1
        p = at[run]
        run = tree.replace((codes[p], first[p], second[p], ids[p]) if p < len(codes) else end)


def _first_of_runs(table: pa.Table, n: int) -> pa.Table:
    """Sort table and keep the first n rows of each group."""
    table = table.take(pc.sort_indices(table, sort_keys=_KEYS))
    g = table["g"].combine_chunks()
    if len(g) <= n:
        return table
    new = np.ones(len(g), bool)
    new[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
    start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return table.filter(pa.array(np.arange(len(g)) - start < n))


def _form_runs(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, rows
            out = _first_of_runs(pa.Table.from_batches(held), n).combine_chunks()
            out = out.append_column("run", pa.array(np.full(len(out), (part << 32) | seq, np.int64)))
            seq, held, rows = seq + 1, [], 0
            return out.append_column("pos", pa.array(np.arange(len(out), dtype=np.int64))).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= RUN_ROWS:
                yield from flush()
        if held:
            yield from flush()

    return run


def _starts(g: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Where each group begins in a column that holds groups one after the other."""
    g = g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g
    new = np.ones(len(g), bool)
    new[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _merge_bucket(n: int):
    def merged(t: pa.Table) -> pa.RecordBatch:
        """The first n of each of the table's groups, whose runs lie side by side in each group."""
        starts = _starts(t["g"])
        codes = np.zeros(t.num_rows, np.int64)
        codes[starts[1:]] = 1
        codes = np.cumsum(codes)
        order = np.argsort(t["run"].to_numpy(), kind="stable")  # each run by group and place
        cols = [codes[order], *(t[c].to_numpy()[order] for c in ("s1", "s2", "id"))]
        cuts = [0, *(np.flatnonzero(np.diff(t["run"].to_numpy()[order])) + 1), t.num_rows]
        runs = [tuple(c[x:y].tolist() for c in cols) for x, y in zip(cuts, cuts[1:])]
        out = np.array(list(merge_runs(runs, n)), np.int64).reshape(-1, 3)
        names = t["g"].combine_chunks().take(pa.array(starts[out[:, 0]]))
        return pa.RecordBatch.from_arrays([names, pa.array(out[:, 1]), pa.array(out[:, 2])], names=["g", "rnk", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows < BLOCK_ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(_starts(t["g"])[-1])  # the last group may go on
            if cut:
                yield merged(t.slice(0, cut))
            rest = t.slice(cut)
            if rest.num_rows >= BLOCK_ROWS:  # a group with very many runs: its first n so far are one run
                rest = _first_of_runs(rest, n)
                rest = rest.set_column(rest.schema.get_field_index("run"), "run", pa.array(np.full(len(rest), -1, np.int64)))
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        if held:
            yield merged(pa.Table.from_batches(held).combine_chunks())

    return run


def top_n_per_group(df: DataFrame, n: int, group: Column, score: Column, second: Column, row_id: Column) -> DataFrame:
    """(g STRING, rnk BIGINT, id BIGINT): the n rows of each group with the least (score, second, row_id).

    1. Each input task sorts up to RUN_ROWS rows at a time into a run and seeks past the group's rows after
       its n-th, so a run carries at most n rows of a group: a hot group shrinks before any shuffle and no
       task ever sees it whole.
    2. The runs are stored in buckets of groups (one hash shuffle, an external sort): by group, each run's part
       of it in its own order.
    3. A task streams its bucket and merges the runs of a block of groups with a loser tree, seeking to the next
       group after n outputs. It holds BLOCK_ROWS rows at a time, however large the bucket is and however many
       runs a group has.

    Rows whose group, score or row_id is null, and scores that are NaN, don't take part; a null `second`
    comes last. `second` must be BIGINT in ascending sense. Ties end at row_id; rows with an equal row_id
    are all kept as separate rows. An empty input gives an empty result; other columns are not read.
    """
    rows = df.select(
        group.cast("string").alias("g"),
        score.cast("double").alias("s1"),
        F.coalesce(second.cast("long"), F.lit(2**63 - 1)).alias("s2"),
        row_id.cast("long").alias("id"),
    ).where("g IS NOT NULL AND s1 IS NOT NULL AND NOT isnan(s1) AND id IS NOT NULL")
    runs = rows.mapInArrow(_form_runs(n), T.StructType([*rows.schema.fields, T.StructField("run", T.LongType()), T.StructField("pos", T.LongType())]))
    buckets = runs.repartition("g").sortWithinPartitions("g", "run", "pos")
    return buckets.mapInArrow(_merge_bucket(n), "g string, rnk long, id long")
