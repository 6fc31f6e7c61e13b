"""Merging of overlapping intervals into continuous periods, and the gaps between them.

The rows are range-sorted by (entity, start) over all partitions, so an entity that holds a third of the rows is
spread over a third of the partitions. Each partition is summarised by the state it would hand on (the last entity, its
latest end and the start of its open period); the summaries, one row for each partition, are prefix-combined; a
second pass over the same sorted partitions starts from the carried state and labels every period and gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiloom.session import checkpointed, shuffle_partitions

STATE = "pid INT, first STRING, last STRING, open_start BIGINT, max_end BIGINT"


def whole_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; NULL for NULL, NaN and the infinities."""
    real = F.when(~F.isnan(seconds) & (F.abs(seconds) < F.lit(9e12)), seconds)
    return F.floor(real * 1000 + F.lit(0.5)).cast("bigint")


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Start and end of the rows, the offset of each entity's first row, and the entities' keys."""
    start = batch.column("s").to_numpy(zero_copy_only=False)
    end = batch.column("e").to_numpy(zero_copy_only=False)
    key = batch.column("k")
    new = np.ones(len(key), dtype=bool)
    if len(key) > 1:
        new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    return start, end, at, key.take(pa.array(at)).to_pylist()


class _Sweep:
    """Walks sorted batches of one partition, holding the open period of the current entity."""

    def __init__(self, key: str | None = None, open_start: int = 0, max_end: int = 0) -> None:
        self.key, self.open_start, self.max_end = key, open_start, max_end
        self.first: str | None = None

    def feed(self, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Entity index of each period that begins in the batch, its start, the end reached before it (its left
        neighbour's end, or the least integer for an entity's first period), as arrays over the batch."""
        start, end, at, keys = _runs(batch)
        if self.first is None:
            self.first = keys[0]
        lengths = np.diff(np.append(at, len(start)))
        group = np.repeat(np.arange(len(at)), lengths)
        least = np.iinfo(np.int64).min
        # A running maximum within each entity: ranks of the ends are shifted by entity, so that one accumulate does all.
        order = np.unique(end, return_inverse=True)
        rank = order[1].astype(np.int64) + group * (len(order[0]) + 1)
        reached = order[0][np.maximum.accumulate(rank) - group * (len(order[0]) + 1)]
        carried = keys[0] == self.key
        if carried:
            reached[: lengths[0]] = np.maximum(reached[: lengths[0]], self.max_end)
        before = np.empty_like(reached)
        before[1:] = reached[:-1]
        before[at] = least
        if carried:
            before[0] = self.max_end
        begins = (start > before) | (before == least)
        where = np.flatnonzero(begins)
        last_group = where[group[where] == len(at) - 1]
        if len(last_group):
            self.open_start = int(start[last_group[-1]])
        self.key, self.max_end = keys[-1], int(reached[-1])
        return keys, group, begins, before, reached, start


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep()
    for batch in batches:
        if batch.num_rows:
            sweep.feed(batch)
    if sweep.first is not None:
        yield pa.RecordBatch.from_pydict(
            {
                "pid": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "first": [sweep.first],
                "last": [sweep.key],
                "open_start": pa.array([sweep.open_start], pa.int64()),
                "max_end": pa.array([sweep.max_end], pa.int64()),
            }
        )


def prefix_combine(rows: list[tuple]) -> dict[int, tuple[str, int, int]]:
    """For each partition the state carried into it, from one (pid, first, last, open_start, max_end) each.

    The combination is associative: a summary whose entity began inside its partition replaces the carried state; one
    that holds a single entity is merged with the carried state of that entity, and keeps the carried period open where
    its own last period begins at or before the carried end.
    """
    carried, state = {}, None
    for pid, first, last, open_start, max_end in sorted(rows):
        if state is not None:
            carried[pid] = state
        if state is not None and first == last == state[0]:
            state = (last, state[1] if open_start <= state[2] else open_start, max(max_end, state[2]))
        else:
            state = (last, open_start, max_end)
    return carried


def _rescan(carried: dict[int, tuple[str, int, int]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(*carried.get(TaskContext.get().partitionId(), ()))
        for batch in batches:
            if not batch.num_rows:
                continue
            key, opened = sweep.key, sweep.open_start
            keys, group, begins, before, reached, start = sweep.feed(batch)
            heads = np.flatnonzero(begins)
            # Pieces of periods: from each beginning (or the carried period's first row here) to the last row before the next.
            cut = heads if len(heads) and heads[0] == 0 else np.append(0, heads).astype(np.int64)
            piece_start = start[cut].copy()
            if not begins[0]:
                assert keys[0] == key
                piece_start[0] = opened
            tail = np.append(cut[1:], len(start)) - 1
            inner = heads[before[heads] != np.iinfo(np.int64).min]
            names = pa.array(keys)
            for kind, which, s, e in (("period", cut, piece_start, reached[tail]), ("gap", inner, before[inner], start[inner])):
                if len(which):
                    yield pa.RecordBatch.from_pydict({"k": names.take(pa.array(group[which])), "kind": pa.array([kind] * len(which)), "s": pa.array(s), "e": pa.array(e)})

    return scan


def merged_intervals(df: DataFrame, key: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Continuous periods of each ``key`` and the gaps between them: (key, kind, start, end).

    ``start`` and ``end`` are integers of one unit (see :func:`whole_ms`), ``key`` is a string; ``kind`` is 'period' or
    'gap'. Intervals that overlap, nest or touch are one period; a gap is the time between two successive periods.
    A row whose key, start or end is NULL, or which does not end after it starts, is no interval. Repeated rows and
    ties change nothing. An empty table gives no row. Other columns of ``df``, whatever their names, are not read.

    The driver receives one summary row for each partition, whose count is set here, never rows of data.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where(F.col("k").isNotNull() & (F.col("e") > F.col("s")))
    longest = rows.groupBy("k", "s").agg(F.max("e").alias("e"))  # of intervals with one start the longest covers the rest; copies collapse before the sort
    ordered = checkpointed(longest.repartitionByRange(n, "k", "s", "e").sortWithinPartitions("k", "s", "e"))
    summaries = ordered.mapInArrow(_summaries, STATE).collect()
    pieces = ordered.mapInArrow(_rescan(prefix_combine([tuple(r) for r in summaries])), "k STRING, kind STRING, s BIGINT, e BIGINT")
    out = pieces.groupBy("k", "kind", "s").agg(F.max("e").alias("e"))
    return out.select(F.col("k").alias(key), "kind", F.col("s").alias(start), F.col("e").alias(end))
