"""Percentiles by group from merging centroid digests, with the rank error certified by a second counting pass.

A digest is a list of clusters of neighbouring values, each with its mean, weight, least and greatest value. Clusters are
cut where the scale function k(q) = delta * (asin(2q - 1) / 2pi + 1/4) passes a whole number: narrow at the tails, and
never more than pi / delta of the weight wide. Digests of partitions, days or files are merged by clustering their
clusters again. A percentile is answered by an end of the cluster that holds its rank, so by a value of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiloom.session import checkpointed, shuffle_partitions

#: Clusters or values a task holds before it clusters them; its memory is bounded by this and by twice its digests' clusters.
HELD = 1_000_000
#: Bytes of estimates sent to the executors at once; more are counted in several passes.
SENT_BYTES = 32_000_000
NO_DAY = np.iinfo(np.int32).min
#: By group, day and measure; empty mean, hi (all clusters are single values) and w (all weights are 1) stand for themselves.
DIGEST = "g STRING, day INT, measure INT, lo ARRAY<DOUBLE>, mean ARRAY<DOUBLE>, hi ARRAY<DOUBLE>, w ARRAY<BIGINT>"


def cluster(seg: np.ndarray, lo: np.ndarray, mean: np.ndarray, hi: np.ndarray, w: np.ndarray, delta: float) -> tuple[np.ndarray, ...]:
    """Clusters the weighted clusters of many digests (``seg`` numbers them) again, all at once; sorted by seg and mean."""
    order = np.lexsort((mean, seg))
    seg, lo, mean, hi, w = seg[order], lo[order], mean[order], hi[order], w[order]
    head = np.ones(len(seg), dtype=bool)
    head[1:] = seg[1:] != seg[:-1]
    at = np.flatnonzero(head)
    cum = np.cumsum(w)
    size = np.diff(np.append(at, len(seg)))
    base = np.repeat(cum[at] - w[at], size)
    total = np.repeat(np.add.reduceat(w, at), size) if len(at) else cum
    q = (cum - base - w / 2) / total
    k = np.floor(delta * (np.arcsin(np.clip(2 * q - 1, -1, 1)) / (2 * np.pi) + 0.25)).astype(np.int64)
    cut = head.copy()
    cut[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(cut)
    if not len(at):
        return seg, lo, mean, hi, w
    weight = np.add.reduceat(w, at)
    low, high = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
    with np.errstate(invalid="ignore"):
        centre = np.add.reduceat(mean * w, at) / weight
    return seg[at], low, np.where((low == high) | np.isnan(centre), low, np.clip(centre, low, high)), high, weight


def quantiles(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, qs: np.ndarray) -> np.ndarray:
    """The values at the ranks max(1, ceil(q n)) of one sorted digest."""
    cum = np.cumsum(w)
    rank = np.clip(np.ceil(qs * cum[-1] - 1e-9), 1, cum[-1])
    c = np.searchsorted(cum, rank)
    return np.where(rank - (cum[c] - w[c]) <= w[c] / 2, lo[c], hi[c])


class _Held:
    """Clusters of many digests, clustered again whenever more than HELD, or twice what they need, are held."""

    def __init__(self, delta: float) -> None:
        self.delta, self.ids, self.keys, self.parts, self.n, self.limit = delta, {}, [], [], 0, HELD

    def id(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
        return self.ids[key]

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.n += len(part[0])
        if self.n > self.limit:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...] | None:
        if not self.parts:
            return None
        whole = cluster(*(np.concatenate(x) for x in zip(*self.parts)), self.delta)
        # Many digests may need more than HELD clusters, delta / 2 each at most: then as many again are awaited, so that
        # the work of clustering stays in proportion to the input.
        self.parts, self.n, self.limit = [whole], len(whole[0]), max(HELD, 2 * len(whole[0]))
        return whole

    def digests(self) -> Iterator[tuple[tuple, slice, tuple[np.ndarray, ...]]]:
        whole = self.shrink()
        if whole is None or not len(whole[0]):
            return
        at = np.flatnonzero(np.append(True, whole[0][1:] != whole[0][:-1]))
        for a, z in zip(at, np.append(at[1:], len(whole[0]))):
            yield self.keys[whole[0][a]], slice(a, z), whole

    def batches(self, size: int = 2000) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (g, day, m), s, (_, lo, mean, hi, w) in self.digests():
            single = bool((lo[s] == hi[s]).all())
            rows.append((g, day, m, lo[s], [] if single else mean[s], [] if single else hi[s], [] if (w[s] == 1).all() else w[s]))
            if len(rows) == size:
                yield _table(rows)
                rows = []
        if rows:
            yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    g, day, m, *arrays = zip(*rows)
    kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(day, pa.int32()), pa.array(m, pa.int32())] + [_lists(a, t) for a, t in zip(arrays, kinds)], ["g", "day", "measure", "lo", "mean", "hi", "w"])


def _lists(arrays: tuple, kind: pa.DataType) -> pa.Array:
    flat = np.concatenate([np.asarray(a) for a in arrays]) if arrays else np.empty(0)
    offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _codes(batch: pa.RecordBatch, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group (``known`` numbers them) and its day."""
    g = batch.column("g").dictionary_encode(null_encoding="encode")
    number = np.array([known.setdefault(x, len(known)) for x in g.dictionary.to_pylist()], dtype=np.int64)
    day = batch.column("day").fill_null(NO_DAY).to_numpy(zero_copy_only=False).astype(np.int64)
    return number[g.indices.to_numpy(zero_copy_only=False)], day


def _values(batch: pa.RecordBatch, m: int) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column(f"v{m}").to_numpy(zero_copy_only=False).astype(np.float64)  # NULL comes as NaN
    ok = ~np.isnan(v)
    return v[ok] + 0.0, ok


def _build(measures: int, delta: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = _Held(delta), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            number, day = _codes(batch, known)
            names = list(known)
            pair = number * (1 << 33) + (day - NO_DAY)
            unique, inverse = np.unique(pair, return_inverse=True)
            for m in range(measures):
                v, ok = _values(batch, m)
                ids = np.array([held.id((names[p >> 33], int((p & ((1 << 33) - 1)) + NO_DAY), m)) for p in unique.tolist()])
                held.add(ids[inverse[ok]], v, v, v, np.ones(len(v), dtype=np.int64))
        yield from held.batches()

    return build


def _merge(delta: float, by_day: bool):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(delta)
        for batch in batches:
            if not batch.num_rows:
                continue
            g, days, ms = (batch.column(c).to_pylist() for c in ("g", "day", "measure"))
            ids = np.array([held.id((a, d if by_day else NO_DAY, m)) for a, d, m in zip(g, days, ms)])
            lo, mean, hi, w = (batch.column(c) for c in ("lo", "mean", "hi", "w"))
            n = np.diff(lo.offsets.to_numpy())
            flat = lo.flatten().to_numpy()
            rows = np.repeat(np.arange(len(ids)), n)
            fill = lambda col, blank: _filled(col, n, blank)
            held.add(ids[rows], flat, fill(mean, flat), fill(hi, flat), fill(w, np.ones(len(flat), dtype=np.int64)))
        yield from held.batches()

    return merge


def _filled(col: pa.ListArray, n: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """The flat values of ``col``, with those of ``blank`` for lists left empty."""
    has = np.repeat(np.diff(col.offsets.to_numpy()) > 0, n)
    out = blank.copy()
    out[has] = col.flatten().to_numpy()
    return out


def _answers(qs: np.ndarray):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, est = [], []
            lo, hi, w = (batch.column(c) for c in ("lo", "hi", "w"))
            for i in range(batch.num_rows):
                a = lo[i].values.to_numpy()
                z = hi[i].values.to_numpy() if len(hi[i].values) else a
                c = w[i].values.to_numpy() if len(w[i].values) else np.ones(len(a), dtype=np.int64)
                n.append(int(c.sum()))
                est.append(quantiles(a, z, c, qs))
            if n:
                yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("day"), batch.column("measure"), pa.array(n, pa.int64()), _lists(tuple(est), pa.float64())], ["g", "day", "measure", "n", "est"])

    return answer


def _count(measures: int, nq: int, sent):
    """Counts, for each estimate, the values below and up to it, of its day and of all days."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, daily, total = sent.value  # total: by group and measure; daily: by sorted key of group and day, and measure
        known = {x: i for i, x in enumerate(names)}
        out = np.zeros((4, len(keys), measures, nq), dtype=np.int64)
        seen = np.zeros(len(keys), dtype=bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            number, day = _codes(batch, known)
            key = number * (1 << 33) + (day - NO_DAY)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            mine = keys[at] == key
            seen[at[mine]] = True
            for m in range(measures):
                v, ok = _values(batch, m)
                ok2 = mine[ok]
                v, rows, groups = v[ok2], at[ok][ok2], number[ok][ok2]
                for i, est in enumerate((daily[:, m][rows], total[:, m][groups])):
                    for j in range(nq):
                        out[2 * i, :, m, j] += np.bincount(rows[v < est[:, j]], minlength=len(keys))
                        out[2 * i + 1, :, m, j] += np.bincount(rows[v <= est[:, j]], minlength=len(keys))
        for m in range(measures):
            rows = np.repeat(np.flatnonzero(seen), nq)
            if len(rows):
                j = np.tile(np.arange(nq), len(rows) // nq)
                g = pa.array([names[k] for k in (keys[rows] >> 33).tolist()], pa.string())
                day = pa.array(((keys[rows] & ((1 << 33) - 1)) + NO_DAY).astype(np.int32))
                counts = [pa.array(out[i, rows, m, j]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([g, day, pa.array(np.full(len(rows), m, dtype=np.int32)), pa.array(j.astype(np.int32)), *counts], ["g", "day", "measure", "j", "day_lt", "day_le", "all_lt", "all_le"])

    return count


def _certified(values: DataFrame, daily: DataFrame, total: DataFrame, measures: int, nq: int) -> DataFrame:
    """The four counts of every estimate, from as many passes over the values as the size of the estimates asks for."""
    spark = values.sparkSession
    bytes_ = daily.count() * nq * 8 * 6
    slices = max(1, -(-bytes_ // SENT_BYTES))
    part = F.pmod(F.xxhash64("g", "day"), F.lit(slices))
    counted = []
    for s in range(slices):
        rows = daily.where(part == s).select("g", "day", "measure", "est").toArrow()
        whole = total.join(daily.where(part == s).select(F.col("g").alias("g2")).distinct(), F.col("g").eqNullSafe(F.col("g2")), "left_semi").select("g", "measure", "est").toArrow()
        if not rows.num_rows:
            continue
        known: dict = {}
        batch = rows.combine_chunks().to_batches()[0]
        number, day = _codes(batch, known)
        key = number * (1 << 33) + (day - NO_DAY)
        keys = np.unique(key)
        est = np.full((len(keys), measures, nq), np.nan)
        est[np.searchsorted(keys, key), batch.column("measure").to_numpy()] = batch.column("est").flatten().to_numpy().reshape(-1, nq)
        every = np.full((len(known), measures, nq), np.nan)
        for g, m, e in zip(*(whole.column(c).to_pylist() for c in ("g", "measure", "est"))):
            every[known[g], m] = e
        counted.append(values.mapInArrow(_count(measures, nq, spark.sparkContext.broadcast((list(known), keys, est, every))), "g STRING, day INT, measure INT, j INT, day_lt BIGINT, day_le BIGINT, all_lt BIGINT, all_le BIGINT"))
    out = counted[0]
    for c in counted[1:]:
        out = out.unionAll(c)
    return out


def daily_digests(df: DataFrame, group: str, at: str, measures: dict[str, Column], delta: float = 1000.0) -> DataFrame:
    """One digest for each group, day of ``at`` and measure: (g, day, measure, lo, mean, hi, w), to keep and to combine.

    ``day`` counts days from 1970-01-01 (the least INT where ``at`` is NULL), ``measure`` is the position in ``measures``.
    """
    return _daily(_long(df, group, at, measures), len(measures), delta)


def _long(df: DataFrame, group: str, at: str, measures: dict[str, Column]) -> DataFrame:
    return df.select(F.col(group).cast("string").alias("g"), F.unix_date(F.to_date(F.col(at))).alias("day"), *[c.cast("double").alias(f"v{i}") for i, c in enumerate(measures.values())])


def _daily(values: DataFrame, measures: int, delta: float) -> DataFrame:
    parts = values.mapInArrow(_build(measures, delta), DIGEST)
    return parts.repartition(shuffle_partitions(values.sparkSession), "g", "day", "measure").mapInArrow(_merge(delta, True), DIGEST)


def combined(digests: DataFrame, delta: float = 1000.0) -> DataFrame:
    """The digests of all days of each group and measure, from those of single days (or of any other parts)."""
    # Two levels: the digests of a group are merged by a salt of the day first, so no task merges all days of a hot group.
    n = shuffle_partitions(digests.sparkSession)
    some = digests.repartition(n, "g", "measure", F.pmod(F.col("day"), F.lit(16))).mapInArrow(_merge(delta, False), DIGEST)
    return some.repartition(n, "g", "measure").mapInArrow(_merge(delta, False), DIGEST)


def certified_percentiles(df: DataFrame, group: str, at: str, measures: dict[str, Column], qs: list[float], bound: float = 0.005, delta: float = 1000.0) -> DataFrame:
    """Percentiles of every measure by group, for each day of ``at`` and for all days, with a certified rank error.

    Returns (level, measure, group, day, q, n, estimate, rank_error, bound): level is 'day' or 'all' (day is then NULL); n
    is the number of values; the estimate is a value of the data; rank_error is the distance of its ranks from
    max(1, ceil(q n)), as a share of n, counted exactly in a second pass over the data. It is at most ``bound``: as long
    as a count shows more, delta is doubled and the digests are built again.

    NULL and NaN aren't values; all others, glitches and repeated rows too, count each. A NULL group is a group of its
    own, and so is a NULL day. Groups without a value, and empty tables, give no row. Only the named columns are read.
    The digests of days merge into those of all days without the values (:func:`daily_digests`, :func:`combined`).
    """
    m, nq, names = len(measures), len(qs), list(measures)
    values = _long(df, group, at, measures)
    answer = _answers(np.asarray(qs, dtype=np.float64))
    schema = "g STRING, day INT, measure INT, n BIGINT, est ARRAY<DOUBLE>"
    while True:
        digests = checkpointed(_daily(values, m, delta))
        daily = checkpointed(digests.mapInArrow(answer, schema))
        total = checkpointed(combined(digests, delta).mapInArrow(answer, schema))
        if daily.isEmpty():
            counts = daily.sparkSession.createDataFrame([], "g STRING, day INT, measure INT, j INT, day_lt BIGINT, day_le BIGINT, all_lt BIGINT, all_le BIGINT")
        else:
            counts = _certified(values, daily, total, m, nq)
        by_day = counts.groupBy("g", "day", "measure", "j").agg(*[F.sum(c).alias(c) for c in ("day_lt", "day_le", "all_lt", "all_le")])
        by_day = checkpointed(by_day)
        by_all = by_day.groupBy("g", "measure", "j").agg(F.sum("all_lt").alias("lt"), F.sum("all_le").alias("le")).withColumn("day", F.lit(int(NO_DAY)))
        each = []
        for level, est, cnt in (("day", daily, by_day.select("g", "day", "measure", "j", F.col("day_lt").alias("lt"), F.col("day_le").alias("le"))), ("all", total, by_all.select("g", "day", "measure", "j", "lt", "le"))):
            long = est.select("g", "day", "measure", "n", F.posexplode("est").alias("j", "estimate"))
            r = cnt.select(F.col("g").alias("g2"), F.col("day").alias("d2"), F.col("measure").alias("m2"), F.col("j").alias("j2"), "lt", "le")
            both = long.join(r, F.col("g").eqNullSafe(F.col("g2")) & (F.col("day") == F.col("d2")) & (F.col("measure") == F.col("m2")) & (F.col("j") == F.col("j2")))
            each.append(both.withColumn("level", F.lit(level)))
        out = each[0].unionByName(each[1])
        q = F.element_at(F.array(*[F.lit(float(x)) for x in qs]), F.col("j") + 1)
        rank = F.greatest(F.lit(1), F.ceil(q * F.col("n") - F.lit(1e-9)))
        error = F.greatest(F.lit(0), F.col("lt") + 1 - rank, rank - F.col("le")) / F.col("n")
        out = checkpointed(out.select("level", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("measure") + 1).alias("measure"), F.col("g").alias(group), F.when((F.col("level") == "day") & (F.col("day") != int(NO_DAY)), F.date_from_unix_date("day")).alias("day"), q.alias("q"), "n", "estimate", error.alias("rank_error"), F.lit(float(bound)).alias("bound")))
        if out.where(F.col("rank_error") > bound).isEmpty():
            return out
        delta *= 2
