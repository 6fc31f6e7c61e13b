"""Order-dependent operators: folds over one entity's ordered rows, each a plain function on arrays, run as grouped maps.

A group is one entity's series (an episode and hand, a segment): its size is bounded by the length of a recording, not by the
table. Groups are sorted inside the function, so no order is assumed of the shuffle; :func:`blocked` has Spark sort the partitions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def grouped(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on each group's rows, sorted by ``order``; ``schema`` is that of f's result, keys included."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values(order, kind="stable").reset_index(drop=True))
        return out if len(out) else out.astype(object)  # Arrow can't take an empty column of numbers for strings

    return df.groupBy(*keys).applyInPandas(run, schema)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each group in rows sorted by ``keys``; NULLs are equal."""
    new = np.ones(len(table), dtype=bool)
    if len(table) > 1:
        new[1:] = False
        for k in keys:
            c = table.column(k).combine_chunks()
            a, b = c.slice(0, len(c) - 1), c.slice(1)
            differ = pc.fill_null(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b)))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def blocked(df: DataFrame, keys: list[str], order: list[str | Column], f: Callable[[pa.Table, np.ndarray], dict], schema: str, least: int = 50_000) -> DataFrame:
    """``f`` on blocks of about ``least`` rows or one larger group, each of whole groups sorted by ``keys`` and ``order``.

    f gets the rows and the bounds of the groups (the first row of each, then the number of rows) and gives the columns of
    ``schema``. One call does thousands of small groups, where :func:`grouped` has a call for each.
    """
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = lambda table, at: pa.RecordBatch.from_pydict(f(table, np.append(at, len(table))), made)
        parts, rows, due = [], 0, least
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows >= due:
                table = pa.Table.from_batches(parts).combine_chunks()
                at = starts(table, keys)
                last = int(at[-1])  # the last group may go on in the next batch
                if last:
                    yield block(table.slice(0, last), at[:-1])
                parts, rows = table.slice(last).to_batches(), len(table) - last
                due = max(least, 2 * rows)
        if rows:
            table = pa.Table.from_batches(parts).combine_chunks()
            yield block(table, starts(table, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as numbers, NaN for NULL."""
    return table.column(name).to_numpy()


def dwell(states: list, t: list[float], least: float) -> list:
    """States with runs shorter than ``least`` taken into the state before, from left to right, until none is left; the first run stays."""
    states = list(states)
    while True:
        heads = [i for i in range(len(states)) if i == 0 or states[i] != states[i - 1]]
        ends = heads[1:] + [len(states)]
        for k in range(1, len(heads)):
            a, z = heads[k], ends[k]
            length = (t[z] if z < len(t) else t[-1]) - t[a]
            if length < least and states[a] != states[a - 1]:
                states[a:z] = [states[a - 1]] * (z - a)
                break
        else:
            return states


def flanks(v: list[float]) -> list[float]:
    """For each value the greatest one before it, back to the last strictly below it; the value itself where that is the one before."""
    out, stack = [], []  # of values that none after is at or below, with the greatest value each has taken in
    for x in v:
        top = None
        while stack and not stack[-1][0] < x:
            y, most = stack.pop()
            top = most if top is None or not most <= top else top
        out.append(x if top is None else top)
        stack.append((x, x if top is None or not top >= x else top))
    return out


def prominent_minima(v: np.ndarray, t: np.ndarray, prominence: float, gap: float) -> list[int]:
    """Rows not above their neighbours whose flanks rise by ``prominence``; the earliest first, at least ``gap`` apart.

    The flank of a side is the greatest value up to the first one strictly below the row's.
    """
    out: list[int] = []
    rows = np.asarray(v, dtype=np.float64)
    known = np.where(np.isnan(rows), np.inf, rows).tolist()
    left, right = flanks(known), flanks(known[::-1])[::-1]
    if np.isnan(rows).any():  # a flank that holds a NaN has no greatest value
        left, right = ([x if x < np.inf else np.nan for x in side] for side in (left, right))
    for i in np.flatnonzero((rows[1:-1] <= rows[:-2]) & (rows[1:-1] <= rows[2:])) + 1:
        if min(left[i], right[i]) - known[i] >= prominence and (not out or t[i] - t[out[-1]] >= gap):
            out.append(int(i))
    return out


def alternating(kinds: list[str], t: list[float], refractory: float, first: str = "contact", second: str = "release") -> list[int]:
    """Rows accepted by the machine that wants ``first`` and ``second`` in turn, at least ``refractory`` after the last accepted."""
    out, want, last = [], first, -np.inf
    for i, (k, x) in enumerate(zip(kinds, t)):
        if k == want and x - last >= refractory:
            out.append(i)
            want, last = (second if want == first else first), x
    return out


def thinned(t: list[float], gap: float, slack: float = 1e-5) -> list[int]:
    """The first row, and each row at least ``gap`` after the last one kept."""
    out: list[int] = []
    for i, x in enumerate(t):
        if not out or x - t[out[-1]] >= gap - slack:
            out.append(i)
    return out


class Levels:
    """Rows (time, level) by time: the lowest of a stretch, the level at a time, the rows near one."""

    def __init__(self, rows: list[tuple[float, float]]) -> None:
        rows = sorted(rows, key=lambda r: r[0])
        self.times, self.levels = [x for x, _ in rows], [v for _, v in rows]
        self.array = np.array(self.levels, dtype=np.float64)

    def lowest(self, a: float, z: float) -> float | None:
        """The time of the lowest row strictly between, the first on a tie; of rows with a NaN level only without others."""
        i, j = bisect_right(self.times, a), bisect_left(self.times, z)
        if i >= j:
            return None
        part = self.array[i:j]
        return self.times[i + int(np.argmin(np.where(np.isnan(part), np.inf, part)))]

    def level(self, x: float) -> float:
        """The level of the first row at or after x, or else of the last; 0 without any."""
        return self.levels[min(bisect_left(self.times, x), len(self.times) - 1)] if self.times else 0.0

    def near(self, x: float, most: float) -> list[tuple[float, float, float]]:
        """(level, distance, time) of the rows at most so far from x."""
        i, j = bisect_left(self.times, -most, key=lambda y: y - x), bisect_right(self.times, most, key=lambda y: y - x)
        return [(v, abs(y - x), y) for y, v in zip(self.times[i:j], self.levels[i:j])]


def levels(rows: list[tuple[float, float]] | Levels) -> Levels:
    return rows if isinstance(rows, Levels) else Levels(rows)


def banded(spans: list[tuple[float, float]], samples: list[tuple[float, float]] | Levels, minima: list[tuple[float, float]] | Levels, low: float = 1.3, high: float = 4.0, mid: float = 2.65) -> list[tuple[float, float]]:
    """Spans with durations brought into a band.

    A long one is cut at the lowest of the ``minima`` (time, level) that leave ``low`` on both sides, the first on a tie, or else at
    the lowest of the ``samples`` there, again and again; without any it stays long. A short one is merged with the touching
    neighbour that brings the sum nearest to ``mid`` and not above ``high``, the one before on a tie, or else left out.
    """
    samples, minima = levels(samples), levels(minima)
    parts: list[tuple[float, float]] = []
    for s in spans:
        left = [s]  # what is still to be looked at, the first part last
        while left:
            a, z = left.pop()
            at = None
            if z - a > high:
                at = minima.lowest(a + low, z - low)
                at = samples.lowest(a + low, z - low) if at is None else at
            if at is None:
                parts.append((a, z))
            else:
                left += [(at, z), (a, at)]
    out: list[tuple[float, float]] = []
    i = 0
    while i < len(parts):
        a, z = parts[i]
        if z - a >= low:
            out.append((a, z))
        else:
            options = []
            if out and abs(out[-1][1] - a) < 1e-9 and z - out[-1][0] <= high:
                options.append((abs(z - out[-1][0] - mid), 0))
            if i + 1 < len(parts) and abs(parts[i + 1][0] - z) < 1e-9 and parts[i + 1][1] - a <= high:
                options.append((abs(parts[i + 1][1] - a - mid), 1))
            if options and min(options)[1] == 0:
                out[-1] = (out[-1][0], z)
            elif options:
                parts[i + 1] = (a, parts[i + 1][1])  # looked at again in its turn
        i += 1
    return out


def refined(bounds: list[float], samples: list[tuple[float, float]] | Levels, minima: list[tuple[float, float]] | Levels, shift: float = 0.4, low: float = 1.3, high: float = 4.0, enough: float = 1.7) -> list[tuple[float, int, str | None]]:
    """Each inner boundary moved to the lowest candidate within ``shift``: (boundary, candidates, why it stayed).

    Candidates are the boundary itself and the minima (time, level); the level of the boundary is that of the first sample at
    or after it. One is feasible if both sides keep a length in the band, and at least the lesser of ``enough`` and their
    own. From left to right, against the boundary already moved; the first and last stay. Ties go to the shorter move,
    then the earlier time. The reason is None for a boundary that moved.
    """
    if 2 * shift >= low:
        raise ValueError("two shifts must be shorter than the least duration")
    samples, minima = levels(samples), levels(minima)
    out: list[tuple[float, int, str | None]] = [(bounds[0], 0, None)] if bounds else []
    for i in range(1, len(bounds) - 1):
        b, before, after = bounds[i], bounds[i] - bounds[i - 1], bounds[i + 1] - bounds[i]
        near = minima.near(b, shift)
        fits = lambda x: all(max(low, min(enough, own) - 1e-9) <= d <= high for d, own in ((x - out[-1][0], before), (bounds[i + 1] - x, after)))  # noqa: B023, E731
        feasible = [c for c in [(samples.level(b), 0.0, b), *near] if fits(c[2])]
        best = min(feasible)[2] if feasible else b
        why = None if best != b else "no_candidate" if not near else "original_best" if len(feasible) > 1 else "band"
        out.append((best, len(near), why))
    if len(bounds) > 1:
        out.append((bounds[-1], 0, None))
    return out


def unmatched(pairs: Iterable[tuple]) -> list[int]:
    """The places of those among (row, column) whose row and column no pair taken before has."""
    out, rows, cols = [], set(), set()
    for k, (i, j) in enumerate(pairs):
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            out.append(k)
    return out


def greedy_pairs(scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """One-to-one pairs by descending score, ties by row then column, of at least ``least`` and above 0."""
    i, j = np.nonzero((scores >= least) & (scores > 0))
    order = np.lexsort((j, i, -scores[i, j]))
    pairs = list(zip(i[order].tolist(), j[order].tolist()))
    return [pairs[k] for k in unmatched(pairs)]


def greedy_nearest(gold: list[float], seen: list[float], tolerance: float) -> list[tuple[int, int]]:
    """For each gold time, in order, the nearest seen time not yet taken; taken only where within the tolerance.

    On a tie the place in ``seen`` decides. Links lead past the times taken, so that a search doesn't grow with their number.
    """
    places = sorted((k for k, x in enumerate(seen) if x == x), key=seen.__getitem__)
    times = [seen[k] for k in places]
    later, sooner = list(range(len(times) + 1)), list(range(len(times) + 1))  # sooner[i + 1] belongs to time i

    def end(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = i = links[links[i]]
        return i

    out = []
    for i, g in sorted(((i, g) for i, g in enumerate(gold) if g == g), key=lambda x: x[1]):
        at = bisect_left(times, g)
        right, left = end(later, at), end(sooner, at) - 1
        near = [abs(times[j] - g) for j in (left, right) if 0 <= j < len(times)]
        if near and min(near) <= tolerance:
            first = end(later, bisect_left(times, -min(near), key=lambda x: x - g))  # noqa: B023
            tied = {first} | ({right} if right < len(times) and near[-1] == min(near) else set())
            j = min(tied, key=places.__getitem__)
            out.append((i, places[j]))
            later[j], sooner[j + 1] = j + 1, j
    return out


def assignment(cost: np.ndarray, infeasible: float = 1e5) -> list[tuple[int, int]]:
    """The one-to-one pairs of least total cost (shortest augmenting paths), without those of ``infeasible`` cost or more."""
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in assignment(cost.T, infeasible))
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] and cost[match[j] - 1, j - 1] < infeasible)


def monotone_alignment(scores: np.ndarray) -> float:
    """The greatest sum of scores over pairs that rise in both rows and columns."""
    best = np.zeros(scores.shape[1] + 1)
    for row in scores:
        before = best.copy()
        for j, s in enumerate(row, 1):
            best[j] = max(before[j], best[j - 1], before[j - 1] + s)
    return float(best[-1])


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersections over unions of all boxes x1, y1, x2, y2 of a with all of b."""
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(hi - lo, 0, None).prod(axis=2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1)
    return inter / np.maximum(area(a)[:, None] + area(b)[None] - inter, 1e-9)


def clashes(box: np.ndarray, kept: np.ndarray, least: float, held: float) -> np.ndarray:
    """Where a box overlaps a kept one by ``least`` or more, or holds ``held`` of it and is larger."""
    inter = np.clip(np.minimum(box[..., 2:], kept[..., 2:]) - np.maximum(box[..., :2], kept[..., :2]), 0, None).prod(axis=-1)
    area, k = (np.clip(x[..., 2:] - x[..., :2], 0, None).prod(axis=-1) for x in (box, kept))
    return (inter / np.maximum(area + k - inter, 1e-9) >= least) | ((area > k) & (inter >= held * np.maximum(k, 1e-9)))


def suppressed(boxes: np.ndarray, scores: np.ndarray, least: float = 0.5, held: float = 0.85) -> list[int]:
    """Boxes kept by descending score: overlapping no kept one by ``least`` or more, and not holding ``held`` of a smaller kept one."""
    kept: list[int] = []
    for i in np.lexsort((np.arange(len(scores)), -scores)):
        if not clashes(boxes[i], boxes[kept], least, held).any():
            kept.append(int(i))
    return sorted(kept)


def suppressed_by_group(boxes: np.ndarray, scores: np.ndarray, at: np.ndarray, least: float = 0.5, held: float = 0.85, small: int = 64) -> np.ndarray:
    """The rows that :func:`suppressed` keeps in each of the groups with bounds ``at``; groups of up to ``small`` rows go rank by rank, all at once."""
    size = np.diff(at)
    order = np.lexsort((np.arange(len(scores)), -scores, np.repeat(np.arange(len(size)), size)))
    b, kept = boxes[order], np.ones(len(scores), dtype=bool)
    for rank in range(1, int(size[size <= small].max(initial=0))):
        i = at[:-1][(size > rank) & (size <= small)] + rank
        for before in range(rank):
            kept[i] &= ~(kept[i - rank + before] & clashes(b[i], b[i - rank + before], least, held))
    for g in np.flatnonzero(size > small):
        own = suppressed(b[at[g] : at[g + 1]], scores[order[at[g] : at[g + 1]]], least, held)
        kept[at[g] : at[g + 1]] = np.isin(np.arange(size[g]), own)
    return np.sort(order[kept])


def track(frames: list[tuple[int, float, list[tuple[np.ndarray, bool]]]], max_gap: float = 0.7, weak_gap: float = 0.7, most: int = 4) -> list[tuple[int, int, int, str]]:
    """Frame by frame, (frame, track, detection, status): detections bound to tracks.

    ``frames`` are (index, time, [(box, strong)]) with rising times. A track ends when none was strong for ``max_gap``. Strong
    detections are assigned first, at the least total cost of 1 - IoU + 0.2 distances in box diagonals; those left begin
    tracks, up to ``most``; weak ones then go to the tracks left over. A track is looked for where its smoothed, bounded velocity
    takes it in at most 0.3 s. One without a detection is reported as 'predicted' with detection -1.
    """
    tracks: dict[int, dict] = {}
    out, number, before = [], 0, -np.inf

    def bind(ids: list[int], picks: list[int], boxes: list[np.ndarray], t: float, strong: bool) -> list[tuple[int, int]]:
        if not ids or not picks:
            return []
        here = np.array([tracks[k]["box"] + np.clip(t - tracks[k]["seen"], 0, 0.3) * tracks[k]["velocity"] for k in ids])
        there = np.array([boxes[j] for j in picks])
        overlap = iou(here, there)
        size = np.maximum(np.linalg.norm(here[:, 2:] - here[:, :2], axis=1), 1e-9)
        apart = np.linalg.norm((here[:, None, :2] + here[:, None, 2:] - there[None, :, :2] - there[None, :, 2:]) / 2, axis=2) / size[:, None]
        allowed = (overlap >= 0.05) | (apart < 0.6) if strong else overlap >= 0.2
        got = assignment(np.where(allowed, 1 - overlap + 0.2 * apart, 1e6))
        for i, j in got:
            k, box = tracks[ids[i]], there[j]
            gap = t - k["seen"]
            most_speed = max(3 * size[i], 30.0)
            k["velocity"] = 0.5 * k["velocity"] + 0.5 * np.clip((box - k["box"]) / gap, -most_speed, most_speed)
            k["box"], k["seen"] = box, t
            if strong:
                k["strong"] = t
        return [(ids[i], picks[j]) for i, j in got]

    for index, t, found in frames:
        if not t > before:
            raise ValueError("frames must come in order of time")
        before = t
        tracks = {k: x for k, x in tracks.items() if t - x["strong"] <= max_gap}
        ids, boxes = sorted(tracks), [b for b, _ in found]
        strong = [j for j, (_, s) in enumerate(found) if s]
        bound = bind(ids, strong, boxes, t, True)
        out += [(index, k, j, "strong") for k, j in bound]
        left = [k for k in ids if k not in {k for k, _ in bound}]
        for j in strong:
            if j not in {j for _, j in bound} and len(tracks) < most:
                tracks[number] = {"box": boxes[j], "velocity": np.zeros(4), "seen": t, "strong": t}
                out.append((index, number, j, "strong"))
                number += 1
        recent = [k for k in left if t - tracks[k]["strong"] <= weak_gap]
        weak = bind(recent, [j for j, (_, s) in enumerate(found) if not s], boxes, t, False)
        out += [(index, k, j, "weak") for k, j in weak]
        out += [(index, k, -1, "predicted") for k in left if k not in {k for k, _ in weak}]
    return out


def bleu(candidate: list[str], reference: list[str], order: int = 4) -> float:
    """Smoothed sentence BLEU: the geometric mean of n-gram precisions (one added above n = 1) times the brevity penalty."""
    from collections import Counter

    if not candidate or not reference:
        return 0.0
    log = 0.0
    for n in range(1, order + 1):
        c = Counter(tuple(candidate[i : i + n]) for i in range(len(candidate) - n + 1))
        r = Counter(tuple(reference[i : i + n]) for i in range(len(reference) - n + 1))
        hit, total = sum((c & r).values()), max(sum(c.values()), 0)
        p = (hit + (n > 1)) / (total + (n > 1)) if total + (n > 1) else 0.0
        if p == 0:
            return 0.0
        log += np.log(p) / order
    return float(np.exp(log) * min(1.0, np.exp(1 - len(reference) / len(candidate))))
