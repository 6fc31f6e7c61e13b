"""Operators on ordered samples: smoothing, derivatives, ranks, runs of a state, and sampling plans.

``keys`` are the partition columns of a series, ``order`` its ordering columns, which must be unique in the series. All are
window expressions, so a series is sorted once for any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def box_smooth(x: Column, n: int, keys: list[str], order: list[str]) -> Column:
    """The mean over the rows from n // 2 before to (n - 1) // 2 after, clipped to the series; x itself in series shorter than n."""
    if n < 2:
        return x
    w = over(keys, order).rowsBetween(-(n // 2), (n - 1) // 2)
    return F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) < n, x).otherwise(F.avg(x).over(w))


def speed(t: Column, dims: list[Column], keys: list[str], order: list[str]) -> Column:
    """The length of the step from the row before over its time, 0 for steps of 1e-9 s or less; NULL in the first row."""
    w = over(keys, order)
    dt = t - F.lag(t).over(w)
    step = F.sqrt(sum((F.pow(d - F.lag(d).over(w), F.lit(2.0)) for d in dims), F.lit(0.0)))
    return F.when(dt <= 1e-9, F.lit(0.0)).otherwise(F.try_divide(step, dt))


def gradient(t: Column, x: Column, keys: list[str], order: list[str]) -> Column:
    """The derivative of second order on an uneven grid, one-sided at both ends; 0 in series of one row."""
    w = over(keys, order)
    hs, hd = t - F.lag(t).over(w), F.lead(t).over(w) - t
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    inner = F.try_divide(hs * hs * after + (hd * hd - hs * hs) * x - hd * hd * before, hs * hd * (hs + hd))
    ends = F.when(hs.isNull() & hd.isNull(), F.lit(0.0)).when(hs.isNull(), F.try_divide(after - x, hd)).when(hd.isNull(), F.try_divide(x - before, hs))
    return F.when(hs.isNull() | hd.isNull(), ends).otherwise(inner)


def angular_speed(t: Column, quat: list[Column], keys: list[str], order: list[str]) -> Column:
    """2 acos |q . q'| over the time of the step; NULL in the first row and in series of under three rows."""
    w = over(keys, order)
    dot = sum((q * F.lag(q).over(w) for q in quat), F.lit(0.0))
    angle = 2 * F.acos(F.least(F.abs(dot), F.lit(1.0)))
    return F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) >= 3, F.try_divide(angle, t - F.lag(t).over(w)))


def percentile_rank(x: Column, keys: list[str], least: int = 8) -> Column:
    """The share of the series' values at or below x; NULL for a NULL, and for all where fewer than ``least`` values are."""
    w = Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.unboundedPreceding, 0)
    n = F.count(x).over(Window.partitionBy(*keys))
    return F.when(x.isNotNull() & (n >= least), F.count(x).over(w) / n)


def with_islands(df: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """The rows whose flag holds, with ``island``: equal within a run of successive flagged rows of a series."""
    w = over(keys, order)
    numbered = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_i", F.row_number().over(w))
    numbered = numbered.withColumn("island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("_f").drop("_f")


def runs(df: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, first, last, n): the inclusive row numbers (from 0) of each run of flagged rows."""
    return with_islands(df, flag, keys, order).groupBy(*keys, "island").agg((F.min("_i") - 1).cast("bigint").alias("first"), (F.max("_i") - 1).cast("bigint").alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def state_runs(df: DataFrame, state: str, t: str, keys: list[str], order: list[str], least_s: float = 0.0, score: str | None = None) -> DataFrame:
    """(keys, state, start, end, mean_score): each run of one state, ending where the next run begins (the last, at its last row).

    A NULL state is a state of its own. Runs shorter than ``least_s`` are left out.
    """
    w = over(keys, order)
    new = (F.row_number().over(w) == 1) | ~F.col(state).eqNullSafe(F.lag(state).over(w))
    marked = df.withColumn("_new", new.cast("int"))
    marked = marked.withColumn("_r", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agg = marked.groupBy(*keys, "_r").agg(F.first(state).alias(state), F.min(t).alias("start"), F.max(t).alias("last"), (F.avg(score) if score else F.lit(None).cast("double")).alias("mean_score"))
    ended = agg.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(*keys).orderBy("_r")), F.col("last")))
    return ended.where(F.col("end") - F.col("start") >= least_s).select(*keys, state, "start", "end", "mean_score")


def dwelt(df: DataFrame, state: str, t: str, keys: list[str], order: list[str], least_s: float) -> DataFrame:
    """The rows with ``dwelt``: the state, or for a run shorter than ``least_s`` that of the last run before that wasn't.

    A run lasts until the next one begins (the last, until its last row); the first of a series is always kept.
    """
    w = over(keys, order)
    new = (F.row_number().over(w) == 1) | ~F.col(state).eqNullSafe(F.lag(state).over(w))
    rows = df.withColumn("_new", new.cast("int")).withColumn("_r", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    runs_ = rows.groupBy(*keys, "_r").agg(F.first(state).alias("_s"), F.min(t).alias("_a"), F.max(t).alias("_z"))
    by_run = Window.partitionBy(*keys).orderBy("_r")
    kept = (F.col("_r") == 1) | (F.coalesce(F.lead("_a").over(by_run), F.col("_z")) - F.col("_a") >= least_s)
    runs_ = runs_.withColumn("_k", F.when(kept, F.struct("_s")))
    runs_ = runs_.select(*keys, "_r", F.last("_k", ignorenulls=True).over(by_run.rowsBetween(Window.unboundedPreceding, 0))["_s"].alias("dwelt"))
    return rows.join(runs_, [*keys, "_r"]).drop("_r")


def evidence_ranges(df: DataFrame, flag: Column, t: str, step: float, least: float, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, start, end): runs of flagged samples as [first t, last t + step], where at least ``least`` long (up to 1e-8)."""
    r = with_islands(df, flag, keys, order).groupBy(*keys, "island").agg(F.min(t).alias("start"), (F.max(t) + F.lit(step)).alias("end"))
    return r.where(F.col("end") - F.col("start") + 1e-8 >= least).drop("island")


def held_range(x: Column, t_us: Column, forward_us: int, keys: list[str], how=F.percentile) -> Column:
    """The median of x over the rows of the series from t to t + forward_us, by a range window on whole microseconds."""
    w = Window.partitionBy(*keys).orderBy(t_us).rangeBetween(0, forward_us)
    return how(x, F.lit(0.5)).over(w)


def onsets(df: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """The rows at which the flag turns from False (or nothing) to True."""
    w = over(keys, order)
    now = F.coalesce(flag, F.lit(False))
    marked = df.withColumn("_f", now)
    return marked.withColumn("_b", F.coalesce(F.lag("_f").over(w), F.lit(False))).where("_f AND NOT _b").drop("_f", "_b")


def first_k(df: DataFrame, k: int, keys: list[str], order: list) -> DataFrame:
    """The first k rows of each group, with their position from 1 as ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def stride_sample(df: DataFrame, k: int, keys: list[str], order: list[str]) -> DataFrame:
    """Every max(1, n // k)-th row of a series of n rows, from the first."""
    w = over(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    step = F.greatest(F.lit(1), F.floor(n / k).cast("int"))
    return df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_s", step).where(F.col("_i") % F.col("_s") == 0).drop("_i", "_s")


def batches(df: DataFrame, size: int, keys: list[str], order: list[str]) -> DataFrame:
    """``batch``: number of the group of ``size`` successive rows in the series, from 0."""
    return df.withColumn("batch", F.floor((F.row_number().over(over(keys, order)) - 1) / size).cast("bigint"))


def foote_novelty(df: DataFrame, vector: str, order: str, keys: list[str], half: int) -> DataFrame:
    """(keys, order, novelty): the checkerboard novelty of unit vectors along a series, of ``half`` rows on each side.

    With a the rows before and b the rows from the current one on, the kernel's sum over the cosine self-similarities is
    |sum a|^2 + |sum b|^2 - 2 (sum a . sum b): two windowed vector sums, without the similarity matrix. NULL within
    ``half`` rows of either end.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = df.withColumn("_u", F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm)))
    w = over(keys, [order])
    prev, nxt = w.rowsBetween(-half, -1), w.rowsBetween(0, half - 1)
    gathered = unit.withColumn("_a", F.collect_list("_u").over(prev)).withColumn("_b", F.collect_list("_u").over(nxt))
    total = lambda c: F.aggregate(c, F.array_repeat(F.lit(0.0), F.size("_u")), lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    diff = F.zip_with(total("_a"), total("_b"), lambda p, q: p - q)
    score = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)
    full = (F.size("_a") == half) & (F.size("_b") == half)
    return gathered.select(*keys, order, F.when(full, score).alias("novelty"))
