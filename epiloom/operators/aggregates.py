"""Aggregations: distributions, window records, rollups, agreement and ranking statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL for NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def distribution(x: Column, prefix: str) -> list[Column]:
    """Least value, p10, median, p90 and greatest value (linear interpolation) of the finite values; NULL without any."""
    v = finite(x)
    names = [("min", F.min(v)), ("p10", F.percentile(v, F.lit(0.1))), ("median", F.percentile(v, F.lit(0.5))), ("p90", F.percentile(v, F.lit(0.9))), ("max", F.max(v))]
    return [c.alias(f"{prefix}_{n}") for n, c in names]


def tumbling(df: DataFrame, keys: list[str], t: str, width: float, aggs: list[Column]) -> DataFrame:
    """(keys, win, aggs): the records of windows of ``width`` seconds from 0; the last may be shorter."""
    return df.withColumn("win", F.floor(F.col(t) / width).cast("bigint")).groupBy(*keys, "win").agg(*aggs)


def share_rollup(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """(keys, n, one count for each flag) for each key and, with NULL keys, for all: grouping sets in one pass.

    ``level`` is 0 for the keys' own rows and 1 for the total.
    """
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()]]
    total = F.grouping(keys[0]).cast("int").alias("level")
    return df.rollup(*keys).agg(total, *aggs) if len(keys) == 1 else df.groupingSets([[F.col(k) for k in keys], []], *keys).agg(total, *aggs)


def rank_auc(df: DataFrame, keys: list[str], score: str, positive: str, least: int = 5) -> DataFrame:
    """(keys, n_pos, n_neg, auc): the rank statistic with ties averaged; NULL with under ``least`` of either side.

    Ranks come from counts by score, so that a hot key's rows are summed up before they are ordered.
    """
    by_score = df.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    r = by_score.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    out = r.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"))
    auc = F.when((F.col("n_pos") >= least) & (F.col("n_neg") >= least), F.col("u") / (F.col("n_pos") * F.col("n_neg")))
    return out.select(*keys, "n_pos", "n_neg", auc.alias("auc"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; NULL where a denominator is 0."""
    p, r = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1")]


def sign_test(wins: Column, n: Column) -> Column:
    """The one-sided binomial p-value: the chance of at least ``wins`` of ``n`` fair coin flips (n up to about a thousand)."""
    # log C(n, i) = lgamma sums, as cumulative sums of logs.
    log_fact = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    term = lambda i: F.exp(log_fact(n) - log_fact(i) - log_fact(n - i) - n * F.log(F.lit(2.0)))
    return F.when(wins <= n, F.aggregate(F.sequence(wins, n), F.lit(0.0), lambda s, i: s + term(i))).otherwise(F.lit(0.0))


def sign_tail(k: int, n: int) -> float:
    """The chance of at least ``k`` of ``n`` fair coin flips, for any n: terms in log space, shifted by the greatest."""
    if k <= 0 or k > n:
        return float(k <= 0)
    i = np.arange(k, n)
    # log C(n, i + 1) - log C(n, i), summed up from the first term.
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)))]) + (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    top = logs.max()
    return min(1.0, math.exp(top) * float(np.exp(logs - top).sum()))


def sign_tails(df: DataFrame, keys: list[str], wins: str, n: str) -> DataFrame:
    """(keys, wins, n, p): :func:`sign_tail` of each row."""
    out = df.select(*keys, wins, n)

    def run(batches):
        for b in batches:
            yield b.assign(p=[sign_tail(int(k), int(m)) for k, m in zip(b[wins], b[n])])

    return out.mapInPandas(run, out.schema.simpleString()[7:-1] + ", p DOUBLE")


def top_repeats(df: DataFrame, keys: list[str], text: Column, order: str, k: int = 5) -> DataFrame:
    """(keys, norm, n, rank): the k most repeated texts of each key, with more than one occurrence; ties by first seen."""
    c = df.select(*keys, text.alias("norm"), F.col(order).alias("_o")).where("norm IS NOT NULL").groupBy(*keys, "norm").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("_o")).where("n > 1")
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_o")
    return c.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).drop("_o")
