import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from epiloom.llm.digest import certified_percentiles, cluster, combined, daily_digests, quantiles

QS = [0.01, 0.5, 0.9, 0.99]


def test_certified_errors_are_true_and_within_the_bound(spark):
    rng = random.Random(1)
    rows = []
    for i in range(30_000):
        g = rng.choice(["a", "a", "b", None])
        v = rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), rng.paretovariate(0.4)])
        rows.append((g, datetime.datetime(2025, 1, 1 + i % 3), v if i % 50 else None, i))
    df = spark.createDataFrame(rows, "cls STRING, at TIMESTAMP, x DOUBLE, day INT")
    out = certified_percentiles(df, "cls", "at", {"x": F.col("x"), "twice": F.col("x") * 2}, QS, bound=0.004, delta=300.0).collect()
    assert len(out) == 2 * 3 * len(QS) * (3 + 1)
    for r in out:
        scale = 1 if r["measure"] == "x" else 2
        vs = np.array(sorted(v * scale for g, t, v, _ in rows if g == r["cls"] and v is not None and (r["level"] == "all" or t.date() == r["day"])))
        assert r["n"] == len(vs) and r["estimate"] in vs
        rank = max(1, int(np.ceil(r["q"] * len(vs) - 1e-9)))
        lo, hi = np.searchsorted(vs, r["estimate"], "left"), np.searchsorted(vs, r["estimate"], "right")
        assert abs(max(0, lo + 1 - rank, rank - hi) / len(vs) - r["rank_error"]) < 1e-12
        assert r["rank_error"] <= 0.004


def test_defined_cases(spark):
    schema = "cls STRING, at TIMESTAMP, x DOUBLE"
    how = lambda rows: certified_percentiles(spark.createDataFrame(rows, schema), "cls", "at", {"x": F.col("x")}, [0.5])
    assert how([]).count() == 0
    assert how([("a", None, None), ("a", None, float("nan"))]).count() == 0
    got = how([("a", None, 3.0), ("a", None, 3.0), ("a", None, -1e300), (None, datetime.datetime(2025, 1, 1), float("inf"))]).collect()
    assert {(r["level"], r["cls"], r["day"], r["n"], r["estimate"]) for r in got} == {
        ("day", "a", None, 3, 3.0),
        ("all", "a", None, 3, 3.0),
        ("day", None, datetime.date(2025, 1, 1), 1, float("inf")),
        ("all", None, None, 1, float("inf")),
    }


def test_digests_of_days_combine(spark):
    rows = [("a", datetime.datetime(2025, 1, 1 + i % 5), float(i)) for i in range(5000)]
    d = daily_digests(spark.createDataFrame(rows, "cls STRING, at TIMESTAMP, x DOUBLE"), "cls", "at", {"x": F.col("x")})
    assert d.count() == 5
    whole = combined(d).collect()
    assert len(whole) == 1
    w = whole[0]["w"] or [1] * len(whole[0]["lo"])
    assert sum(w) == 5000
    est = quantiles(np.array(whole[0]["lo"]), np.array(whole[0]["hi"] or whole[0]["lo"]), np.array(w), np.array([0.5]))[0]
    assert abs(est - 2500) < 25


def test_cluster_keeps_weight_and_order():
    rng = np.random.default_rng(0)
    v = rng.normal(size=5000)
    seg = rng.integers(0, 3, 5000)
    s, lo, mean, hi, w = cluster(seg, v, v, v, np.ones(5000, dtype=np.int64), 100.0)
    for k in range(3):
        assert w[s == k].sum() == (seg == k).sum()
        assert (lo[s == k] <= mean[s == k]).all() and (mean[s == k] <= hi[s == k]).all()
        assert (hi[s == k][:-1] <= lo[s == k][1:]).all() and (s == k).sum() <= 52
