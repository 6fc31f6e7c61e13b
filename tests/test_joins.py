import random

import numpy as np

from epiloom.operators import joins as J


def tables(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 5 + ["a", "b", None])
    left = [(i, key(), float(rng.randrange(0, 2000)) / 2 if i % 40 else None) for i in range(300)]
    right = [(i, key(), float(rng.randrange(0, 900)) / 2, float(i % 7)) for i in range(200)]
    return left, right, spark.createDataFrame(left, "id INT, k STRING, t DOUBLE"), spark.createDataFrame(right, "rid INT, k STRING, t DOUBLE, x DOUBLE")


def test_asof_forward_and_nearest(spark):
    left, right, l, r = tables(spark, 1)
    forward = {row["id"]: row["r_rid"] for row in J.asof_forward(l, r, ["k"], "t", ["rid"], ["rid"]).collect()}
    near = {row["id"]: row["r_t"] for row in J.asof_nearest(l, r, ["k"], "t", ["rid"], ["rid"]).collect()}
    assert len(forward) == len(near) == len(left)
    for i, k, t in left:
        mine = sorted((rt, rid) for rid, rk, rt, _ in right if rk == k and k is not None)
        if t is None or not mine:
            assert forward[i] is None and near[i] is None
            continue
        after = [m for m in mine if m[0] >= t]
        assert forward[i] == (after[0] if after else mine[-1])[1]
        assert near[i] == min((abs(m[0] - t), -m[0]) for m in mine)[1] * -1


def test_without_clamp_nothing_is_past_the_end(spark):
    left, right, l, r = tables(spark, 2)
    got = {row["id"]: row["r_t"] for row in J.asof_forward(l, r, ["k"], "t", ["rid"], ["rid"], clamp=False).collect()}
    for i, k, t in left:
        after = sorted(rt for _, rk, rt, _ in right if rk == k and t is not None and k is not None and rt >= t)
        assert got[i] == (after[0] if after else None)


def test_interpolated(spark):
    left, right, l, r = tables(spark, 3)
    got = {row["id"]: row["value"] for row in J.interpolated(l, r, ["k"], "t", "x").collect()}
    for i, k, t in left:
        if t is None or k is None:
            continue
        at = {}
        for _, rk, rt, x in right:
            if rk == k:
                at.setdefault(rt, []).append(x)
        ts = sorted(at)
        assert abs(got[i] - np.interp(t, ts, [np.mean(at[s]) for s in ts])) < 1e-9


def test_intervals(spark):
    rng = random.Random(4)
    span = lambda: (a := rng.randrange(0, 300) / 2, a + rng.choice([0.0, 0.5, 3.0, 50.0]))
    a = [(i, "e", *span()) for i in range(60)]
    b = [(i, "e", *span()) for i in range(60)]
    A, B = spark.createDataFrame(a, "i INT, k STRING, a DOUBLE, z DOUBLE"), spark.createDataFrame(b, "j INT, k STRING, c DOUBLE, d DOUBLE")
    got = [(r["i"], r["j"]) for r in J.overlap_pairs(A, B, ["k"], ("a", "z"), ("c", "d"), 7.0).collect()]
    want = {(i, j) for i, _, x, y in a for j, _, c, d in b if min(y, d) > max(x, c)}
    assert len(got) == len(set(got)) and set(got) == want
    p = spark.createDataFrame([(i, "e", i / 3) for i in range(600)], "p INT, k STRING, t DOUBLE")
    got = [(r["p"], r["i"]) for r in J.points_in_intervals(p, A, ["k"], "t", "a", "z", 7.0).collect()]
    want = {(q, i) for q in range(600) for i, _, x, y in a if x <= q / 3 < y}
    assert len(got) == len(set(got)) and set(got) == want
