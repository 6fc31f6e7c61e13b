import random

from epiloom.llm.nearest import nearest_in_time


def run(spark, left, right, tol=150, slice_us=1000):
    l = spark.createDataFrame([(*r, "z") for r in left], "id BIGINT, k STRING, t BIGINT, s STRING")
    r = spark.createDataFrame([(*r, 0) for r in right], "id BIGINT, k STRING, t BIGINT, p INT")
    return {tuple(x) for x in nearest_in_time(l, r, tol, slice_us).collect()}


def brute(left, right, tol):
    out = set()
    for i, k, t in left:
        near = [(abs(t - rt), r) for r, rk, rt in right if None not in (i, k, t, r, rk, rt) and rk == k and abs(t - rt) <= tol]
        if near:
            d, r = min(near)
            out.add((i, r, d))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), rng.choice([rng.randrange(-3000, 9000), None] if i % 30 == 0 else [rng.randrange(-3000, 9000)])) for i in range(400)]
    right = [(i, key(), rng.randrange(-3000, 9000)) for i in range(600)]
    right += right[:80] + [(900 + i, "hot", 500) for i in range(50)]  # redelivered rows and a burst
    assert run(spark, left, right) == brute(left, right, 150)


def test_tolerance_is_inclusive_and_ties_go_to_the_least_id(spark):
    assert run(spark, [(1, "a", 1000)], [(5, "a", 1150), (4, "a", 850)]) == {(1, 4, 150)}
    assert run(spark, [(1, "a", 1000)], [(5, "a", 1151), (4, "a", 849)]) == set()
    assert run(spark, [(1, "a", 1000), (1, "a", 1000)], [(9, "a", 1000), (3, "a", 1000)]) == {(1, 3, 0)}


def test_empty(spark):
    assert run(spark, [], [(1, "a", 1)]) == run(spark, [(1, "a", 1)], []) == run(spark, [], []) == set()
