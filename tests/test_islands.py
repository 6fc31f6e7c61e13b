import random

from pyspark.sql import functions as F

from epiloom.operators.islands import merged_intervals, prefix_combine, whole_ms


def brute(rows):
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, spans in by.items():
        spans.sort()
        periods = [list(spans[0])]
        for s, e in spans[1:]:
            if s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out |= {(k, "period", a, z) for a, z in periods}
        out |= {(k, "gap", p[1], q[0]) for p, q in zip(periods, periods[1:])}
    return out


def run(spark, rows, n=None):
    df = spark.createDataFrame(rows, "k STRING, s BIGINT, e BIGINT")
    got = merged_intervals(df, "k", "s", "e", n).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_against_brute_force(spark):
    rng = random.Random(5)
    for hot in (0.0, 0.7):
        rows = []
        for _ in range(800):
            k = "hot" if rng.random() < hot else f"e{rng.randrange(6)}"
            s = rng.randrange(4000)
            rows.append((k, s, s + rng.choice([1, 5, 20, 400])))
        rows += rows[:50]  # repeated rows
        assert run(spark, rows, 7) == brute(rows)


def test_one_period_over_all_partitions(spark):
    rows = [("a", 0, 10_000)] + [("a", i, i + 1) for i in range(0, 9_000, 3)] + [("a", 20_000, 20_001)]
    assert run(spark, rows, 8) == {("a", "period", 0, 10_000), ("a", "gap", 10_000, 20_000), ("a", "period", 20_000, 20_001)}


def test_defined_cases(spark):
    rows = [("a", 1, 2), ("a", 2, 3), ("a", 5, 5), ("a", 9, 7), (None, 1, 2), ("a", None, 2), ("a", 1, None), ("b", -5, -1)]
    assert run(spark, rows) == {("a", "period", 1, 3), ("b", "period", -5, -1)}
    assert run(spark, []) == set()


def test_clashing_columns_are_not_read(spark):
    df = spark.createDataFrame([("a", 1, 4, "x", 9)], "ep STRING, start BIGINT, end BIGINT, k STRING, kind INT")
    assert [tuple(r) for r in merged_intervals(df, "ep", "start", "end").collect()] == [("a", "period", 1, 4)]


def test_whole_ms(spark):
    df = spark.createDataFrame([(1.0004,), (-0.00022,), (None,), (float("nan"),), (float("inf"),)], "x DOUBLE")
    assert [r[0] for r in df.select(whole_ms(F.col("x"))).collect()] == [1000, 0, None, None, None]


def test_prefix_combine_is_carried_through_single_entity_partitions():
    rows = [(0, "a", "a", 0, 50), (1, "a", "a", 10, 20), (2, "a", "b", 5, 6), (3, "b", "b", 7, 8)]
    assert prefix_combine(rows) == {1: ("a", 0, 50), 2: ("a", 0, 50), 3: ("b", 5, 6)}
