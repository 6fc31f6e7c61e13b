import random

from epiloom.llm.cutoff import fraction_cutoffs


def brute(rows, num, den):
    by = {}
    for s, v in rows:
        if v is not None and v == v:
            by.setdefault(s, []).append(v)
    out = {}
    for s, vs in by.items():
        vs.sort()
        k = -(-len(vs) * num // den)
        out[s] = (len(vs), vs[k - 1], sum(v <= vs[k - 1] for v in vs))
    return out


def run(spark, rows, keep=(3, 10), **how):
    df = spark.createDataFrame([(*r, 1) for r in rows], "src STRING, x DOUBLE, v INT")
    return {r[0]: tuple(r)[1:] for r in fraction_cutoffs(df, "src", "x", keep, **how).collect()}


def test_rounds_of_quickselect_against_sorting(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.random(), 0.0, 0.5])) for _ in range(3000)] + [(f"s{i % 9}", round(rng.gauss(0, 3), 2)) for i in range(1500)]
    rows += [(None, float(i)) for i in range(50)]
    for keep in ((3, 10), (1, 1), (1, 1000), (1, 2)):
        assert run(spark, rows, keep, block_values=200) == brute(rows, *keep)
    assert run(spark, rows[-900:], block_values=200, halvings=1) == brute(rows[-900:], 3, 10)


def test_defined_cases(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("b", None), ("c", -0.0), ("c", 0.0), ("c", 0.0), ("d", float("inf")), ("d", -1.0)]
    assert run(spark, rows) == {"a": (1, 1.0, 1), "c": (3, 0.0, 3), "d": (2, -1.0, 1)}
    assert run(spark, []) == {}


def test_all_values_equal_and_even_pivots(spark):
    rows = [("a", 2.0)] * 500 + [("b", float(i % 2)) for i in range(400)] + [("c", float(i)) for i in range(100)]
    assert run(spark, rows) == brute(rows, 3, 10)
