import math
import os
from fractions import Fraction

import pytest

import __spark_entry__ as entry
from epiloom.operators.aggregates import sign_tail

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("k, n", [(0, 0), (0, 9), (6, 6), (5, 61), (40, 60), (70, 100), (3000, 6031), (1200, 2000), (1500, 1500)])
def test_sign_tail(k, n):
    exact = Fraction(sum(math.comb(n, i) for i in range(k, n + 1)), 2**n)
    if exact < Fraction(1, 10**300):
        assert sign_tail(k, n) < 1e-300
    else:
        assert sign_tail(k, n) == pytest.approx(float(exact), rel=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sign_test_of_large_episodes(spark):
    sizes = [r.n for r in entry.queries()["a5_sign_test_all"](spark, SF).collect()]
    assert max(sizes) > 60
