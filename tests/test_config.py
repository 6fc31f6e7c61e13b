import numpy as np
import pytest

from epiloom.config import DEFAULT
from epiloom.plans.pipelines import similarity_error


def test_options_are_read_as_the_type_they_replace():
    s = DEFAULT.with_options({"window_s": "8", "quality_gate": "no", "pose_source": "other"})
    assert (s.window_s, s.quality_gate, s.pose_source) == (8.0, False, "other") and DEFAULT.window_s == 4.0
    with pytest.raises(ValueError):
        DEFAULT.with_options({"nothing": "1"})


def test_similarity_error_is_zero_for_similar_points():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(21, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert similarity_error(x, 2.5 * x @ q + 4) < 1e-9
    assert similarity_error(x, rng.normal(size=(21, 3))) > 0.1
