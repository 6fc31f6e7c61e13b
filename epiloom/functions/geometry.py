"""Quaternions, projection and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quat_to_matrix(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The nine entries, by row, of the rotation of a quaternion, which is normalised first; the identity for a zero norm."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (F.try_divide(c, n) for c in (w, x, y, z))
    m = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
    return [F.coalesce(c, F.lit(1.0 if i % 4 == 0 else 0.0)) for i, c in enumerate(m)]


def matrix_to_quat(m: list[Column]) -> list[Column]:
    """w, x, y, z of a rotation matrix by the branch with the greatest diagonal, so that nothing small is divided by."""
    a, b, c, d, e, f, g, h, i = m
    t = a + e + i
    s0 = 2 * F.sqrt(F.greatest(t + 1, F.lit(0.0)))
    s1, s2, s3 = (2 * F.sqrt(F.greatest(1 + p - q - r, F.lit(0.0))) for p, q, r in ((a, e, i), (e, a, i), (i, a, e)))
    cases = [
        [s0 / 4, F.try_divide(h - f, s0), F.try_divide(c - g, s0), F.try_divide(d - b, s0)],
        [F.try_divide(h - f, s1), s1 / 4, F.try_divide(b + d, s1), F.try_divide(c + g, s1)],
        [F.try_divide(c - g, s2), F.try_divide(b + d, s2), s2 / 4, F.try_divide(f + h, s2)],
        [F.try_divide(d - b, s3), F.try_divide(c + g, s3), F.try_divide(f + h, s3), s3 / 4],
    ]
    pick = lambda k: F.when(t > 0, cases[0][k]).when((a >= e) & (a >= i), cases[1][k]).when(e >= i, cases[2][k]).otherwise(cases[3][k])
    return [pick(k) for k in range(4)]


def rotate_inverse(m: list[Column], p: list[Column]) -> list[Column]:
    """The transposed matrix times p."""
    return [m[k] * p[0] + m[3 + k] * p[1] + m[6 + k] * p[2] for k in range(3)]


def project(p: list[Column], fx: Column, fy: Column, cx: Column, cy: Column, axis: int = 1) -> list[Column]:
    """Pixel coordinates of a camera-frame point; NULL where it isn't in front along ``axis`` z."""
    z = p[2] * axis
    front = z > 1e-6
    return [F.when(front, fx * p[0] / z + cx), F.when(front, fy * p[1] / z + cy)]


def in_rect(u: Column, v: Column, w: Column, h: Column, margin: float = 0.0) -> Column:
    """Whether a pixel lies inside the sensor less ``margin`` of it on each side; False for NULL and NaN."""
    mx, my = w * margin, h * margin
    return F.coalesce((u >= mx) & (u < w - mx) & (v >= my) & (v < h - my) & ~F.isnan(u) & ~F.isnan(v), F.lit(False))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2, with 1e-9 as the least union."""
    iw = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    ih = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    return iw * ih / F.greatest(area(a) + area(b) - iw * ih, F.lit(1e-9))


def geodesic_angle(m: list[Column], n: list[Column]) -> Column:
    """The angle between two rotations, from the trace of one's transpose times the other."""
    trace = sum((a * b for a, b in zip(m, n)), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))
