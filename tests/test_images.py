import numpy as np

from epiloom.functions import images as I
from pyspark.sql import functions as F


def frame(seed=0, h=48, w=64):
    return np.random.default_rng(seed).integers(0, 256, (h, w), dtype=np.uint8)


def test_laplacian_against_loops():
    g = frame(h=6, w=7)
    want = [[sum(int(g[i + a, j + b]) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))) - 4 * int(g[i, j]) for j in range(1, 6)] for i in range(1, 5)]
    assert I.laplacian(g).tolist() == want


def test_sharpness_leaves_flat_tiles_out():
    g = np.full((60, 80), 100, dtype=np.uint8)
    assert I.sharpness(g) == (0.0, True)
    g[:, :60] = frame(h=60, w=60)
    value, poor = I.sharpness(g)
    assert value > 1000 and not poor


def test_hash_survives_brightness_and_not_other_frames():
    a = (frame(1) // 2).astype(np.uint8)
    assert I.perceptual_hash(a) == I.perceptual_hash(a + 40) and len(I.perceptual_hash(a)) == 63
    assert sum(x != y for x, y in zip(I.perceptual_hash(a), I.perceptual_hash(frame(2)))) > 15


def test_block_quality():
    assert np.isnan(I.block_quality(np.full((32, 32), 9, dtype=np.uint8)))
    assert 0 <= I.block_quality(frame()) <= 100


def test_udf(spark):
    g = frame()
    rows = [(1, bytes(g.tobytes()), 64, 48), (2, None, 64, 48), (3, b"ab", 64, 48)]
    df = spark.createDataFrame(rows, "id INT, gray BINARY, w INT, h INT").select("id", I.frame_metrics("gray", "w", "h").alias("m")).select("id", "m.*")
    got = {r["id"]: r for r in df.collect()}
    assert abs(got[1]["mean"] - g.mean()) < 1e-9 and got[2]["mean"] is None and got[3]["phash"] is None
    d = df.where("id = 1").select(I.hash_distance(F.col("phash"), F.reverse("phash")).alias("d")).collect()[0][0]
    p = got[1]["phash"]
    assert abs(d - sum(a != b for a, b in zip(p, p[::-1])) / 63) < 1e-12
