import itertools
import random

import numpy as np

from epiloom.operators.joins import duplicate_pairs


def brute(clips):
    for (i, fa, da, na, ta, sa), (j, fb, db, nb, tb, sb) in itertools.combinations(clips, 2):
        if fa == fb:
            yield i, j, "identical_file"
        elif da and da == db and na == nb and abs(ta - tb) < 0.05:
            yield i, j, "identical_decoded_frames"
        elif abs(ta - tb) < max(0.15, ta * 0.03) and len(sa) >= 3 and len(sb) >= 3:
            aa, bb = ([s[k] for k in np.linspace(0, len(s) - 1, 8).round().astype(int)] for s in (sa, sb))
            ds = [sum(x != y for x, y in zip(u[0], v[0])) / 63 for u, v in zip(aa, bb)]
            if max(ds) <= 0.18 and np.mean(ds) <= 0.10 and min(u[1] for u in aa + bb) > 8:
                yield i, j, "near_duplicate_candidate"


def test_three_kinds(spark):
    rng = random.Random(15)
    flip = lambda h, n: "".join(str(1 - int(c)) if i in n else c for i, c in enumerate(h))
    clips = []
    for i in range(90):
        if i % 3 == 0 or rng.random() < 0.2:
            base = [("".join(rng.choice("01") for _ in range(63)), 20.0) for _ in range(rng.choice([2, 3, 8, 11]))]
            t0 = rng.choice([1.0, 4.9, 5.1, 40.0])
        samples = [(flip(h, set(rng.sample(range(63), rng.choice([0, 4, 6, 7, 11, 12])))), c if rng.random() < 0.99 else 8.0) for h, c in base]
        clips.append((i, f"f{rng.randrange(60)}", rng.choice([None, f"d{rng.randrange(12)}"]), rng.choice([10, 11]), t0 * rng.choice([1, 1.02, 0.971, 1.04]), samples))
    df = spark.createDataFrame(clips, "id BIGINT, file_hash STRING, decoded_hash STRING, frame_count INT, duration DOUBLE, samples ARRAY<STRUCT<hash: STRING, contrast: DOUBLE>>")
    want = set(brute(clips))
    assert {k for _, _, k in want} == {"identical_file", "identical_decoded_frames", "near_duplicate_candidate"}
    assert {(r.left_id, r.right_id, r.kind) for r in duplicate_pairs(df).collect()} == want
