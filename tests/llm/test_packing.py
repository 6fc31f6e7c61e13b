import random
from collections import defaultdict

import numpy as np

from epiloom.llm.packing import pack, packed


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7) for r in rows], "id BIGINT, n_tokens BIGINT, n_loss BIGINT, batch INT")
    return packed(df, **how).collect()


def test_limits_and_wholeness(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(60, 900), rng.randrange(900, 7000) if i % 40 == 0 else 5]), 0) for i in range(4000)]
    rows = [(i, n, rng.choice([0, n, n // 2])) for i, n, _ in rows]
    got = run(spark, rows, capacity=2048, segments=100, loss_limit=1536, group_items=700)
    size, count, loss = defaultdict(int), defaultdict(int), defaultdict(int)
    pieces = defaultdict(list)
    whole = {i: (n, l) for i, n, l in rows}
    for r in got:
        size[r["batch"]] += r["n_tokens"]
        count[r["batch"]] += 1
        pieces[r["id"]].append((r["start"], r["n_tokens"]))
        n, l = whole[r["id"]]
        own = max(0, min(r["n_tokens"], r["start"] + r["n_tokens"] - (n - l)))
        assert r["n_loss"] == own and r["over"] == (own > 1536)
        loss[r["batch"]] += min(1536, own)
    assert max(size.values()) <= 2048 and max(count.values()) <= 100 and max(loss.values()) <= 1536
    for i, (n, _) in whole.items():
        p = sorted(pieces[i])
        assert sum(k for _, k in p) == n and len(p) == -(-n // 2048)
        assert [s for s, _ in p] == [2048 * j for j in range(len(p))]
    assert sum(size.values()) / (2048 * len(size)) > 0.97  # many tiny items: the segments run out before the tokens


def test_defined_cases(spark):
    got = {tuple(r) for r in run(spark, [(1, 0, 0), (2, None, None), (3, 2048, None), (4, 2049, 9999), (None, 3, -4)])}
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 0, 0), (2, 0, 0), (3, 0, 2048), (4, 0, 2048), (4, 2048, 1), (None, 0, 3)}
    assert {r[0] for r in got if r[5] is None} == {1, 2}
    assert [r[:5] for r in got if r[4]] == [(4, 0, 2048, 2048, True)]
    assert run(spark, []) == []


def test_repeated_items_are_items_each(spark):
    got = run(spark, [(1, 1024, 0)] * 6)
    assert len(got) == 6 and len({r["batch"] for r in got}) == 3


def test_dot_product_prefers_what_is_left():
    # A bin with a loss-bearing item takes the plain one next, since loss has run out.
    batch = pack(np.array([60, 40, 40]), np.array([60, 0, 40]), 100, 10, 60)
    assert batch[0] == batch[1] != batch[2]


def plain(tokens, loss, capacity, segments, loss_limit):
    """The heuristic by a look at every item for every place."""
    left, out, number = set(range(len(tokens))), {}, -1
    while left:
        number += 1
        room, room_loss = capacity, loss_limit
        weight = (sum(loss[i] for i in left) / sum(tokens[i] for i in left) / (sum(loss) / sum(tokens))) ** 4 if sum(loss) else 1.0
        for _ in range(segments):
            fit = [i for i in left if tokens[i] <= room and loss[i] <= room_loss]
            if not fit:
                break
            score = lambda i: (tokens[i] * (room / capacity / capacity) + loss[i] * (weight * room_loss / loss_limit / loss_limit), tokens[i], -i)  # noqa: B023, E731
            i = max(fit, key=score)
            out[i] = number
            left.discard(i)
            room, room_loss = room - tokens[i], room_loss - loss[i]
    return [out[i] for i in range(len(tokens))]


def test_chains_give_the_best_item():
    rng = np.random.default_rng(1)
    for n in (1, 50, 300):
        tokens = rng.integers(1, 90, n)
        loss = np.where(rng.random(n) < 0.5, tokens, rng.integers(0, 90, n) % (tokens + 1)).clip(max=60)
        got = pack(tokens, loss, 100, 4, 60)
        want = plain(tokens.tolist(), loss.tolist(), 100, 4, 60)
        size = lambda b: sorted(zip(np.bincount(b, tokens), np.bincount(b, loss)))  # noqa: B023, E731
        assert size(got) == size(np.array(want))
