"""Whole stages, composed of the operators, and agreement of poses with other measurements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epiloom.config import DEFAULT, Settings
from epiloom.operators import aggregates as A
from epiloom.operators import folds, joins
from epiloom.operators import signal as S
from epiloom.plans.ordered import by_episode, troughs, with_minima
from epiloom.plans.records import Q, clips, spans
from epiloom.plans.registry import fixed, query, sql_fixed
from epiloom.plans.signals import CE, KEYS, ORDER, contacts
from epiloom.plans.timejoins import rejected
from epiloom.session import load, stored


def built_spans(spark, sf_dir: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Spans from speed troughs: banded, refined, gated by quality, with the events each holds."""

    def f(s: list, m: list) -> list[tuple[float, float]]:
        samples, low, all_low = folds.Levels(m), folds.Levels(troughs(m, cfg.trough_depth, cfg.trough_gap_s)), folds.Levels(troughs(m, cfg.trough_depth * 0.35))
        out = []
        for a, z in folds.banded(s, samples, all_low, cfg.low_s, cfg.high_s):
            b = [x for x, _, _ in folds.refined([a - cfg.high_s, a, z, z + cfg.high_s], samples, low, cfg.shift_s, cfg.low_s, 2 * cfg.high_s)]
            out.append((b[1], b[2]) if cfg.low_s <= b[2] - b[1] <= cfg.high_s else (a, z))
        return out

    rows = spans(spark, sf_dir).where("end_ts > start_ts")
    made = by_episode(with_minima(spark, sf_dir, rows), f, "a DOUBLE, z DOUBLE").distinct()
    made = stored(made.withColumn("id", F.concat("episode", F.lit("@"), F.format_string("%012.6f", "a"), F.lit("-"), F.format_string("%012.6f", "z"))))  # read three times
    bad = joins.overlap_fraction(made, rejected(spark, sf_dir), ["episode"], ("a", "z"), ("ba", "bz"), "id", 4.0).select("id", "bad_fraction")
    held = joins.points_in_intervals(contacts(spark, sf_dir).select("episode", "t", "type"), made, ["episode"], "t", "a", "z", 4.0).groupBy("id").agg(F.count_if(F.col("type") == "contact").alias("contacts"), F.count_if(F.col("type") == "release").alias("releases"))
    out = made.join(bad, "id").join(held, "id", "left")
    if cfg.quality_gate:
        out = out.where(F.col("bad_fraction") < cfg.bad_share)
    none = F.lit(0).cast("bigint")
    return out.select("id", "episode", "a", "z", "bad_fraction", F.coalesce("contacts", none).alias("contacts"), F.coalesce("releases", none).alias("releases"))


@query("u9_built_spans")
def u9(spark, sf_dir):
    return built_spans(spark, sf_dir)


@query("u10_measured_events")
def u10(spark, sf_dir):
    """Events accepted in turn, each contact paired with the release after it, by hand; the pairs' times and the shares of the states."""
    c = contacts(spark, sf_dir)
    f = lambda p: p.iloc[folds.alternating(p.type.tolist(), p.t.tolist(), DEFAULT.refractory_s)][["event_id", "episode", "side", "type", "t"]]
    taken = folds.grouped(c, KEYS, ORDER, f, "event_id BIGINT, episode STRING, side STRING, type STRING, t DOUBLE")
    w = S.over(KEYS, ORDER)
    pairs = taken.withColumns({"nt": F.lead("type").over(w), "te": F.lead("t").over(w)}).where("type = 'contact' AND nt = 'release'")
    return pairs.groupBy("episode", "side").agg(F.count(F.lit(1)).alias("grasps"), fixed(F.percentile(F.col("te") - F.col("t"), F.lit(0.5))).alias("median_s"))


@query(
    "u11_measured_quality",
    f"""WITH {CE}, w AS (SELECT episode, CAST(floor(t / 4) AS BIGINT) AS win, max(v) AS peak, count(*) AS n FROM ce GROUP BY 1, 2),
    r AS (SELECT *, (row_number() OVER (PARTITION BY episode ORDER BY peak, win) - 1)::DOUBLE / count(*) OVER (PARTITION BY episode) AS p FROM w WHERE peak <= 6)
    SELECT w.episode, w.win, w.n, w.peak > 6 AS hard, coalesce(r.p >= 0.7, false) AS motion, w.peak <= 6 AND coalesce(r.p < 0.7, true) AS accepted FROM w LEFT JOIN r ON w.episode = r.episode AND w.win = r.win""",
)
def u11(spark, sf_dir):
    """Window records, the hard test, then the rank filter among those that passed it: two windows, no join."""
    w = A.tumbling(contacts(spark, sf_dir), ["episode"], "t", DEFAULT.window_s, [F.max("v").alias("peak"), F.count(F.lit(1)).alias("n")])
    hard = F.col("peak") > 6
    part = Window.partitionBy("episode", hard)
    p = (F.row_number().over(part.orderBy("peak", "win")) - 1).cast("double") / F.count(F.lit(1)).over(part)
    motion = ~hard & (F.col("p") >= DEFAULT.reject_share)
    return w.withColumn("p", p).select("episode", "win", "n", hard.alias("hard"), motion.alias("motion"), (~hard & ~motion).alias("accepted"))


@query("u14_stub_captions", "SELECT DISTINCT span_id, 'Hold the object with the ' || CASE hand WHEN 'LEFT' THEN 'left hand' WHEN 'RIGHT' THEN 'right hand' ELSE 'hands' END AS text, 'hold' AS verb, 'stub' AS backend FROM spans")
def u14(spark, sf_dir):
    """Captions by the deterministic stub of a captioning engine: the same plan a model would be called from."""

    def stub(batches):
        names = {"LEFT": "left hand", "RIGHT": "right hand"}
        for p in batches:
            yield pd.DataFrame({"span_id": p.span_id, "text": ["Hold the object with the " + names.get(h, "hands") for h in p.hand], "verb": "hold", "backend": "stub"})

    return load(spark, sf_dir, "spans").select("span_id", "hand").distinct().mapInPandas(stub, "span_id STRING, text STRING, verb STRING, backend STRING")


VECTORS = "p AS (SELECT vec_id, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings)"


@query(
    "a24_pose_agreement",
    f"""WITH j AS (SELECT vec_id, label, embedding AS e, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
    d AS (SELECT label, (sqrt((e[1]::DOUBLE - f[1]::DOUBLE) ** 2 + (e[2]::DOUBLE - f[2]::DOUBLE) ** 2 + (e[3]::DOUBLE - f[3]::DOUBLE) ** 2) + sqrt((e[4]::DOUBLE - f[4]::DOUBLE) ** 2 + (e[5]::DOUBLE - f[5]::DOUBLE) ** 2 + (e[6]::DOUBLE - f[6]::DOUBLE) ** 2)) / 2 AS d FROM j WHERE f IS NOT NULL)
    SELECT label, count(*) AS n, {sql_fixed("quantile_cont(d, 0.5)")} AS mpjpe FROM d GROUP BY label HAVING count(*) >= 8""",
)
def a24(spark, sf_dir):
    """Median over pairs of the mean distance of two joints (dimensions 1 to 3 and 4 to 6), where eight pairs or more are."""
    e = load(spark, sf_dir, "embeddings").withColumn("f", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("f IS NOT NULL")
    sq = lambda i: F.pow(F.element_at("embedding", i).cast("double") - F.element_at("f", i).cast("double"), F.lit(2.0))
    d = (F.sqrt(sq(1) + sq(2) + sq(3)) + F.sqrt(sq(4) + sq(5) + sq(6))) / 2
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), fixed(F.percentile(d, F.lit(0.5))).alias("mpjpe")).where("n >= 8")


def similarity_error(x: np.ndarray, y: np.ndarray) -> float:
    """The mean distance of points y from x after the best rotation, scale and shift of x."""
    a, b = x - x.mean(0), y - y.mean(0)
    u, s, v = np.linalg.svd(a.T @ b)
    sign = np.ones(len(s))
    sign[-1] = np.sign(np.linalg.det(u @ v))
    scale = (s * sign).sum() / max((a * a).sum(), 1e-12)
    return float(np.linalg.norm(scale * a @ (u * sign) @ v - b, axis=1).mean())


@query("a25_aligned_error")
def a25(spark, sf_dir):
    """Each vector as 21 points against the next of its label, after the best similarity: mean distance."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id")).alias("f")).where("f IS NOT NULL")

    def score(batches):
        for p in batches:
            points = lambda c: [np.asarray(v, dtype=np.float64)[:63].reshape(21, 3) for v in p[c]]
            yield pd.DataFrame({"vec_id": p.vec_id, "error": [similarity_error(x, y) for x, y in zip(points("embedding"), points("f"))]})

    return e.mapInPandas(score, "vec_id BIGINT, error DOUBLE")


@query(
    "a31_scale_grid",
    f"""WITH {CE}, g AS (SELECT unnest(range(50, 231)) AS k), x AS (SELECT k, abs(v * k / 100.0 - abs(d) * 10) AS err FROM ce, g), m AS (SELECT k, {sql_fixed("quantile_cont(err, 0.5)")} AS err FROM x GROUP BY k)
    SELECT CAST(arg_min(k, (err, k)) AS BIGINT) AS scale_percent, min(err) AS error FROM m""",
)
def a31(spark, sf_dir):
    """The scale of 181 on a grid with the least median error; every row is tried at every scale, as the grid asks."""
    c = contacts(spark, sf_dir)
    err = lambda k: fixed(F.percentile(F.abs(F.col("v") * k / 100.0 - F.abs("d") * 10), F.lit(0.5)))
    g = c.withColumn("k", F.explode(F.sequence(F.lit(50), F.lit(230)))).groupBy("k").agg(err(F.col("k")).alias("err"))
    return g.agg(F.min_by("k", F.struct("err", "k")).cast("bigint").alias("scale_percent"), F.min("err").alias("error"))


@query(
    "a32_crop",
    f"""WITH {CE}, p AS (SELECT ce.episode, e.k.cx + d * 4000 AS u, e.k.cy + r * 200 AS v, e.k.w AS w, e.k.h AS h FROM ce JOIN episodes e ON ce.episode = e.episode WHERE e.k IS NOT NULL),
    b AS (SELECT episode, min(w) AS w, min(h) AS h, quantile_cont(u, 0.01) AS a, quantile_cont(u, 0.99) AS z, quantile_cont(v, 0.01) AS c, quantile_cont(v, 0.99) AS f FROM p GROUP BY episode)
    SELECT episode, CAST(2 * floor(greatest(a - 20, 0) / 2) AS BIGINT) AS x1, CAST(2 * floor(least(z + 20, w) / 2) AS BIGINT) AS x2, CAST(2 * floor(greatest(c - 20, 0) / 2) AS BIGINT) AS y1, CAST(2 * floor(least(f + 20, h) / 2) AS BIGINT) AS y2 FROM b""",
)
def a32(spark, sf_dir):
    """The rectangle of all but the outermost hundredths of the projected points, padded, inside the frame, at even pixels."""
    j = contacts(spark, sf_dir).join(load(spark, sf_dir, "episodes").where("k IS NOT NULL").select("episode", "k"), "episode")
    u, v = F.col("k.cx") + F.col("d") * 4000, F.col("k.cy") + F.col("r") * 200
    q = lambda c, p: F.percentile(c, F.lit(p))
    b = j.groupBy("episode").agg(F.min("k.w").alias("w"), F.min("k.h").alias("h"), q(u, 0.01).alias("a"), q(u, 0.99).alias("z"), q(v, 0.01).alias("c"), q(v, 0.99).alias("f"))
    even = lambda c: (2 * F.floor(c / 2)).cast("bigint")
    low, high = lambda c: even(F.greatest(F.col(c) - 20, F.lit(0.0))), lambda c, m: even(F.least(F.col(c) + 20, F.col(m)))
    return b.select("episode", low("a").alias("x1"), high("z", "w").alias("x2"), low("c").alias("y1"), high("f", "h").alias("y2"))


@query(
    "f7_rank_copies",
    f"""WITH {Q}, r AS (SELECT clip_id, {", ".join(f"CASE WHEN {c} IS NOT NULL THEN count({c}) OVER (PARTITION BY episode ORDER BY {c} RANGE UNBOUNDED PRECEDING)::DOUBLE / count({c}) OVER (PARTITION BY episode) END AS n_{c}" for c in ("piqe", "head_motion"))}, count(piqe) OVER (PARTITION BY episode) AS a, count(head_motion) OVER (PARTITION BY episode) AS b FROM q)
    SELECT clip_id, {sql_fixed("CASE WHEN a >= 8 THEN n_piqe END")} AS n_piqe, {sql_fixed("CASE WHEN b >= 8 THEN n_head_motion END")} AS n_head_motion FROM r""",
)
def f7(spark, sf_dir):
    """Rank-normalised copies of an episode's features."""
    return clips(spark, sf_dir).select("clip_id", *[fixed(S.percentile_rank(F.col(c), ["episode"])).alias(f"n_{c}") for c in ("piqe", "head_motion")])


@query(
    "f9_camera_to_world",
    f"""WITH {CE}, l AS (SELECT event_id, episode, t, d, r, v FROM ce WHERE side = 'left'), x AS (SELECT episode, t, min(d) AS d FROM ce WHERE side = 'right' GROUP BY episode, t),
    j AS (SELECT l.*, x.d AS shift FROM l ASOF LEFT JOIN x ON l.episode = x.episode AND l.t <= x.t) SELECT event_id, {sql_fixed("d + shift")} AS wx, {sql_fixed("-v + shift")} AS wz FROM j""",
)
def f9(spark, sf_dir):
    """Points lifted by the shift of the next camera row (as-of forward, none past the end), the depth axis flipped."""
    c = contacts(spark, sf_dir)
    left = c.where("side = 'left'").select("event_id", "episode", "t", "d", "v")
    right = c.where("side = 'right'").groupBy("episode", "t").agg(F.min("d").alias("d"))
    j = joins.asof_forward(left, right, ["episode"], "t", ["d"], [], clamp=False)
    return j.select("event_id", fixed(F.col("d") + F.col("r_d")).alias("wx"), fixed(-F.col("v") + F.col("r_d")).alias("wz"))


@query("f28_rounding", "SELECT record_id, floor(start_ts * 1000 + 0.5) / 1000 AS ms, CAST(floor(start_ts * 1000 + 0.5) AS BIGINT) AS whole FROM baseline_vision WHERE start_ts IS NOT NULL")
def f28(spark, sf_dir):
    """Three decimals by the same operations in every engine."""
    b = load(spark, sf_dir, "baseline_vision").where("start_ts IS NOT NULL")
    return b.select("record_id", fixed(F.col("start_ts"), 3).alias("ms"), F.floor(F.col("start_ts") * 1000 + 0.5).cast("bigint").alias("whole"))


@query(
    "j11_nearest_hand",
    f"""WITH {CE}, f AS (SELECT episode, CAST(floor(t) AS BIGINT) AS frame, side, avg(CAST(floor(d * 1e6 + 0.5) AS BIGINT)) AS x FROM ce WHERE side IN ('left', 'right') GROUP BY 1, 2, 3),
    p AS (SELECT episode, frame, max(CASE WHEN side = 'left' THEN x END) AS lx, max(CASE WHEN side = 'right' THEN x END) AS rx FROM f GROUP BY 1, 2)
    SELECT event_id, CASE WHEN lx IS NULL AND rx IS NULL THEN NULL WHEN rx IS NULL THEN 'left' WHEN lx IS NULL THEN 'right' WHEN abs(d * 1e6 - lx) <= abs(d * 1e6 - rx) THEN 'left' ELSE 'right' END AS nearer FROM ce JOIN p ON ce.episode = p.episode AND CAST(floor(t) AS BIGINT) = p.frame""",
)
def j11(spark, sf_dir):
    """Each detection goes to the hand whose mean place in its second is nearer."""
    c = contacts(spark, sf_dir).withColumn("frame", F.floor("t").cast("bigint"))
    micro = F.floor(F.col("d") * 1e6 + 0.5).cast("bigint")
    f = c.where("side IN ('left', 'right')").groupBy("episode", "frame", "side").agg(F.avg(micro).alias("x"))
    p = f.groupBy("episode", "frame").agg(*[F.max(F.when(F.col("side") == s, F.col("x"))).alias(f"{s[0]}x") for s in ("left", "right")])
    x, l, r = F.col("d") * 1e6, F.col("lx"), F.col("rx")
    near = F.when(r.isNull(), "left").when(l.isNull(), "right").when(F.abs(x - l) <= F.abs(x - r), "left").otherwise("right")
    return c.join(p, ["episode", "frame"]).select("event_id", F.when(l.isNotNull() | r.isNotNull(), near).alias("nearer"))


@query("j18_matched_samples", "WITH d AS (SELECT clip_id, accepted, row_number() OVER (PARTITION BY clip_id ORDER BY record_id) AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM quality), m AS (SELECT clip_id, bool_and(accepted) FILTER (i = 1) AS a, bool_and(accepted) FILTER (i = n) AS z FROM d WHERE n > 1 GROUP BY clip_id) SELECT count(*) AS matched, count(CASE WHEN z AND NOT a THEN 1 END) AS gained, count(CASE WHEN a AND NOT z THEN 1 END) AS lost FROM m")
def j18(spark, sf_dir):
    """Clips delivered more than once: gained and lost between the first and the last delivery."""
    m = load(spark, sf_dir, "quality").groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("accepted", "record_id").alias("a"), F.max_by("accepted", "record_id").alias("z")).where("n > 1")
    return m.agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("z") & ~F.col("a")).alias("gained"), F.count_if(F.col("a") & ~F.col("z")).alias("lost"))


@query("j22_edge_boxes", f"WITH {CE}, e AS (SELECT DISTINCT episode, k.w AS w FROM episodes WHERE k IS NOT NULL) SELECT event_id, CASE WHEN x BETWEEN w * 0.35 - 3 AND w * 0.35 + 3 OR x + 40 BETWEEN w * 0.65 - 3 AND w * 0.65 + 3 THEN false ELSE true END AS valid, x < w * 0.65 AS first_tile, x + 40 >= w * 0.35 AS second_tile FROM (SELECT event_id, episode, abs(d) * 8000 AS x FROM ce) b JOIN e USING (episode)")
def j22(spark, sf_dir):
    """Boxes 40 pixels wide against two overlapping tiles: which tiles hold them, and whether they touch a tile's inner edge."""
    e = load(spark, sf_dir, "episodes").where("k IS NOT NULL").select("episode", F.col("k.w").alias("w")).distinct()
    b = contacts(spark, sf_dir).select("event_id", "episode", (F.abs("d") * 8000).alias("x")).join(e, "episode")
    x, w = F.col("x"), F.col("w")
    touches = x.between(w * 0.35 - 3, w * 0.35 + 3) | (x + 40).between(w * 0.65 - 3, w * 0.65 + 3)
    return b.select("event_id", (~touches).alias("valid"), (x < w * 0.65).alias("first_tile"), (x + 40 >= w * 0.35).alias("second_tile"))


@query("w17_activity_troughs")
def w17(spark, sf_dir):
    """Troughs of the greater speed of both hands, in each episode."""
    c = contacts(spark, sf_dir).groupBy("episode", "t").agg(F.max("v").alias("v"))
    f = lambda p: p.iloc[folds.prominent_minima(p.v.to_numpy(), p.t.to_numpy(), 0.14, 1.7)][["episode", "t"]]
    return folds.grouped(c, ["episode"], ["t"], f, "episode STRING, t DOUBLE")
