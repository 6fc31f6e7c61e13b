"""Sequence operators on detected contact events, state spans and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiloom.operators import signal as S
from epiloom.plans.registry import fixed, query, sql_fixed
from epiloom.session import load

KEYS, ORDER = ["episode", "side"], ["t", "event_id"]
CE = """ce AS (SELECT DISTINCT event_id, episode, lower(trim(hand)) AS side, type, t, aperture_delta AS d, aperture_rate AS r, wrist_speed AS v, jerk
  FROM contact_events WHERE t IS NOT NULL AND hand IS NOT NULL)"""
W = "WINDOW w AS (PARTITION BY episode, side ORDER BY t, event_id)"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct detected events that have a time and a hand: one series for each episode and side."""
    rows = load(spark, sf_dir, "contact_events").where("t IS NOT NULL AND hand IS NOT NULL")
    return rows.select("event_id", "episode", F.lower(F.trim("hand")).alias("side"), "type", "t", F.col("aperture_delta").alias("d"), F.col("aperture_rate").alias("r"), F.col("wrist_speed").alias("v"), "jerk").distinct()


@query(
    "w1_box_smooth",
    f"""WITH {CE}, s AS (SELECT event_id, v, count(*) OVER (PARTITION BY episode, side) AS n,
      avg(v) OVER (PARTITION BY episode, side ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM ce)
    SELECT event_id, {sql_fixed("CASE WHEN n < 5 THEN v ELSE m END")} AS smooth FROM s""",
)
def w1(spark, sf_dir):
    return contacts(spark, sf_dir).select("event_id", fixed(S.box_smooth(F.col("v"), 5, KEYS, ORDER)).alias("smooth"))


@query(
    "w2_speed",
    f"""WITH {CE}, s AS (SELECT event_id, t - lag(t) OVER w AS dt, d - lag(d) OVER w AS dd, r - lag(r) OVER w AS dr FROM ce {W})
    SELECT event_id, {sql_fixed("CASE WHEN dt <= 1e-9 THEN 0.0 ELSE sqrt(dd * dd + dr * dr) / dt END")} AS speed FROM s""",
)
def w2(spark, sf_dir):
    c = contacts(spark, sf_dir)
    return c.select("event_id", fixed(S.speed(F.col("t"), [F.col("d"), F.col("r")], KEYS, ORDER)).alias("speed"))


@query(
    "w3_gradient",
    f"""WITH {CE}, s AS (SELECT event_id, v, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, lag(v) OVER w AS b, lead(v) OVER w AS a FROM ce {W})
    SELECT event_id, {sql_fixed('''CASE WHEN hs IS NULL AND hd IS NULL THEN 0.0 WHEN hs IS NULL THEN (a - v) / nullif(hd, 0) WHEN hd IS NULL THEN (v - b) / nullif(hs, 0)
      ELSE (hs * hs * a + (hd * hd - hs * hs) * v - hd * hd * b) / nullif(hs * hd * (hs + hd), 0) END''', 3)} AS slope FROM s""",
)
def w3(spark, sf_dir):
    return contacts(spark, sf_dir).select("event_id", fixed(S.gradient(F.col("t"), F.col("v"), KEYS, ORDER), 3).alias("slope"))


@query(
    "w4_angular_speed",
    f"""WITH q AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS q FROM embeddings),
    u AS (SELECT vec_id, label, q[1] / s AS w, q[2] / s AS x, q[3] / s AS y, q[4] / s AS z FROM (SELECT *, sqrt(q[1]*q[1] + q[2]*q[2] + q[3]*q[3] + q[4]*q[4]) AS s FROM q)),
    d AS (SELECT vec_id, count(*) OVER (PARTITION BY label) AS n, vec_id - lag(vec_id) OVER k AS dt, w * lag(w) OVER k + x * lag(x) OVER k + y * lag(y) OVER k + z * lag(z) OVER k AS dot
      FROM u WINDOW k AS (PARTITION BY label ORDER BY vec_id))
    SELECT vec_id, {sql_fixed("CASE WHEN n >= 3 THEN 2 * acos(least(abs(dot), 1.0)) / dt END", 5)} AS rate FROM d""",
)
def w4(spark, sf_dir):
    """The first four dimensions of each vector as a quaternion, vec_id as the time."""
    e = load(spark, sf_dir, "embeddings")
    q = [F.element_at("embedding", i).cast("double") for i in range(1, 5)]
    e = e.select("vec_id", "label", *[x.alias(f"q{i}") for i, x in enumerate(q)])
    s = F.sqrt(F.col("q0") * F.col("q0") + F.col("q1") * F.col("q1") + F.col("q2") * F.col("q2") + F.col("q3") * F.col("q3"))
    e = e.select("vec_id", "label", *[(F.col(f"q{i}") / s).alias(f"q{i}") for i in range(4)])
    return e.select("vec_id", fixed(S.angular_speed(F.col("vec_id").cast("double"), [F.col(f"q{i}") for i in range(4)], ["label"], ["vec_id"]), 5).alias("rate"))


@query(
    "w5_runs",
    f"""WITH {CE}, f AS (SELECT *, v > 1.0 AS f, row_number() OVER w AS i FROM ce {W}),
    g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY episode, side ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT episode, side, min(i) - 1 AS first, max(i) - 1 AS last, count(*) AS n FROM g WHERE f GROUP BY episode, side, island""",
)
def w5(spark, sf_dir):
    return S.runs(contacts(spark, sf_dir), F.col("v") > 1.0, KEYS, ORDER)


@query(
    "w6_state_runs",
    f"""WITH {CE}, a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR type IS DISTINCT FROM lag(type) OVER w THEN 1 ELSE 0 END AS new FROM ce {W}),
    b AS (SELECT *, sum(new) OVER (PARTITION BY episode, side ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a),
    c AS (SELECT episode, side, k, min(type) AS type, min(t) AS s, max(t) AS l, avg(v) AS m FROM b GROUP BY episode, side, k),
    d AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY episode, side ORDER BY k), l) AS e FROM c)
    SELECT episode, side, type, s AS start, e AS "end", {sql_fixed("m")} AS mean_score FROM d WHERE e - s >= 0.5""",
)
def w6(spark, sf_dir):
    r = S.state_runs(contacts(spark, sf_dir), "type", "t", KEYS, ORDER, 0.5, "v")
    return r.withColumn("mean_score", fixed(F.col("mean_score")))


@query(
    "w7_evidence_ranges",
    f"""WITH {CE}, f AS (SELECT *, d < 0 AS f, row_number() OVER w AS i FROM ce {W}),
    g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY episode, side ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM f),
    h AS (SELECT episode, side, min(t) AS s, max(t) + 0.25 AS e FROM g WHERE f GROUP BY episode, side, island)
    SELECT episode, side, {sql_fixed("s", 4)} AS start, {sql_fixed("e", 4)} AS "end" FROM h WHERE e - s + 1e-8 >= 0.5""",
)
def w7(spark, sf_dir):
    r = S.evidence_ranges(contacts(spark, sf_dir), F.col("d") < 0, "t", 0.25, 0.5, KEYS, ORDER)
    return r.withColumns({"start": fixed(F.col("start"), 4), "end": fixed(F.col("end"), 4)})


@query(
    "w11_percentile_rank",
    f"""WITH {CE}, n AS (SELECT event_id, v, count(v) OVER (PARTITION BY episode, side) AS n, count(v) OVER (PARTITION BY episode, side ORDER BY v RANGE UNBOUNDED PRECEDING) AS c FROM ce)
    SELECT event_id, {sql_fixed("CASE WHEN v IS NOT NULL AND n >= 8 THEN c::DOUBLE / n END")} AS pct FROM n""",
)
def w11(spark, sf_dir):
    return contacts(spark, sf_dir).select("event_id", fixed(S.percentile_rank(F.col("v"), KEYS)).alias("pct"))


@query(
    "w12_motion_rank",
    """WITH q AS (SELECT DISTINCT clip_id, episode, head_motion AS m FROM quality WHERE NOT hard_reject AND head_motion IS NOT NULL),
    r AS (SELECT *, (row_number() OVER (PARTITION BY episode ORDER BY m, clip_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY episode) AS p FROM q)
    SELECT clip_id, p AS pctile, p >= 0.7 AS rejected FROM r""",
)
def w12(spark, sf_dir):
    """0-based rank by head motion among the clips of an episode that count, as a share."""
    q = load(spark, sf_dir, "quality").where(~F.col("hard_reject") & F.col("head_motion").isNotNull()).select("clip_id", "episode", F.col("head_motion").alias("m")).distinct()
    p = (F.row_number().over(S.over(["episode"], ["m", "clip_id"])) - 1).cast("double") / F.count(F.lit(1)).over(Window.partitionBy("episode"))
    return q.withColumn("pctile", p).select("clip_id", "pctile", (F.col("pctile") >= 0.7).alias("rejected"))


@query(
    "w13_state_hold",
    f"""WITH {CE}, u AS (SELECT *, CAST(floor(t * 1e6 + 0.5) AS BIGINT) AS us FROM ce)
    SELECT event_id, {sql_fixed("quantile_cont(v, 0.5) OVER (PARTITION BY episode, side ORDER BY us RANGE BETWEEN CURRENT ROW AND 400000 FOLLOWING)")} AS held FROM u""",
)
def w13(spark, sf_dir):
    """The median of wrist speed over the 0.4 s from each event on."""
    c = contacts(spark, sf_dir).withColumn("us", F.floor(F.col("t") * 1e6 + 0.5).cast("bigint"))
    return c.select("event_id", fixed(S.held_range(F.col("v"), F.col("us"), 400_000, KEYS)).alias("held"))


@query(
    "t5_jerk_snap",
    f"""WITH {CE}, u AS (SELECT *, CAST(floor(t * 1e6 + 0.5) AS BIGINT) AS us FROM ce)
    SELECT event_id, max(jerk) OVER (PARTITION BY episode, side ORDER BY us RANGE BETWEEN 200000 PRECEDING AND 200000 FOLLOWING) AS peak FROM u""",
)
def t5(spark, sf_dir):
    """The greatest jerk within 0.2 s of each event, by a range window on both sides."""
    c = contacts(spark, sf_dir).withColumn("us", F.floor(F.col("t") * 1e6 + 0.5).cast("bigint"))
    return c.select("event_id", F.max("jerk").over(Window.partitionBy(*KEYS).orderBy("us").rangeBetween(-200_000, 200_000)).alias("peak"))


@query(
    "w15_grasp_pairs",
    f"""WITH {CE}, n AS (SELECT *, lead(type) OVER w AS nt, lead(t) OVER w AS te, lead(event_id) OVER w AS ne FROM ce {W})
    SELECT event_id AS contact_id, ne AS release_id, {sql_fixed("te - t")} AS held_s FROM n WHERE type = 'contact' AND nt = 'release'""",
)
def w15(spark, sf_dir):
    """Each contact directly followed by a release of the same hand."""
    w = S.over(KEYS, ORDER)
    c = contacts(spark, sf_dir).withColumns({"nt": F.lead("type").over(w), "te": F.lead("t").over(w), "release_id": F.lead("event_id").over(w)})
    return c.where("type = 'contact' AND nt = 'release'").select(F.col("event_id").alias("contact_id"), "release_id", fixed(F.col("te") - F.col("t")).alias("held_s"))


@query(
    "w20_overlap_adjacent",
    """WITH s AS (SELECT DISTINCT span_id, episode, start_ts AS a, end_ts AS z FROM spans WHERE start_ts IS NOT NULL AND end_ts IS NOT NULL),
    p AS (SELECT *, lag(z) OVER (PARTITION BY episode ORDER BY a, z, span_id) AS before FROM s)
    SELECT span_id, episode FROM p WHERE a < before - 1e-6""",
)
def w20(spark, sf_dir):
    """Labels that begin before the label just before them has ended; only neighbours are compared."""
    s = load(spark, sf_dir, "spans").where("start_ts IS NOT NULL AND end_ts IS NOT NULL").select("span_id", "episode", "start_ts", "end_ts").distinct()
    s = s.withColumn("before", F.lag("end_ts").over(S.over(["episode"], ["start_ts", "end_ts", "span_id"])))
    return s.where(F.col("start_ts") < F.col("before") - 1e-6).select("span_id", "episode")


@query(
    "w21_onsets_first8",
    f"""WITH {CE}, f AS (SELECT *, coalesce(v > 0.8, false) AS f FROM ce), g AS (SELECT *, coalesce(lag(f) OVER w, false) AS b FROM f {W}),
    o AS (SELECT *, CAST(floor(t / 8) AS BIGINT) AS win FROM g WHERE f AND NOT b),
    r AS (SELECT *, row_number() OVER (PARTITION BY episode, side, win ORDER BY t, event_id) AS rank FROM o)
    SELECT episode, side, win, event_id, rank FROM r WHERE rank <= 8""",
)
def w21(spark, sf_dir):
    """Where the hand becomes fast; the first eight onsets of each 8 s window."""
    o = S.onsets(contacts(spark, sf_dir), F.col("v") > 0.8, KEYS, ORDER).withColumn("win", F.floor(F.col("t") / 8).cast("bigint"))
    return S.first_k(o, 8, [*KEYS, "win"], ORDER).select("episode", "side", "win", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "w22_window_plan",
    """WITH e AS (SELECT episode, duration_s AS d, ceil(duration_s / 8) AS w FROM episodes WHERE duration_s > 0)
    SELECT episode, CAST(w AS BIGINT) AS windows, CAST((w - 1) * 12 + least(12, ceil((d - (w - 1) * 8) * 2) + 1) AS BIGINT) AS planned FROM e""",
)
def w22(spark, sf_dir):
    """8 s windows of each episode and the frames to sample in them: min(12, ceil(2 length) + 1) each."""
    e = load(spark, sf_dir, "episodes").where("duration_s > 0").select("episode", F.col("duration_s").alias("d"), F.ceil(F.col("duration_s") / 8).alias("windows"))
    last = F.least(F.lit(12), F.ceil((F.col("d") - (F.col("windows") - 1) * 8) * 2) + 1)
    return e.select("episode", "windows", ((F.col("windows") - 1) * 12 + last).cast("bigint").alias("planned"))


@query(
    "w23_repeats",
    """WITH d AS (SELECT doc_id, source, md5(text) AS h FROM documents WHERE text IS NOT NULL),
    p AS (SELECT *, lag(h) OVER (PARTITION BY source ORDER BY doc_id) AS before, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS nth FROM d)
    SELECT doc_id, coalesce(h = before, false) AS same_as_previous, nth > 1 AND h IS DISTINCT FROM before AS seen_earlier FROM p WHERE nth > 1""",
)
def w23(spark, sf_dir):
    """Texts identical to the one before, or to an earlier one of the source, by digest."""
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.md5("text").alias("h"))
    d = d.withColumns({"before": F.lag("h").over(S.over(["source"], ["doc_id"])), "nth": F.row_number().over(S.over(["source", "h"], ["doc_id"]))}).where("nth > 1")
    return d.select("doc_id", F.coalesce(F.col("h") == F.col("before"), F.lit(False)).alias("same_as_previous"), (~F.col("h").eqNullSafe(F.col("before"))).alias("seen_earlier"))


@query(
    "w24_gaps",
    f"""WITH {CE}, s AS (SELECT event_id, episode, side, t - lag(t) OVER (PARTITION BY episode, side ORDER BY event_id) AS dt FROM ce),
    m AS (SELECT episode, side, quantile_cont(dt, 0.5) FILTER (dt > 0) AS step FROM s GROUP BY episode, side)
    SELECT event_id, CASE WHEN dt <= 0 THEN 'non_monotonic' ELSE 'gap' END AS issue FROM s JOIN m USING (episode, side) WHERE dt <= 0 OR dt > 1.5 * step""",
)
def w24(spark, sf_dir):
    """Steps back in time, and steps of more than 1.5 times the usual one, in order of arrival."""
    c = contacts(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(S.over(KEYS, ["event_id"])))
    step = c.where("dt > 0").groupBy(*KEYS).agg(F.percentile("dt", F.lit(0.5)).alias("step"))
    j = c.join(step, KEYS).where((F.col("dt") <= 0) | (F.col("dt") > 1.5 * F.col("step")))
    return j.select("event_id", F.when(F.col("dt") <= 0, "non_monotonic").otherwise("gap").alias("issue"))


@query(
    "w26_fixed_grid",
    f"""WITH {CE}, g AS (SELECT *, CAST(floor((t + 1e-5) / 0.5) AS BIGINT) AS cell FROM ce), r AS (SELECT *, row_number() OVER (PARTITION BY episode, side, cell ORDER BY t, event_id) AS i FROM g)
    SELECT episode, side, cell, event_id FROM r WHERE i = 1""",
)
def w26(spark, sf_dir):
    """The first sample at or after each deadline of a fixed half-second grid."""
    c = contacts(spark, sf_dir).withColumn("cell", F.floor((F.col("t") + 1e-5) / 0.5).cast("bigint"))
    return S.first_k(c, 1, [*KEYS, "cell"], ORDER).select("episode", "side", "cell", "event_id")


@query(
    "w28_dominant_hand",
    f"""WITH {CE}, s AS (SELECT episode, side, abs(d - lag(d) OVER w) AS step FROM ce {W}), p AS (SELECT episode, side, sum(step) AS path, count(*) AS n FROM s GROUP BY episode, side HAVING count(*) >= 3),
    q AS (SELECT episode, max(CASE WHEN side = 'left' THEN path END) AS l, max(CASE WHEN side = 'right' THEN path END) AS r FROM p GROUP BY episode)
    SELECT e.episode, CASE WHEN l IS NULL AND r IS NULL THEN 'NEITHER' WHEN r IS NULL THEN 'LEFT' WHEN l IS NULL THEN 'RIGHT' WHEN l > 1.6 * r THEN 'LEFT' WHEN r > 1.6 * l THEN 'RIGHT' ELSE 'BOTH' END AS hand
    FROM (SELECT DISTINCT episode FROM ce) e LEFT JOIN q ON e.episode = q.episode""",
)
def w28(spark, sf_dir):
    """The side whose path is more than 1.6 times the other's; BOTH where neither is; sides of under three rows don't count."""
    c = contacts(spark, sf_dir)
    steps = c.withColumn("step", F.abs(F.col("d") - F.lag("d").over(S.over(KEYS, ORDER)))).groupBy(*KEYS).agg(F.sum("step").alias("path"), F.count(F.lit(1)).alias("n"))
    kept = F.when(F.col("n") >= 3, F.col("path"))
    both = steps.groupBy("episode").agg(F.max(F.when(F.col("side") == "left", kept)).alias("l"), F.max(F.when(F.col("side") == "right", kept)).alias("r"))
    l, r = F.col("l"), F.col("r")
    hand = F.when(l.isNull() & r.isNull(), "NEITHER").when(r.isNull(), "LEFT").when(l.isNull(), "RIGHT").when(l > 1.6 * r, "LEFT").when(r > 1.6 * l, "RIGHT").otherwise("BOTH")
    return both.select("episode", hand.alias("hand"))


@query(
    "w29_aperture_trend",
    f"""WITH {CE}, i AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY episode, side) AS n FROM ce {W}), k AS (SELECT *, greatest(2, n // 4) AS k FROM i),
    m AS (SELECT episode, side, max(n) AS n, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.5) FILTER (i <= k) AS a, quantile_cont(v, 0.5) FILTER (i > n - k) AS z FROM k GROUP BY episode, side)
    SELECT episode, side, {sql_fixed("p10")} AS p10, {sql_fixed("p90")} AS p90, CASE WHEN abs(z - a) < 0.006 THEN 'flat' WHEN z > a THEN 'opening' ELSE 'closing' END AS trend FROM m WHERE n >= 3""",
)
def w29(spark, sf_dir):
    """Spread of a series and its trend: the median of its last quarter against that of its first."""
    w = S.over(KEYS, ORDER)
    c = contacts(spark, sf_dir).withColumns({"i": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(*KEYS))}).withColumn("k", F.greatest(F.lit(2), F.floor(F.col("n") / 4)))
    med = lambda c: F.percentile(F.when(c, F.col("v")), F.lit(0.5))
    m = c.groupBy(*KEYS).agg(F.max("n").alias("n"), F.percentile("v", F.lit(0.1)).alias("p10"), F.percentile("v", F.lit(0.9)).alias("p90"), med(F.col("i") <= F.col("k")).alias("a"), med(F.col("i") > F.col("n") - F.col("k")).alias("z"))
    trend = F.when(F.abs(F.col("z") - F.col("a")) < 0.006, "flat").when(F.col("z") > F.col("a"), "opening").otherwise("closing")
    return m.where("n >= 3").select(*KEYS, fixed(F.col("p10")).alias("p10"), fixed(F.col("p90")).alias("p90"), trend.alias("trend"))


@query(
    "w31_span_speed",
    f"""WITH {CE} SELECT episode, {sql_fixed("max(m)", 3)} AS speed FROM (SELECT episode, side, quantile_cont(v, 0.5) AS m FROM ce GROUP BY episode, side) GROUP BY episode""",
)
def w31(spark, sf_dir):
    """The greater of the sides' median wrist speeds."""
    m = contacts(spark, sf_dir).groupBy(*KEYS).agg(F.percentile("v", F.lit(0.5)).alias("m"))
    return m.groupBy("episode").agg(fixed(F.max("m"), 3).alias("speed"))


@query("w32_foote_novelty")
def w32(spark, sf_dir):
    """Checkerboard novelty along the embeddings of each label."""
    return S.foote_novelty(load(spark, sf_dir, "embeddings"), "embedding", "vec_id", ["label"], 4)


@query(
    "o11_stride_sample",
    f"""WITH {CE}, i AS (SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY episode, side) AS n FROM ce {W})
    SELECT event_id FROM i WHERE i % greatest(1, n // 10) = 0""",
)
def o11(spark, sf_dir):
    return S.stride_sample(contacts(spark, sf_dir), 10, KEYS, ORDER).select("event_id")


@query(
    "o10_batches",
    """WITH s AS (SELECT DISTINCT span_id, segment, start_ts FROM spans) SELECT span_id, CAST((row_number() OVER (PARTITION BY segment ORDER BY start_ts, span_id) - 1) // 5 AS BIGINT) AS batch FROM s""",
)
def o10(spark, sf_dir):
    """Groups of five spans in the order of their segment."""
    s = load(spark, sf_dir, "spans").select("span_id", "segment", "start_ts").distinct()
    w = Window.partitionBy("segment").orderBy(F.col("start_ts").asc_nulls_last(), "span_id")
    return s.select("span_id", F.floor((F.row_number().over(w) - 1) / 5).cast("bigint").alias("batch"))


@query(
    "o5_last_context",
    """WITH c AS (SELECT record_id, segment, text, start_ts FROM baseline_vision WHERE text IS NOT NULL AND NOT coalesce(uncertain, false) AND start_ts IS NOT NULL)
    SELECT record_id, coalesce(list(record_id) OVER (PARTITION BY segment ORDER BY start_ts, record_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []) AS context FROM c""",
)
def o5(spark, sf_dir):
    """The last four certain captions of the segment before each caption."""
    c = load(spark, sf_dir, "baseline_vision").where(F.col("text").isNotNull() & ~F.coalesce("uncertain", F.lit(False)) & F.col("start_ts").isNotNull())
    w = S.over(["segment"], ["start_ts", "record_id"]).rowsBetween(-4, -1)
    return c.select("record_id", F.collect_list("record_id").over(w).alias("context"))
