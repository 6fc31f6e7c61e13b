"""Alignment, plans, validation and provenance: the smaller operators over several tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epiloom.functions import text as T
from epiloom.operators import joins as J
from epiloom.operators import signal as S
from epiloom.plans.records import LIMITS, Q, SPANS, clips, listed, spans
from epiloom.plans.registry import fixed, query, sql_fixed, sql_whole, whole
from epiloom.plans.signals import CE, KEYS, ORDER, contacts
from epiloom.session import load


@query(
    "a6_boundary_alignment",
    f"""WITH {CE}, {SPANS}, b AS (SELECT DISTINCT episode, start_ts AS t FROM sp WHERE start_ts IS NOT NULL), e AS (SELECT DISTINCT episode, t FROM ce),
    f AS (SELECT b.episode, b.t, e.t AS et FROM b ASOF LEFT JOIN e ON b.episode = e.episode AND b.t <= e.t), k AS (SELECT b.episode, b.t, e.t AS et FROM b ASOF LEFT JOIN e ON b.episode = e.episode AND b.t >= e.t)
    SELECT f.episode, count(*) AS n, {sql_fixed("quantile_cont(least(coalesce(f.et - f.t, 1e9), coalesce(f.t - k.et, 1e9)), 0.5)")} AS median_distance FROM f JOIN k ON f.episode = k.episode AND f.t = k.t WHERE f.et IS NOT NULL OR k.et IS NOT NULL GROUP BY f.episode""",
)
def a6(spark, sf_dir):
    """The median distance of the starts of an episode's spans from the nearest event."""
    b = spans(spark, sf_dir).where("start_ts IS NOT NULL").select("episode", F.col("start_ts").alias("t")).distinct()
    near = J.asof_nearest(b, contacts(spark, sf_dir).select("episode", "t").distinct(), ["episode"], "t", [], [])
    d = near.where("r_t IS NOT NULL").withColumn("d", F.abs(F.col("r_t") - F.col("t")))
    return d.groupBy("episode").agg(F.count(F.lit(1)).alias("n"), fixed(F.percentile("d", F.lit(0.5))).alias("median_distance"))


IN_RANGE = sql_whole("1 - coalesce(saturated_pixel_frac, 0) - coalesce(crushed_pixel_frac, 0)", 1e6)
FRAMES = sql_whole("duration_s * src_fps", 1e2)


@query("a27_pixel_coverage", f"WITH {Q} SELECT episode, {sql_fixed(f'sum({IN_RANGE} * {FRAMES})::DOUBLE / nullif(sum({FRAMES}), 0)::DOUBLE / 1e6')} AS in_range FROM q GROUP BY episode")
def a27(spark, sf_dir):
    """The share of pixels in range, over frames."""
    frames = whole(F.col("duration_s") * F.col("src_fps"), 1e2)
    good = whole(1 - F.coalesce("saturated_pixel_frac", F.lit(0.0)) - F.coalesce("crushed_pixel_frac", F.lit(0.0)), 1e6)
    share = F.try_divide(F.sum((good * frames).cast("decimal(38,0)")).cast("double"), F.sum(frames).cast("double"))
    return clips(spark, sf_dir).groupBy("episode").agg(fixed(F.try_divide(share, F.lit(1e6))).alias("in_range"))


@query("a26_median_ratio", f"""WITH {Q} SELECT task, {sql_fixed("quantile_cont(max_wrist_speed, 0.5) / nullif(quantile_cont(max_head_speed, 0.5), 0)")} AS ratio, bool_and(duration_s > 0) AS all_positive FROM q GROUP BY task""")
def a26(spark, sf_dir):
    """Ratio of two medians and whether a test holds throughout."""
    med = lambda c: F.percentile(c, F.lit(0.5))
    return clips(spark, sf_dir).groupBy("task").agg(fixed(F.try_divide(med("max_wrist_speed"), med("max_head_speed"))).alias("ratio"), F.bool_and(F.col("duration_s") > 0).alias("all_positive"))


@query(
    "s4_shared_timebase",
    f"""WITH {CE}, n AS (SELECT episode, side, t, row_number() OVER w AS i FROM ce WINDOW w AS (PARTITION BY episode, side ORDER BY t, event_id)),
    j AS (SELECT coalesce(l.episode, r.episode) AS episode, coalesce(abs(l.t - r.t) <= 1e-6, false) AS same FROM (SELECT * FROM n WHERE side = 'left') l FULL JOIN (SELECT * FROM n WHERE side = 'right') r ON l.episode = r.episode AND l.i = r.i)
    SELECT episode, bool_and(same) AS shared, count(CASE WHEN same THEN 1 END) AS equal_times FROM j GROUP BY episode""",
)
def s4(spark, sf_dir):
    """Whether both hands have as many samples at the same times: one pivoted aggregation by position."""
    n = contacts(spark, sf_dir).where("side IN ('left', 'right')").withColumn("i", F.row_number().over(S.over(KEYS, ORDER)))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("t")))
    same = F.coalesce(F.abs(side("left") - side("right")) <= 1e-6, F.lit(False))
    return n.groupBy("episode", "i").agg(same.alias("same")).groupBy("episode").agg(F.bool_and("same").alias("shared"), F.count_if("same").alias("equal_times"))


@query(
    "s13_constant_rate",
    f"""WITH {CE}, n AS (SELECT episode, side, t, row_number() OVER w - 1 AS i, first_value(t) OVER w AS t0 FROM ce WINDOW w AS (PARTITION BY episode, side ORDER BY t, event_id))
    SELECT episode, side, bool_and(abs(t - t0 - i / 30.0) <= 0.002) AS constant FROM n GROUP BY episode, side""",
)
def s13(spark, sf_dir):
    """Whether a series lies on a constant grid of 30 a second, within 2 ms."""
    w = S.over(KEYS, ORDER)
    n = contacts(spark, sf_dir).withColumns({"i": F.row_number().over(w) - 1, "t0": F.first("t").over(w)})
    return n.groupBy(*KEYS).agg(F.bool_and(F.abs(F.col("t") - F.col("t0") - F.col("i") / 30.0) <= 0.002).alias("constant"))


@query(
    "s16_verifier_plan",
    f"""WITH {SPANS}, n AS (SELECT span_id, start_ts AS a, end_ts - start_ts AS d, least(16, CAST(ceil((end_ts - start_ts) * 4) AS BIGINT) + 1) AS n FROM sp WHERE end_ts > start_ts),
    k AS (SELECT *, unnest(range(0, n)) AS i FROM n) SELECT span_id, i, {sql_fixed("a + d * i / n")} AS target FROM k""",
)
def s16(spark, sf_dir):
    """The times to look at in each span: min(16, ceil(4 length) + 1), spread over its half-open interval."""
    d = F.col("end_ts") - F.col("start_ts")
    n = spans(spark, sf_dir).where("end_ts > start_ts").select("span_id", F.col("start_ts").alias("a"), d.alias("d"), F.least(F.lit(16).cast("bigint"), F.ceil(d * 4) + 1).alias("n"))
    return n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).select("span_id", "i", fixed(F.col("a") + F.col("d") * F.col("i") / F.col("n")).alias("target"))


@query("s26_stems", "SELECT stem, count(*) AS paths FROM (SELECT DISTINCT regexp_replace(regexp_replace(source_path, '^.*/', ''), '\\.[^.]*$', '') AS stem, source_path FROM quality WHERE source_path IS NOT NULL) GROUP BY stem")
def s26(spark, sf_dir):
    """The stem of every recording's path, and how many paths share it."""
    stem = F.regexp_replace(F.regexp_replace("source_path", "^.*/", ""), r"\.[^.]*$", "")
    return load(spark, sf_dir, "quality").where("source_path IS NOT NULL").select(stem.alias("stem"), "source_path").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("paths"))


@query("s27_unknown_references", "SELECT DISTINCT cls FROM spans WHERE cls IS NOT NULL AND cls NOT IN (SELECT cls FROM class_packs WHERE cls IS NOT NULL)")
def s27(spark, sf_dir):
    """Classes in use that the specification doesn't know."""
    return load(spark, sf_dir, "spans").where("cls IS NOT NULL").select("cls").distinct().join(load(spark, sf_dir, "class_packs").select("cls"), "cls", "left_anti")


HMS = "CAST(CAST(floor(start_ts) AS BIGINT) // 3600 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(start_ts) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(start_ts) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


@query("s29_timecodes", f"WITH c AS (SELECT record_id, {HMS} AS code FROM baseline_vision WHERE start_ts >= 0) SELECT record_id, code, CAST(string_split(code, ':')[1] AS BIGINT) * 3600 + CAST(string_split(code, ':')[2] AS BIGINT) * 60 + CAST(string_split(code, ':')[3] AS BIGINT) AS seconds FROM c")
def s29(spark, sf_dir):
    """Seconds as H:MM:SS and back."""
    s = F.floor("start_ts")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    code = F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    part = lambda i: F.get(F.split("code", ":"), F.lit(i)).cast("bigint")
    return load(spark, sf_dir, "baseline_vision").where("start_ts >= 0").select("record_id", code.alias("code")).select("record_id", "code", (part(0) * 3600 + part(1) * 60 + part(2)).alias("seconds"))


@query("s32_source_switch", f"WITH {SPANS} SELECT span_id, coalesce(pose_source, 'shipped') AS source, CASE WHEN coalesce(pose_source, 'shipped') = 'shipped' THEN wrist_speed END AS speed FROM sp")
def s32(spark, sf_dir):
    """One source's measures, the other's rows blank."""
    source = F.coalesce("pose_source", F.lit("shipped"))
    return spans(spark, sf_dir).select("span_id", source.alias("source"), F.when(source == "shipped", F.col("wrist_speed")).alias("speed"))


@query(
    "w27_net_change",
    f"""WITH {CE}, s AS (SELECT episode, side, sum(d) AS net, sum(abs(d)) AS total, count(*) AS n FROM ce GROUP BY episode, side)
    SELECT episode, side, {sql_fixed("net")} AS net, CASE WHEN n < 4 THEN NULL WHEN abs(net) >= 0.05 AND abs(net) >= 0.2 * total THEN CASE WHEN net > 0 THEN 'opening' ELSE 'closing' END ELSE 'none' END AS direction FROM s""",
)
def w27(spark, sf_dir):
    """The net change of a series and its direction, where it is large and coherent; NULL for under four rows."""
    s = contacts(spark, sf_dir).groupBy(*KEYS).agg(F.sum("d").alias("net"), F.sum(F.abs("d")).alias("total"), F.count(F.lit(1)).alias("n"))
    a = F.abs("net")
    way = F.when(F.col("n") < 4, None).when((a >= 0.05) & (a >= 0.2 * F.col("total")), F.when(F.col("net") > 0, "opening").otherwise("closing")).otherwise("none")
    return s.select(*KEYS, fixed(F.col("net")).alias("net"), way.alias("direction"))


@query(
    "w30_relative_state",
    f"""WITH {SPANS}, v AS (SELECT span_id, episode, CAST(aperture_mm[1] AS DOUBLE) AS a FROM sp WHERE len(aperture_mm) > 0 AND aperture_mm[1] IS NOT NULL),
    e AS (SELECT episode, quantile_cont(a, 0.85) AS hi, quantile_cont(a, 0.2) AS lo FROM v GROUP BY episode)
    SELECT span_id, CASE WHEN a < 22 AND a < lo THEN 'pinch' WHEN a >= hi THEN 'extended' ELSE 'between' END AS state FROM v JOIN e USING (episode)""",
)
def w30(spark, sf_dir):
    """A span's aperture against the percentiles of its whole episode."""
    v = spans(spark, sf_dir).select("span_id", "episode", F.get("aperture_mm", F.lit(0)).cast("double").alias("a")).where("a IS NOT NULL")
    e = v.groupBy("episode").agg(F.percentile("a", F.lit(0.85)).alias("hi"), F.percentile("a", F.lit(0.2)).alias("lo"))
    state = F.when((F.col("a") < 22) & (F.col("a") < F.col("lo")), "pinch").when(F.col("a") >= F.col("hi"), "extended").otherwise("between")
    return v.join(e, "episode").select("span_id", state.alias("state"))


@query("f4_axis", f"WITH {Q}, m AS (SELECT episode, quantile_cont(hand_offaxis_deg, 0.5) FILTER (hand_fov_axis = '+z') AS p, quantile_cont(hand_offaxis_deg, 0.5) FILTER (hand_fov_axis = '-z') AS n FROM q GROUP BY episode) SELECT episode, CASE WHEN n < p OR p IS NULL AND n IS NOT NULL THEN '-z' ELSE '+z' END AS axis FROM m")
def f4(spark, sf_dir):
    """The camera axis with the smaller median angle; ties and nothing at all go to +z."""
    med = lambda a: F.percentile(F.when(F.col("hand_fov_axis") == a, F.col("hand_offaxis_deg")), F.lit(0.5))
    m = clips(spark, sf_dir).groupBy("episode").agg(med("+z").alias("p"), med("-z").alias("n"))
    p, n = F.col("p"), F.col("n")
    return m.select("episode", F.when((n < p) | (p.isNull() & n.isNotNull()), "-z").otherwise("+z").alias("axis"))


VEC = "v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d, embedding[5]::DOUBLE AS e, embedding[6]::DOUBLE AS f FROM embeddings), u AS (SELECT *, a / n AS x, b / n AS y, c / n AS z FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM v)), w AS (SELECT *, d * x + e * y + f * z AS k FROM u)"


@query("f6_canonical_frame", f"WITH {VEC}, g AS (SELECT vec_id, x, y, z, d - k * x AS p, e - k * y AS q, f - k * z AS r FROM w) SELECT vec_id, {sql_fixed('x', 5)} AS x0, {sql_fixed('y', 5)} AS x1, {sql_fixed('z', 5)} AS x2, {sql_fixed('p / sqrt(p * p + q * q + r * r)', 5)} AS y0, {sql_fixed('q / sqrt(p * p + q * q + r * r)', 5)} AS y1, {sql_fixed('r / sqrt(p * p + q * q + r * r)', 5)} AS y2 FROM g")
def f6(spark, sf_dir):
    """Two orthonormal axes from two vectors: the first normalised, the second made upright to it."""
    col = lambda i: F.element_at("embedding", i).cast("double")
    v = load(spark, sf_dir, "embeddings").select("vec_id", *[col(i + 1).alias(n) for i, n in enumerate("abcdef")])
    norm = lambda p, q, r: F.sqrt(p * p + q * q + r * r)
    n = norm(*[F.col(c) for c in "abc"])
    u = v.withColumns({"x": F.col("a") / n, "y": F.col("b") / n, "z": F.col("c") / n})
    k = F.col("d") * F.col("x") + F.col("e") * F.col("y") + F.col("f") * F.col("z")
    g = u.withColumns({"p": F.col("d") - k * F.col("x"), "q": F.col("e") - k * F.col("y"), "r": F.col("f") - k * F.col("z")})
    m = norm(*[F.col(c) for c in "pqr"])
    return g.select("vec_id", *[fixed(F.col(c), 5).alias(f"x{i}") for i, c in enumerate("xyz")], *[fixed(F.col(c) / m, 5).alias(f"y{i}") for i, c in enumerate("pqr")])


@query("f23_packs", "SELECT coalesce(p.pack, 'core') AS pack, count(*) AS captions, count(DISTINCT lower(trim(b.verb))) AS verbs FROM baseline_vision b LEFT JOIN class_packs p ON b.cls = p.cls GROUP BY 1")
def f23(spark, sf_dir):
    """Captions and distinct verbs of each vocabulary pack; classes without one count as 'core'."""
    p = load(spark, sf_dir, "class_packs").select("cls", F.col("pack").alias("p"))
    b = load(spark, sf_dir, "baseline_vision").select("cls", "verb").join(p, "cls", "left")
    return b.groupBy(F.coalesce("p", F.lit("core")).alias("pack")).agg(F.count(F.lit(1)).alias("captions"), F.countDistinct(F.lower(F.trim("verb"))).alias("verbs"))


@query("f24_reply_objects", r"SELECT doc_id, len(regexp_extract_all(text, '\x22reason\x22:')) AS objects, regexp_extract(text, '\x22span\x22: \x22([0-9]+)\x22', 1) AS span FROM documents WHERE source = 'audit_reply' AND text IS NOT NULL")
def f24(spark, sf_dir):
    """Objects and the span's id found anywhere in a reply, whole or not."""
    d = load(spark, sf_dir, "documents").where("source = 'audit_reply' AND text IS NOT NULL")
    return d.select("doc_id", F.regexp_count("text", F.lit('"reason":')).cast("bigint").alias("objects"), F.regexp_extract("text", r'"span": "([0-9]+)"', 1).alias("span"))


@query("f26_prompts", f"WITH {SPANS} SELECT span_id, concat_ws('; ', 'class: ' || cls, 'hand: ' || lower(hand), 'rotation: ' || rotation, 'trend: ' || ap_trend) AS prompt FROM sp")
def f26(spark, sf_dir):
    """Measured facts of a span as one line; unknown ones are left out."""
    part = lambda n, c: F.concat(F.lit(f"{n}: "), c)
    return spans(spark, sf_dir).select("span_id", F.concat_ws("; ", part("class", F.col("cls")), part("hand", F.lower("hand")), part("rotation", F.col("rotation")), part("trend", F.col("ap_trend"))).alias("prompt"))


@query("j19_single_match", "WITH m AS (SELECT b.record_id, count(s.record_id) AS n FROM baseline_vision b LEFT JOIN spans s ON b.segment = s.segment AND b.start_ts = s.start_ts AND b.end_ts = s.end_ts GROUP BY b.record_id) SELECT record_id, n = 1 AS single FROM m")
def j19(spark, sf_dir):
    """Captions whose segment and times are exactly those of one delivered span."""
    s = load(spark, sf_dir, "spans").groupBy("segment", "start_ts", "end_ts").agg(F.count(F.lit(1)).alias("n"))
    b = load(spark, sf_dir, "baseline_vision").select("record_id", "segment", "start_ts", "end_ts").join(s, ["segment", "start_ts", "end_ts"], "left")
    return b.select("record_id", (F.coalesce("n", F.lit(0)) == 1).alias("single"))


@query("pred11_exclusions", "SELECT CASE WHEN text IS NULL THEN 'no_text' WHEN uncertain IS NULL THEN 'unknown' WHEN uncertain THEN 'uncertain' WHEN visibility = 'OUT_OF_FRAME' THEN 'out_of_frame' ELSE 'kept' END AS reason, count(*) AS n FROM baseline_vision GROUP BY 1")
def pred11(spark, sf_dir):
    """Why captions are left out of a comparison; the first reason that holds."""
    r = F.when(F.col("text").isNull(), "no_text").when(F.col("uncertain").isNull(), "unknown").when(F.col("uncertain"), "uncertain").when(F.col("visibility") == "OUT_OF_FRAME", "out_of_frame").otherwise("kept")
    return load(spark, sf_dir, "baseline_vision").groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("o1_sorted_positions", f"WITH {SPANS} SELECT span_id, row_number() OVER (PARTITION BY episode ORDER BY start_ts NULLS LAST, duration DESC NULLS LAST, span_id) AS position FROM sp")
def o1(spark, sf_dir):
    """Positions under a sort by start, longest first, then id."""
    w = Window.partitionBy("episode").orderBy(F.col("start_ts").asc_nulls_last(), F.col("duration").desc_nulls_last(), "span_id")
    return spans(spark, sf_dir).select("span_id", F.row_number().over(w).cast("bigint").alias("position"))


@query("o2_top_report", f"WITH {Q} SELECT clip_id, head_motion FROM q WHERE head_motion IS NOT NULL ORDER BY head_motion DESC, clip_id LIMIT 25")
def o2(spark, sf_dir):
    """The 25 clips with the most head motion: a top-k report."""
    return clips(spark, sf_dir).where("head_motion IS NOT NULL").orderBy(F.desc("head_motion"), "clip_id").limit(25).select("clip_id", "head_motion")


@query(
    "t11_best_candidate",
    """WITH e AS (SELECT span_id, record_id, CASE WHEN text IS NULL THEN 1 ELSE 0 END + CASE WHEN verb IS NULL THEN 1 ELSE 0 END + CASE WHEN noun IS NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(uncertain, true) THEN 1 ELSE 0 END AS errors FROM baseline_vision)
    SELECT span_id, arg_min(record_id, (errors, record_id)) AS record_id, CAST(min(errors) AS INTEGER) AS errors FROM e GROUP BY span_id""",
)
def t11(spark, sf_dir):
    """Of all attempts at a span the one with strictly fewest errors; the earliest on a tie."""
    bad = lambda c: F.when(c, 1).otherwise(0)
    errors = bad(F.col("text").isNull()) + bad(F.col("verb").isNull()) + bad(F.col("noun").isNull()) + bad(F.coalesce("uncertain", F.lit(True)))
    e = load(spark, sf_dir, "baseline_vision").select("span_id", "record_id", errors.alias("errors"))
    return e.groupBy("span_id").agg(F.min_by("record_id", F.struct("errors", "record_id")).alias("record_id"), F.min("errors").alias("errors"))


FAULTS = [("clean", 4.0, 9.0, 1.0), ("short", 1.0, 9.0, 1.0), ("blurred", 4.0, 1.0, 1.0), ("fast", 4.0, 9.0, 7.0), ("all", 0.5, 0.0, 99.0), ("unmeasured", None, None, None)]
KNOWN = [x for x in LIMITS if x[0].split()[0] in ("duration_s", "sharpness_p25", "max_wrist_speed")]


@query("u12_fault_injection", f"WITH f(fault, duration_s, sharpness_p25, max_wrist_speed) AS (VALUES {', '.join('(' + repr(f[0]) + ', ' + ', '.join('NULL' if x is None else str(x) for x in f[1:]) + ')' for f in FAULTS)}) SELECT fault, {listed(*[f'''CASE WHEN {c} THEN '{n}' END''' for c, n in KNOWN])} AS reasons FROM f")
def u12(spark, sf_dir):
    """Synthetic faults through the reject predicates."""
    f = spark.createDataFrame(FAULTS, "fault STRING, duration_s DOUBLE, sharpness_p25 DOUBLE, max_wrist_speed DOUBLE")
    return f.select("fault", T.issues(*[(F.expr(c), n) for c, n in KNOWN]).alias("reasons"))
