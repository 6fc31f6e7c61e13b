"""Predicates, aggregations and set operations on clip quality records, spans, states and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiloom.functions import geometry as G
from epiloom.functions import text as T
from epiloom.operators import aggregates as A
from epiloom.operators import signal as S
from epiloom.plans.registry import fixed, query, sql_fixed, sql_whole, whole
from epiloom.plans.signals import CE, KEYS, ORDER, contacts
from epiloom.session import load

Q = "q AS (SELECT * FROM quality QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY record_id) = 1)"
SPANS = "sp AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY record_id) = 1)"


def first_delivery(df: DataFrame, key: str) -> DataFrame:
    """The record of the least record_id of each key, by one aggregation."""
    return df.groupBy(key).agg(F.min_by(F.struct("*"), "record_id").alias("_x")).select("_x.*")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(load(spark, sf_dir, "quality"), "clip_id")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(load(spark, sf_dir, "spans"), "span_id")


def listed(*cases: str) -> str:
    return "list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL)"


@query("pred1_window", f"WITH {CE} SELECT event_id FROM ce WHERE t >= 10 AND t < 20")
def pred1(spark, sf_dir):
    """Events in the half-open window from 10 s to 20 s."""
    return contacts(spark, sf_dir).where((F.col("t") >= 10) & (F.col("t") < 20)).select("event_id")


#: Thresholds of the measures, with the code of each test.
LIMITS = [("duration_s < 2.0", "clip_too_short"), ("len_missing > 0", "missing_modality"), ("sharpness_p25 < 4.0", "blurred"), ("brightness_out_frac > 0.30", "brightness_out_of_range"), ("max_wrist_speed > 6.0", "wrist_too_fast"), ("max_head_speed > 4.0", "head_too_fast"), ("max_angular_speed > 15.0", "turning_too_fast"), ("hand_visible_rate < 0.30", "hands_out_of_view"), ("hand_central50_rate < 0.60", "hands_poorly_framed")]


@query("pred2_reject_reasons", f"WITH {Q}, m AS (SELECT *, coalesce(len(missing_topics), 0) AS len_missing FROM q) SELECT clip_id, {listed(*[f'''CASE WHEN {c} THEN '{n}' END''' for c, n in LIMITS])} AS reasons FROM m")
def pred2(spark, sf_dir):
    """The ordered list of reasons for which a clip's measures are out of range; a NULL measure gives none."""
    m = clips(spark, sf_dir).withColumn("len_missing", F.coalesce(F.array_size("missing_topics"), F.lit(0)))
    return m.select("clip_id", T.issues(*[(F.expr(c), n) for c, n in LIMITS]).alias("reasons"))


@query("pred3_exposure", f"WITH {Q} SELECT clip_id, coalesce(brightness_mean < 25 OR brightness_mean > 235 OR saturated_pixel_frac > 0.10 OR crushed_pixel_frac > 0.35, false) AS bad FROM q")
def pred3(spark, sf_dir):
    b = F.col("brightness_mean")
    bad = (b < 25) | (b > 235) | (F.col("saturated_pixel_frac") > 0.10) | (F.col("crushed_pixel_frac") > 0.35)
    return clips(spark, sf_dir).select("clip_id", F.coalesce(bad, F.lit(False)).alias("bad"))


@query(
    "pred4_candidate_flags",
    f"""WITH {Q}, l AS (SELECT *, lag(brightness_mean) OVER w AS b, lag(sharpness_p25) OVER w AS s, row_number() OVER w AS i FROM q WINDOW w AS (PARTITION BY episode ORDER BY start_ts NULLS FIRST, clip_id))
    SELECT clip_id, coalesce(brightness_mean < 40, false) AS dark, coalesce(brightness_mean > 215, false) AS bright, coalesce(sharpness_p25 < 6, false) AS low_detail,
      i > 1 AND coalesce(abs(brightness_mean - b) > 30, false) AS abrupt_change, i > 1 AND coalesce(brightness_mean = b AND sharpness_p25 = s, false) AS identical_adjacent FROM l""",
)
def pred4(spark, sf_dir):
    """Threshold flags of each clip in the order of its episode; the first has no change."""
    w = S.over(["episode"], ["start_ts", "clip_id"])
    c = clips(spark, sf_dir).withColumns({"b": F.lag("brightness_mean").over(w), "s": F.lag("sharpness_p25").over(w), "i": F.row_number().over(w)})
    no = lambda x: F.coalesce(x, F.lit(False))
    m = F.col("brightness_mean")
    later = F.col("i") > 1
    return c.select("clip_id", no(m < 40).alias("dark"), no(m > 215).alias("bright"), no(F.col("sharpness_p25") < 6).alias("low_detail"), (later & no(F.abs(m - F.col("b")) > 30)).alias("abrupt_change"), (later & no((m == F.col("b")) & (F.col("sharpness_p25") == F.col("s")))).alias("identical_adjacent"))


PIX = f"px AS (SELECT event_id, e.k.cx + d * 4000 AS u, e.k.cy + r * 200 AS v, e.k.w AS w, e.k.h AS h FROM ce JOIN episodes e ON ce.episode = e.episode)"


@query("pred5_in_rect", f"WITH {CE}, {PIX} SELECT event_id, coalesce(u >= 0 AND u < w AND v >= 0 AND v < h, false) AS inside, coalesce(u >= w * 0.25 AND u < w - w * 0.25 AND v >= h * 0.25 AND v < h - h * 0.25, false) AS central FROM px")
def pred5(spark, sf_dir):
    """Whether a pixel (made of the event's aperture change and rate) lies in the sensor, and in its central half."""
    j = contacts(spark, sf_dir).join(load(spark, sf_dir, "episodes").select("episode", "k"), "episode")
    u, v = F.col("k.cx") + F.col("d") * 4000, F.col("k.cy") + F.col("r") * 200
    return j.select("event_id", G.in_rect(u, v, F.col("k.w"), F.col("k.h")).alias("inside"), G.in_rect(u, v, F.col("k.w"), F.col("k.h"), 0.25).alias("central"))


@query(
    "pred6_actionness",
    f"""WITH {CE} SELECT event_id, CASE WHEN abs(r) > 0.5 AND v > 0.413 THEN 'manipulate' WHEN v > 0.8 THEN 'reach' WHEN jerk > 20 THEN 'reposition' ELSE 'idle' END AS state,
    {sql_fixed("0.6 * least(greatest(coalesce(v, 0.0) / 0.413, 0.0), 1.0) + 0.4 * least(greatest(abs(coalesce(r, 0.0)) / 0.5, 0.0), 1.0)")} AS score FROM ce""",
)
def pred6(spark, sf_dir):
    """A classification by the first test that holds, and a weighted score of clipped ratios."""
    v, r, one = F.col("v"), F.abs(F.col("r")), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    state = F.when((r > 0.5) & (v > 0.413), "manipulate").when(v > 0.8, "reach").when(F.col("jerk") > 20, "reposition").otherwise("idle")
    score = 0.6 * one(F.coalesce(v, F.lit(0.0)) / 0.413) + 0.4 * one(F.abs(F.coalesce("r", F.lit(0.0))) / 0.5)
    return contacts(spark, sf_dir).select("event_id", state.alias("state"), fixed(score).alias("score"))


@query("pred7_validity", f"WITH {CE} SELECT event_id, jerk IS NULL OR isnan(jerk) AS flag_missing, coalesce(v > 6.0, false) AS flag_speed FROM ce")
def pred7(spark, sf_dir):
    """Validity flags that travel with the row; nothing is filled in."""
    return contacts(spark, sf_dir).select("event_id", (F.col("jerk").isNull() | F.isnan("jerk")).alias("flag_missing"), F.coalesce(F.col("v") > 6.0, F.lit(False)).alias("flag_speed"))


@query("pred8_confidence_gate", "SELECT event_id, max(CASE WHEN state_gate_margin > 0.01 THEN aperture_held END) AS held FROM contact_events GROUP BY event_id")
def pred8(spark, sf_dir):
    """Values whose confidence is too low are blanked; their rows stay."""
    kept = F.when((F.col("state_gate_margin") > 0.01) & ~F.isnan("state_gate_margin"), F.col("aperture_held"))
    return load(spark, sf_dir, "contact_events").groupBy("event_id").agg(F.max(kept).alias("held"))


@query(
    "pred10_span_validator",
    f"""WITH n AS (SELECT record_id, span_id, segment, episode, start_ts, end_ts, duration, v_start, v_end, row_number() OVER (PARTITION BY span_id ORDER BY record_id) AS nth FROM spans),
    o AS (SELECT *, max(v_end) OVER (PARTITION BY segment ORDER BY v_start, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached,
      first_value(start_ts - v_start) OVER (PARTITION BY segment ORDER BY v_start, record_id) AS shift, first_value(episode) OVER (PARTITION BY segment ORDER BY v_start, record_id) AS ep FROM n)
    SELECT record_id, {listed("CASE WHEN span_id IS NULL THEN 'no_id' END", "CASE WHEN nth > 1 THEN 'duplicate_id' END", "CASE WHEN NOT end_ts > start_ts THEN 'not_increasing' END",
      "CASE WHEN abs(end_ts - start_ts - duration) > 0.0031 THEN 'duration' END", "CASE WHEN v_start < reached - 0.0011 THEN 'overlap' END", "CASE WHEN abs(start_ts - v_start - shift) > 0.0031 THEN 'offset' END", "CASE WHEN episode <> ep THEN 'episode' END")} AS issues FROM o""",
)
def pred10(spark, sf_dir):
    """Rules on ids, order and overlap of the spans of a segment; overlap is with the furthest end so far."""
    n = load(spark, sf_dir, "spans").withColumn("nth", F.row_number().over(S.over(["span_id"], ["record_id"])))
    w = Window.partitionBy("segment").orderBy(F.col("v_start").asc_nulls_last(), "record_id")
    o = n.withColumns({"reached": F.max("v_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "shift": F.first(F.col("start_ts") - F.col("v_start")).over(w), "ep": F.first("episode").over(w)})
    a, z = F.col("start_ts"), F.col("end_ts")
    tests = [(F.col("span_id").isNull(), "no_id"), (F.col("nth") > 1, "duplicate_id"), (~(z > a), "not_increasing"), (F.abs(z - a - F.col("duration")) > 0.0031, "duration"), (F.col("v_start") < F.col("reached") - 0.0011, "overlap"), (F.abs(a - F.col("v_start") - F.col("shift")) > 0.0031, "offset"), (F.col("episode") != F.col("ep"), "episode")]
    return o.select("record_id", T.issues(*tests).alias("issues"))


@query(
    "pred12_reply_schema",
    r"""WITH r AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '^\s*```json\s*', ''), '\s*```\s*$', '')) AS j FROM documents WHERE source = 'audit_reply' AND text IS NOT NULL)
    SELECT doc_id, CASE WHEN json_valid(j) THEN coalesce(json_extract_string(j, '$.verdict') IN ('S', 'C', 'U') AND json_extract_string(j, '$.span') IS NOT NULL, false) ELSE false END AS valid FROM r""",
)
def pred12(spark, sf_dir):
    """Whether a reply is one whole JSON object with a span and a known verdict."""
    r = load(spark, sf_dir, "documents").where("source = 'audit_reply' AND text IS NOT NULL")
    j = F.try_parse_json(F.trim(F.regexp_replace(F.regexp_replace("text", r"^\s*```json\s*", ""), r"\s*```\s*$", "")))
    ok = F.try_variant_get(j, "$.verdict", "string").isin("S", "C", "U") & F.try_variant_get(j, "$.span", "string").isNotNull()
    return r.select("doc_id", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("pred13_reply_form", r"SELECT doc_id, regexp_matches(text, '^\s*(```json\s*)?\{\s*\x22span\x22: \x22[0-9]+\x22,\s*\x22verdict\x22: \x22[SCU]\x22') AS ordered FROM documents WHERE source = 'audit_reply' AND text IS NOT NULL")
def pred13(spark, sf_dir):
    """Whether a reply begins with its keys in the order asked for."""
    d = load(spark, sf_dir, "documents").where("source = 'audit_reply' AND text IS NOT NULL")
    return d.select("doc_id", F.col("text").rlike(r'^\s*(```json\s*)?\{\s*"span": "[0-9]+",\s*"verdict": "[SCU]"').alias("ordered"))


@query("pred15_claims", r"SELECT doc_id, regexp_matches(lower(text), '\b(never|whole|entire|always|throughout)\b') AS claims FROM documents WHERE text IS NOT NULL")
def pred15(spark, sf_dir):
    """Texts that claim something of the whole recording."""
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").rlike(r"\b(never|whole|entire|always|throughout)\b").alias("claims"))


@query(
    "pred16_parity",
    """WITH d AS (SELECT clip_id, episode, head_motion, piqe, row_number() OVER (PARTITION BY clip_id ORDER BY record_id) AS i FROM quality), a AS (SELECT * FROM d WHERE i = 1), b AS (SELECT * FROM d WHERE i = 2)
    SELECT count(*) AS compared, count(CASE WHEN a.episode IS NOT DISTINCT FROM b.episode THEN 1 END) AS same_episode, count(CASE WHEN a.head_motion IS NOT DISTINCT FROM b.head_motion THEN 1 END) AS same_motion,
      count(CASE WHEN a.piqe IS NOT DISTINCT FROM b.piqe THEN 1 END) AS same_piqe FROM a JOIN b ON a.clip_id = b.clip_id""",
)
def pred16(spark, sf_dir):
    """Field by field, in how many redelivered clips the second delivery equals the first."""
    d = load(spark, sf_dir, "quality").select("clip_id", "episode", "head_motion", "piqe", F.row_number().over(S.over(["clip_id"], ["record_id"])).alias("i")).where("i <= 2")
    fields = ["episode", "head_motion", "piqe"]
    p = d.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("i") == k, F.struct(*fields))).alias(f"x{k}") for k in (1, 2)]).where("n = 2")
    same = lambda f: F.count_if(F.col(f"x1.{f}").eqNullSafe(F.col(f"x2.{f}")))
    return p.agg(F.count(F.lit(1)).alias("compared"), same("episode").alias("same_episode"), same("head_motion").alias("same_motion"), same("piqe").alias("same_piqe"))


@query("s2_any_flag", "SELECT episode, coalesce(len(list_filter(meta.devices, lambda d: d.modality = 'pose')) > 0, false) AS has_pose FROM episodes")
def s2(spark, sf_dir):
    """Whether any device of the recording delivers poses; False where nothing is known."""
    return load(spark, sf_dir, "episodes").select("episode", F.coalesce(F.exists("meta.devices", lambda d: d["modality"] == "pose"), F.lit(False)).alias("has_pose"))


@query("s3_modality_audit", "SELECT clip_id, list_sort(list_distinct(list_concat(coalesce(missing_topics, []), coalesce(declared_but_undelivered, [])))) AS lacking FROM (SELECT * FROM quality QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY record_id) = 1)")
def s3(spark, sf_dir):
    """Topics that a clip lacks, required or declared."""
    none = F.array().cast("array<string>")
    return clips(spark, sf_dir).select("clip_id", F.array_sort(F.array_union(F.coalesce("missing_topics", none), F.coalesce("declared_but_undelivered", none))).alias("lacking"))


@query("s5_fps", "SELECT episode, coalesce(nullif(meta_fps, 0), nullif(msg_fps, 0), 30.0) AS fps, coalesce(abs(meta_fps - msg_fps) > 1.0, false) AS mismatch FROM episodes")
def s5(spark, sf_dir):
    """The frame rate declared, or measured, or 30; 0 counts as none."""
    zero = F.lit(0.0)
    return load(spark, sf_dir, "episodes").select("episode", F.coalesce(F.nullif(F.col("meta_fps"), zero), F.nullif(F.col("msg_fps"), zero), F.lit(30.0)).alias("fps"), F.coalesce(F.abs(F.col("meta_fps") - F.col("msg_fps")) > 1.0, F.lit(False)).alias("mismatch"))


@query(
    "s14_frame_sampler",
    f"""WITH {SPANS}, b AS (SELECT span_id, CAST(ceil(v_start * 30 - 1e-7) AS BIGINT) AS lo, CAST(ceil(v_end * 30 - 1e-7) AS BIGINT) - 1 AS hi FROM sp WHERE v_end > v_start),
    k AS (SELECT span_id, unnest(range(0, 5)) AS i, lo, hi FROM b WHERE hi >= lo) SELECT DISTINCT span_id, CAST(floor(lo + i * (hi - lo) / 4.0 + 0.5) AS BIGINT) AS frame FROM k""",
)
def s14(spark, sf_dir):
    """Five frames spread evenly over each span at 30 frames a second, each once."""
    lo, hi = F.ceil(F.col("v_start") * 30 - 1e-7), F.ceil(F.col("v_end") * 30 - 1e-7) - 1
    b = spans(spark, sf_dir).where("v_end > v_start").select("span_id", lo.alias("lo"), hi.alias("hi")).where("hi >= lo")
    frames = F.array_distinct(F.array(*[F.floor(F.col("lo") + i * (F.col("hi") - F.col("lo")) / 4.0 + 0.5).cast("bigint") for i in range(5)]))
    return b.select("span_id", F.explode(frames).alias("frame"))


@query("s19_digest", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def s19(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("s25_first_name_match", "SELECT segment, arg_min(x.episode, p) AS episode FROM (SELECT g.segment, e.episode, CASE WHEN g.episode = e.episode THEN 0 WHEN g.episode = e.source_path THEN 1 ELSE 2 END AS p FROM (SELECT DISTINCT segment, episode FROM gold) g JOIN episodes e ON g.episode = e.episode OR g.episode = e.source_path OR lower(trim(g.episode)) = e.episode) x GROUP BY segment")
def s25(spark, sf_dir):
    """The episode that a spelled name means: its name, its path, or its name up to case and space, tried in this order."""
    e = load(spark, sf_dir, "episodes").select(F.col("episode").alias("ep"), "source_path")
    names = e.select(F.col("ep").alias("name"), "ep", F.lit(0).alias("p")).unionAll(e.select("source_path", "ep", F.lit(1)))
    g = load(spark, sf_dir, "gold").select("segment", "episode").distinct()
    exact = g.join(names, g["episode"] == names["name"]).select("segment", "ep", "p")
    loose = g.join(e, F.lower(F.trim("episode")) == F.col("ep")).select("segment", "ep", F.lit(2).alias("p"))
    return exact.unionAll(loose).groupBy("segment").agg(F.min_by("ep", "p").alias("episode"))


@query(
    "a1_distribution",
    f"""WITH {Q} SELECT task, min(piqe) AS piqe_min, {sql_fixed("quantile_cont(piqe, 0.1)")} AS piqe_p10, {sql_fixed("quantile_cont(piqe, 0.5)")} AS piqe_median, {sql_fixed("quantile_cont(piqe, 0.9)")} AS piqe_p90, max(piqe) AS piqe_max FROM q GROUP BY task""",
)
def a1(spark, sf_dir):
    d = clips(spark, sf_dir).groupBy("task").agg(*A.distribution(F.col("piqe"), "piqe"))
    return d.withColumns({c: fixed(F.col(c)) for c in ("piqe_p10", "piqe_median", "piqe_p90")})


@query(
    "a2_clip_windows",
    f"""WITH {CE} SELECT episode, CAST(floor(t / 4) AS BIGINT) AS win, count(*) AS n, max(v) AS peak, {sql_fixed("quantile_cont(v, 0.25)")} AS v_p25, min(d) AS d_min, count(DISTINCT side) AS sides FROM ce GROUP BY 1, 2""",
)
def a2(spark, sf_dir):
    """Records of tumbling windows of four seconds."""
    aggs = [F.count(F.lit(1)).alias("n"), F.max("v").alias("peak"), fixed(F.percentile("v", F.lit(0.25))).alias("v_p25"), F.min("d").alias("d_min"), F.countDistinct("side").alias("sides")]
    return A.tumbling(contacts(spark, sf_dir), ["episode"], "t", 4.0, aggs)


@query(
    "a3_reject_rollup",
    f"""WITH {Q} SELECT episode, CAST(grouping(episode) AS INTEGER) AS level, count(*) AS n, count(CASE WHEN hard_reject THEN 1 END) AS hard, count(CASE WHEN motion_reject THEN 1 END) AS motion, count(CASE WHEN accepted THEN 1 END) AS kept FROM q GROUP BY ROLLUP (episode)""",
)
def a3(spark, sf_dir):
    """Counts of clips by outcome, for each episode and for all."""
    return A.share_rollup(clips(spark, sf_dir), ["episode"], {"hard": F.col("hard_reject"), "motion": F.col("motion_reject"), "kept": F.col("accepted")})


@query("a3_reason_counts", f"WITH {Q} SELECT reason, count(*) AS n FROM (SELECT unnest(reject_reasons) AS reason FROM q) GROUP BY reason")
def a3b(spark, sf_dir):
    return clips(spark, sf_dir).select(F.explode("reject_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a4_time_budget",
    f"""WITH s AS (SELECT DISTINCT episode, state, CAST(floor(start_s * 1000 + 0.5) AS BIGINT) AS a, CAST(floor(end_s * 1000 + 0.5) AS BIGINT) AS z FROM state_spans WHERE end_s > start_s),
    t AS (SELECT state, sum(z - a) AS ms FROM s GROUP BY state) SELECT state, CAST(ms AS BIGINT) AS ms, {sql_fixed("ms::DOUBLE / (SELECT sum(ms) FROM t)")} AS share FROM t""",
)
def a4(spark, sf_dir):
    """The share of time that each state takes."""
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("bigint")
    s = load(spark, sf_dir, "state_spans").where("end_s > start_s").select("episode", "state", ms("start_s").alias("a"), ms("end_s").alias("z")).distinct()
    t = s.groupBy("state").agg(F.sum(F.col("z") - F.col("a")).alias("ms"))
    # The window over all holds one row for each state.
    return t.select("state", "ms", fixed(F.col("ms").cast("double") / F.sum("ms").over(Window.partitionBy())).alias("share"))


@query(
    "a5_sign_test",
    f"""WITH {CE}, b AS (SELECT episode, count(*) AS n, count(CASE WHEN d < 0 THEN 1 END) AS k FROM ce GROUP BY episode HAVING count(*) <= 60),
    i AS (SELECT episode, n, k, unnest(range(k, n + 1)) AS i FROM b)
    SELECT episode, n, k, {sql_fixed("sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))", 5)} AS p FROM i GROUP BY episode, n, k""",
)
def a5(spark, sf_dir):
    """How likely so many closing events are by chance, in episodes of up to 60 events."""
    b = contacts(spark, sf_dir).groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") < 0).alias("k")).where("n <= 60")
    return b.select("episode", "n", "k", fixed(A.sign_test(F.col("k"), F.col("n")), 5).alias("p"))


@query(
    "a5_sign_test_all",
    f"""WITH {CE}, b AS (SELECT episode, count(*) AS n, count(CASE WHEN d < 0 THEN 1 END) AS k FROM ce GROUP BY episode),
    i AS (SELECT episode, n, k, unnest(range(k, n + 1)) AS i FROM b)
    SELECT episode, n, k, {sql_fixed("sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) + 1e-11", 5)} AS p FROM i GROUP BY episode, n, k""",
)
def a5_all(spark, sf_dir):
    """The sign test of every episode, however many events it has; 1e-11 keeps sixty-fourths off the edge of rounding."""
    b = contacts(spark, sf_dir).groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") < 0).alias("k"))
    return A.sign_tails(b, ["episode"], "k", "n").select("episode", "n", "k", fixed(F.col("p") + 1e-11, 5).alias("p"))


@query(
    "a7_pooled_calibration",
    f"""WITH {Q}, p AS (SELECT {sql_fixed("quantile_cont(max_wrist_speed, 0.95) FILTER (accepted)")} AS good_p95, {sql_fixed("quantile_cont(max_wrist_speed, 0.05) FILTER (NOT accepted)")} AS bad_p05 FROM q)
    SELECT good_p95, bad_p05, CASE WHEN good_p95 < bad_p05 THEN (good_p95 + bad_p05) / 2 ELSE 0.6 * bad_p05 END AS floor_value FROM p""",
)
def a7(spark, sf_dir):
    """A threshold between two pooled distributions: half way where they part, else 0.6 of the other's."""
    c, v = clips(spark, sf_dir), F.col("max_wrist_speed")
    p = c.agg(fixed(F.percentile(F.when(F.col("accepted"), v), F.lit(0.95))).alias("good_p95"), fixed(F.percentile(F.when(~F.col("accepted"), v), F.lit(0.05))).alias("bad_p05"))
    g, b = F.col("good_p95"), F.col("bad_p05")
    return p.withColumn("floor_value", F.when(g < b, (g + b) / 2).otherwise(0.6 * b))


@query(
    "a8_rank_auc",
    f"""WITH {Q}, r AS (SELECT task, hard_reject AS pos, rank() OVER (PARTITION BY task ORDER BY piqe) + (count(*) OVER (PARTITION BY task, piqe) - 1) / 2.0 AS r FROM q WHERE piqe IS NOT NULL),
    s AS (SELECT task, count(CASE WHEN pos THEN 1 END) AS n_pos, count(CASE WHEN NOT pos THEN 1 END) AS n_neg, sum(CASE WHEN pos THEN r END) AS sr FROM r GROUP BY task)
    SELECT task, n_pos, n_neg, {sql_fixed("CASE WHEN n_pos >= 5 AND n_neg >= 5 THEN (sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END")} AS auc FROM s""",
)
def a8(spark, sf_dir):
    """How well compression artefacts rank the rejected clips above the others, by task."""
    r = A.rank_auc(clips(spark, sf_dir).where("piqe IS NOT NULL"), ["task"], "piqe", "hard_reject")
    return r.select("task", "n_pos", "n_neg", fixed(F.col("auc")).alias("auc"))


@query(
    "a9_precision_recall",
    f"""WITH {Q}, c AS (SELECT task, count(CASE WHEN motion_reject AND head_motion > 1 THEN 1 END) AS tp, count(CASE WHEN motion_reject AND NOT coalesce(head_motion > 1, false) THEN 1 END) AS fp, count(CASE WHEN NOT motion_reject AND head_motion > 1 THEN 1 END) AS fn FROM q GROUP BY task),
    p AS (SELECT task, tp, fp, fn, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS r FROM c)
    SELECT task, tp, fp, fn, {sql_fixed("p")} AS precision, {sql_fixed("r")} AS recall, {sql_fixed("2 * p * r / nullif(p + r, 0)")} AS f1 FROM p""",
)
def a9(spark, sf_dir):
    """Precision, recall and F1 of the motion filter against a threshold, by task."""
    hit, truth = F.coalesce("motion_reject", F.lit(False)), F.coalesce(F.col("head_motion") > 1, F.lit(False))
    c = clips(spark, sf_dir).groupBy("task").agg(F.count_if(hit & truth).alias("tp"), F.count_if(F.col("motion_reject") & ~truth).alias("fp"), F.count_if(~F.col("motion_reject") & truth).alias("fn"))
    out = c.select("task", "tp", "fp", "fn", *A.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.withColumns({x: fixed(F.col(x)) for x in ("precision", "recall", "f1")})


@query(
    "a10_bimanual_share",
    f"""WITH {CE}, u AS (SELECT *, CAST(floor(t * 1e6 + 0.5) AS BIGINT) AS us FROM ce), e AS (SELECT event_id, episode,
      count(CASE WHEN side = 'left' THEN 1 END) OVER w AS l, count(CASE WHEN side = 'right' THEN 1 END) OVER w AS r, side FROM u WINDOW w AS (PARTITION BY episode, type ORDER BY us RANGE BETWEEN 200000 PRECEDING AND 200000 FOLLOWING))
    SELECT episode, count(*) AS n, count(CASE WHEN (side = 'left' AND r > 0) OR (side = 'right' AND l > 0) THEN 1 END) AS with_partner FROM e GROUP BY episode""",
)
def a10(spark, sf_dir):
    """Events with one of the same type by the other hand within 0.2 s, by a range window instead of a join."""
    us = F.floor(F.col("t") * 1e6 + 0.5).cast("bigint")
    w = Window.partitionBy("episode", "type").orderBy("us").rangeBetween(-200_000, 200_000)
    near = lambda s: F.count_if(F.col("side") == s).over(w)
    e = contacts(spark, sf_dir).withColumn("us", us).withColumns({"l": near("left"), "r": near("right")})
    partner = ((F.col("side") == "left") & (F.col("r") > 0)) | ((F.col("side") == "right") & (F.col("l") > 0))
    return e.groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.count_if(partner).alias("with_partner"))


NORM = "regexp_replace(trim(lower(text)), '[^a-z0-9 ]', '', 'g')"


@query("a11_uniqueness", f"SELECT cls, count(*) AS n, count(DISTINCT {NORM}) AS distinct_texts FROM baseline_vision WHERE text IS NOT NULL GROUP BY cls")
def a11(spark, sf_dir):
    """Distinct normalised captions of each class."""
    b = load(spark, sf_dir, "baseline_vision").where("text IS NOT NULL")
    return b.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(T.normalised(F.col("text"))).alias("distinct_texts"))


@query(
    "a11_top_repeats",
    f"""WITH c AS (SELECT cls, {NORM} AS norm, count(*) AS n, min(record_id) AS o FROM baseline_vision WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, o) AS rank FROM c) SELECT cls, norm, n, rank FROM r WHERE rank <= 5""",
)
def a11b(spark, sf_dir):
    """The five most repeated captions of each class."""
    return A.top_repeats(load(spark, sf_dir, "baseline_vision"), ["cls"], T.normalised(F.col("text")), "record_id")


@query(
    "a12_rarefaction",
    f"""WITH c AS (SELECT {NORM} AS norm, count(*) AS k FROM baseline_vision WHERE text IS NOT NULL GROUP BY 1), t AS (SELECT CAST(sum(k) AS BIGINT) AS n FROM c), f AS (SELECT k, count(*) AS m FROM c GROUP BY k),
    s AS (SELECT unnest([100, 500, 1000]) AS size)
    SELECT size, {sql_fixed("sum(m * (1 - CASE WHEN n - k < size THEN 0.0 ELSE exp(lgamma(n - k + 1) - lgamma(n - k - size + 1) - lgamma(n + 1) + lgamma(n - size + 1)) END))", 2)} AS expected_unique FROM f, t, s WHERE size <= n GROUP BY size""",
)
def a12(spark, sf_dir):
    """The distinct captions expected in a random sample of a size, in closed form from the frequencies of frequencies."""
    c = load(spark, sf_dir, "baseline_vision").where("text IS NOT NULL").groupBy(T.normalised(F.col("text")).alias("norm")).agg(F.count(F.lit(1)).alias("k"))
    f = c.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    f = f.withColumn("n", F.sum(F.col("k") * F.col("m")).over(Window.partitionBy()))  # one row for each frequency
    s = f.withColumn("size", F.explode(F.array(*[F.lit(x) for x in (100, 500, 1000)]))).where("size <= n")
    n, k, z = (F.col(x).cast("double") for x in ("n", "k", "size"))
    # The chance that a text of k copies is missed: a product of (n - k - i) / (n - i) for i below the size.
    miss = F.exp(F.aggregate(F.sequence(F.lit(0), F.col("size") - 1), F.lit(0.0), lambda a, i: a + F.log((n - k - i) / (n - i))))
    missed = F.when(n - k < z, F.lit(0.0)).otherwise(miss)
    return s.groupBy("size").agg(fixed(F.sum(F.col("m") * (1 - missed)), 2).alias("expected_unique"))


@query(
    "a13_grounding",
    """SELECT CASE WHEN lower(trim(verb)) NOT IN ('open', 'close', 'grasp', 'release', 'let go of', 'squeeze') OR ap_trend IS NULL OR ap_trend = 'flat' OR verb IS NULL THEN 'untestable'
      WHEN (lower(trim(verb)) IN ('open', 'release', 'let go of')) = (ap_trend = 'opening') THEN 'agree' ELSE 'conflict' END AS grounding, count(*) AS n FROM baseline_vision GROUP BY 1""",
)
def a13(spark, sf_dir):
    """Whether the verb agrees with the measured opening or closing of the hand."""
    v = F.lower(F.trim("verb"))
    opening, closing = ["open", "release", "let go of"], ["close", "grasp", "squeeze"]
    known = F.coalesce(v.isin(*opening, *closing), F.lit(False)) & F.col("ap_trend").isNotNull() & (F.col("ap_trend") != "flat")
    g = F.when(~known, "untestable").when(v.isin(*opening) == (F.col("ap_trend") == "opening"), "agree").otherwise("conflict")
    return load(spark, sf_dir, "baseline_vision").groupBy(g.alias("grounding")).agg(F.count(F.lit(1)).alias("n"))


WORDS = r"CASE WHEN trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')), ' ')) END"


@query(
    "a14_scorecard",
    f"""WITH c AS (SELECT cls, {NORM} AS norm, {WORDS} AS words, end_ts - start_ts AS d FROM baseline_vision WHERE text IS NOT NULL)
    SELECT cls, count(*) AS captions, count(DISTINCT norm) AS distinct_texts, {sql_fixed("avg(words)")} AS words_mean, min(words) AS words_min, max(words) AS words_max, count(CASE WHEN d BETWEEN 1.3 AND 4.0 THEN 1 END) AS in_band FROM c GROUP BY cls""",
)
def a14(spark, sf_dir):
    """Captions of each class: how many, how different, how long, how many in the duration band."""
    c = load(spark, sf_dir, "baseline_vision").where("text IS NOT NULL").select("cls", T.normalised(F.col("text")).alias("norm"), T.word_count(F.col("text")).alias("words"), (F.col("end_ts") - F.col("start_ts")).alias("d"))
    return c.groupBy("cls").agg(F.count(F.lit(1)).alias("captions"), F.countDistinct("norm").alias("distinct_texts"), fixed(F.avg("words")).alias("words_mean"), F.min("words").alias("words_min"), F.max("words").alias("words_max"), F.count_if(F.col("d").between(1.3, 4.0)).alias("in_band"))


@query(
    "a15_two_arms",
    f"""WITH {SPANS}, a AS (SELECT cls, count(*) AS n, {sql_fixed("quantile_cont(end_ts - start_ts, 0.9)")} AS p90 FROM sp GROUP BY cls), b AS (SELECT cls, count(*) AS n, {sql_fixed("quantile_cont(end_ts - start_ts, 0.9)")} AS p90 FROM baseline_vision GROUP BY cls)
    SELECT a.cls, a.n AS spans, b.n AS captions, a.p90 AS spans_p90, b.p90 AS captions_p90 FROM a JOIN b ON a.cls IS NOT DISTINCT FROM b.cls""",
)
def a15(spark, sf_dir):
    """Numbers and long durations of the two arms, by class."""
    arm = lambda df, n: df.groupBy("cls").agg(F.count(F.lit(1)).alias(n), fixed(F.percentile(F.col("end_ts") - F.col("start_ts"), F.lit(0.9))).alias(f"{n}_p90"))
    a, b = arm(spans(spark, sf_dir), "spans"), arm(load(spark, sf_dir, "baseline_vision"), "captions").withColumnRenamed("cls", "c2")
    return a.join(b, F.col("cls").eqNullSafe(F.col("c2"))).drop("c2")


@query(
    "a18_fraction_summary",
    f"""WITH {Q} SELECT task, count(CASE WHEN coalesce(brightness_out_frac, 0) > 0 THEN 1 END) AS clips_with, {sql_fixed(f"sum({sql_whole('coalesce(brightness_out_frac, 0)', 1e6)} * {sql_whole('duration_s', 1e3)})::DOUBLE / (sum({sql_whole('duration_s', 1e3)})::DOUBLE * 1e6)")} AS weighted FROM q GROUP BY task""",
)
def a18(spark, sf_dir):
    """Clips with any out-of-range frames, and their share weighted by duration; NULL counts as 0."""
    f, d = F.coalesce("brightness_out_frac", F.lit(0.0)), whole(F.col("duration_s"), 1e3)
    return clips(spark, sf_dir).groupBy("task").agg(F.count_if(f > 0).alias("clips_with"), fixed(F.try_divide(F.sum((whole(f, 1e6) * d).cast("decimal(38,0)")).cast("double"), F.sum(d).cast("double") * 1e6)).alias("weighted"))


def _sql_mean(x: str) -> str:
    w = f"{sql_whole(x, 1e6)} * {sql_whole('duration_s', 1e3)}"
    return f"sum({w}) FILTER ({x} IS NOT NULL)::DOUBLE / nullif(sum({sql_whole('duration_s', 1e3)}) FILTER ({x} IS NOT NULL), 0)::DOUBLE / 1e6"


@query(
    "a19_composite",
    f"""WITH {Q}, d AS (SELECT task, {_sql_mean("hand_visible_rate")} AS x, {_sql_mean("hand_central50_rate")} AS y FROM q GROUP BY task)
    SELECT task, {sql_fixed("x * 100", 4)} AS visible, {sql_fixed("y * 100", 4)} AS central, {sql_fixed("(x + y) * 50", 4)} AS overall FROM d""",
)
def a19(spark, sf_dir):
    """Duration-weighted means of two dimensions and their mean; NULL where one was never assessed."""
    d = whole(F.col("duration_s"), 1e3)

    def mean(c):
        known = F.col(c).isNotNull()
        total = F.sum(F.when(known, (whole(F.col(c), 1e6) * d).cast("decimal(38,0)"))).cast("double")
        return F.try_divide(F.try_divide(total, F.sum(F.when(known, d)).cast("double")), F.lit(1e6))

    m = clips(spark, sf_dir).groupBy("task").agg(mean("hand_visible_rate").alias("x"), mean("hand_central50_rate").alias("y"))
    return m.select("task", fixed(F.col("x") * 100, 4).alias("visible"), fixed(F.col("y") * 100, 4).alias("central"), fixed((F.col("x") + F.col("y")) * 50, 4).alias("overall"))


@query(
    "a20_confusion",
    """WITH j AS (SELECT b.uncertain AS u, b.hand AS h, s.hand AS g FROM baseline_vision b JOIN (SELECT DISTINCT span_id, hand FROM spans) s ON b.span_id = s.span_id)
    SELECT count(CASE WHEN NOT u AND h = 'LEFT' AND g = 'LEFT' THEN 1 END) AS tp, count(CASE WHEN NOT u AND h = 'LEFT' AND g <> 'LEFT' THEN 1 END) AS fp, count(CASE WHEN NOT u AND h <> 'LEFT' AND g = 'LEFT' THEN 1 END) AS fn, count(CASE WHEN NOT u AND h <> 'LEFT' AND g <> 'LEFT' THEN 1 END) AS tn, count(CASE WHEN u THEN 1 END) AS abstained FROM j""",
)
def a20(spark, sf_dir):
    """Agreement of captioned and measured hands; uncertain captions abstain."""
    s = load(spark, sf_dir, "spans").select("span_id", F.col("hand").alias("g")).distinct()
    j = load(spark, sf_dir, "baseline_vision").select("span_id", "hand", "uncertain").join(s, "span_id")
    h, g, sure = F.col("hand") == "LEFT", F.col("g") == "LEFT", ~F.col("uncertain")
    return j.agg(F.count_if(sure & h & g).alias("tp"), F.count_if(sure & h & ~g).alias("fp"), F.count_if(sure & ~h & g).alias("fn"), F.count_if(sure & ~h & ~g).alias("tn"), F.count_if("uncertain").alias("abstained"))


@query(
    "a21_longest_gap",
    f"""WITH {CE}, g AS (SELECT episode, t, lead(t) OVER (PARTITION BY episode ORDER BY t, event_id) - t AS gap FROM ce), m AS (SELECT episode, max(gap) AS gap FROM g GROUP BY episode) SELECT episode, {sql_fixed("gap")} AS longest_gap FROM m""",
)
def a21(spark, sf_dir):
    """The longest time of each episode without a detected event between two."""
    c = contacts(spark, sf_dir).withColumn("gap", F.lead("t").over(S.over(["episode"], ["t", "event_id"])) - F.col("t"))
    return c.groupBy("episode").agg(fixed(F.max("gap")).alias("longest_gap"))


@query("a22_motion_summary", f"""WITH {CE} SELECT side, count(*) AS n, count(jerk) AS valid, {sql_fixed("quantile_cont(jerk, 0.5)")} AS jerk_median FROM ce GROUP BY side""")
def a22(spark, sf_dir):
    """Valid values and their median, by side."""
    return contacts(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count("jerk").alias("valid"), fixed(F.percentile("jerk", F.lit(0.5))).alias("jerk_median"))


@query(
    "a23_error_summary",
    f"""WITH {SPANS}, e AS (SELECT cls, CAST(aperture_end_mm AS DOUBLE) AS x, CAST(aperture_mm[2] AS DOUBLE) AS y FROM sp WHERE aperture_end_mm IS NOT NULL AND len(aperture_mm) >= 2 AND aperture_mm[2] IS NOT NULL)
    SELECT cls, count(*) AS n, {sql_fixed("quantile_cont(x - y, 0.5)")} AS bias, {sql_fixed("avg(abs(x - y))")} AS mae, {sql_fixed("avg(CASE WHEN abs(x - y) <= 5 THEN 1.0 ELSE 0.0 END)")} AS within_5 FROM e GROUP BY cls""",
)
def a23(spark, sf_dir):
    """Signed median, mean absolute error and share within 5 mm of two measurements of one aperture."""
    e = spans(spark, sf_dir).select("cls", F.col("aperture_end_mm").cast("double").alias("x"), F.get("aperture_mm", F.lit(1)).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    d = F.col("x") - F.col("y")
    return e.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), fixed(F.percentile(d, F.lit(0.5))).alias("bias"), fixed(F.avg(F.abs(d))).alias("mae"), fixed(F.avg((F.abs(d) <= 5).cast("double"))).alias("within_5"))


@query(
    "a33_ledger",
    """WITH s AS (SELECT DISTINCT episode, span_id FROM spans), c AS (SELECT DISTINCT span_id FROM baseline_vision WHERE text IS NOT NULL)
    SELECT episode, count(*) AS requested, count(c.span_id) AS captioned, list_sort(list(s.span_id) FILTER (c.span_id IS NULL))[1:3] AS first_missing FROM s LEFT JOIN c ON s.span_id = c.span_id GROUP BY episode""",
)
def a33(spark, sf_dir):
    """Requested and captioned spans of each episode, and the first three missing."""
    s = load(spark, sf_dir, "spans").select("episode", "span_id").distinct()
    c = load(spark, sf_dir, "baseline_vision").where("text IS NOT NULL").select(F.col("span_id").alias("c")).distinct()
    j = s.join(c, F.col("span_id") == F.col("c"), "left")
    # Only the first three missing ids of an episode are gathered.
    ranked = j.withColumn("i", F.when(F.col("c").isNull(), F.row_number().over(Window.partitionBy("episode", F.col("c").isNull()).orderBy("span_id"))))
    out = ranked.groupBy("episode").agg(F.count(F.lit(1)).alias("requested"), F.count("c").alias("captioned"), F.array_sort(F.collect_list(F.when(F.col("i") <= 3, F.col("span_id")))).alias("m"))
    return out.select("episode", "requested", "captioned", F.when(F.size("m") > 0, F.col("m")).alias("first_missing"))


@query("o3_top_k", f"WITH {Q} SELECT task, clip_id, rank FROM (SELECT task, clip_id, row_number() OVER (PARTITION BY task ORDER BY head_motion DESC NULLS LAST, clip_id) AS rank FROM q) WHERE rank <= 3")
def o3(spark, sf_dir):
    """The three clips of each task with the most head motion."""
    return S.first_k(clips(spark, sf_dir).select("task", "clip_id", "head_motion"), 3, ["task"], [F.desc_nulls_last("head_motion"), "clip_id"]).select("task", "clip_id", F.col("rank").cast("bigint").alias("rank"))


@query("o4_arg_min", f"WITH {Q} SELECT episode, arg_min(clip_id, (piqe, clip_id)) AS best FROM q WHERE piqe IS NOT NULL GROUP BY episode")
def o4(spark, sf_dir):
    """The clip of each episode with the least (piqe, clip_id)."""
    return clips(spark, sf_dir).where("piqe IS NOT NULL").groupBy("episode").agg(F.min_by("clip_id", F.struct("piqe", "clip_id")).alias("best"))


@query("o6_ordered_distinct", "SELECT text, min(record_id) AS first_id FROM baseline_vision WHERE text IS NOT NULL GROUP BY text")
def o6(spark, sf_dir):
    """Each text at its first occurrence."""
    return load(spark, sf_dir, "baseline_vision").where("text IS NOT NULL").groupBy("text").agg(F.min("record_id").alias("first_id"))


@query("o7_union_all", "SELECT source, count(*) AS n FROM (SELECT 'spans' AS source FROM spans UNION ALL SELECT 'states' FROM state_spans UNION ALL SELECT 'captions' FROM baseline_vision) GROUP BY source")
def o7(spark, sf_dir):
    parts = [load(spark, sf_dir, t).select(F.lit(n).alias("source")) for n, t in (("spans", "spans"), ("states", "state_spans"), ("captions", "baseline_vision"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("o8_difference", "SELECT DISTINCT span_id FROM spans WHERE span_id IS NOT NULL EXCEPT SELECT span_id FROM baseline_vision")
def o8(spark, sf_dir):
    """Spans without any caption."""
    return load(spark, sf_dir, "spans").where("span_id IS NOT NULL").select("span_id").subtract(load(spark, sf_dir, "baseline_vision").select("span_id"))


@query("o8_intersection", "SELECT episode FROM quality INTERSECT SELECT episode FROM contact_events")
def o8b(spark, sf_dir):
    return load(spark, sf_dir, "quality").select("episode").intersect(load(spark, sf_dir, "contact_events").select("episode"))


@query(
    "o9_symmetric",
    """WITH d AS (SELECT clip_id, min(CASE WHEN accepted THEN 1 ELSE 0 END) AS a, max(CASE WHEN head_motion <= 0.5 THEN 1 ELSE 0 END) AS b FROM quality GROUP BY clip_id)
    SELECT clip_id, CASE WHEN b > a THEN 'gained' ELSE 'lost' END AS flip FROM d WHERE a <> b""",
)
def o9(spark, sf_dir):
    """Clips that another rule would gain or lose."""
    one = lambda c: F.when(c, 1).otherwise(0)
    d = load(spark, sf_dir, "quality").groupBy("clip_id").agg(F.min(one(F.col("accepted"))).alias("a"), F.max(one(F.col("head_motion") <= 0.5)).alias("b"))
    return d.where("a <> b").select("clip_id", F.when(F.col("b") > F.col("a"), "gained").otherwise("lost").alias("flip"))


@query("t4_event_windows", "SELECT event_type, CAST(floor(epoch(ts) / 14400) AS BIGINT) AS win, count(*) AS n, " + sql_fixed("sum(value)", 4) + " AS total FROM events GROUP BY 1, 2")
def t4(spark, sf_dir):
    """Tumbling windows of four hours of event time."""
    e = load(spark, sf_dir, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return e.groupBy("event_type", F.floor(F.col("at") / 14400).cast("bigint").alias("win")).agg(F.count(F.lit(1)).alias("n"), fixed(F.sum("value"), 4).alias("total"))


@query("t7_late_rows", "SELECT record_id, date_diff('day', CAST(e.recorded_at AS DATE), CAST(q.ingested_at AS DATE)) AS days FROM quality q JOIN episodes e ON q.episode = e.episode WHERE date_diff('day', CAST(e.recorded_at AS DATE), CAST(q.ingested_at AS DATE)) > 7")
def t7(spark, sf_dir):
    """Clips that arrived over a week after their recording."""
    j = load(spark, sf_dir, "quality").select("record_id", "episode", "ingested_at").join(load(spark, sf_dir, "episodes").select("episode", "recorded_at"), "episode")
    days = F.date_diff(F.to_date("ingested_at"), F.to_date("recorded_at"))
    return j.select("record_id", days.cast("bigint").alias("days")).where("days > 7")


@query("t14_incremental", "SELECT DISTINCT s.span_id FROM spans s WHERE s.ingested_at >= TIMESTAMP '2025-06-01' AND NOT EXISTS (SELECT 1 FROM spans o WHERE o.span_id = s.span_id AND o.ingested_at < TIMESTAMP '2025-06-01')")
def t14(spark, sf_dir):
    """Spans that an earlier run hadn't yet seen."""
    s = load(spark, sf_dir, "spans").select("span_id", "ingested_at")
    cut = F.lit("2025-06-01").cast("timestamp_ntz")
    return s.where(F.col("ingested_at") >= cut).select("span_id").distinct().join(s.where(F.col("ingested_at") < cut), "span_id", "left_anti")
