"""Scalar functions and label rules over captions, documents, embeddings and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epiloom.functions import geometry as G
from epiloom.functions import labels as L
from epiloom.functions import text as T
from epiloom.plans.records import listed
from epiloom.plans.registry import fixed, query, sql_fixed
from epiloom.plans.signals import CE, contacts
from epiloom.session import load

WORDS = r"CASE WHEN trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')), ' ')) END"
VERBS = "len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w IN (" + ", ".join(f"'{v}'" for v in L.VERBS) + ")))"
inlist = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
FIRST = r"regexp_extract({}, '^\s*(\S+)', 1)"
RULES = [
    ("d <= 0", "A1_empty"), ("d > 0 AND d < 1.3", "A1_short"), ("d > 4.0", "A1_long"), ("words < 6 AND NOT coalesce(uncertain, false)", "A2_few_words"), ("words > 15", "A2_many_words"), ("verbs = 0", "A3_no_verb"), ("verbs > 1", "A3_many_verbs"),
    ("NOT contains(lower(text), lower(trim(verb)))", "A4_verb_not_in_text"), ("NOT contains(lower(text), lower(trim(noun)))", "A4_noun_not_in_text"), (f"hand NOT IN {inlist(L.HANDS)}", "A5_hand"), (f"visibility NOT IN {inlist(L.VISIBILITY)}", "A5_visibility"),
    (f"regexp_matches(lower(text), '{L.BANNED}')", "A6_phrasing"), (f"NOT regexp_matches({FIRST.format('text')}, '^[A-Z][a-z]+$')", "A7_first_word"), (f"regexp_matches({FIRST.format('lower(text)')}, '^[a-z]+ing$')", "A7_gerund"), ("rotation = 'clockwise' AND contains(lower(text), 'counter-clockwise')", "A9_rotation"),
]


@query(
    "lint_rules",
    f"""WITH c AS (SELECT *, end_ts - start_ts AS d, {WORDS} AS words, {VERBS} AS verbs FROM baseline_vision),
    m AS (SELECT *, {listed(*[f"CASE WHEN {f} IS NULL THEN 'A0_{f}' END" for f in L.FIELDS])} AS missing FROM c)
    SELECT record_id, CASE WHEN len(missing) > 0 THEN missing ELSE {listed(*[f"CASE WHEN {t} THEN '{n}' END" for t, n in RULES])} END AS issues FROM m""",
)
def lint_rules(spark, sf_dir):
    """The broken rules of each caption."""
    return load(spark, sf_dir, "baseline_vision").select("record_id", L.lint().alias("issues"))


@query(
    "a29_lint_pass_rate",
    f"""WITH c AS (SELECT *, end_ts - start_ts AS d, {WORDS} AS words, {VERBS} AS verbs FROM baseline_vision),
    m AS (SELECT *, {listed(*[f"CASE WHEN {f} IS NULL THEN 'A0_{f}' END" for f in L.FIELDS])} AS missing FROM c),
    i AS (SELECT cls, CASE WHEN len(missing) > 0 THEN missing ELSE {listed(*[f"CASE WHEN {t} THEN '{n}' END" for t, n in RULES])} END AS issues FROM m)
    SELECT cls, count(*) AS n, count(CASE WHEN len(issues) = 0 THEN 1 END) AS clean FROM i GROUP BY cls""",
)
def a29(spark, sf_dir):
    """Captions of each class without any broken rule."""
    c = load(spark, sf_dir, "baseline_vision").select("cls", L.lint().alias("issues"))
    return c.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("issues") == 0).alias("clean"))


QUAT = "q AS (SELECT vec_id, label, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z FROM embeddings), u AS (SELECT vec_id, label, w / n AS w, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM q))"


def quats(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate("wxyz")])


@query(
    "f1_quat_to_matrix",
    f"""WITH {QUAT} SELECT vec_id, {sql_fixed("1 - 2 * (y * y + z * z)")} AS m0, {sql_fixed("2 * (x * y - z * w)")} AS m1, {sql_fixed("2 * (x * z + y * w)")} AS m2, {sql_fixed("2 * (x * y + z * w)")} AS m3, {sql_fixed("1 - 2 * (x * x + z * z)")} AS m4,
    {sql_fixed("2 * (y * z - x * w)")} AS m5, {sql_fixed("2 * (x * z - y * w)")} AS m6, {sql_fixed("2 * (y * z + x * w)")} AS m7, {sql_fixed("1 - 2 * (x * x + y * y)")} AS m8 FROM u""",
)
def f1(spark, sf_dir):
    m = G.quat_to_matrix(*[F.col(c) for c in "wxyz"])
    return quats(spark, sf_dir).select("vec_id", *[fixed(c).alias(f"m{i}") for i, c in enumerate(m)])


@query("f2_matrix_to_quat", "SELECT vec_id, true AS same FROM embeddings")
def f2(spark, sf_dir):
    """Quaternion to rotation and back gives the same rotation."""
    q = quats(spark, sf_dir)
    r = q.select("*", *[c.alias(f"m{i}") for i, c in enumerate(G.quat_to_matrix(*[F.col(c) for c in "wxyz"]))])
    back = G.matrix_to_quat([F.col(f"m{i}") for i in range(9)])
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in "wxyz"), F.lit(0.0)))
    dot = sum((a * F.col(c) / n for a, c in zip(back, "wxyz")), F.lit(0.0))
    return r.select("vec_id", (F.abs(F.abs(dot) - 1) < 1e-9).alias("same"))


@query(
    "f3_projection",
    f"""WITH {CE} SELECT event_id, {sql_fixed("e.k.fx * d / (v + 0.2) + e.k.cx", 4)} AS u, {sql_fixed("e.k.fy * r / (v + 0.2) + e.k.cy", 4)} AS v FROM ce JOIN episodes e ON ce.episode = e.episode""",
)
def f3(spark, sf_dir):
    """The pixel of the point (aperture change, rate, speed + 0.2) in the episode's camera; NULL without a camera."""
    j = contacts(spark, sf_dir).join(load(spark, sf_dir, "episodes").select("episode", "k"), "episode")
    u, v = G.project([F.col("d"), F.col("r"), F.col("v") + 0.2], F.col("k.fx"), F.col("k.fy"), F.col("k.cx"), F.col("k.cy"))
    return j.select("event_id", fixed(u, 4).alias("u"), fixed(v, 4).alias("v"))


@query(
    "f5_visibility",
    f"""WITH {CE}, p AS (SELECT ce.episode, e.k.fx * d / (v + 0.2) + e.k.cx AS pu, e.k.fy * r / (v + 0.2) + e.k.cy AS pv, e.k.w AS w, e.k.h AS h FROM ce JOIN episodes e ON ce.episode = e.episode)
    SELECT episode, {sql_fixed("avg(CASE WHEN pu >= 0 AND pu < w AND pv >= 0 AND pv < h THEN 1.0 ELSE 0.0 END)")} AS visible, {sql_fixed("avg(CASE WHEN pu >= w * 0.25 AND pu < w - w * 0.25 AND pv >= h * 0.25 AND pv < h - h * 0.25 THEN 1.0 ELSE 0.0 END)")} AS central FROM p GROUP BY episode""",
)
def f5(spark, sf_dir):
    """The share of projected points inside the sensor, and inside its central half."""
    j = contacts(spark, sf_dir).join(load(spark, sf_dir, "episodes").select("episode", "k"), "episode")
    u, v = G.project([F.col("d"), F.col("r"), F.col("v") + 0.2], F.col("k.fx"), F.col("k.fy"), F.col("k.cx"), F.col("k.cy"))
    share = lambda m: fixed(F.avg(G.in_rect(u, v, F.col("k.w"), F.col("k.h"), m).cast("double")))
    return j.groupBy("episode").agg(share(0.0).alias("visible"), share(0.25).alias("central"))


@query(
    "f8_geodesic_angle",
    f"""WITH {QUAT}, d AS (SELECT vec_id, abs(w * lag(w) OVER k + x * lag(x) OVER k + y * lag(y) OVER k + z * lag(z) OVER k) AS dot FROM u WINDOW k AS (PARTITION BY label ORDER BY vec_id))
    SELECT vec_id, {sql_fixed("acos(greatest(-1.0, least(1.0, 2 * dot * dot - 1)))", 4)} AS angle FROM d""",
)
def f8(spark, sf_dir):
    """The angle of the rotation from each orientation to the next of its label."""
    r = quats(spark, sf_dir).select("vec_id", "label", *[c.alias(f"m{i}") for i, c in enumerate(G.quat_to_matrix(*[F.col(c) for c in "wxyz"]))])
    w = Window.partitionBy("label").orderBy("vec_id")
    m = [F.col(f"m{i}") for i in range(9)]
    r = r.withColumns({f"p{i}": F.lag(c).over(w) for i, c in enumerate(m)})
    return r.select("vec_id", fixed(G.geodesic_angle(m, [F.col(f"p{i}") for i in range(9)]), 4).alias("angle"))


@query(
    "f19_box_iou",
    f"""WITH {CE}, b AS (SELECT event_id, d * 1000 AS x, r * 50 AS y, 40 + v * 20 AS s, lag(d * 1000) OVER w AS px, lag(r * 50) OVER w AS py, lag(40 + v * 20) OVER w AS ps FROM ce WINDOW w AS (PARTITION BY episode, side ORDER BY t, event_id)),
    i AS (SELECT *, greatest(0.0, least(x + s, px + ps) - greatest(x, px)) * greatest(0.0, least(y + s, py + ps) - greatest(y, py)) AS i FROM b WHERE ps IS NOT NULL)
    SELECT event_id, {sql_fixed("i / greatest(s * s + ps * ps - i, 1e-9)", 4)} AS iou FROM i""",
)
def f19(spark, sf_dir):
    """Each box against the one before it in its series."""
    w = Window.partitionBy("episode", "side").orderBy("t", "event_id")
    x, y, s = F.col("d") * 1000, F.col("r") * 50, 40 + F.col("v") * 20
    b = contacts(spark, sf_dir).select("event_id", "episode", "side", "t", x.alias("x1"), y.alias("y1"), (x + s).alias("x2"), (y + s).alias("y2"))
    b = b.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("x1", "y1", "x2", "y2")}).where("p_x1 IS NOT NULL")
    cs = ("x1", "y1", "x2", "y2")
    return b.select("event_id", fixed(G.box_iou([F.col(c) for c in cs], [F.col(f"p_{c}") for c in cs]), 4).alias("iou"))


@query("f20_word_count", f"SELECT doc_id, {WORDS} AS words FROM documents WHERE text IS NOT NULL")
def f20(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("f21_verb_cores", f"SELECT record_id, CAST({VERBS} AS INTEGER) AS verbs FROM baseline_vision WHERE text IS NOT NULL")
def f21(spark, sf_dir):
    return load(spark, sf_dir, "baseline_vision").where("text IS NOT NULL").select("record_id", L.verb_count(F.col("text")).alias("verbs"))


@query("f22_contains_word", r"SELECT doc_id, regexp_matches(text, '(?i)\bleft hand\b') AS found FROM documents WHERE text IS NOT NULL")
def f22(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.contains_word(F.col("text"), "left hand").alias("found"))


@query("f27_ids", "SELECT record_id, segment || '#' || lpad(CAST(CAST(floor(start_ts * 1000 + 0.5) AS BIGINT) AS VARCHAR), 9, '0') AS id FROM baseline_vision WHERE start_ts >= 0")
def f27(spark, sf_dir):
    """An id of segment and start in whole milliseconds, of fixed width."""
    ms = F.floor(F.col("start_ts") * 1000 + 0.5).cast("bigint").cast("string")
    return load(spark, sf_dir, "baseline_vision").where("start_ts >= 0").select("record_id", F.concat("segment", F.lit("#"), F.lpad(ms, 9, "0")).alias("id"))


@query("f29_time_difference", "SELECT event_id, date_diff('microsecond', lag(ts) OVER w, ts) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def f29(spark, sf_dir):
    """Whole microseconds since the user's event before, subtracted as integers."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("event_id", (us - F.lag(us).over(w)).alias("us"))


@query("f30_finite_or_default", "SELECT event_id, coalesce(CASE WHEN isfinite(jerk) THEN jerk END, 0.0) AS jerk FROM (SELECT DISTINCT event_id, jerk FROM contact_events)")
def f30(spark, sf_dir):
    from epiloom.operators.aggregates import finite

    return load(spark, sf_dir, "contact_events").select("event_id", "jerk").distinct().select("event_id", F.coalesce(finite(F.col("jerk")), F.lit(0.0)).alias("jerk"))


@query("f32_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f32(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
