"""Joins by time on detected events, hand-labelled events, spans and states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epiloom.operators import joins as J
from epiloom.operators.islands import merged_intervals, whole_ms
from epiloom.plans.registry import fixed, query, sql_fixed
from epiloom.plans.signals import CE, contacts
from epiloom.session import load

SP = "sp AS (SELECT DISTINCT span_id, episode, cls, start_ts AS a, end_ts AS z FROM spans WHERE start_ts IS NOT NULL AND end_ts IS NOT NULL)"
BAD = "bad AS (SELECT DISTINCT clip_id, episode, start_ts AS ba, end_ts AS bz FROM quality WHERE hard_reject AND start_ts IS NOT NULL AND end_ts IS NOT NULL)"


def distinct_spans(spark, sf_dir):
    s = load(spark, sf_dir, "spans").where("start_ts IS NOT NULL AND end_ts IS NOT NULL")
    return s.select("span_id", "episode", "cls", F.col("start_ts").alias("a"), F.col("end_ts").alias("z")).distinct()


def rejected(spark, sf_dir):
    q = load(spark, sf_dir, "quality").where("hard_reject AND start_ts IS NOT NULL AND end_ts IS NOT NULL")
    return q.select("clip_id", "episode", F.col("start_ts").alias("ba"), F.col("end_ts").alias("bz")).distinct()


def sides(spark, sf_dir):
    c = contacts(spark, sf_dir).select("event_id", "episode", "side", "t", "v")
    return c.where("side = 'left'").drop("side"), c.where("side = 'right'").drop("side").groupBy("episode", "t").agg(F.min("event_id").alias("event_id"), F.min_by("v", "event_id").alias("v"))


LR = f"{CE}, l AS (SELECT * FROM ce WHERE side = 'left'), r AS (SELECT episode, t, min(event_id) AS event_id, arg_min(v, event_id) AS v FROM ce WHERE side = 'right' GROUP BY episode, t)"


@query(
    "j1_asof_forward",
    f"""WITH {LR}, f AS (SELECT l.event_id, r.event_id AS r, r.t AS rt FROM l ASOF LEFT JOIN r ON l.episode = r.episode AND l.t <= r.t),
    last AS (SELECT episode, arg_max(event_id, t) AS r, max(t) AS rt FROM r GROUP BY episode)
    SELECT l.event_id, coalesce(f.r, last.r) AS r_event_id, coalesce(f.rt, last.rt) AS r_t FROM l JOIN f ON l.event_id = f.event_id LEFT JOIN last ON l.episode = last.episode""",
)
def j1(spark, sf_dir):
    """Each left-hand event with the first right-hand one at or after it, or else the last."""
    left, right = sides(spark, sf_dir)
    return J.asof_forward(left, right, ["episode"], "t", ["event_id"], ["event_id"]).select("event_id", "r_event_id", "r_t")


@query(
    "j2_nearest",
    f"""WITH {LR}, f AS (SELECT l.event_id, r.event_id AS r, r.t AS rt FROM l ASOF LEFT JOIN r ON l.episode = r.episode AND l.t <= r.t),
    b AS (SELECT l.event_id, r.event_id AS r, r.t AS rt FROM l ASOF LEFT JOIN r ON l.episode = r.episode AND l.t >= r.t)
    SELECT l.event_id, CASE WHEN f.r IS NULL THEN b.r WHEN b.r IS NULL THEN f.r WHEN l.t - b.rt < f.rt - l.t THEN b.r ELSE f.r END AS r_event_id
    FROM l JOIN f ON l.event_id = f.event_id JOIN b ON l.event_id = b.event_id""",
)
def j2(spark, sf_dir):
    """Each left-hand event with the right-hand one nearest in time; of two equally near, the later."""
    left, right = sides(spark, sf_dir)
    return J.asof_nearest(left, right, ["episode"], "t", ["event_id"], ["event_id"]).select("event_id", "r_event_id")


@query(
    "j3_interpolated",
    f"""WITH {CE}, l AS (SELECT * FROM ce WHERE side = 'left'), r AS (SELECT episode, t, avg(v) AS v FROM ce WHERE side = 'right' GROUP BY episode, t),
    f AS (SELECT l.event_id, r.v AS v, r.t AS rt FROM l ASOF LEFT JOIN r ON l.episode = r.episode AND l.t <= r.t), b AS (SELECT l.event_id, r.v AS v, r.t AS rt FROM l ASOF LEFT JOIN r ON l.episode = r.episode AND l.t >= r.t)
    SELECT l.event_id, {sql_fixed('''CASE WHEN f.v IS NULL AND b.v IS NULL THEN 0.0 WHEN f.rt = l.t THEN f.v WHEN f.v IS NULL THEN b.v WHEN b.v IS NULL THEN f.v
      ELSE b.v + (f.v - b.v) * ((l.t - b.rt) / nullif(f.rt - b.rt, 0)) END''')} AS value FROM l JOIN f ON l.event_id = f.event_id JOIN b ON l.event_id = b.event_id""",
)
def j3(spark, sf_dir):
    """The right hand's speed at the times of the left-hand events, by linear interpolation."""
    c = contacts(spark, sf_dir).select("event_id", "episode", "side", "t", "v")
    out = J.interpolated(c.where("side = 'left'").drop("side"), c.where("side = 'right'").select("episode", "t", "v"), ["episode"], "t", "v")
    return out.select("event_id", fixed(F.col("value")).alias("value"))


@query("j4_events_in_spans", f"WITH {CE}, {SP} SELECT event_id, span_id FROM ce JOIN sp ON ce.episode = sp.episode AND t >= a AND t < z")
def j4(spark, sf_dir):
    """The detected events inside each span, start included and end not."""
    return J.points_in_intervals(contacts(spark, sf_dir), distinct_spans(spark, sf_dir), ["episode"], "t", "a", "z", 4.0).select("event_id", "span_id")


@query(
    "j5_overlap_gate",
    f"""WITH {SP}, {BAD}, o AS (SELECT span_id, sum(least(z, bz) - greatest(a, ba)) AS o FROM sp JOIN bad ON sp.episode = bad.episode AND a < bz AND ba < z AND a < z AND ba < bz GROUP BY span_id)
    SELECT sp.span_id, {sql_fixed("CASE WHEN z > a THEN coalesce(o, 0.0) / (z - a) ELSE 0.0 END")} AS bad_fraction FROM sp LEFT JOIN o ON sp.span_id = o.span_id""",
)
def j5(spark, sf_dir):
    """The share of each span that lies in rejected clips."""
    f = J.overlap_fraction(distinct_spans(spark, sf_dir).drop("cls"), rejected(spark, sf_dir), ["episode"], ("a", "z"), ("ba", "bz"), "span_id", 4.0)
    return f.select("span_id", fixed(F.col("bad_fraction")).alias("bad_fraction"))


GS = "g AS (SELECT DISTINCT segment, lower(trim(episode)) AS episode, t0, t1 FROM gold WHERE t0 < t1)"
ST = "s AS (SELECT DISTINCT episode, state, start_s, end_s FROM state_spans WHERE end_s > start_s)"


@query(
    "j6_clipped_references",
    f"""WITH {GS}, {ST} SELECT segment, state, {sql_fixed("greatest(t0, start_s) - t0", 3)} AS a, {sql_fixed("least(t1, end_s) - t0", 3)} AS z
    FROM g JOIN s ON g.episode = s.episode AND start_s < t1 AND t0 < end_s WHERE least(t1, end_s) - greatest(t0, start_s) > 0.2""",
)
def j6(spark, sf_dir):
    """States clipped to the hand-labelled segments, in the segment's own time, where more than 0.2 s remain."""
    g = load(spark, sf_dir, "gold").where("t0 < t1").select("segment", F.lower(F.trim("episode")).alias("episode"), "t0", "t1").distinct()
    s = load(spark, sf_dir, "state_spans").where("end_s > start_s").select("episode", "state", "start_s", "end_s").distinct()
    p = J.overlap_pairs(g, s, ["episode"], ("t0", "t1"), ("start_s", "end_s"), 60.0).where("overlap > 0.2")
    return p.select("segment", "state", fixed(F.greatest("t0", "start_s") - F.col("t0"), 3).alias("a"), fixed(F.least("t1", "end_s") - F.col("t0"), 3).alias("z"))


@query(
    "j7_temporal_iou",
    f"""WITH {SP}, c AS (SELECT record_id, episode, start_ts AS ca, end_ts AS cz FROM baseline_vision WHERE end_ts > start_ts)
    SELECT span_id, record_id, {sql_fixed("(least(z, cz) - greatest(a, ca)) / (greatest(z, cz) - least(a, ca))")} AS iou FROM sp JOIN c ON sp.episode = c.episode AND a < cz AND ca < z AND a < z
    WHERE least(z, cz) - greatest(a, ca) > 0.9 * (greatest(z, cz) - least(a, ca))""",
)
def j7(spark, sf_dir):
    """Pairs of a span and a caption whose intersection over union exceeds 0.9."""
    c = load(spark, sf_dir, "baseline_vision").where("end_ts > start_ts").select("record_id", "episode", F.col("start_ts").alias("ca"), F.col("end_ts").alias("cz"))
    p = J.overlap_pairs(distinct_spans(spark, sf_dir), c, ["episode"], ("a", "z"), ("ca", "cz"), 4.0)
    return p.where("overlap > 0.9 * (greatest(z, cz) - least(a, ca))").select("span_id", "record_id", fixed(F.col("iou")).alias("iou"))


@query(
    "j12_bound_labels",
    """WITH s AS (SELECT span_id, max(segment) AS segment, max(episode) AS episode FROM spans GROUP BY span_id),
    l AS (SELECT record_id, span_id, segment, episode, row_number() OVER (PARTITION BY span_id ORDER BY record_id) AS n FROM baseline_vision),
    j AS (SELECT l.*, s.span_id IS NOT NULL AS known, s.segment AS seg, s.episode AS ep FROM l LEFT JOIN s ON l.span_id = s.span_id)
    SELECT record_id, list_filter([CASE WHEN NOT known THEN 'unknown_id' END, CASE WHEN n > 1 THEN 'duplicate_label' END, CASE WHEN known AND segment IS DISTINCT FROM seg THEN 'mismatch_segment' END,
      CASE WHEN known AND episode IS DISTINCT FROM ep THEN 'mismatch_episode' END], lambda x: x IS NOT NULL) AS issues FROM j""",
)
def j12(spark, sf_dir):
    """Captions bound to their spans by id: unknown ids, duplicates and fields that differ."""
    s = load(spark, sf_dir, "spans").groupBy("span_id").agg(F.max("segment").alias("segment"), F.max("episode").alias("episode"))
    l = load(spark, sf_dir, "baseline_vision").select("record_id", "span_id", "segment", "episode", F.col("record_id").alias("label_order"))
    return J.bound(l, s, "span_id", ["segment", "episode"]).select("record_id", "issues")


@query(
    "j13_merged_audits",
    """WITH s AS (SELECT DISTINCT span_id, segment FROM spans), c AS (SELECT span_id, count(*) AS n FROM baseline_vision WHERE text IS NOT NULL GROUP BY span_id),
    j AS (SELECT s.segment, s.span_id, c.n FROM s FULL OUTER JOIN c ON s.span_id = c.span_id)
    SELECT coalesce(segment, '(none)') AS segment, count(span_id) AS requested, count(CASE WHEN span_id IS NOT NULL THEN n END) AS captioned, count(*) - count(span_id) AS unrequested,
      CASE WHEN count(span_id) = 0 THEN 0.0 ELSE count(CASE WHEN span_id IS NOT NULL THEN n END)::DOUBLE / count(span_id) END AS coverage FROM j GROUP BY 1""",
)
def j13(spark, sf_dir):
    """Coverage of the requested spans by captions, by segment; 0 where none was requested."""
    s = load(spark, sf_dir, "spans").select("span_id", "segment").distinct()
    c = load(spark, sf_dir, "baseline_vision").where("text IS NOT NULL").groupBy(F.col("span_id").alias("c_id")).agg(F.count(F.lit(1)).alias("n"))
    j = s.join(c, F.col("span_id") == F.col("c_id"), "full_outer").groupBy(F.coalesce("segment", F.lit("(none)")).alias("segment"))
    out = j.agg(F.count("span_id").alias("requested"), F.count(F.when(F.col("span_id").isNotNull(), F.col("n"))).alias("captioned"), (F.count(F.lit(1)) - F.count("span_id")).alias("unrequested"))
    return out.withColumn("coverage", F.when(F.col("requested") == 0, F.lit(0.0)).otherwise(F.col("captioned").cast("double") / F.col("requested")))


@query(
    "j14_pack_lookup",
    """SELECT span_id, cls, coalesce(pack, 'core') AS pack FROM (SELECT DISTINCT span_id, cls FROM spans) s LEFT JOIN class_packs p USING (cls)""",
)
def j14(spark, sf_dir):
    """The vocabulary pack of each span's class; 'core' for classes without one."""
    packs = load(spark, sf_dir, "class_packs").select("cls", "pack")
    return load(spark, sf_dir, "spans").select("span_id", "cls").distinct().join(packs, "cls", "left").select("span_id", "cls", F.coalesce("pack", F.lit("core")).alias("pack"))


@query(
    "j15_identical_documents",
    """WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT min(doc_id) OVER (PARTITION BY h) AS first_id, doc_id FROM d QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)""",
)
def j15(spark, sf_dir):
    """Each byte-identical text with the first one of its class, by digest."""
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    firsts = d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first_id")
    return d.join(firsts, "h").where("doc_id > first_id").select("first_id", "doc_id")


@query("j15_duplicate_pairs")
def j15_pairs(spark, sf_dir):
    """Duplicate clips of three kinds. Each vector begins a clip of up to eight in a row of its label, which are its samples.

    The signs of 63 dimensions are a sample's hash, 100 times their deviation its contrast; a second lies between vectors.
    """
    e = load(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id").rowsBetween(0, 7)
    bits = F.array_join(F.transform(F.slice("embedding", 1, 63), lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    mean = lambda f: F.aggregate("embedding", F.lit(0.0), lambda a, x: a + f(x.cast("double"))) / F.size("embedding")
    contrast = 100 * F.sqrt(F.greatest(mean(lambda x: x * x) - mean(lambda x: x) * mean(lambda x: x), F.lit(0.0)))
    c = e.select("vec_id", F.collect_list(F.struct(bits.alias("hash"), contrast.alias("contrast"))).over(w).alias("samples"), F.collect_list("embedding").over(w).alias("v"))
    near = F.transform("v", lambda x: F.transform(x, lambda y: F.round(y, 2)))
    digest = lambda v: F.sha2(F.to_json(v), 256)
    n = F.size("v")
    return J.duplicate_pairs(c.select(F.col("vec_id").alias("id"), digest(F.col("v")).alias("file_hash"), digest(near).alias("decoded_hash"), n.alias("frame_count"), n.cast("double").alias("duration"), "samples"))


@query(
    "j20_manifest_upsert",
    """WITH q AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC, record_id DESC) AS i FROM quality) SELECT clip_id, record_id, episode FROM q WHERE i = 1""",
)
def j20(spark, sf_dir):
    """The latest delivery of each clip replaces earlier ones."""
    q = load(spark, sf_dir, "quality").groupBy("clip_id").agg(F.max_by(F.struct("record_id", "episode"), F.struct("ingested_at", "record_id")).alias("x"))
    return q.select("clip_id", "x.record_id", "x.episode")


@query(
    "w9_union_length",
    f"""WITH ms AS (SELECT episode, CAST(floor(start_s * 1000 + 0.5) AS BIGINT) AS s, CAST(floor(end_s * 1000 + 0.5) AS BIGINT) AS e FROM state_spans WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND episode IS NOT NULL),
    b AS (SELECT *, max(e) OVER (PARTITION BY episode ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ms WHERE e > s)
    SELECT episode, CAST(sum(greatest(0, e - greatest(s, coalesce(m, s)))) AS BIGINT) AS covered_ms FROM b GROUP BY episode""",
)
def w9(spark, sf_dir):
    """The length of the union of the states' intervals."""
    s = load(spark, sf_dir, "state_spans").select("episode", whole_ms(F.col("start_s")).alias("s"), whole_ms(F.col("end_s")).alias("e"))
    return merged_intervals(s, "episode", "s", "e").where("kind = 'period'").groupBy("episode").agg(F.sum(F.col("e") - F.col("s")).alias("covered_ms"))
