"""Frame plans, timeline checks and parsed tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epiloom.operators import signal as S
from epiloom.plans.records import SPANS, spans
from epiloom.plans.registry import query
from epiloom.plans.signals import CE, KEYS, ORDER, contacts
from epiloom.session import load


@query(
    "s7_timeline_check",
    """WITH t AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER w - 1 AS i, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS step, epoch_us(first_value(ts) OVER w) AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, count(*) AS n, coalesce(bool_and(step > 0), true) AS rising, bool_and(abs(us - t0 - i * 1000000) <= 1000) AS uniform FROM t GROUP BY user_id""",
)
def s7(spark, sf_dir):
    """Whether a clock, in whole microseconds, only rises, and whether it keeps to a grid of a second within a millisecond."""
    w = S.over(["user_id"], ["event_id"])
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = load(spark, sf_dir, "events").select("user_id", "event_id", us.alias("us"))
    t = t.withColumns({"i": F.row_number().over(w) - 1, "step": F.col("us") - F.lag("us").over(w), "t0": F.first("us").over(w)})
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("rising"), F.bool_and(F.abs(F.col("us") - F.col("t0") - F.col("i") * 1_000_000) <= 1000).alias("uniform"))


@query(
    "s12_planned_frames",
    f"""WITH {CE}, {SPANS}, have AS (SELECT DISTINCT episode, CAST(floor(t * 30) AS BIGINT) AS frame FROM ce), want AS (SELECT DISTINCT episode, CAST(floor((start_ts + end_ts) * 15) AS BIGINT) AS frame FROM sp WHERE end_ts > start_ts)
    SELECT want.episode, count(*) AS planned, count(have.frame) AS found FROM want LEFT JOIN have ON want.episode = have.episode AND want.frame = have.frame GROUP BY want.episode""",
)
def s12(spark, sf_dir):
    """Of the frames that spans ask for (their middle ones, each once), those that are there; none stands in for another."""
    have = contacts(spark, sf_dir).select("episode", F.floor(F.col("t") * 30).alias("frame")).distinct().withColumn("found", F.lit(1))
    want = spans(spark, sf_dir).where("end_ts > start_ts").select("episode", F.floor((F.col("start_ts") + F.col("end_ts")) * 15).alias("frame")).distinct()
    return want.join(have, ["episode", "frame"], "left").groupBy("episode").agg(F.count(F.lit(1)).alias("planned"), F.count("found").alias("found"))


@query("s15_size_guard", "SELECT coalesce(episode, '(none)') AS episode, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, sum(octet_length(encode(text))) > 20000 AS over_limit FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s15(spark, sf_dir):
    """The bytes that an episode's texts take, and whether they exceed a limit."""
    total = F.sum(F.octet_length("text"))
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.coalesce("episode", F.lit("(none)")).alias("episode")).agg(total.alias("bytes"), (total > 20000).alias("over_limit"))


@query(
    "s17_visual_plan",
    f"""WITH {CE}, f AS (SELECT *, coalesce(v > 0.8, false) AS f FROM ce), g AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY episode, side ORDER BY t, event_id), false) AS b FROM f),
    w AS (SELECT DISTINCT episode, CAST(floor(t / 8) AS BIGINT) AS win FROM ce WHERE t >= 0), u AS (SELECT episode, win, CAST(floor((win * 8 + i * 8 / 12.0) * 30) AS BIGINT) AS frame FROM w, unnest(range(0, 12)) AS r(i)),
    o AS (SELECT episode, CAST(floor(t / 8) AS BIGINT) AS win, CAST(floor(t * 30) AS BIGINT) AS frame FROM g WHERE f AND NOT b AND t >= 0)
    SELECT episode, win, count(DISTINCT frame) AS frames FROM (SELECT * FROM u UNION ALL SELECT * FROM o) GROUP BY episode, win""",
)
def s17(spark, sf_dir):
    """The frames to look at in each 8 s window: twelve spread evenly, and those at which the hand becomes fast."""
    c = contacts(spark, sf_dir)
    win = F.floor(F.col("t") / 8).cast("bigint").alias("win")
    w = c.where("t >= 0").select("episode", win).distinct()
    even = w.select("episode", "win", F.explode(F.array(*[F.floor((F.col("win") * 8 + i * 8 / 12.0) * 30) for i in range(12)])).alias("frame"))
    fast = S.onsets(c, F.col("v") > 0.8, KEYS, ORDER).where("t >= 0").select("episode", win, F.floor(F.col("t") * 30).alias("frame"))
    return even.unionAll(fast).groupBy("episode", "win").agg(F.countDistinct("frame").alias("frames"))


ROW = r"^\|\s*([0-9.]+)\s*\|\s*([0-9.]+)\s*\|\s*(.*?)\s*\|\s*([A-Z_]+)\s*\|\s*$"


@query(
    "f25_parsed_tables",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'caption_table' AND text IS NOT NULL),
    p AS (SELECT doc_id, regexp_extract(line, '{ROW}', 1) AS a, regexp_extract(line, '{ROW}', 2) AS z, regexp_extract(line, '{ROW}', 3) AS caption, regexp_extract(line, '{ROW}', 4) AS visibility FROM l WHERE regexp_matches(line, '{ROW}'))
    SELECT doc_id, CAST(a AS DOUBLE) AS a, CAST(z AS DOUBLE) AS z, caption, visibility FROM p WHERE try_cast(a AS DOUBLE) < try_cast(z AS DOUBLE)""",
)
def f25(spark, sf_dir):
    """The rows of captions that a table holds, whole ones whose start is before their end."""
    lines = load(spark, sf_dir, "documents").where("source = 'caption_table' AND text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    part = lambda i: F.regexp_extract("line", ROW, i)
    p = lines.where(F.col("line").rlike(ROW)).select("doc_id", part(1).try_cast("double").alias("a"), part(2).try_cast("double").alias("z"), part(3).alias("caption"), part(4).alias("visibility"))
    return p.where("a < z")


@query("t8_fan_out", "SELECT cls, hand, CAST(grouping(cls) AS INTEGER) AS all_classes, CAST(grouping(hand) AS INTEGER) AS all_hands, count(*) AS n FROM spans GROUP BY GROUPING SETS ((cls), (hand), ())")
def t8(spark, sf_dir):
    """Three consumers of one pass: counts by class, by hand, and of all."""
    s = load(spark, sf_dir, "spans")
    by = [F.col("cls")], [F.col("hand")], []
    return s.groupingSets(list(by), "cls", "hand").agg(F.grouping("cls").cast("int").alias("all_classes"), F.grouping("hand").cast("int").alias("all_hands"), F.count(F.lit(1)).alias("n"))
