"""The core queries: name -> (callable of (spark, sf_dir), SQL on the same tables or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiloom.operators.islands import merged_intervals, whole_ms
from epiloom.plans import checks, frames, ordered, pipelines, records, scalars, signals, sinks, streams, timejoins  # noqa: F401
from epiloom.plans.registry import QUERIES, SQL, query  # noqa: F401
from epiloom.session import load


def interval_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both interval streams as (k = stream and episode, start_ms, end_ms)."""
    spans = load(spark, sf_dir, "state_spans").select(F.lit("state_spans").alias("stream"), "episode", F.col("start_s").alias("a"), F.coalesce("end_s", F.col("start_s") + F.col("duration")).alias("z"))
    vision = load(spark, sf_dir, "baseline_vision").select(F.lit("baseline_vision").alias("stream"), "episode", F.col("start_ts").alias("a"), F.col("end_ts").alias("z"))
    both = spans.unionByName(vision)
    return both.select(F.concat("stream", F.lit("\t"), "episode").alias("k"), whole_ms(F.col("a")).alias("start_ms"), whole_ms(F.col("z")).alias("end_ms"))


@query(
    "p3_found",
    """
    WITH raw AS (
      SELECT 'state_spans' AS stream, episode, start_s AS a, coalesce(end_s, start_s + duration) AS z FROM state_spans
      UNION ALL SELECT 'baseline_vision', episode, start_ts, end_ts FROM baseline_vision),
    ms AS (SELECT stream, episode, CAST(floor(a * 1000 + 0.5) AS BIGINT) AS s, CAST(floor(z * 1000 + 0.5) AS BIGINT) AS e
      FROM raw WHERE a IS NOT NULL AND z IS NOT NULL AND isfinite(a) AND isfinite(z) AND episode IS NOT NULL),
    seen AS (SELECT *, max(e) OVER (PARTITION BY stream, episode ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM ms WHERE e > s),
    lab AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY stream, episode ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen),
    per AS (SELECT stream, episode, min(s) AS s, max(e) AS e FROM lab GROUP BY stream, episode, island)
    SELECT stream, episode, 'period' AS kind, s AS start_ms, e AS end_ms FROM per
    UNION ALL
    SELECT stream, episode, 'gap', e, nxt FROM (SELECT *, lead(s) OVER (PARTITION BY stream, episode ORDER BY s) AS nxt FROM per) WHERE nxt IS NOT NULL
    """,
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of the intervals of state_spans and of baseline_vision, by episode."""
    out = merged_intervals(interval_streams(spark, sf_dir), "k", "start_ms", "end_ms")
    part = F.split("k", "\t", 2)
    return out.select(part[0].alias("stream"), part[1].alias("episode"), "kind", "start_ms", "end_ms")
