"""Streaming queries, each replaying a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiloom.plans.registry import fixed, query, sql_fixed
from epiloom.streaming import replay as R


@query("stream_windows", f"SELECT event_type, CAST(floor(epoch(ts) / 14400) AS BIGINT) AS win, count(*) AS n, {sql_fixed('sum(value)', 4)} AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Tumbling windows of four hours over the stream of events."""
    w = R.windowed_counts(R.stream(spark, sf_dir, "events"), "ts", "4 hours", "1 day", ["event_type"], "value")
    out = R.latest(R.replayed(w, "update"), ["event_type", "start"])
    return out.select("event_type", F.floor(F.unix_timestamp("start") / 14400).cast("bigint").alias("win"), "n", fixed(F.col("total"), 4).alias("total"))


@query("stream_distinct", "SELECT DISTINCT event_id FROM events")
def stream_distinct(spark, sf_dir):
    """Each event once, redeliveries within the watermark dropped."""
    return R.replayed(R.distinct_by_key(R.stream(spark, sf_dir, "events").select("event_id", "ts"), "event_id", "ts", "400 days"), "append").select("event_id")


@query("stream_state", "SELECT user_id, count(*) AS n, max(value) AS peak FROM events GROUP BY user_id")
def stream_state(spark, sf_dir):
    """Count and peak of each user from a state kept between batches."""
    return R.latest(R.replayed(R.running_state(R.stream(spark, sf_dir, "events"), "user_id", "value"), "update"), ["user_id"])
