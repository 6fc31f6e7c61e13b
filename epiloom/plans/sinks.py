"""Round trips through the sinks and sources: what is written comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from epiloom.plans.registry import query
from epiloom.session import load, shared_dir
from epiloom.sources import files


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s20_jsonl_round_trip", "SELECT record_id, episode, state, start_s, end_s, mean_score FROM state_spans")
def s20(spark, sf_dir):
    df = load(spark, sf_dir, "state_spans").select("record_id", "episode", "state", "start_s", "end_s", "mean_score")
    files.write_jsonl(df, path := _folder(spark, "jsonl"))
    return files.read_jsonl(spark, path, df.schema)


@query("s22_archive_round_trip", "SELECT segment, count(*) AS n FROM spans WHERE cls = 'tea service' GROUP BY segment")
def s22(spark, sf_dir):
    """A partitioned archive, of which one partition is read: the filter prunes the folders."""
    df = load(spark, sf_dir, "spans").where("cls IS NOT NULL").select("cls", "segment", "span_id")
    files.write_archive(df, path := _folder(spark, "archive"), ["cls"])
    return spark.read.parquet(path).where("cls = 'tea service'").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("s23_csv_round_trip", "SELECT event_id, t, wrist_speed FROM contact_events")
def s23(spark, sf_dir):
    df = load(spark, sf_dir, "contact_events").select("event_id", "t", "wrist_speed")
    df.write.mode("overwrite").csv(path := _folder(spark, "csv"), header=True)
    return files.read_csv(spark, path, df.schema)
