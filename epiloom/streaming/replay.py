"""Structured Streaming over the Parquet tables: windows with watermarks, duplicates by key, state for each key.

A table is replayed with ``availableNow``: all its files in micro-batches, then the query ends. Results go through
``foreachBatch`` to a folder shared by the executors, where a batch that is tried again overwrites itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from epiloom.session import load, shared_dir


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a stream of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    is_dir = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(load(spark, sf_dir, table).schema).option("maxFilesPerTrigger", "8")
    return reader.parquet(f"{sf_dir}/{table}.parquet") if is_dir else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def replayed(df: DataFrame, mode: str) -> DataFrame:
    """The rows that the streaming ``df`` emits in all its batches, with the ``batch`` they came in."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/run={batch}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    schema = StructType([*df.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{base}/out").drop("run")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of updates by key, the last batch's."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, "_x.*")


def windowed_counts(events: DataFrame, t: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """(keys, start, n, total): sums in tumbling windows of event time, for rows at most ``late`` behind the latest."""
    w = events.withColumn("_t", F.col(t).cast("timestamp")).withWatermark("_t", late)
    return w.groupBy(F.window("_t", width).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("_w.start").alias("start"), "n", "total")


def distinct_by_key(events: DataFrame, key: str, t: str, late: str) -> DataFrame:
    """The first row of each key, repeats within the watermark being dropped; the state kept is bounded by ``late``."""
    return events.withColumn("_t", F.col(t).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def running_state(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, peak): count and greatest value of each key so far, by a state that outlives the batches."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, peak = state.get if state.exists else (0, float("-inf"))
        for p in batches:
            n += len(p)
            peak = max(peak, float(p[value].max()))
        state.update((n, peak))
        yield pd.DataFrame({key: [k[0]], "n": [n], "peak": [peak]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n BIGINT, peak DOUBLE", "n BIGINT, peak DOUBLE", "update", GroupStateTimeout.NoTimeout)
