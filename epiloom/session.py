"""Session-level helpers: reading the tables, the shared folder, cutting lineage, and clearing what was written for it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of checkpoints and tables written by this process, by application.
_WRITTEN: dict[str, list[str]] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a session of one machine (as in tests) gets a temporary folder; a cluster is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="epiloom-checkpoint-"))
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder at once: the lineage is cut and the rows keep their partitions."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _noted(df.sparkSession, file.get())
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: smaller than a checkpoint, other partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _noted(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _noted(spark: SparkSession, path: str) -> None:
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)


def mark(spark: SparkSession) -> int:
    """A mark for :func:`release`: what is written from here on."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Deletes the checkpoints and tables written between two marks, by default all; returns their number.

    Frames that still read them must have been consumed. Loops call it for the state of the round before, jobs when their
    results are written.
    """
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone = 0
    for i in range(since, len(paths) if until is None else until):
        if paths[i]:
            path = spark._jvm.org.apache.hadoop.fs.Path(paths[i])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            paths[i] = ""
            gone += 1
    return gone


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
