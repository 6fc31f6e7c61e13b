"""Sources and sinks: JSON lines, CSV and partitioned Parquet with declared schemas, file listings, NPZ archives and MCAP logs.

NPZ and MCAP are Python data sources: register them once, then ``spark.read.format("npz")`` or ``"mcap"``.
"""

from __future__ import annotations

import glob
import io
import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines of a declared schema; a line that doesn't fit it fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)


def write_archive(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet partitioned by ``by``; rows of one partition are brought together first, so that each gets few files."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def listed_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, stem, size, modified, sha256) of the files below ``path`` whose names match; stems that repeat have ``clashes`` > 1."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = f.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    return rows.join(rows.groupBy("stem").agg(F.count(F.lit(1)).alias("clashes")), "stem")


class _Files(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _paths(path: str, suffix: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "**", f"*{suffix}"), recursive=True))
    return sorted(glob.glob(path))


class NpzReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Files(p) for p in _paths(self.path, ".npz")] or [_Files("")]

    def read(self, partition: _Files) -> Iterator[tuple]:
        import numpy as np

        if not partition.path:
            return
        episode = os.path.basename(partition.path).rsplit(".", 1)[0]
        with np.load(partition.path, allow_pickle=False) as archive:
            for name in archive.files:
                a = np.asarray(archive[name])
                if a.dtype.kind in "iufb" and a.ndim:
                    flat = a.reshape(len(a), -1).astype(float)
                    for i, row in enumerate(flat):
                        yield episode, name, i, [None if x != x else x for x in row.tolist()]


class Npz(DataSource):
    """Arrays of NPZ archives in long form: (episode, array, row, values); NaN is NULL. One task for each file."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "episode STRING, array STRING, row BIGINT, values ARRAY<DOUBLE>"

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)


_MAGIC = b"\x89MCAP0\r\n"


def _records(buffer: io.BufferedIOBase) -> Iterator[tuple[int, bytes]]:
    while head := buffer.read(9):
        if len(head) < 9:
            return
        op, size = struct.unpack("<BQ", head)
        body = buffer.read(size)
        if len(body) < size:
            return
        yield op, body


def _string(b: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", b, at)
    return b[at + 4 : at + 4 + n].decode(), at + 4 + n


def mcap_messages(path: str, topics: set[str] | None = None) -> Iterator[tuple[str, int, int, bytes]]:
    """(topic, log time, publish time, data) of a log's messages, in the file's order; chunks may be plain or of zstd.

    A file that breaks off is read up to its last whole record.
    """

    def walk(buffer: io.BufferedIOBase) -> Iterator[tuple[str, int, int, bytes]]:
        for op, b in _records(buffer):
            if op == 0x04:  # channel: id, schema id, topic, ...
                channel, _ = struct.unpack_from("<HH", b)
                names[channel] = _string(b, 4)[0]
            elif op == 0x05:  # message: channel, sequence, log time, publish time, data
                channel, _, logged, published = struct.unpack_from("<HIQQ", b)
                topic = names.get(channel)
                if topic is not None and (topics is None or topic in topics):
                    yield topic, logged, published, b[22:]
            elif op == 0x06:  # chunk: start, end, size, crc, compression, records
                size, _ = struct.unpack_from("<QI", b, 16)
                kind, at = _string(b, 28)
                data = b[at + 8 :]
                if kind == "zstd":
                    import zstandard

                    data = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
                elif kind:
                    raise ValueError(f"chunks of {kind} can't be read")
                yield from walk(io.BytesIO(data))
            elif op == 0x0F:  # end of data
                return

    names: dict[int, str] = {}
    with open(path, "rb") as f:
        if f.read(8) != _MAGIC:
            raise ValueError(f"{path} is no MCAP file")
        yield from walk(f)


class McapReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.topics = set(options["topics"].split(",")) if options.get("topics") else None

    def partitions(self) -> list[InputPartition]:
        return [_Files(p) for p in _paths(self.path, ".mcap")] or [_Files("")]

    def read(self, partition: _Files) -> Iterator[tuple]:
        if partition.path:
            episode = os.path.basename(partition.path).rsplit(".", 1)[0]
            for topic, logged, published, data in mcap_messages(partition.path, self.topics):
                yield episode, topic, logged, published, data


class Mcap(DataSource):
    """Messages of MCAP logs: (episode, topic, log_ns, publish_ns, data); option ``topics`` reads only those. One task for each file."""

    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        return "episode STRING, topic STRING, log_ns BIGINT, publish_ns BIGINT, data BINARY"

    def reader(self, schema) -> McapReader:
        return McapReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Npz)
    spark.dataSource.register(Mcap)
