import io
import struct

import numpy as np
import pytest
import zstandard

from epiloom.sources import files


def record(op, body):
    return struct.pack("<BQ", op, len(body)) + body


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def channel(i, topic):
    return record(0x04, struct.pack("<HH", i, 1) + text(topic) + text("raw") + struct.pack("<I", 0))


def message(i, t, data):
    return record(0x05, struct.pack("<HIQQ", i, 0, t, t) + data)


def chunk(data, kind):
    packed = zstandard.ZstdCompressor().compress(data) if kind == "zstd" else data
    return record(0x06, struct.pack("<QQQI", 0, 9, len(data), 0) + text(kind) + struct.pack("<Q", len(packed)) + packed)


def log(tail=b""):
    inner = channel(2, "/b") + message(2, 5, b"xyz") + message(1, 6, b"")
    return files._MAGIC + channel(1, "/a") + message(1, 3, b"one") + chunk(inner, "zstd") + chunk(message(2, 7, b"w"), "") + record(0x0F, b"\0" * 4) + tail


def test_mcap(tmp_path, spark):
    (tmp_path / "e1.mcap").write_bytes(log())
    (tmp_path / "e2.mcap").write_bytes(log()[:-10])
    files.register(spark)
    rows = spark.read.format("mcap").load(str(tmp_path)).where("episode = 'e1'").collect()
    assert [(r.topic, r.log_ns, bytes(r.data)) for r in rows] == [("/a", 3, b"one"), ("/b", 5, b"xyz"), ("/a", 6, b""), ("/b", 7, b"w")]
    assert spark.read.format("mcap").option("topics", "/a").load(str(tmp_path)).count() == 4
    (tmp_path / "bad.mcap").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        list(files.mcap_messages(str(tmp_path / "bad.mcap")))


def test_npz(tmp_path, spark):
    np.savez(tmp_path / "ep.npz", pose=np.array([[1.0, np.nan], [3.0, 4.0]]), name=np.array(["x"]))
    files.register(spark)
    rows = spark.read.format("npz").load(str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("ep", "pose", 0, [1.0, None]), ("ep", "pose", 1, [3.0, 4.0])]


def test_jsonl_fails_on_other_lines(tmp_path, spark):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": "x"\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path), "a INT").collect()


def test_listing(tmp_path, spark):
    (tmp_path / "x").mkdir()
    for p in ("a.mp4", "b.mp4", "x/a.mp4", "c.txt"):
        (tmp_path / p).write_bytes(p.encode())
    rows = files.listed_files(spark, str(tmp_path), "*.mp4").collect()
    assert sorted((r.stem, r.clashes, r["size"]) for r in rows) == [("a", 2, 5), ("a", 2, 7), ("b", 1, 5)]
