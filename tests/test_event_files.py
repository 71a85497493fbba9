"""Event files written by the test are read back; damage is told."""

import struct

import numpy as np
import pytest
from pyspark.sql import Row

from prefmill.session import scratch_path
from prefmill.sources import event_files as E


def folder(tmp_path, files):
    for name, data in files.items():
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(data)
    return str(tmp_path)


def file_of(points):
    return b"".join(E._framed(m) for m in [b"\x1a\x0dbrain.Event:2", *[E.event(*p) for p in points]])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_checksum():
    """The published check value of CRC-32C."""
    data = np.frombuffer(b"123456789", np.uint8)
    crc = 0xE3069283
    masked = ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert E.masked_crcs(data, np.array([0]), np.array([9])).tolist() == [masked]


def test_points_of_several_files(spark, tmp_path):
    one = [("train/loss", s, s / 4, 1.5) for s in range(2000)] + [("eval/loss", -3, -0.5, 2.0), ("ünï", 2**40, 1e-3, 0.0)]
    tensor = b"\x08\x01\x12\x00\x22\x04" + struct.pack("<f", 2.5)
    item = b"\x0a\x01t" + b"\x42" + bytes([len(tensor)]) + tensor
    other = b"\x10\x07\x2a" + bytes([len(item) + 2]) + b"\x0a" + bytes([len(item)]) + item
    path = folder(tmp_path, {"a/events.out.tfevents.1": file_of(one), "b/events.out.tfevents.2": E._framed(other), "b/notes.txt": b"x", "c/events.out.tfevents.3": b""})
    single = lambda x: struct.unpack("<f", struct.pack("<f", x))[0]
    expected = [("a", "events.out.tfevents.1", t, s, single(v)) for t, s, v, _ in one] + [("b", "events.out.tfevents.2", "t", 7, 2.5)]
    assert rows(E.read_event_files(spark, path)) == sorted(expected)
    assert rows(E.read_event_files(spark, path, ["eval/loss", "none"])) == [("a", "events.out.tfevents.1", "eval/loss", -3, -0.5)]
    assert E.read_event_files(spark, path).rdd.getNumPartitions() == 3


def test_filters_on_tags_reach_the_source(spark, tmp_path):
    path = folder(tmp_path, {"a/events.out.tfevents.1": file_of([("x", 1, 1.0), ("y", 2, 2.0)])})
    E.register(spark)
    df = spark.read.format("event_files").load(path).filter("tag IN ('y', 'z') AND step > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "tag" not in plan.split("Filter")[1].split("\n")[0] and [r["tag"] for r in df.collect()] == ["y"]
    assert spark.read.format("event_files").load(path).filter("tag = 'y' AND tag = 'x'").count() == 0


def test_torn_and_damaged_files(spark, tmp_path):
    whole = file_of([("x", k, 1.0) for k in range(5)])
    first = len(file_of([("x", k, 1.0) for k in range(2)]))
    flipped = bytearray(whole)
    flipped[first + 14] ^= 1
    length = bytearray(whole)
    length[first + 3] ^= 1
    files = {"w": whole, "t": whole[:-5], "h": whole[: first + 7], "d": bytes(flipped), "l": bytes(length)}
    path = folder(tmp_path, {f"{n}/events.out.tfevents.0": d for n, d in files.items()})
    report = {r["run"]: (r["n_records"], r["problem"]) for r in E.event_file_report(spark, path).collect()}
    assert report == {"w": (6, None), "t": (5, "torn"), "h": (3, "torn"), "d": (3, "damaged"), "l": (3, "damaged")}
    counts = {r["run"]: r["count"] for r in E.read_event_files(spark, path, damaged="stop").groupBy("run").count().collect()}
    assert counts == {"w": 5, "t": 4, "h": 2, "d": 2, "l": 2}
    with pytest.raises(Exception, match="damaged record"):
        E.read_event_files(spark, path).count()


def test_records_longer_than_a_chunk(spark, tmp_path, monkeypatch):
    import io

    data = file_of([("x" * 50, k, 1.0) for k in range(9)])
    monkeypatch.setattr(E, "CHUNK", 7)
    found = list(E.records(io.BytesIO(data)))
    assert sum(len(m) for m, _, _ in found) == 10 and sum(t for _, t, _ in found) == len(data) and found[-1][2] is None


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        E.read_event_files(spark, str(tmp_path / "none")).count()


def test_written_files_are_read_back(spark):
    path = scratch_path(spark, "events")
    points = spark.range(1000).selectExpr("'r' || id % 3 AS run", "'t' || id % 2 AS tag", "id AS step", "id / 8D AS value")
    E.write_event_files(points.repartition(4), path)
    assert rows(E.read_event_files(spark, path).select("run", "tag", "step", "value")) == rows(points)


def test_checksums_are_made_for_many_records_at_once(tmp_path, monkeypatch):
    """Made a record at a time, they took most of a job's time."""
    calls, made = [], E.masked_crcs
    monkeypatch.setattr(E, "masked_crcs", lambda *a: calls.append(1) or made(*a))
    points = [Row(run=f"r{k % 2}", tag="x" * (k % 5 + 1), step=k, value=k / 4) for k in range(2 * E.TOGETHER + 7)]
    writer = E.EventWriter({"path": str(tmp_path)})
    writer.commit([writer.write(iter(points))])
    assert len(calls) < 20
    for run in ("r0", "r1"):
        (file,) = (tmp_path / run).iterdir()
        assert file.read_bytes() == file_of([(p.tag, p.step, p.value) for p in points if p.run == run])
