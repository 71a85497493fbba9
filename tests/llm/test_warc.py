import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from prefmill.llm import warc
from prefmill.session import scratch_path

TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n\r\n"


def rows():
    same = [(100 + k, f"http://h/{k}", "<p>same é</p>") for k in range(30)]
    return [*same, (1, "http://h/x y\r\nz", TRICKY), (2, None, None), (3, "no url", ""), (4, "http://h/?q=1#f", "x" * 300_000), (5, "http://h/", "\x00\x01 binary-ish 𝛼")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def written(spark, pages, **how):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, **how)
    return path


@pytest.mark.parametrize("small", [warc.SMALL, 0])
def test_round_trip(spark, monkeypatch, small):
    monkeypatch.setattr(warc.with_first_seen, "__defaults__", (small,))
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    records = warc.read_records(spark, written(spark, pages, compression="none" if small else "gzip"))
    assert records.count() == 3 * len(rows())
    caught = warc.captures(records).withColumn("page_id", F.col("metadata.fields")["pageId"].cast("long"))
    got = {r["page_id"]: r for r in warc.with_referred(caught, F.col("page_id"), "first").collect()}
    largest = {}
    for i, _, html in rows():
        largest[html or ""] = max(i, largest.get(html or "", 0))
    for i, url, html in rows():
        r = got[i]
        own = largest[html or ""] == i
        assert r["payload_bytes"] == len((html or "").encode()) and r["payload_digest"] == digest(html)
        assert (r["record_type"], r["first"]) == (("response", None) if own else ("revisit", largest[html or ""]))
        assert (r["payload"] is None) == (not own) and (not own or bytes(r["payload"]).decode() == (html or ""))
        assert (r["n_requests"], r["n_metadata"]) == (1, 1) and r["request"]["http_status"].startswith("GET ")
        assert r["target_uri"] == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
    assert got[4]["request"]["http_status"] == "GET /?q=1 HTTP/1.1"


def test_base32(spark, column):
    values = ["", "a", "é" * 100]
    assert column(warc.base32_sha1(F.encode("x", "UTF-8")), values) == [digest(v) for v in values]


def test_repeats_and_missing_ids(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "y"), (None, "u", "y")], "page_id long, url string, html string")
    records = warc.read_records(spark, written(spark, pages))
    kinds = sorted(r["record_type"] for r in warc.captures(records).collect())
    assert kinds == ["response"] * 4 + ["revisit"]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.captures(warc.read_records(spark, written(spark, pages))).count() == 0


RECORD = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\n%sContent-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"


def record(kind, name, more, content_type, block):
    return RECORD % (kind, name, more, content_type, len(block), block)


def test_foreign_files(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n c\r\n\r\nbody"
    first = record(b"warcinfo", b"i", b"", b"application/warc-fields", b"software: s\r\n")
    second = record(b"response", b"r", b"WARC-Concurrent-To: <q1>\r\n", b"application/http; msgtype=response", http)
    third = record(b"request", b"q1", b"", b"application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n")
    fourth = record(b"request", b"q0", b"WARC-Concurrent-To: <r>\r\nX:\r\n folded\r\n", b"application/http", b"GET /0 HTTP/1.1\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(second))
    (tmp_path / "b.warc").write_bytes(third + fourth)
    caught = warc.captures(warc.read_records(spark, str(tmp_path))).collect()
    assert [(r["record_id"], bytes(r["payload"]), r["request"]["record_id"], r["n_requests"], r["metadata"]) for r in caught] == [("<r>", b"body", "<q0>", 2, None)]


def test_gzipped_files_stream_record_by_record(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    bodies = {f"{f}-{k}": (b"WARC/1.1\r\nWARC/1." * (k % 7) + b"\xff\x00" * (40_000 * k) + b"WARC/1.") for f in range(3) for k in range(12)}
    for f in range(3):
        of_file = [record(b"response", name.encode(), b"", b"application/http", http + body) for name, body in bodies.items() if name.startswith(f"{f}-")]
        (tmp_path / f"{f}.warc.gz").write_bytes(gzip.compress(of_file[0]) + gzip.compress(b"".join(of_file[1:])))
    (tmp_path / "none.warc.gz").write_bytes(gzip.compress(b""))
    plan = warc.read_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan
    got = {r["record_id"][1:-1]: bytes(r["payload"]) for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert got == bodies


@pytest.mark.parametrize("cut", [3, 40, 120])
def test_a_cut_gzipped_file_is_an_error(spark, tmp_path, cut):
    good = record(b"response", b"r", b"", b"application/http", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 100)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good + good[: len(good) - cut - 4]))
    with pytest.raises(Exception, match="ends within"):
        warc.read_records(spark, str(tmp_path)).collect()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good)[:-cut])
    with pytest.raises(Exception):  # noqa: B017, PT011
        warc.read_records(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("cut", [3, 40, 120])
def test_a_cut_file_is_an_error(cut):
    whole = record(b"response", b"r", b"", b"application/http", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 100)
    assert len(list(warc.parse(whole))) == 1
    with pytest.raises(ValueError):
        list(warc.parse(whole[: len(whole) - cut - 4]))
    with pytest.raises(ValueError):
        list(warc.parse(whole[:cut]))
