"""Operator 7, WARC: archives written, read back and assembled into captures.

Writing. Each page becomes a request, a response and a metadata record, tied by ``WARC-Concurrent-To``. Of pages
with equal payloads the one with the largest id is the response, the others are revisits of it and carry its
digest and length but no payload. Records are plain rows written by Spark's text writer, whose line separator
is the blank line that ends a record: committed like any table, wherever Spark can write.

Each task writes one file, about as large as its part of the pages.

Reading. Gzipped files (``*.gz``) stream through Spark's text reader, split at every ``WARC/1.``: a task puts the pieces
together again and cuts them by the records' lengths, so payloads may hold anything and a task holds a record, not
a file. Other files are read whole, one row a file. A file that ends within a record is an error, not a shorter
result (but for one that ends right after those seven bytes). Digests and lengths of responses are computed anew
from the payload.

Assembly. Requests and metadata are joined to the response or revisit they name, or that names them, and each
capture is one nested row. Several requests of one capture give the first by record id and their number.
Look-ups of a payload that very many pages share are spread over salts.

Defined results: null html is an empty payload; a null url gives no target; line breaks in a url are
percent-encoded. A repeated page is a repeated capture. Pages without an id cannot be referred to: among equal
payloads without any id all are responses. Empty tables give empty archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmill.llm.tables import bounded_batches, cut

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
#: Where the text reader cuts gzipped archives: every record begins with it.
_START = "WARC/1."
#: Repeated payloads that are looked up in memory (about 60 bytes each).
SMALL = 100_000
_SALTS = 16
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = (
    "record_id string, record_type string, date string, target_uri string, concurrent_to array<string>, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, http_status string, fields map<string,string>"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of 20 bits, four characters each."""
    digest = F.sha1(payload)
    out = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for place in (15, 10, 5, 0):
            at = F.shiftright(bits, place).bitwiseAND(F.lit(31)) + 1
            out.append(F.substr(F.lit(_ALPHABET), at, F.lit(1)))
    return F.concat(*out)


def _urn(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_first_seen(pages: DataFrame, page_id: str, digest: str, small: int = SMALL) -> DataFrame:
    """Adds ``first_id``: the page whose response holds an equal payload; null if it is the page's own.

    Payloads that repeat are looked up in memory while there are at most ``small`` of them; beyond that the pages
    are moved by digest and salt.
    """
    held = pages.groupBy(digest).agg(F.max(page_id).alias("_largest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _largest IS NOT NULL")
    held = cut(held.select(F.col(digest).alias("_digest"), "_largest"), "repeated")
    if held.count() <= small:
        joined = pages.join(F.broadcast(held), F.col(digest) == F.col("_digest"), "left")
    else:
        joined = salted_left_join(pages, held, digest, "_digest", F.col(page_id))
    return joined.withColumn("first_id", F.when(~F.col(page_id).eqNullSafe(F.col("_largest")), F.col("_largest"))).drop("_digest", "_largest")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, right_key: str, spread_by: Column) -> DataFrame:
    """A left join to rows that are unique by key, in which a hot key's left rows go to several tasks."""
    copies = right.withColumn("_look", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(_SALTS)).cast("int"))
    return salted.join(copies, (F.col(key) == F.col(right_key)) & (F.col("_salt") == F.col("_look")), "left").drop("_salt", "_look")


def _record(kind: Column, headers: list[tuple[str, Column]], content_type: Column, block: Column) -> Column:
    lines = [F.lit(f"{VERSION}{_CRLF}WARC-Type: "), kind, F.lit(_CRLF)]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit("")))
    lines += [F.lit("Content-Type: "), content_type, F.lit(f"{_CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_CRLF * 2), block]
    return F.concat(*lines)


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    compression: str = "gzip",
) -> None:
    """Write three records for each page to files below ``path``, each file compressed as a whole (``none``: not)."""
    chosen = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col(url).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    marked = chosen.withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    seen = with_first_seen(marked, "page_id", "digest")
    repeated = F.col("first_id").isNotNull()
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(_CRLF * 2),
    )
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    own, target = F.col("own_id"), F.col("url")
    profile = F.when(repeated, F.lit(PROFILE))
    response = _record(
        F.when(repeated, F.lit("revisit")).otherwise(F.lit("response")),
        [("WARC-Record-ID", own), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest)]
        + [("WARC-Profile", profile), ("WARC-Refers-To", F.when(repeated, _urn("response", F.col("first_id"), F.col("digest"))))],
        F.lit("application/http;msgtype=response"),
        F.concat(head, F.when(repeated, F.lit("")).otherwise(F.col("html"))),
    )
    path_of = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit(""))
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", _urn("request", F.col("page_id"), F.col("digest"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", target), ("WARC-Concurrent-To", own)],
        F.lit("application/http;msgtype=request"),
        F.concat(F.lit("GET "), F.when(path_of == "", F.lit("/")).otherwise(path_of), F.lit(f" HTTP/1.1{_CRLF * 2}")),
    )
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", _urn("metadata", F.col("page_id"), F.col("digest"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", target), ("WARC-Concurrent-To", own)],
        F.lit("application/warc-fields"),
        F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_CRLF)),
    )
    rows = seen.withColumn("own_id", _urn("response", F.col("page_id"), F.col("digest"))).select(F.explode(F.array(request, response, metadata)).alias("value"))
    rows.write.option("lineSep", _CRLF * 2).option("compression", compression).text(path)


def _headers(stream: io.BufferedIOBase) -> Iterator[tuple[str, str]]:
    name, value = "", ""
    while True:
        line = stream.readline()
        if not line.endswith(b"\n"):
            raise ValueError("an archive ends within the header of a record")
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            value += " " + text.strip()
            continue
        if name:
            yield name, value
        if not text:
            return
        name, _, value = (x.strip() for x in text.partition(":"))


def _http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status or request line, headers and body of an HTTP message; without its headers' end all is body."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        return "", {}, block
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in rest:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    return first, fields, body


class _Joined(io.RawIOBase):
    """Pieces of a file as one stream, with what they were cut at put back between them."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.rest, self.begun = iter(pieces), memoryview(b""), False

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = memoryview(_START.encode() + piece if self.begun else piece)
            self.begun = True
        n = min(len(room), len(self.rest))
        room[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def parse(content: bytes, payloads: bool = True) -> Iterator[dict]:
    """The records of one file, in order."""
    whole = io.BytesIO(content)
    return parse_stream(gzip.GzipFile(fileobj=whole) if content[:2] == b"\x1f\x8b" else whole, payloads)


def parse_stream(stream: io.BufferedIOBase, payloads: bool = True) -> Iterator[dict]:
    """The records of an unpacked file, in order."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        concurrent, fields = [], {}
        for name, value in _headers(stream):
            if name.lower() == "warc-concurrent-to":
                concurrent.append(value)
            else:
                fields.setdefault(name.lower(), value)
        size = int(fields.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("an archive ends within a record")
        kind = fields.get("warc-type", "")
        status, more, body = _http(block) if fields.get("content-type", "").startswith("application/http") else ("", {}, block)
        if kind == "metadata":
            more = dict((a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in body.decode("utf-8", "replace").splitlines()) if a)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        length = len(body)
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        elif kind == "revisit" and more.get("content-length", "").isdigit():
            length = int(more["content-length"])
        yield {
            "record_id": fields.get("warc-record-id"),
            "record_type": kind,
            "date": fields.get("warc-date"),
            "target_uri": fields.get("warc-target-uri"),
            "concurrent_to": concurrent,
            "refers_to": fields.get("warc-refers-to"),
            "payload_digest": digest,
            "payload_bytes": length,
            "payload": body if payloads and kind in ("response", "resource") else None,
            "http_status": status or None,
            "fields": more,
        }


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the files below a path."""
    bounded_batches(spark)
    text, number = pa.string(), pa.int64()
    kinds = [("record_id", text), ("record_type", text), ("date", text), ("target_uri", text), ("concurrent_to", pa.list_(text)), ("refers_to", text)]
    kinds += [("payload_digest", text), ("payload_bytes", number), ("payload", pa.binary()), ("http_status", text), ("fields", pa.map_(text, text))]
    schema = pa.schema(kinds)

    def rows_of(records: Iterable[dict]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for record in records:
            record["fields"] = list(record["fields"].items())
            rows.append(record)
            held += len(record["payload"] or b"") + 500
            if held > 4_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from rows_of(parse(content.as_py(), payloads))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((file.as_py(), piece) for batch in batches for file, piece in zip(batch.column(0), batch.column(1), strict=True))
        for _, own in groupby(pieces, lambda pair: pair[0]):
            yield from rows_of(parse_stream(io.BufferedReader(_Joined(piece.as_py() for _, piece in own), 1 << 20), payloads))

    file = F.col("_metadata.file_path")
    packed = spark.read.option("lineSep", _START).option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*.gz").text(path)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").option("recursiveFileLookup", "true").load(path)
    streams = packed.select(file, F.col("value").cast("binary").alias("piece")).mapInArrow(streamed, RECORDS)
    return streams.unionByName(plain.filter(~file.endswith(".gz")).select("content").mapInArrow(whole, RECORDS))


def captures(records: DataFrame) -> DataFrame:
    """One row for each response or revisit, with the request and the metadata that belong to it.

    Columns: those of the record, ``request`` and ``metadata`` (structs, null if there is none), ``n_requests`` and
    ``n_metadata``.
    """
    sides = records.filter("record_type IN ('request', 'metadata')")
    main = records.filter("record_type IN ('response', 'revisit')")
    named = sides.select(F.explode("concurrent_to").alias("capture"), "record_id", "record_type", "target_uri", "http_status", "fields")
    # A response may also name its request; the request then has no name to give, so it is looked up by its own id.
    naming = main.filter(F.size("concurrent_to") > 0).select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other"))
    looked = naming.join(sides, naming["other"] == sides["record_id"]).select("capture", "record_id", "record_type", "target_uri", "http_status", "fields")
    tied = named.unionByName(looked).withColumn("fields", F.map_entries("fields"))

    def first(kind: str) -> Column:
        own = F.col("record_type") == kind
        return F.min(F.when(own, F.struct("record_id", "target_uri", "http_status", "fields"))).alias(kind)

    def number(kind: str) -> Column:
        return F.count_distinct(F.when(F.col("record_type") == kind, F.col("record_id"))).alias(f"n_{kind}")

    def mapped(kind: str) -> Column:
        one = F.col(kind)
        whole = F.struct(one["record_id"].alias("record_id"), one["target_uri"].alias("target_uri"), one["http_status"].alias("http_status"), F.map_from_entries(one["fields"]).alias("fields"))
        return F.when(one.isNotNull(), whole).alias(kind)

    found = tied.groupBy("capture").agg(first("request"), first("metadata"), number("request"), number("metadata"))
    joined = main.join(found, main["record_id"] == found["capture"], "left")
    return joined.select(
        *[main[c] for c in main.columns],
        mapped("request"),
        mapped("metadata"),
        F.coalesce("n_request", F.lit(0)).alias("n_requests"),
        F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )


def with_referred(caught: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds to each revisit a value of the capture it refers to; null for responses."""
    wanted = caught.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("_wanted")).distinct()
    held = caught.filter("record_type = 'response'").select(F.col("record_id").alias("_held"), value.alias(name))
    held = held.join(wanted, F.col("_held") == F.col("_wanted"), "left_semi").groupBy("_held").agg(F.min(name).alias(name))
    return salted_left_join(caught, held, "refers_to", "_held", F.col("record_id")).drop("_held")
