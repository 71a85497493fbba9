"""Binary event files of training runs as a Spark data source (``spark.read.format("event_files")``) and sink.

A file is a partition. It is a sequence of framed records: length, masked CRC-32C of the length, an event message, masked
CRC-32C of the message. Records are checked and decoded a few MB at a time, and only the wanted tags become rows: filters on
``tag`` reach the source (with ``spark.sql.python.filterPushdown.enabled``), as does the option ``tags``.

A file whose last record is cut off, as a writer leaves it that is still at work or was stopped, gives the records before.
``option("report", "true")`` gives a row a file instead: how many records and bytes were read, and what follows them
(``torn`` or ``damaged``). A record with a wrong checksum fails the job, unless ``option("damaged", "stop")`` is given: then
the file ends before it.

Points are scalar summary values, plain or as tensors of one float or double; other values are passed over.
"""

from __future__ import annotations

import fnmatch
import json
import struct
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

PATTERN = "events.out.tfevents.*"
POINTS = "run string, event_file string, tag string, step long, value double, wall_time double"
REPORT = "run string, event_file string, n_records long, n_bytes long, problem string"
CHUNK = 4 << 20
#: Records written at once.
TOGETHER = 4096

# Fixed value: the polynomial of CRC-32C, and the constant that masks a checksum.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8


def _table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(_POLYNOMIAL), crc >> 1)
    return crc


_CRC = _table()


def masked_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each stretch; stretches of one size are taken together, byte by byte."""
    out = np.zeros(len(starts), np.uint32)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for k in range(int(size)):
            crc = _CRC[(crc ^ data[starts[rows] + k]) & 255] ^ (crc >> 8)
        out[rows] = ~crc
    return (out >> 15 | out << 17) + np.uint32(_MASK)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields; fixed-width values as their bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _scalar(tensor: bytes) -> float | None:
    """The value of a tensor of one float or double."""
    found = dict(fields(tensor))
    kind, packed = {1: ("<f", 5), 2: ("<d", 6)}.get(found.get(1), (None, 0))
    raw = found.get(4) or found.get(packed)
    return struct.unpack(kind, raw)[0] if kind and raw and len(raw) == struct.calcsize(kind) else None


def points(event: bytes, tags: frozenset[str] | None) -> Iterator[tuple[str, int, float, float]]:
    """(tag, step, value, wall time) of an event's scalars."""
    step, wall, summaries = 0, 0.0, []
    for number, value in fields(event):
        if number == 1:
            wall = struct.unpack("<d", value)[0]
        elif number == 2:
            step = value - (1 << 64) if value >> 63 else value
        elif number == 5:
            summaries.append(value)
    for summary in summaries:
        for number, item in fields(summary):
            if number == 1:
                own = dict(fields(item))
                tag = own.get(1, b"").decode("utf-8", "replace")
                if tags is None or tag in tags:
                    value = struct.unpack("<f", own[2])[0] if 2 in own else _scalar(own[8]) if 8 in own else None
                    if value is not None:
                        yield tag, step, value, wall


def records(file) -> Iterator[tuple[list[bytes], int, str | None]]:
    """Messages of some MB, the bytes they took, and at the end what is wrong with the rest of the file."""
    rest = b""
    while True:
        more = file.read(CHUNK)
        data = rest + more
        at, starts, sizes = 0, [], []
        while at + 12 <= len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            if at + 16 + size > len(data):
                break
            starts.append(at)
            sizes.append(size)
            at += 16 + size
        raw = np.frombuffer(data, np.uint8)
        begin, size = np.array(starts, np.int64), np.array(sizes, np.int64)
        stated = lambda where: np.frombuffer(raw[where[:, None] + np.arange(4)].tobytes(), "<u4")
        fine = masked_crcs(raw, begin, np.full(len(begin), 8)) == stated(begin + 8)
        # A damaged length would send the reader anywhere: what follows it is not looked at.
        good = int(np.argmin(fine)) if len(fine) and not fine.all() else len(fine)
        begin, size = begin[:good], size[:good]
        sound = masked_crcs(raw, begin + 12, size) == stated(begin + 12 + size)
        good = int(np.argmin(sound)) if len(sound) and not sound.all() else len(sound)
        taken = int(begin[good - 1] + size[good - 1] + 16) if good else 0
        messages = [data[b + 12 : b + 12 + s] for b, s in zip(begin[:good].tolist(), size[:good].tolist(), strict=True)]
        if good < len(fine):
            yield messages, taken, "damaged"
            return
        rest = data[at:]
        # A record that does not end in the chunk: its length is told from a damaged one by its checksum.
        if len(rest) >= 12 and masked_crcs(np.frombuffer(rest, np.uint8), np.zeros(1, np.int64), np.array([8]))[0] != int.from_bytes(rest[8:12], "little"):
            yield messages, taken, "damaged"
            return
        if not more:
            yield messages, taken, "torn" if rest else None
            return
        yield messages, taken, None


def _files(path: str) -> list[tuple[str, str]]:
    """(path, address) of the event files at or below a path."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted((f.path, path) for f in found if f.type == fs.FileType.File and (f.path == place or fnmatch.fnmatch(f.base_name, PATTERN)))


def _system(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)[0] if "://" in address or address.startswith("file:") else fs.LocalFileSystem()


@dataclass
class EventFile(InputPartition):
    path: str
    address: str


class EventReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.report = options["path"], options.get("report") == "true"
        self.stop = options.get("damaged", "fail") == "stop" or self.report
        self.tags = frozenset(json.loads(options["tags"])) if "tags" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("tag",) and not self.report:
                wanted = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.tags = wanted if self.tags is None else self.tags & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [EventFile(*f) for f in _files(self.path)] or [EventFile("", "")]

    def read(self, partition: EventFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        run, name = partition.path.split("/")[-2:] if "/" in partition.path else ("", partition.path)
        n_records = n_bytes = 0
        wrong = None
        with _system(partition.address).open_input_stream(partition.path) as file:
            for messages, taken, problem in records(file):
                n_records, n_bytes, wrong = n_records + len(messages), n_bytes + taken, problem
                if problem == "damaged" and not self.stop:
                    raise ValueError(f"{partition.path}: damaged record after {n_bytes} bytes")
                if not self.report:
                    rows = [p for m in messages for p in points(m, self.tags)]
                    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
                    kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
                    same = [pa.array([x] * len(rows), pa.string()) for x in (run, name)]
                    arrays = [*same, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
                    yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in POINTS.split(", ")])
        if self.report:
            row = {"run": run, "event_file": name, "n_records": n_records, "n_bytes": n_bytes, "problem": wrong}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("run", pa.string()), ("event_file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("problem", pa.string())]))


def framed(messages: Sequence[bytes]) -> bytes:
    """Messages as records, one after another; their checksums are made together."""
    sizes = np.array([len(m) for m in messages], np.int64)
    heads, ends = sizes.astype("<u8").tobytes(), np.cumsum(sizes)
    of_sizes = masked_crcs(np.frombuffer(heads, np.uint8), np.arange(0, len(heads), 8), np.full(len(sizes), 8)).astype("<u4").tobytes()
    of_messages = masked_crcs(np.frombuffer(b"".join(messages), np.uint8), ends - sizes, sizes).astype("<u4").tobytes()
    return b"".join(
        part for k, m in enumerate(messages) for part in (heads[8 * k : 8 * k + 8], of_sizes[4 * k : 4 * k + 4], m, of_messages[4 * k : 4 * k + 4])
    )


def _framed(message: bytes) -> bytes:
    return framed([message])


def _number(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def event(tag: str, step: int, value: float, wall_time: float = 0.0) -> bytes:
    """The message of one scalar."""
    name = tag.encode()
    item = b"\x0a" + _number(len(name)) + name + b"\x15" + struct.pack("<f", value)
    summary = b"\x0a" + _number(len(item)) + item
    return b"\x09" + struct.pack("<d", wall_time) + b"\x10" + _number(step) + b"\x2a" + _number(len(summary)) + summary


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class EventWriter(DataSourceWriter):
    """Each task writes a file for each run it has rows of; files get their names when all tasks are done."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        system, root = _system(self.path), self.path.split("://")[-1]
        files, moves, mark = {}, [], uuid.uuid4().hex
        waiting: dict[str, list[bytes]] = {}
        for row in rows:
            if row.run not in files:
                hidden, final = f"{root}/{row.run}/_writing.{mark}", f"{root}/{row.run}/events.out.tfevents.{mark}"
                system.create_dir(f"{root}/{row.run}", recursive=True)
                files[row.run] = system.open_output_stream(hidden)
                moves.append((hidden, final))
                waiting[row.run] = [b"\x1a\x0dbrain.Event:2"]
            waiting[row.run].append(event(row.tag, row.step, row.value))
            if len(waiting[row.run]) >= TOGETHER:
                files[row.run].write(framed(waiting[row.run]))
                waiting[row.run] = []
        for run, file in files.items():
            if waiting[run]:
                file.write(framed(waiting[run]))
            file.close()
        return Written(moves)

    def commit(self, messages: list) -> None:
        for hidden, final in (m for x in messages if x for m in x.moves):
            _system(self.path).move(hidden, final)

    def abort(self, messages: list) -> None:
        for hidden, _ in (m for x in messages if x for m in x.moves):
            _system(self.path).delete_file(hidden)


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return REPORT if self.options.get("report") == "true" else POINTS

    def reader(self, schema) -> EventReader:
        return EventReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> EventWriter:
        return EventWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters on tags pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventFiles)


def read_event_files(spark: SparkSession, path: str, tags: Sequence[str] | None = None, damaged: str = "fail") -> DataFrame:
    """Points (run, event_file, tag, step, value) of the event files at or below a path; a run is a file's folder."""
    register(spark)
    reader = spark.read.format("event_files").option("damaged", damaged)
    if tags is not None:
        reader = reader.option("tags", json.dumps(list(tags)))
    return reader.load(path).drop("wall_time")


def event_file_report(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: records and bytes read, and the problem after them, if any."""
    register(spark)
    return spark.read.format("event_files").option("report", "true").load(path)


def write_event_files(points: DataFrame, path: str) -> None:
    """Save points (run, tag, step, value), at least one file a run; values become single precision."""
    register(points.sparkSession)
    points.select("run", "tag", "step", "value").write.format("event_files").mode("append").save(path)


# The workers get the source by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
