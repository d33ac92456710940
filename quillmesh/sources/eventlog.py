"""The append-only event log: JSON lines in numbered segments under a folder per machine."""

from __future__ import annotations

import os
import secrets
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.dates import MAX_DRIFT_MS
from quillmesh.schemas import EVENT

SEGMENT_BYTES = 4 << 20
MAX_SEGMENTS = 9_999
_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def read(spark: SparkSession, root: str) -> DataFrame:
    """(id, hlc, author, op, machine, segment, corrupt): a row per line; corrupt holds what didn't parse.

    Every machine's segments are scanned as text, so a bad line costs that line only. A line is parsed with
    the fixed schema; unknown fields are passed over and missing ones null.
    """
    lines = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(f"{root}/events")
    return parse(lines.select("value", F.col("_metadata.file_path").alias("file")))


def parse(lines: DataFrame) -> DataFrame:
    schema = T.StructType.fromDDL(f"{EVENT}, _corrupt string")
    e = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    part = lambda i: F.element_at(F.split("file", "/"), i)
    rows = lines.filter(F.trim("value") != "").select(e.alias("e"), "value", part(-2).alias("machine"), part(-1).alias("segment"))
    bad = F.col("e._corrupt").isNotNull() | F.col("e.id").isNull() | F.col("e.hlc").isNull() | F.col("e.op.type").isNull()
    return rows.select("e.id", "e.hlc", "e.author", "e.op", "machine", "segment", F.when(bad, F.col("value")).alias("corrupt"))


def events(log: DataFrame) -> DataFrame:
    return log.filter("corrupt is null").select("id", "hlc", "author", "op")


def corrupt_counts(log: DataFrame) -> DataFrame:
    """(machine, corrupt): what a notice reports."""
    return log.groupBy("machine").agg(F.count("corrupt").alias("corrupt")).filter("corrupt > 0")


class StaleCursor(ValueError):
    """A cursor lies behind its segment's end, or its segment is gone: what was read before can't be built upon."""


def read_since(spark: SparkSession, root: str, cursors: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """(``read``'s rows of the whole lines behind the cursors, the cursors behind these).

    ``cursors``: bytes read by "machine/segment"; none is the start. Only segments that have grown are read, and a line
    without its end waits for it. Segments are bounded in size, so each is a row's bytes; their list is as
    long as the log has segments.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(f"{root}/events")
    listed = {"/".join(x.path.split("/")[-2:]): (x.path, x.length) for x in files.select("path", "length").collect()}
    for name, at in cursors.items():
        if name not in listed or at > listed[name][1]:
            raise StaleCursor(f"{name} has less than {at} bytes: rebuild")
    grown = [(path, cursors.get(name, 0)) for name, (path, size) in sorted(listed.items()) if size > cursors.get(name, 0)]
    if not grown:
        return parse(spark.createDataFrame([], "value string, file string")), dict(cursors)
    start = spark.createDataFrame(grown, "file string, start bigint")
    read_ = spark.read.format("binaryFile").load([path for path, _ in grown]).select(F.col("path").alias("file"), "content")
    new = read_.join(start, "file").withColumn("text", F.expr("cast(substring(content, cast(start + 1 as int)) as string)"))
    whole = F.octet_length("text") - F.octet_length(F.substring_index("text", "\n", -1))
    new = new.select("file", "start", "text", F.when(F.col("text").contains("\n"), whole).otherwise(0).alias("bytes"))
    ends = {"/".join(x.file.split("/")[-2:]): x.start + x.bytes for x in new.select("file", "start", "bytes").collect()}
    lines = new.filter("bytes > 0").select("file", F.explode(F.split(F.expr("substring(text, 1, char_length(text) - char_length(substring_index(text, '\n', -1)) - 1)"), "\n")).alias("value"))
    return parse(lines.select("value", "file")), {**cursors, **ends}


def stream(spark: SparkSession, root: str) -> DataFrame:
    """The same rows as a stream; the file source's checkpoint is the cursor. It reads a file once, so segments must
    arrive whole: for a log whose segments grow, ``read_since`` reads what is new."""
    lines = spark.readStream.schema("value string").format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(f"{root}/events")
    return parse(lines.select("value", F.col("_metadata.file_path").alias("file")))


@dataclass
class Clock:
    """Hybrid logical clock of the writing machine; runs on the driver."""

    machine: str
    wall_ms: int = 0
    counter: int = 0
    clamped: int = 0
    now_ms: object = field(default=lambda: int(time.time() * 1000))

    def observe(self, wall_ms: int, counter: int) -> bool:
        """Follow a remote clock, unless it is over a day ahead; whether it was followed."""
        if wall_ms > self.now_ms() + MAX_DRIFT_MS:
            self.clamped += 1
            return False
        if (wall_ms, counter) > (self.wall_ms, self.counter):
            self.wall_ms, self.counter = wall_ms, counter
        return True

    def tick(self) -> dict:
        now = self.now_ms()
        if now > self.wall_ms:
            self.wall_ms, self.counter = now, 0
        else:
            self.counter += 1
        return {"wall_ms": self.wall_ms, "counter": self.counter, "machine": self.machine}


class Ulids:
    """26 sortable characters; ids of one writer ascend even within a millisecond."""

    def __init__(self) -> None:
        self.last = 0

    def next(self, wall_ms: int) -> str:
        self.last = max(self.last + 1, (wall_ms << 80) | secrets.randbits(80))
        return "".join(_CROCKFORD[(self.last >> (5 * i)) & 31] for i in range(25, -1, -1))


class LocalLog:
    """Single writer of one machine's segments, on the driver; a batch is one write to one segment."""

    def __init__(self, root: str, machine: str, create: bool = False):
        self.dir = os.path.join(root, "events", machine)
        if create:
            os.makedirs(self.dir, exist_ok=True)
        elif not os.path.isdir(self.dir):
            raise FileNotFoundError(f"no log at {self.dir}")

    def segments(self) -> list[str]:
        return sorted(f for f in os.listdir(self.dir) if f.endswith(".jsonl") and os.path.isfile(os.path.join(self.dir, f)))

    def active(self, size: int) -> str:
        """The segment for a batch: the last one unless it would outgrow the limit; an empty one is used."""
        have = self.segments()
        if have:
            last = os.path.join(self.dir, have[-1])
            now = os.path.getsize(last)
            if not now or now + size <= SEGMENT_BYTES:
                return last
        number = int(have[-1].split(".")[0]) + 1 if have else 1
        if number > MAX_SEGMENTS:
            raise OverflowError("the log has no segment numbers left")
        return os.path.join(self.dir, f"{number:04d}.jsonl")

    def append(self, lines: list[str]) -> None:
        data = "".join(f"{x}\n" for x in lines).encode()
        if data:
            with open(self.active(len(data)), "ab") as f:
                f.write(data)


def complete_lines(data: bytes, start: int = 0) -> tuple[list[bytes], int]:
    """Whole lines from an offset and the offset behind them; a torn tail waits for its end."""
    if start > len(data):
        raise ValueError("the cursor lies behind the end: rebuild")
    end = data.rfind(b"\n", start) + 1
    return (data[start:end].splitlines(), end) if end > start else ([], start)
