"""Topics as an append-only log of files: a stream source with offsets and consumer groups, and a sink that writes once.

A log is a folder that the driver and all executors mount. Each message stands in a partition of its topic, by the hash
of its key, at the next offset. Tasks write their messages to segments; then the driver makes the next version, a small
file with the segments' offsets, the ends of all partitions, and the last batch of each producer. A version is made only
if no other producer made it first, and a batch that its producer's number says is there is passed over. So a batch that
is repeated after a crash writes nothing twice, and what a failed batch left is never read.

    spark.dataSource.register(TopicLog)
    rows.writeStream.format("topiclog").option("path", folder).option("producer", "search")  # columns topic, key, value
    spark.readStream.format("topiclog").option("path", folder).option("group", "monitor")

A stream starts at its group's committed offsets, or at the beginning (startingOffsets earliest, which replays the log
under a new checkpoint), or at the end (latest). Its own checkpoint goes on without loss or repeats. A group's offsets are
noted when its query begins the batch after: another query of the group may see the last batch again. topics and
messagesPerTrigger bound what a batch reads.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "topic string, partition int, offset long, key string, value string"
PARTITIONS = 6
#: Messages that a task holds before it writes them to its segment, and attempts to make a version.
HELD = 20_000
ATTEMPTS = 50


def _name(topic: str, partition: int) -> str:
    return f"{topic}/{partition}"


class Log:
    """The versions of a log's folder."""

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")

    def last(self) -> int:
        folder = f"{self.path}/versions"
        return max((int(n.removesuffix(".json")) for n in os.listdir(folder) if n.endswith(".json")), default=-1) if os.path.isdir(folder) else -1

    def at(self, number: int) -> dict:
        if number < 0:
            return {"ends": {}, "producers": {}, "segments": []}
        with open(f"{self.path}/versions/{number:020d}.json", encoding="utf-8") as file:
            return json.load(file)

    def make(self, number: int, content: dict) -> bool:
        """Makes a version, whole, unless there is one of this number."""
        os.makedirs(f"{self.path}/versions", exist_ok=True)
        draft = f"{self.path}/versions/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as file:
            json.dump(content, file)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(draft, f"{self.path}/versions/{number:020d}.json")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def between(self, start: dict[str, int], end: dict[str, int]) -> list[dict]:
        """The segments that hold messages from start up to end, newest first."""
        out, left = [], {p for p, e in end.items() if start.get(p, 0) < e}
        number = self.last()
        while left and number >= 0:
            version = self.at(number)
            for s in version["segments"]:
                p = s["partition"]
                low, high = max(s["start"], start.get(p, 0)), min(s["start"] + s["count"], end.get(p, 0))
                if low < high:
                    out.append(s | {"low": low, "high": high})
                if s["start"] <= start.get(p, 0):
                    left.discard(p)
            number -= 1
        return out

    def committed(self, group: str) -> dict[str, int] | None:
        name = f"{self.path}/groups/{group}.json"
        if not os.path.exists(name):
            return None
        with open(name, encoding="utf-8") as file:
            return json.load(file)

    def commit(self, group: str, ends: dict[str, int]) -> None:
        os.makedirs(f"{self.path}/groups", exist_ok=True)
        draft = f"{self.path}/groups/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as file:
            json.dump(ends, file)
        os.replace(draft, f"{self.path}/groups/{group}.json")


@dataclass
class Segment(InputPartition):
    """Batches of a segment's file that hold a partition's messages, and the offsets that are wanted."""

    topic: str
    partition: int
    file: str
    batches: list[int]
    start: int
    low: int
    high: int


def _read(segment: Segment) -> Iterator[pa.RecordBatch]:
    with pa.memory_map(segment.file) as source:
        reader, at = pa.ipc.open_file(source), segment.start
        for k in segment.batches:
            batch = reader.get_batch(k)
            low, high = max(segment.low - at, 0), min(segment.high - at, batch.num_rows)
            if low < high:
                n = high - low
                own = batch.slice(low, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment.topic] * n), pa.array(np.full(n, segment.partition, np.int32)), pa.array(np.arange(at + low, at + high)), own.column(0), own.column(1)],
                    ["topic", "partition", "offset", "key", "value"],
                )
            at += batch.num_rows


def _segments(log: Log, start: dict[str, int], end: dict[str, int]) -> list[Segment]:
    out = []
    for s in log.between(start, end):
        topic, _, partition = s["partition"].rpartition("/")
        out.append(Segment(topic, int(partition), f"{log.path}/segments/{s['file']}", s["batches"], s["start"], s["low"], s["high"]))
    return out


class LogReader(DataSourceReader):
    """The whole log, or the listed topics, as a table."""

    def __init__(self, log: Log, topics: set[str] | None) -> None:
        self.log, self.topics = log, topics

    def partitions(self) -> list[InputPartition]:
        ends = self.log.at(self.log.last())["ends"]
        return _segments(self.log, {}, {p: e for p, e in ends.items() if self.topics is None or p.rpartition("/")[0] in self.topics}) or [Segment("", 0, "", [], 0, 0, 0)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _read(partition)


class LogStream(DataSourceStreamReader):
    """The log as a stream: an offset is the end of every partition."""

    def __init__(self, log: Log, topics: set[str] | None, options: dict) -> None:
        self.log, self.topics = log, topics
        self.group, self.starting = options.get("group"), options.get("startingoffsets", "group")
        self.most = int(options.get("messagespertrigger", 0))
        self.reached: dict[str, int] | None = None

    def _ends(self) -> dict[str, int]:
        ends = self.log.at(self.log.last())["ends"]
        return {p: e for p, e in ends.items() if self.topics is None or p.rpartition("/")[0] in self.topics}

    def initialOffset(self) -> dict:
        if self.starting == "latest":
            return self._ends()
        return (self.log.committed(self.group) if self.group and self.starting == "group" else None) or {}

    def latestOffset(self) -> dict:
        ends = self._ends()
        if not self.most:
            return ends
        # A bounded step beyond what was given last, partition by partition.
        before = self.reached if self.reached is not None else self.initialOffset()
        left, out = self.most, dict(before)
        for p in sorted(ends):
            step = min(left, ends[p] - before.get(p, 0))
            if step > 0:
                out[p], left = before.get(p, 0) + step, left - step
        self.reached = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = end
        return _segments(self.log, start, end)

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)

    def commit(self, end: dict) -> None:
        if self.group:
            self.log.commit(self.group, end)


@dataclass
class Written(WriterCommitMessage):
    """The segment file of a task: its batches and messages by partition."""

    file: str
    held: dict[str, tuple[list[int], int]]


class LogWriter(DataSourceStreamArrowWriter):
    """Appends a stream's micro-batches, each once."""

    def __init__(self, log: Log, options: dict) -> None:
        self.log, self.producer, self.count = log, options.get("producer", "default"), int(options.get("partitions", PARTITIONS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(f"{self.log.path}/segments", exist_ok=True)
        file, schema = f"{uuid.uuid4().hex}.arrow", pa.schema([("key", pa.string()), ("value", pa.string())])
        held: dict[str, list[tuple[str | None, str | None]]] = {}
        done: dict[str, tuple[list[int], int]] = {}
        size = number = 0
        with pa.OSFile(f"{self.log.path}/segments/{file}", "wb") as sink, pa.ipc.new_file(sink, schema) as out:

            def flush() -> None:
                nonlocal number, size
                for p in sorted(held):
                    keys, values = zip(*held[p])
                    out.write_batch(pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], schema=schema))
                    batches, n = done.get(p, ([], 0))
                    done[p] = ([*batches, number], n + len(keys))
                    number += 1
                held.clear()
                size = 0

            for batch in iterator:
                for topic, key, value in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("topic", "key", "value"))):
                    held.setdefault(_name(topic, zlib.crc32((key or "").encode()) % self.count), []).append((key, value))
                    size += 1
                if size >= HELD:
                    flush()
            flush()
        return Written(file, done)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        for _ in range(ATTEMPTS):
            number = self.log.last()
            at = self.log.at(number)
            if at["producers"].get(self.producer, -1) >= batchId:
                return
            ends, segments = dict(at["ends"]), []
            for m in messages:
                for p, (batches, n) in (m.held if m else {}).items():
                    start = ends.get(p, 0)
                    segments.append({"partition": p, "file": m.file, "batches": batches, "start": start, "count": n})
                    ends[p] = start + n
            if self.log.make(number + 1, {"ends": ends, "producers": at["producers"] | {self.producer: batchId}, "segments": segments}):
                return
        raise RuntimeError(f"no version could be made in {ATTEMPTS} attempts: too many producers")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        """What was written is named by no version."""


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topiclog"

    def schema(self) -> str:
        return SCHEMA

    def _log(self) -> tuple[Log, set[str] | None]:
        options = {k.lower(): v for k, v in self.options.items()}
        topics = options.get("topics")
        return Log(options["path"]), {t.strip() for t in topics.split(",")} if topics else None

    def reader(self, schema: object) -> DataSourceReader:
        return LogReader(*self._log())

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return LogStream(*self._log(), {k.lower(): v for k, v in self.options.items()})

    def streamWriter(self, schema: object, overwrite: bool) -> DataSourceStreamArrowWriter:
        return LogWriter(self._log()[0], {k.lower(): v for k, v in self.options.items()})
