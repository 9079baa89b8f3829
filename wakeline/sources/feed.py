"""A feed of JSON envelopes as a data source, `spark.read` and `spark.readStream` alike.

Frames lie in a folder of numbered segments (one frame a line), which is the feed's log: a stream's offset is the
number of segments that it has read, so that a restart neither loses nor repeats any, and executors read segments
in parallel. With `host` and `port` the stream itself holds the connection on the driver: it subscribes with the
options' boxes, vessels and message types, and writes what comes to the folder, a segment for each batch. What fits
no filter, and frames that are no JSON, are never given to Spark; a batch read pushes its filters here.
"""

from __future__ import annotations

import json
import os
import random
import socket
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from wakeline.sources.envelopes import POSITION_TYPES, STATIC_TYPES

SCHEMA = "mmsi long, message_type string, lat double, lon double, envelope string"
COLUMNS = ("mmsi", "message_type", "lat", "lon")
#: Seconds before the first and the last of the growing waits between connections, and the share of jitter.
FIRST_WAIT, LONGEST_WAIT, JITTER = 1.0, 60.0, 0.25
#: Frames of a segment, and the seconds after which a smaller one is closed.
SEGMENT_FRAMES, SEGMENT_S = 5000, 2.0
WORLD = [[[-90.0, -180.0], [90.0, 180.0]]]


def _listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


@dataclass(frozen=True)
class FeedOptions:
    """What the feed is asked for: boxes ([[south, west], [north, east]]), vessels (empty: all) and message types."""

    folder: str
    boxes: list = field(default_factory=lambda: [list(b) for b in WORLD])
    vessels: list[int] = field(default_factory=list)
    types: list[str] = field(default_factory=lambda: POSITION_TYPES + STATIC_TYPES)
    host: str = ""
    port: int = 0
    key: str = ""

    @classmethod
    def of(cls, options: Mapping[str, str]) -> FeedOptions:
        """Options as text: boxes as JSON, lists with commas; what is absent or blank is left at its default."""
        read: dict[str, Callable] = {"boxes": json.loads, "vessels": lambda t: [int(x) for x in _listed(t)], "types": _listed, "port": int}
        given = {f.name: options[f.name] for f in fields(cls) if (options.get(f.name) or "").strip()}
        if "folder" not in given:
            raise ValueError("the feed needs a folder for its segments")
        out = cls(**{k: read.get(k, str)(v) for k, v in given.items()})
        for box in out.boxes:
            (south, west), (north, east) = box
            if not (-90 <= south <= north <= 90 and -180 <= west <= 180 and -180 <= east <= 180):
                raise ValueError(f"no box: {box}")
        return out

    @classmethod
    def from_env(cls, prefix: str = "WAKELINE_FEED_", env: Mapping[str, str] | None = None) -> FeedOptions:
        held = os.environ if env is None else env
        return cls.of({f.name: held.get(prefix + f.name.upper(), "") for f in fields(cls)})

    def subscription(self) -> str:
        """The line that is sent at the start of a connection: what the feed is to send (its names are fixed values of the feed)."""
        said: dict = {"APIKey": self.key, "BoundingBoxes": self.boxes}
        if self.vessels:
            said["FiltersShipMMSI"] = [str(v) for v in self.vessels]
        if self.types:
            said["FilterMessageTypes"] = self.types
        return json.dumps(said)

    def wants(self, row: tuple) -> bool:
        mmsi, kind, lat, lon, _ = row
        return (not self.types or kind in self.types) and (not self.vessels or mmsi in self.vessels) and (lat is None or lon is None or any(_in_box(b, lat, lon) for b in self.boxes))


def _in_box(box: list, lat: float, lon: float) -> bool:
    """A box whose west lies east of its east crosses the antimeridian."""
    (south, west), (north, east) = box
    return south <= lat <= north and (west <= lon <= east if west <= east else lon >= west or lon <= east)


def frame_row(line: str) -> tuple | None:
    """mmsi, message_type, lat, lon and the text of a frame; None if it is no JSON object."""
    try:
        frame = json.loads(line)
    except ValueError:
        return None
    if not isinstance(frame, dict):
        return None
    meta = frame.get("MetaData")
    meta = meta if isinstance(meta, dict) else {}
    kind = frame.get("MessageType")

    def number(*names: str, whole: bool = False) -> float | int | None:
        said = next((meta[n] for n in names if meta.get(n) is not None), None)
        try:
            return None if said is None else int(said) if whole else float(said)
        except (TypeError, ValueError):
            return None

    return number("MMSI", "mmsi", whole=True), kind if isinstance(kind, str) else None, number("Latitude", "latitude"), number("Longitude", "longitude"), line.rstrip("\r\n")


def backoff(jitter: Callable[[], float] = random.random) -> Iterator[float]:
    """Waits between connections: doubled up to the longest, each with its share of jitter on top."""
    wait = FIRST_WAIT
    while True:
        yield min(wait, LONGEST_WAIT) + jitter() * wait * JITTER
        wait = min(wait * 2, LONGEST_WAIT)


class Segments:
    """Numbered segments of a folder; each appears whole, by a rename."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{os.path.abspath(folder)}")
        self._file = fs.FileType.File

    def path(self, number: int) -> str:
        return f"{self.root}/{number:012d}.ndjson"

    def count(self, known: int = 0) -> int:
        """How many there are, from the number known to be there."""
        while self.files.get_file_info(self.path(known)).type == self._file:
            known += 1
        return known

    def write(self, number: int, lines: list[str]) -> None:
        self.files.create_dir(self.root, recursive=True)
        part = f"{self.root}/.{number:012d}.part"
        with self.files.open_output_stream(part) as out:
            out.write("".join(f"{line}\n" for line in lines).encode())
        self.files.move(part, self.path(number))

    def read(self, number: int) -> Iterator[str]:
        with self.files.open_input_stream(self.path(number)) as held:
            yield from filter(None, held.read().decode("utf-8", "replace").split("\n"))


class Collector(threading.Thread):
    """Holds the connection: subscribes, writes frames to segments, and connects again after a wait when it drops."""

    def __init__(self, options: FeedOptions, frames: int = SEGMENT_FRAMES, seconds: float = SEGMENT_S, waits: Callable[[], Iterator[float]] = backoff) -> None:
        super().__init__(daemon=True)
        self.options, self.frames, self.seconds, self.waits = options, frames, seconds, waits
        self.segments = Segments(options.folder)
        self.next, self.held, self.opened = self.segments.count(), [], time.monotonic()
        self.over, self.lock = threading.Event(), threading.Lock()

    def run(self) -> None:
        waits = self.waits()
        while not self.over.is_set():
            try:
                with socket.create_connection((self.options.host, self.options.port), timeout=5) as link:
                    link.sendall(f"{self.options.subscription()}\n".encode())
                    link.settimeout(0.2)
                    if self._receive(link):
                        waits = self.waits()
            except OSError:
                pass  # the next turn connects again
            self.close_segment(now=True)
            self.over.wait(next(waits))

    def _receive(self, link: socket.socket) -> bool:
        """Takes frames until the connection ends; whether any came."""
        left, came = b"", False
        while not self.over.is_set():
            try:
                got = link.recv(1 << 16)
            except TimeoutError:
                self.close_segment()
                continue
            if not got:
                break
            came = True
            *lines, left = (left + got).split(b"\n")
            with self.lock:
                self.held += [t for t in (x.decode("utf-8", "replace").strip() for x in lines) if t]
            self.close_segment()
        return came

    def close_segment(self, now: bool = False) -> None:
        """Writes what is held if it is enough or old enough."""
        with self.lock:
            if self.held and (now or len(self.held) >= self.frames or time.monotonic() - self.opened >= self.seconds):
                self.segments.write(self.next, self.held)
                self.next, self.held, self.opened = self.next + 1, [], time.monotonic()
            elif not self.held:
                self.opened = time.monotonic()

    def stop(self) -> None:
        self.over.set()
        self.join(10)
        self.close_segment(now=True)


def _holds(value: object, op: str, to: object) -> bool:
    if value is None:
        return op == "<=>" and to is None
    return {"=": lambda: value == to, "<=>": lambda: value == to, "in": lambda: value in to, ">": lambda: value > to, ">=": lambda: value >= to, "<": lambda: value < to, "<=": lambda: value <= to}[op]()


def _rows(options: FeedOptions, number: int, tests: list[tuple[int, str, object]]) -> Iterator[tuple]:
    for line in Segments(options.folder).read(number):
        row = frame_row(line)
        if row is not None and options.wants(row) and all(_holds(row[i], op, value) for i, op, value in tests):
            yield row


class FeedReader(DataSourceReader):
    """All segments that are there, each a partition; comparisons of vessels, types and places are taken over."""

    OPERATORS = {EqualTo: "=", EqualNullSafe: "<=>", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, options: FeedOptions) -> None:
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            op, name = self.OPERATORS.get(type(f)), getattr(f, "attribute", ())
            if op is None or len(name) != 1 or name[0] not in COLUMNS:
                yield f  # Spark's to test
            else:
                self.tests.append((COLUMNS.index(name[0]), op, f.value))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(Segments(self.options.folder).count())] or [InputPartition(-1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value >= 0:
            yield from _rows(self.options, partition.value, self.tests)


class FeedStreamReader(DataSourceStreamReader):
    """Segments as they come; with a host, the connection that writes them."""

    def __init__(self, options: FeedOptions) -> None:
        self.options, self.collector, self.known = options, None, 0

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        if self.options.host and self.collector is None:
            self.collector = Collector(self.options)
            self.collector.start()
        self.known = Segments(self.options.folder).count(self.known)
        return {"segments": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(i) for i in range(start["segments"], end["segments"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.options, partition.value, [])

    def __getstate__(self) -> dict:
        return {"options": self.options, "collector": None, "known": 0}

    def stop(self) -> None:
        if self.collector is not None:
            self.collector.stop()
            self.collector = None


class FeedSource(DataSource):
    """The format `wakeline_feed`; its options are those of FeedOptions."""

    @classmethod
    def name(cls) -> str:
        return "wakeline_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FeedReader:
        return FeedReader(FeedOptions.of(dict(self.options)))

    def streamReader(self, schema: object) -> FeedStreamReader:
        return FeedStreamReader(FeedOptions.of(dict(self.options)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets batch reads push their filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
