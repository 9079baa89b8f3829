"""The feed: options, subscription, waits, filters at the source, restarts, a socket that drops."""

import json
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from wakeline.sources.envelopes import from_envelopes
from wakeline.sources.feed import LONGEST_WAIT, Collector, FeedOptions, Segments, backoff, frame_row, register


def frame(mmsi, kind="PositionReport", lat=1.0, lon=2.0, n=0):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "Latitude": lat, "Longitude": lon, "time_utc": "2025-03-04 05:06:07 +0000 UTC"}, "Message": {kind: {"Sog": n, "Valid": True}}})


@pytest.fixture
def feed(spark):
    register(spark)
    return spark


def test_options(tmp_path):
    o = FeedOptions.from_env("F_", {"F_FOLDER": "/x", "F_BOXES": "[[[1, 2], [3, 4]]]", "F_VESSELS": " 5, ,6", "F_TYPES": "", "F_PORT": "9"})
    assert (o.boxes, o.vessels, o.port, o.host) == ([[[1, 2], [3, 4]]], [5, 6], 9, "")
    assert "ShipStaticData" in o.types
    said = json.loads(o.subscription())
    assert said["BoundingBoxes"] == [[[1, 2], [3, 4]]] and said["FiltersShipMMSI"] == ["5", "6"]
    assert "FiltersShipMMSI" not in json.loads(FeedOptions("/x").subscription())
    for bad in ({}, {"folder": "/x", "boxes": "[[[5, 0], [1, 0]]]"}, {"folder": "/x", "boxes": "no"}):
        with pytest.raises(ValueError):
            FeedOptions.of(bad)


def test_waits_double_up_to_the_longest():
    waits = backoff(lambda: 0.0)
    assert [next(waits) for _ in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60]
    waits = backoff(lambda: 1.0)
    assert [next(waits) for _ in range(2)] == [1.25, 2.5]
    assert max(next(waits) for _ in range(9)) <= LONGEST_WAIT * 1.25


def test_frames():
    assert frame_row("{nope") is None and frame_row("[1]") is None
    assert frame_row('{"MetaData": 3}')[:4] == (None, None, None, None)
    assert frame_row(frame(7, lat=None))[:4] == (7, "PositionReport", None, 2.0)
    assert frame_row('{"MetaData": {"mmsi": "8", "latitude": "x"}}')[:4] == (8, None, None, None)


def test_boxes_across_the_antimeridian():
    o = FeedOptions("/x", boxes=[[[-10, 170], [10, -170]], [[40, 0], [50, 10]]])
    want = {(0, 175): True, (0, -175): True, (0, 0): False, (45, 5): True, (45, 175): False}
    assert {p: o.wants((1, "PositionReport", *p, "")) for p in want} == want
    assert o.wants((1, "ShipStaticData", None, None, ""))


def test_batch_read_pushes_filters(feed, tmp_path):
    s = Segments(str(tmp_path))
    s.write(0, [frame(1, n=1), "not json", frame(2, n=2), frame(3, "ShipStaticData")])
    s.write(1, [frame(1, n=3, lat=50.0), frame(4, "BaseStationReport"), "", frame(None)])
    df = feed.read.format("wakeline_feed").option("folder", str(tmp_path)).load()
    assert sorted((r.mmsi or 0, r.message_type) for r in df.collect()) == [(0, "PositionReport"), (1, "PositionReport"), (1, "PositionReport"), (2, "PositionReport"), (3, "ShipStaticData")]
    picked = df.where("mmsi in (1, 2) and message_type = 'PositionReport' and lat < 40 and envelope like '%Sog%'")
    assert sorted(r.mmsi for r in picked.collect()) == [1, 2]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "Batch" not in line]
    assert not any("mmsi" in f and "IN (1,2)" in f for f in filters)  # Spark tests no more than the text
    assert df.where("mmsi <=> null").count() == 1
    assert df.where("lat >= 1 and lat <= 1 and lon > 1.5 and mmsi = 2").count() == 1
    assert from_envelopes(picked).where("kind = 'position'").count() == 2
    few = feed.read.format("wakeline_feed").option("folder", str(tmp_path)).option("vessels", "1").option("boxes", "[[[40, 0], [60, 5]]]").load()
    assert [r.lat for r in few.collect()] == [50.0]
    assert feed.read.format("wakeline_feed").option("folder", str(tmp_path / "none")).load().count() == 0


def _drain(spark, folder, out, check, host=None, until=None):
    r = spark.readStream.format("wakeline_feed").option("folder", folder)
    if host:
        r = r.option("host", host[0]).option("port", str(host[1])).option("vessels", "1,2,3,4,5,6,7,8,9")
    w = r.load().select("mmsi", "envelope").writeStream.format("parquet").option("checkpointLocation", check)
    q = w.trigger(processingTime="1 second").start(out) if host else w.trigger(availableNow=True).start(out)
    if host:
        end = time.time() + 60
        while time.time() < end and not until():
            time.sleep(0.5)
        q.stop()
    else:
        q.awaitTermination(90)
    assert q.exception() is None


def _vessels(spark, out):
    return sorted(r.mmsi for r in spark.read.schema("mmsi long, envelope string").parquet(out).collect())


def test_a_restart_loses_and_repeats_nothing(feed, tmp_path):
    folder, out, check = (str(tmp_path / d) for d in ("feed", "out", "check"))
    s = Segments(folder)
    s.write(0, [frame(1), frame(2)])
    _drain(feed, folder, out, check)
    assert _vessels(feed, out) == [1, 2]
    s.write(1, [frame(3)])
    s.write(2, [frame(4), "{"])
    _drain(feed, folder, out, check)
    _drain(feed, folder, out, check)
    assert _vessels(feed, out) == [1, 2, 3, 4]


class Server(threading.Thread):
    """Sends given frames to each connection in turn, then drops it; keeps the lines it was sent."""

    def __init__(self, *turns):
        super().__init__(daemon=True)
        self.turns, self.heard = list(turns), []
        self.door = socket.create_server(("127.0.0.1", 0))
        self.at = self.door.getsockname()

    def run(self):
        for frames in self.turns:
            link, _ = self.door.accept()
            with link:
                self.heard.append(link.makefile().readline().strip())
                whole = "".join(f"{x}\n" for x in frames).encode()
                for i in range(0, len(whole), 50):  # frames come in pieces
                    link.sendall(whole[i : i + 50])
        self.door.close()


def test_collector_subscribes_and_connects_again(tmp_path):
    server = Server([frame(1), frame(2)], [], [frame(3), "junk"])
    server.start()
    c = Collector(FeedOptions(str(tmp_path), host=server.at[0], port=server.at[1], vessels=[1, 2, 3]), frames=2, seconds=0.1, waits=lambda: iter(lambda: 0.05, None))
    c.start()
    end = time.time() + 20
    while time.time() < end and len(server.heard) < 3:
        time.sleep(0.05)
    time.sleep(0.5)
    c.stop()
    assert len(server.heard) == 3 and len(set(server.heard)) == 1
    assert json.loads(server.heard[0])["FiltersShipMMSI"] == ["1", "2", "3"]
    s = Segments(str(tmp_path))
    lines = [line for n in range(s.count()) for line in s.read(n)]
    assert [frame_row(x)[0] if frame_row(x) else x for x in lines] == [1, 2, 3, "junk"]


def test_a_stream_from_a_socket(feed, tmp_path):
    folder, out, check = (str(tmp_path / d) for d in ("feed", "out", "check"))
    server = Server([frame(1), frame(77), "junk", frame(2)], [frame(3)])
    server.start()
    count = lambda: len(_vessels(feed, out) if (tmp_path / "out").exists() else []) >= 3
    _drain(feed, folder, out, check, server.at, count)
    assert _vessels(feed, out) == [1, 2, 3]
    assert feed.read.format("wakeline_feed").option("folder", folder).load().where(F.col("mmsi") == 77).count() == 1
