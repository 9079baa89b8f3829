"""Envelopes to tables: repeats, replays, drops, newest rows; files with faults; checks of a data set."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wakeline.operators.updates import upsert_zones
from wakeline.sources.feed import Segments, register
from wakeline.sources.files import batches, dataset_checks, read_lines, write_report, write_shards
from wakeline.sources.tracks import as_historical, box_scan, import_csv
from wakeline.streaming.ingest import DropCounts, Ingest, start


def envelope(mmsi, kind="PositionReport", at="2025-03-04 05:06:07", lat=1.0, lon=2.0, name="V", **body):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "latitude": lat, "longitude": lon, "ShipName": name, "time_utc": f"{at} +0000 UTC"}, "Message": {kind: {"Sog": 3.0, "Valid": True, **body}}})


def test_stream_from_feed_to_tables(spark, tmp_path):
    register(spark)
    feed = Segments(f"{tmp_path}/feed")
    feed.write(0, [envelope(1), envelope(1), envelope(1, Valid=False), envelope("x"), envelope(2, at="noon"), envelope(5, "ShipStaticData", name="Old", Type=70)])
    sink = Ingest(f"{tmp_path}/store")
    assert sink.static(spark).count() == 0
    stream = spark.readStream.format("wakeline_feed").option("folder", f"{tmp_path}/feed").load()
    for more in ([], [envelope(1), envelope(3), envelope(5, "ShipStaticData", at="2025-03-04 06:00:00", name="New", Type=71)]):
        if more:
            feed.write(1, more)
        q = start(stream.writeStream.foreachBatch(sink), f"{tmp_path}/c", once=True)
        q.awaitTermination(90)
        assert q.exception() is None
    stored = spark.read.parquet(f"{tmp_path}/store/positions")
    assert sorted(r.mmsi for r in stored.collect()) == [1, 3]
    assert [(r.ship_name, r.ship_type) for r in sink.static(spark).collect()] == [("New", 71)]
    assert sink.drops.drain() == {"invalid_flag": 1, "bad_mmsi": 1, "bad_timestamp": 1} and sink.drops.drain() == {}
    again = spark.createDataFrame([(envelope(3),), (envelope(4),)], "envelope string")
    sink(again, 7)
    sink(again, 7)
    assert sorted(r.mmsi for r in spark.read.parquet(f"{tmp_path}/store/positions").collect()) == [1, 3, 4]


def test_drop_counts_of_a_batch_that_runs_again():
    d = DropCounts()
    d.set(1, {"a": 2})
    d.set(2, {"a": 1, "b": 4})
    d.set(1, {"a": 3})
    assert d.drain() == {"a": 4, "b": 4} and d.drain() == {}


def test_a_bad_line_is_named_by_its_number(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n{broken\n')
    with pytest.raises(ValueError, match=r"a\.jsonl:4: not valid JSON: \{broken"):
        read_lines(spark, str(tmp_path), "id string")


def test_data_set_checks(spark):
    rows = [(m, "train" if m < 60 else "holdout", "a" if m % 3 else "b") for m in range(80)]
    df = spark.createDataFrame(rows, "mmsi long, split string, label string")
    got = {(r.split, r.label): (r.n, r.few) for r in dataset_checks(df, ["a", "b", "c"], 20).collect()}
    assert got == {("train", "a"): (40, False), ("train", "b"): (20, False), ("train", "c"): (0, True), ("holdout", "a"): (13, True), ("holdout", "b"): (7, True), ("holdout", "c"): (0, True)}
    with pytest.raises(ValueError, match="more than one split"):
        dataset_checks(df.unionByName(df.limit(1).withColumn("split", F.lit("other"))), ["a"])


def test_batches_of_shards(spark, tmp_path):
    write_shards(spark.range(10).select("id", F.lit("train").alias("split")), f"{tmp_path}/s", 3)
    plain = list(batches(spark, f"{tmp_path}/s", 4))
    assert [len(b) for b in plain] == [4, 4, 2] and sorted(r.id for b in plain for r in b) == list(range(10))
    one, two, other = ([r.id for b in batches(spark, f"{tmp_path}/s", 4, seed, "id") for r in b] for seed in (1, 1, 2))
    assert one == two != other and sorted(one) == sorted(other) == list(range(10))


def test_report_file_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "n long, rate double")
    for _ in range(2):
        write_report(df, str(tmp_path), "r")
    (part,) = (tmp_path / "r").glob("*.json")
    assert json.loads(part.read_text()) == {"n": 1, "rate": None}


def test_zones_that_are_not_manual_stay(spark):
    stored = spark.createDataFrame([("a", "u", 0.1, "manual"), ("b", "u", 0.1, "official"), ("c", "u", 0.1, "manual"), ("a", "v", 0.1, None)], "name string, source_url string, confidence double, origin string")
    after, counts = upsert_zones(stored, spark.createDataFrame([("a", "u", 0.9), ("b", "u", 0.9), ("d", "u", 0.9), ("a", "v", 0.9)], "name string, source_url string, confidence double"))
    assert {(r.name, r.source_url): (r.confidence, r.origin) for r in after.collect()} == {("a", "u"): (0.9, "manual"), ("b", "u"): (0.1, "official"), ("c", "u"): (0.1, "manual"), ("d", "u"): (0.9, "manual"), ("a", "v"): (0.1, None)}
    assert tuple(counts.first()) == (1, 1, 2)


def test_historical_rows_and_box_scan(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.csv").write_text("MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading\n1,2024-01-01T10:00:00,1,2,3,4,5\n1,2024-01-02T00:00:00,1,2,3,4,511\n2,2024-01-01T11:00:00,9,2,,4,5\n")
    rows = as_historical(import_csv(spark, str(tmp_path / "i")))
    assert {r.message_type for r in rows.collect()} == {"historical"} and rows.columns[-2:] == ["rate_of_turn", "message_type"]
    rows.withColumn("event_date", F.to_date("received_at")).write.partitionBy("event_date").parquet(f"{tmp_path}/p")
    held = spark.read.parquet(f"{tmp_path}/p")
    found = box_scan(held, "2024-01-01T00:00:00", "2024-01-02T00:00:00", 0, 2, 2, 3)
    assert [(r.mmsi, r.received_at) for r in found.collect()] == [(1, dt.datetime(2024, 1, 1, 10))]
    assert "PartitionFilters: [isnotnull(event_date" in found._jdf.queryExecution().executedPlan().toString()
