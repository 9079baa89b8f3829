import pytest
from pyspark.sql import functions as F

from wakeline.operators import rules, updates
from wakeline.plans.records import ZONE_FILE
from wakeline.sources.envelopes import from_envelopes, time_utc
from wakeline.sources.zones import parse_zones, sound_zones


def test_times_are_cut_to_microseconds(spark):
    said = ["2031-08-17 03:04:05.123456789 +0000 UTC", " 2031-08-17 03:04:05 +0000 UTC ", "2031-13-17 03:04:05 +0000 UTC", "2031-08-17T03:04:05Z", None]
    got = [r.t for r in spark.createDataFrame([(s,) for s in said], "s string").select(F.unix_micros(time_utc(F.col("s"))).alias("t")).collect()]
    assert got == [1944702245123456, 1944702245000000, None, None, None]


def test_envelopes_without_type_identity_or_place_are_ignored(spark):
    rows = ['{"MessageType":"Other"}', '{"MessageType":"PositionReport","MetaData":{}}', '{"MessageType":"PositionReport","MetaData":{"MMSI":5,"time_utc":"2031-08-17 03:04:05 +0000 UTC"}}', "no json", None]
    got = from_envelopes(spark.createDataFrame([(r,) for r in rows], "envelope string")).collect()
    assert [(r.kind, r.reason) for r in got] == [("ignored", None)] * 5


@pytest.mark.parametrize(("old", "new", "problem"), [("https://x.org/1", "ftp://x", "source_url"), ("0.8", "1.8", "confidence"), ("[4.0, 51.02]]", "[4.1, 51.02]]", "ring"), ("4.08, 51.05", "184.08, 51.05", "position"), ('"last_seen": "2024-01-20"', '"last_seen": "2024-01-02"', "dates"), ('"2024-01-05"', '"2024-02-30"', "dates"), ('"Polygon"', '"Point"', "geometry")])
def test_unsound_zones_stop_the_load(spark, old, new, problem):
    assert old in ZONE_FILE
    zones = parse_zones(spark.createDataFrame([(ZONE_FILE.replace(old, new, 1),)], "document string"))
    with pytest.raises(ValueError, match=problem):
        sound_zones(zones)


def test_a_key_twice_in_a_file_stops_the_load(spark):
    twice = ZONE_FILE.replace("south", "north").replace("x.org/2", "x.org/1")
    with pytest.raises(ValueError, match="twice"):
        sound_zones(parse_zones(spark.createDataFrame([(twice,)], "document string")))


def test_upsert_on_an_empty_table_and_without_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert {tuple(r) for r in updates.upsert(rows.where("false"), rows, ["k"]).collect()} == {(1, "a", "inserted"), (2, None, "inserted")}
    assert {tuple(r) for r in updates.upsert(rows, rows.where("false"), ["k"]).collect()} == {(1, "a", "kept"), (2, None, "kept")}


def test_forced_verdicts_are_recorded(spark):
    held = spark.createDataFrame([(1, "benign")], "incident_id long, verdict string")
    given = spark.createDataFrame([(1, "jamming")], "incident_id long, verdict string")
    assert updates.record_verdicts(held, given, force=True).first().outcome == "recorded"


def test_pairs_of_thresholds():
    rules.check_pair(1.0, 1.5)
    for pair in ((1.0, 1.4), (20.0, 40.0), (1e-5, 1.0)):
        with pytest.raises(ValueError):
            rules.check_pair(*pair)


def test_an_empty_report_has_one_issue(spark):
    got = spark.range(1).select(rules.report_issues(F.lit(" "), F.lit(1), F.lit("jamming"), F.lit(0.5), F.lit(None).cast("string")).alias("i")).first().i
    assert got == ["empty"]
