"""Thresholds, audit rows, report texts with an end, the retention, counts with a limit of time, text forms."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from wakeline.functions.cleaning import as_time, not_told
from wakeline.functions.geo import as_geojson, ewkt, point_of
from wakeline.operators import rules
from wakeline.operators.limits import count_within
from wakeline.sources.stores import ReportStore, Retention, ThresholdStore, record_audit
from wakeline.sources.zones import parse_zones

T0 = dt.datetime(2024, 1, 1, 12)


def test_thresholds(spark, tmp_path):
    s = ThresholdStore(spark, f"{tmp_path}/t")
    assert s.active().count() == 0
    assert [s.set(0.1 * i, 0.2 * i, "m", "agent", T0 - dt.timedelta(days=i)) for i in (1, 2, 3)] == [1, 2, 3]
    assert (s.active().first().id, s.active().first().a) == (3, pytest.approx(0.3))
    assert [r.id for r in s.history(2).collect()] == [3, 2]
    for a, b in ((0.1, 0.1), (1e-6, 1.0), (50.0, 100.0)):
        with pytest.raises(ValueError):
            s.set(a, b, None, "hand", T0)
    assert s.rows().count() == 3
    with pytest.raises(ValueError):
        s.history(0)


def test_audit_rows_are_written_once_and_never_raise(spark, tmp_path):
    row = ("scope", "7", "baseline", "[]", "{}", T0)
    assert record_audit(spark, f"{tmp_path}/a", *row) and record_audit(spark, f"{tmp_path}/a", *row)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 1
    (tmp_path / "file").write_text("")
    assert record_audit(spark, f"{tmp_path}/file/a", *row) is False


def test_reports_end(spark, tmp_path):
    s = ReportStore(spark, f"{tmp_path}/r")
    assert s.expire(T0) == 0
    hours = lambda n: T0 + dt.timedelta(hours=n)
    texts = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "three")], "incident_id string, report_text string")
    s.store(texts, T0)
    s.store(texts, T0)  # done again: nothing new
    assert s.log().count() == 3
    assert s.delete(F.col("incident_id") == "2", hours(1)) == 1
    assert s.delete(F.col("incident_id") == "2", hours(2)) == 0
    s.store(texts.where("incident_id = '3'"), hours(10))
    assert s.expire(hours(24)) == 0
    assert s.expire(hours(25)) == 1
    state = {r.incident_id: (r.report_text, r.delete_reason) for r in s.state().collect()}
    assert state == {"1": (None, "expired"), "2": (None, "deleted"), "3": ("three", None)}


def test_retention_goes_on_after_a_failure():
    turns = []

    class Broken:
        def expire(self, at):
            turns.append(at)
            if len(turns) == 1:
                raise RuntimeError("no store")

    r = Retention(Broken(), pause_s=0.05, clock=lambda: T0)
    r.start()
    end = time.time() + 10
    while len(turns) < 3 and time.time() < end:
        time.sleep(0.02)
    r.stop()
    assert len(turns) >= 3 and not r.is_alive()


def test_count_within_a_time(spark):
    assert count_within(spark.range(10), 60) == 10
    sleepy = spark.range(0, 4, 1, 4).mapInPandas(lambda it: (time.sleep(8) or b for b in it), "id long")
    began = time.time()
    assert count_within(sleepy, 1.0) is None
    assert time.time() - began < 10
    status = spark.sparkContext.statusTracker()
    end = time.time() + 15
    while status.getActiveJobsIds() and time.time() < end:
        time.sleep(0.1)
    assert not status.getActiveJobsIds()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        count_within(spark.range(3).where(F.expr("1 / (id - id) > 0")), 60)


def test_text_forms(spark):
    row = spark.range(1).select(ewkt(F.lit(1.5), F.lit(-2.0)).alias("a"), ewkt(F.lit(None).cast("double"), F.lit(1.0)).alias("b"), point_of(F.lit("SRID=4326;POINT(-2.0 1.5)")).alias("c"), point_of(F.lit("POINT (3 4)")).alias("d"), point_of(F.lit("LINE(1 2)")).alias("e"), not_told(F.lit(-1.0)).alias("f"), not_told(F.lit(0.0)).alias("g")).first()
    assert (row.a, row.b, tuple(row.c), tuple(row.d), row.e, row.f, row.g) == ("SRID=4326;POINT(-2.0 1.5)", None, (1.5, -2.0), (4.0, 3.0), None, None, 0.0)
    times = spark.createDataFrame([("2025-03-04T05:06:07",), ("2025-03-04T05:06:07.25+02:00",), ("2025-03-04T05:06:07Z",), ("soon",), (None,)], "t string").select(F.unix_micros(as_time(F.col("t"))).alias("t")).collect()
    base = int(dt.datetime(2025, 3, 4, 5, 6, 7, tzinfo=dt.UTC).timestamp()) * 10**6
    assert [r.t for r in times] == [base, base - 7200 * 10**6 + 250_000, base, None, None]


def test_geojson_out_and_in(spark):
    square = '{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"name": "z"}}]}'
    zones = parse_zones(spark.createDataFrame([(square,)], "document string"))
    again = zones.select(F.concat(F.lit('{"features": [{"geometry": '), as_geojson(F.col("polygons")), F.lit(', "properties": {"name": "z"}}]}')).alias("document"))
    assert parse_zones(again).first().polygons == zones.first().polygons


def test_what_the_report_patterns_find(spark):
    texts = {"80 %": ("80", False), "12.5\t%": ("12.5", False), "% 80": ("", False), "Confirmed GPS spoofing": ("", True), "confirmed  spoof": ("", True), "confirmed ais\nspoofing at 7%": ("7", True), "spoofing confirmed": ("", False), "confirmed radar spoofing": ("", False)}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract("t", rules.PERCENT, 1).alias("p"), F.col("t").rlike(rules.CONFIRMED).alias("c"))
    assert {r.t: (r.p, r.c) for r in df.collect()} == texts


def test_training_windows(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    ready = lambda last, now: tuple(rules.training_windows(spark.createDataFrame([(T0, day(last))], "first_at timestamp, last_at timestamp"), F.lit(day(now))).select("initial_ready", "rolling_ready").first())
    assert [ready(13.9, 20), ready(14, 14.9), ready(14, 15), ready(30, 30)] == [(False, False), (False, True), (True, True), (True, True)]
