"""Clusters, streams and readers against plain versions and small cases."""

import datetime as dt
from collections import defaultdict
from math import asin, cos, inf, nan, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from wakeline.functions.cleaning import normalize
from wakeline.operators.clusters import clusters
from wakeline.operators.reports import log_histogram, merged
from wakeline.operators.rules import benign_weight, priority
from wakeline.sources.tracks import import_csv
from wakeline.streaming.live import paused_flags, report_stream


def _km(a, b):
    y, x = radians(b[0] - a[0]) / 2, radians(b[1] - a[1]) / 2
    return 2 * 6371.0088 * asin(min(1, sqrt(sin(y) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(x) ** 2)))


def test_clusters_equal_plain_version(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    at = dt.datetime(2024, 1, 1, 0, 5)
    rows = [(i, i, at, 50 + (i * 37 % 60) * 0.05, 4 + (i * 53 % 60) * 0.05) for i in range(60)]
    got = {(r.cluster, r.vessels) for r in clusters(spark.createDataFrame(rows, "mmsi long, event_id long, received_at timestamp_ntz, lat double, lon double"), km=15).collect()}
    where = {r[0]: r[3:] for r in rows}
    near = {a: [b for b in where if _km(where[a], where[b]) <= 15] for a in where}
    core = {a for a in where if len(near[a]) >= 3}
    label = {a: a for a in core}
    for _ in range(60):
        label = {a: min(label[b] for b in near[a] if b in core) for a in core}
    members = defaultdict(set)
    for a in where:
        if mine := [label[b] for b in near[a] if b in core]:
            members[label.get(a, min(mine))].add(a)
    assert got == {(k, len(v)) for k, v in members.items()}
    assert got


def test_normalize_drops_and_nulls(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, True, 1.0, 2.0, 102.3, 360.0, 511), (2, at, None, 1.0, 2.0, 5.0, 10.0, 20), (None, at, True, 1.0, 2.0, 1.0, 1.0, 1), (3, None, True, 1.0, 2.0, 1.0, 1.0, 1), (4, at, False, 1.0, 2.0, 1.0, 1.0, 1), (5, at, True, 91.0, 2.0, 1.0, 1.0, 1), (6, at, True, nan, 2.0, 1.0, 1.0, 1)]
    out = normalize(spark.createDataFrame(rows, "mmsi long, received_at timestamp_ntz, valid boolean, lat double, lon double, sog double, cog double, heading int")).orderBy("mmsi").collect()
    assert [(r.mmsi, r.sog, r.cog, r.heading) for r in out] == [(1, None, None, None), (2, 5.0, 10.0, 20)]


def test_histogram_ends_and_merge(spark):
    df = spark.createDataFrame([(0.0,), (1e-5,), (1e9,), (nan,), (inf,), (None,), (1.0,)], "x double")
    h = log_histogram(df, F.col("x"))
    assert {r.bin: r.n for r in h.collect()} == {0: 2, 100: 1, 119: 1}
    assert {r.bin: r.n for r in merged(h, h).collect()} == {0: 4, 100: 2, 119: 2}


def test_weights(spark):
    df = spark.createDataFrame([(True, 1.0, False, True), (False, 3.0, True, False)], "s boolean, r double, c boolean, p boolean")
    got = [x[0] for x in df.select(benign_weight(F.col("s"), F.col("r"), F.col("c"), F.col("p"))).collect()]
    assert got == [0.9, 0.0]
    one = spark.range(1).select(priority(F.lit(0.8), F.lit(0.5), F.lit("area"), F.lit(0.9))).first()[0]
    assert one == pytest.approx(round(0.75 * (0.28 + 0.125 + 0.15 + 0.25), 3))


def test_import_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading\n12,2024-01-01T00:00:00,1.5,2.5,x,10,87.5\nbad,2024-01-01T00:00:00,1,2,3,4,5\n")
    (row,) = import_csv(spark, str(tmp_path)).collect()
    assert (row.mmsi, row.lat, row.sog, row.heading) == (12, 1.5, None, None)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.csv").write_text("MMSI,LAT\n1,2\n")
    with pytest.raises(ValueError):
        import_csv(spark, str(tmp_path / "b"))


def test_streams(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, t(0), 1.0, 2.0), (1, t(0), 1.0, 2.0), (1, t(1), 1.0, 2.0), (2, t(0), 1.0, 2.0), (1, t(6), 1.0, 2.0), (1, t(7), 1.0, 2.0)]
    spark.createDataFrame(rows, "mmsi long, received_at timestamp, lat double, lon double").write.parquet(f"{tmp_path}/in")
    q = report_stream(spark, f"{tmp_path}/in", "mmsi long, received_at timestamp, lat double, lon double").writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
    q.awaitTermination(90)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    flags = spark.readStream.schema("mmsi long, received_at timestamp, lat double, lon double").parquet(f"{tmp_path}/in").selectExpr("mmsi", "received_at as flagged_at", "lat + mmsi as score")
    q = paused_flags(flags).writeStream.option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/kept")
    q.awaitTermination(90)
    out = spark.read.parquet(f"{tmp_path}/kept")
    assert sorted((r.mmsi, r.flagged_at.hour) for r in out.collect()) == [(1, 0), (1, 6), (2, 0)]
