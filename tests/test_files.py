"""Files in and out, percentiles and the stream with context, on small cases."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import console, reports
from wakeline.sources import files
from wakeline.streaming.live import recent_context


def _put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_labelled_readings(spark, tmp_path):
    path = _put(tmp_path / "a", "r.csv", "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,Label,speed_calc\n5,2024-01-01,51.5,4,, 12 ,x,Normal,1\n6,2024-01-01,52,4,3,,,Spoofed ,\n7,2024-01-01,52,4,3,,,Odd,\n")
    got = files.labelled_readings(spark, path).orderBy("mmsi").collect()
    assert [(r.mmsi, r.lat, r.sog, r.cog, r.heading, r.speed_calc, r.acceleration, r.spoofed) for r in got] == [("5", 51.5, None, 12.0, None, 1.0, None, False), ("6", 52.0, 3.0, None, None, None, None, True)]
    bad = _put(tmp_path / "b", "r.csv", "MMSI,BaseDateTime,LAT,LON,Label\n5,2024-01-01,,4,Normal\n5,2024-01-01,north,4,Normal\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.labelled_readings(spark, bad).collect()


def test_lines_and_labels(spark, tmp_path):
    good = _put(tmp_path / "a", "l.jsonl", '{"id":"1","label":"x"}\n\n{"id":"1","label":"x"}\n{"id":"2","label":"y"}\n')
    assert sorted(tuple(r) for r in files.read_labels(spark, good, ["x", "y"]).collect()) == [("1", "x"), ("2", "y")]
    for n, (text, problem) in enumerate([('{"id":"1"\n', "not valid JSON"), ('{"id":"1"}\n', "needs id and label"), ('{"id":"1","label":"z"}\n', "unknown label"), ('{"id":"1","label":"x"}\n{"id":"1","label":"y"}\n', "conflicting")]):
        with pytest.raises(ValueError, match=problem):
            files.read_labels(spark, _put(tmp_path / f"bad{n}", "l.jsonl", text), ["x", "y"])


def test_splits_shards_and_order(spark, tmp_path):
    rows = spark.range(5000, numPartitions=1).select("id", (F.col("id") % 7).alias("mmsi"), F.when(F.col("id") % 5 == 0, "holdout").otherwise("train").alias("split"))
    manifest = {r.split: (r.rows, r.vessels) for r in files.write_splits(rows, f"{tmp_path}/s").collect()}
    assert manifest == {"holdout": (1000, 7), "train": (4000, 7)}
    files.write_shards(rows, f"{tmp_path}/p")
    per_file = spark.read.parquet(f"{tmp_path}/p").groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in per_file) == [1000, 1952, 2048]
    order = [r.id for r in files.shuffled(rows, 3, "id").collect()]
    assert order == [r.id for r in files.shuffled(rows.repartition(5), 3, "id").collect()] != sorted(order)
    assert order != [r.id for r in files.shuffled(rows, 4, "id").collect()]


def test_rows_are_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2024, 1, d), 1.0) for d in (1, 2, 2)], "mmsi long, received_at timestamp, lat double")
    more = rows.unionByName(spark.createDataFrame([(2, datetime(2024, 1, 2), 5.0)], rows.schema))
    for df in (rows, rows, more):
        files.append_new(df, f"{tmp_path}/t", ["mmsi", "received_at", "lat"])
    assert sorted((r.mmsi, r.received_at.day) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, 1), (1, 2), (2, 2)]


def test_reports_that_cannot_be_read_are_passed_over(spark, tmp_path):
    for name, text in (("a.json", json.dumps({"score": 1.5, "note": "n"})), ("b.json", "{no"), ("c.json", '{"note":"m"}'), ("d.txt", '{"score":2}')):
        _put(tmp_path / "r", name, text)
    assert [r.score for r in files.read_reports(spark, f"{tmp_path}/r", "score double, note string", "score").collect()] == [1.5]


def test_archive_holds_every_envelope_by_day(spark, tmp_path):
    spark.createDataFrame([("{}", datetime(2024, 1, 1)), ('{"a":1}', datetime(2024, 1, 2)), ("no json", datetime(2024, 1, 2))], "envelope string, at timestamp").write.parquet(f"{tmp_path}/in")
    q = files.archive(spark.readStream.schema("envelope string, at timestamp").parquet(f"{tmp_path}/in"), F.col("at"), f"{tmp_path}/out", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((str(r.day), r.value) for r in spark.read.text(f"{tmp_path}/out").collect())
    assert got == [("2024-01-01", "{}"), ("2024-01-02", "no json"), ("2024-01-02", '{"a":1}')]


@pytest.mark.parametrize("values", [[], [0.0], [3.0] * 50, [0.0, 0.0, 5.0], None])
def test_percentiles_are_exact(spark, values):
    values = list(np.random.default_rng(1).lognormal(size=2000)) if values is None else values
    shares = [0.0, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    got = {r.p: r.value for r in reports.percentiles(df, "v", shares).collect()}
    assert got == ({} if not values else {s: pytest.approx(float(np.quantile(values, s)), abs=1e-12) for s in shares})


def test_limits_of_lists(spark):
    for n in (0, 101):
        with pytest.raises(ValueError, match="limit"):
            console.incident_list(spark.createDataFrame([], "incident_id long, flagged_at timestamp"), n)


def test_stream_gives_each_report_its_context(spark, tmp_path):
    start = datetime(2024, 1, 1)
    hours = [0, 1, 5, 8, 13, 13.5]
    steps = [[(1, h) for h in hours[:3]] + [(2, 0)], [(1, hours[3]), (1, 4.5)], [(1, h) for h in hours[4:]]]
    schema = "mmsi long, received_at timestamp, sog double"
    for n, step in enumerate(steps):
        spark.createDataFrame([(m, start + timedelta(hours=h), None if h == 5 else float(h)) for m, h in step], schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        q = recent_context(spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), most=3, late="1 day").writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()
    got = sorted((r.mmsi, (r.received_at - start) / timedelta(hours=1), r.n_context, (r.context_from - start) / timedelta(hours=1), r.mean_sog) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # 4.5 comes late: it stands in the context of 8 but is not given out itself.
    assert got == [(1, 0, 1, 0, 0), (1, 1, 2, 0, 0.5), (1, 5, 3, 0, 0.5), (1, 8, 3, 4.5, 6.25), (1, 13, 2, 8, 10.5), (1, 13.5, 3, 8, 11.5), (2, 0, 1, 0, 0)]
