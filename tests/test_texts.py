"""Texts for readers against plain versions."""

import datetime as dt
import json

from pyspark.sql import functions as F

from wakeline.operators import texts
from wakeline.operators.windows import first_of, recent_reports, steps

T0 = dt.datetime(2024, 1, 1)


def test_track_summary_of_a_frozen_and_a_short_track(spark):
    rows = [(1, 0, i, i, T0 + dt.timedelta(minutes=10 * i), 50.0 + (0.05 if i == 3 else 0.0), 5.0, 4.0, 10.0 * i) for i in range(6)] + [(2, 0, 0, 9, T0, 1.0, 1.0, None, None)]
    df = steps(spark.createDataFrame(rows, "mmsi long, window_index long, place long, event_id long, received_at timestamp_ntz, lat double, lon double, sog double, cog double"))
    got = {r.mmsi: r.summary.split("\n") for r in texts.track_summaries(df).collect()}
    assert got[2] == ["reports: 1", "not enough reports to describe motion"]
    assert got[1][0] == "reports: 6, span_minutes: 50.0" and got[1][1] == "reported_speed_knots: mean 4.0, max 4.0"
    assert got[1][4:8] == ["max_step_km: 5.56", "steps_claiming_speed_but_not_moving: 3, longest_run: 2", "reports_repeating_earlier_positions: 1", "max_course_change_between_reports_deg: 10"]
    assert got[1][9].endswith(("-4.0", "+0.0", "-0.0")) or got[1][9].split()[-1][0] in "+-"


def test_a_mean_does_not_depend_on_the_order(spark):
    # Added up in double from left to right these give 4.4 (or 4.5 from the right); their exact sum is 44.5.
    speeds = [7.73, 5.12, 3.89, 1.15, 2.54, 2.01, 1.4, 8.25, 7.01, 5.4]
    for order in (speeds, sorted(speeds), speeds[::-1]):
        rows = [(1, 0, i, i, T0 + dt.timedelta(minutes=i), 50.0, 5.0, v, 0.0) for i, v in enumerate(order)]
        df = steps(spark.createDataFrame(rows, "mmsi long, window_index long, place long, event_id long, received_at timestamp_ntz, lat double, lon double, sog double, cog double"))
        assert texts.track_summaries(df).head().summary.split("\n")[1] == "reported_speed_knots: mean 4.5, max 8.2"


def test_evidence_and_votes(spark):
    rows = [(1, "freeze_replay+prediction_error", 2.5, 4, 12, None, 0, 1, "gradual_drift", 0.83, "near others"), (2, "", 0.1, 0, 0, 7, 1, 0, None, None, " "), (3, "speed_jump", 0.1, 2, 3, None, 2, 5, "freeze_replay", None, None)]
    df = spark.createDataFrame(rows, "incident_id long, votes string, score double, n_freeze long, n_track long, zone_id long, n_prior long, elsewhere long, label string, sure double, note string")
    got = {r.incident_id: r.lines for r in texts.evidence_lines(df).collect()}
    assert got[1] == [texts.FIRED + "Freeze or replay, Prediction error.", "4 of 11" + texts.REPEATED, texts.IN_NO_AREA, texts.NONE_EARLIER, "1 incident" + texts.ELSEWHERE, texts.READS + "gradual drift (83%).", "near others"]
    assert got[2] == [texts.IN_AREA + "7.", "1 earlier incident" + texts.ON_VESSEL]
    assert got[3] == [texts.FIRED + "Speed jump.", texts.IN_NO_AREA, "2 earlier incidents" + texts.ON_VESSEL, "5 incidents" + texts.ELSEWHERE, texts.READS + "freeze replay."]
    few = texts.evidence_lines(df.drop("elsewhere", "label", "sure", "note"))
    assert {r.incident_id: len(r.lines) for r in few.collect()} == {1: 4, 2: 2, 3: 3}
    votes = {(r.incident_id, r.detector): (r.fired, r.value, r.threshold) for r in texts.vote_rows(df).collect()}
    assert votes == {
        (1, "Prediction error"): (True, 2.5, None), (1, "Freeze or replay"): (True, 4.0, 3.0), (2, "Prediction error"): (False, 0.1, None), (2, "Freeze or replay"): (False, 0.0, 3.0),
        (3, "Prediction error"): (False, 0.1, None), (3, "Freeze or replay"): (False, 2.0, 3.0), (3, "Speed jump"): (True, None, None),
    }


def test_lists_and_constants(spark):
    rows = [(1, "A", None, None, 5, T0), (22, None, "benign", 0.755, 6, None)]
    got = {r.incident_id: r.line for r in texts.list_lines(spark.createDataFrame(rows, "incident_id long, tier string, hypothesis string, confidence double, mmsi long, flagged_at timestamp_ntz")).collect()}
    assert "untracked" in got[1] and "2024-01-01 00:00" in got[1] and "0.7" in got[22] and got[22].startswith("      22  -  benign")
    stats = spark.createDataFrame([("benign", 3, 1, 1, 0.5), ("jamming", 1, 1, 0, None)], "hypothesis string, reviewed long, unclear long, correct long, precision double")
    assert {r.hypothesis: r.line.split()[-1] for r in texts.review_lines(stats).collect()} == {"benign": "0.50", "jamming": "n/a"}
    said = json.loads(spark.range(1).select(texts.question()).first()[0])
    assert said["pattern"]["type"] == "choice" and list(said["pattern"]["criteria"]) == list(texts.QUESTION)
    assert texts.model_version("m.pt", 10, 17.9) == "m.pt#10@17" and texts.model_version("m.pt", None, 17.9) == "m.pt@17"


def test_recent_reports_and_first_windows(spark):
    rows = [(m, i, T0 + dt.timedelta(hours=i)) for m, n in ((1, 30), (2, 4), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "mmsi long, event_id long, received_at timestamp_ntz")
    got = {(r.mmsi, r.short_history): r.n for r in recent_reports(df, F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"), 20, 3).groupBy("mmsi", "short_history").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, False): 20, (2, True): 2}
    w = spark.createDataFrame([(m, i) for m in (3, 1, 2) for i in range(5)], "mmsi long, window_index long")
    assert sorted(map(tuple, first_of(w, 2, 7).collect())) == [(1, i) for i in range(5)] + [(2, 0), (2, 1)]
    assert first_of(w).count() == 15 and first_of(w, vessels=1).count() == 5
