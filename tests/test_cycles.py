"""Cycles: the cap and what it puts off, replays, pauses, open incidents, thresholds, retunes, failures, statistics."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators.reports import BINS, EDGES
from wakeline.streaming.cycles import Cycles, Thresholds, report_flags

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SF = "/root/testdata/sf0.01"
SCORED = "mmsi long, received_at timestamp, error double, freeze double, reason string"


class Clock:
    def __init__(self):
        self.now = T0

    def __call__(self):
        return self.now


def scored(spark, *rows):
    """(mmsi, error[, freeze[, reason[, minute]]])"""
    full = [(*r, *(0.0, None, 0)[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(m, T0 + dt.timedelta(minutes=at), e, f, why) for m, e, f, why, at in full], SCORED)


def found(chosen):
    return chosen.select("mmsi", F.lit("benign").alias("hypothesis"))


def cycles(tmp_path, clock, **how):
    return Cycles(f"{tmp_path}/cycles", **({"investigate": found, "thresholds": lambda: Thresholds(0.5, 2.0), "clock": clock} | how))


def outcomes(spark, tmp_path, number):
    return {r.mmsi: r.outcome for r in spark.read.parquet(f"{tmp_path}/cycles/decided/cycle={number}").collect()}


def stats(spark, tmp_path, number):
    return spark.read.parquet(f"{tmp_path}/cycles/stats/cycle={number}").first()


def test_every_flag_is_taken_up_once_also_after_a_replay(spark, tmp_path):
    clock = Clock()
    run = cycles(tmp_path, clock, most=2)
    batches = [scored(spark, *((m, 1.0 + m / 10) for m in range(1, 6))), scored(spark), scored(spark)]
    for n, b in enumerate(batches):
        run(b, n)
        if n == 1:
            clock.now += dt.timedelta(minutes=9)  # the second run of a cycle keeps its first time
            run(b, n)
        clock.now += dt.timedelta(seconds=30)
    chosen = [sorted(m for m, o in outcomes(spark, tmp_path, n).items() if o == "chosen") for n in range(3)]
    assert chosen == [[4, 5], [2, 3], [1]]
    assert [stats(spark, tmp_path, n).deferred for n in range(3)] == [3, 1, 0]
    assert [stats(spark, tmp_path, n).flagged for n in range(3)] == [5, 3, 1]
    at = [r.t for r in spark.read.parquet(f"{tmp_path}/cycles/clock").orderBy("cycle").select(F.unix_seconds("cycle_at").alias("t")).collect()]
    assert at[1] - at[0] == 30


def test_a_stronger_flag_replaces_a_carried_one(spark, tmp_path):
    clock = Clock()
    run = cycles(tmp_path, clock, most=1)
    run(scored(spark, (1, 9.0), (2, 1.0), (3, 1.5)), 0)
    run(scored(spark, (2, 5.0), (3, 1.0)), 1)
    rows = {r.mmsi: (r.error, r.outcome, r.tier) for r in spark.read.parquet(f"{tmp_path}/cycles/decided/cycle=1").collect()}
    assert rows == {2: (5.0, "chosen", "B"), 3: (1.5, "deferred", "A")}


def test_a_chosen_vessel_rests_for_the_pause(spark, tmp_path):
    clock = Clock()
    run = cycles(tmp_path, clock)
    seen = []
    for n, hours in enumerate((0, 1, 5.9, 6.1)):
        clock.now = T0 + dt.timedelta(hours=hours)
        run(scored(spark, (1, 1.0)), n)
        seen.append(outcomes(spark, tmp_path, n)[1])
    assert seen == ["chosen", "debounced", "debounced", "chosen"]


def test_open_incidents_debounce(spark, tmp_path):
    rows = [(1, "escalated", T0 - dt.timedelta(hours=1)), (2, "resolved", T0 - dt.timedelta(hours=1)), (3, "reported", T0 - dt.timedelta(hours=7)), (4, None, T0)]
    run = cycles(tmp_path, Clock(), incidents=lambda: spark.createDataFrame(rows, "mmsi long, status string, created_at timestamp"))
    run(scored(spark, (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)), 0)
    assert outcomes(spark, tmp_path, 0) == {1: "debounced", 2: "chosen", 3: "chosen", 4: "debounced"}
    s = stats(spark, tmp_path, 0)
    assert (s.flagged, s.debounced, s.investigated) == (4, 2, 2)


def test_votes_tiers_and_steps_that_cannot_be_judged(spark):
    rows = scored(spark, (1, 0.5), (2, 0.6), (3, 2.0), (4, 0.0, 0.6), (5, 0.9, 0.9), (6, 9.0, 0.0, "long_gap"), (7, float("nan"), 0.0), (8, None, 0.7), (9, 0.7, 0.0, None, 1), (9, 0.6, 0.6, None, 0))
    got = {r.mmsi: (r.error, r.n_votes, r.tier) for r in report_flags(rows, 0.5, 2.0).collect()}
    assert got == {2: (0.6, 1, "A"), 3: (2.0, 1, "B"), 4: (0.0, 1, "A"), 5: (0.9, 2, "A"), 8: (None, 1, "A"), 9: (0.6, 2, "A")}
    assert {r.mmsi for r in report_flags(rows, 0.5, None, min_votes=2).collect()} == {5, 9}


def test_without_thresholds_a_cycle_only_observes(spark, tmp_path):
    run = cycles(tmp_path, Clock(), thresholds=lambda: None)
    run(scored(spark, (1, 9.0), (2, 9.0, 0.0, "long_gap")), 0)
    s = stats(spark, tmp_path, 0)
    assert (s.observing_only, s.flagged, s.reports_scored, s.skipped_unscorable, s.vessels_seen) == (True, 0, 1, 1, 2)


def test_statistics_hold_the_histogram_of_judged_errors(spark, tmp_path):
    run = cycles(tmp_path, Clock(), model_version="m1")
    run(scored(spark, (1, 1e-9), (1, EDGES[7]), (2, 50.0), (2, 1.0, 0.0, "long_gap"), (3, float("nan"))), 0)
    s = stats(spark, tmp_path, 0)
    assert {i: n for i, n in enumerate(s.histogram) if n} == {0: 1, 7: 1, BINS - 1: 1}
    assert (s.model_version, s.flagged_a, s.flagged_b) == ("m1", 0, 1)


def test_failures_do_not_stop_a_cycle(spark, tmp_path):
    calls = []

    def broken(chosen):
        calls.append(chosen.count())
        raise RuntimeError("no tools")

    clock = Clock()
    cycles(tmp_path, clock, investigate=broken)(scored(spark, (1, 1.0), (2, 3.0)), 0)
    s = stats(spark, tmp_path, 0)
    assert calls == [2] and (s.failed, s.investigated, s.flagged_b) == (2, 0, 1)
    half = cycles(tmp_path, clock, investigate=lambda c: found(c.where("mmsi = 3")), follow_up=lambda i: 1 / 0)
    half(scored(spark, (1, 1.0), (3, 1.0), (4, 1.0)), 1)
    s = stats(spark, tmp_path, 1)
    assert (s.debounced, s.investigated, s.failed) == (1, 1, 1)


def test_follow_up_sees_what_was_stored(spark, tmp_path):
    seen = []
    run = cycles(tmp_path, Clock(), follow_up=lambda stored: seen.extend(r.mmsi for r in stored.collect()))
    run(scored(spark, (1, 1.0)), 0)
    run(scored(spark), 1)
    assert seen == [1]


def _retunes(spark, tmp_path, steps, thresholds, **how):
    clock, calls = Clock(), []
    run = cycles(tmp_path, clock, thresholds=thresholds, retune=lambda: calls.append(clock.now), model_version="m2", **how)
    for n, s in enumerate(steps):
        clock.now = T0 + dt.timedelta(seconds=s)
        run(scored(spark, (1, 0.1)), n)
    return [int((c - T0).total_seconds()) for c in calls]


def test_retune_at_the_start_and_each_hour(spark, tmp_path):
    assert _retunes(spark, tmp_path, (0, 30, 3599, 3600, 3700), lambda: Thresholds(0.5, model_version="m2")) == [0, 3600]


def test_a_new_model_retunes_early_but_not_every_cycle(spark, tmp_path):
    assert _retunes(spark, tmp_path, (0, 30, 299, 300, 400, 601), lambda: Thresholds(0.5, model_version="m1")) == [0, 300, 601]


def test_a_retune_that_fails_leaves_the_thresholds(spark, tmp_path):
    run = cycles(tmp_path, Clock(), retune=lambda: 1 / 0)
    run(scored(spark, (1, 1.0)), 0)
    assert outcomes(spark, tmp_path, 0) == {1: "chosen"}


def test_random_cycles_equal_a_plain_version(spark, tmp_path):
    rng = random.Random(6)
    clock, most = Clock(), 3
    run = cycles(tmp_path, clock, most=most)
    carried, chosen_at = {}, {}
    for n in range(5):
        clock.now = T0 + dt.timedelta(hours=3 * n)
        rows = [(rng.randrange(12), rng.choice([0.2, 0.6, 1.0, 3.0]), rng.choice([0.0, 0.7]), None, rng.randrange(3)) for _ in range(8)]
        run(scored(spark, *rows), n)
        flags = dict(carried)
        for m, e, f, _, at in rows:
            v = (e > 0.5) + (f > 0.5)
            if v and (m not in flags or (v, e, at) > flags[m]):
                flags[m] = (v, e, at)
        free = [m for m in flags if m not in chosen_at or clock.now - chosen_at[m] >= dt.timedelta(hours=6)]
        order = sorted(free, key=lambda m: (*(-x for x in flags[m]), m))
        want = {m: "debounced" for m in flags} | {m: "deferred" for m in free} | {m: "chosen" for m in order[:most]}
        assert outcomes(spark, tmp_path, n) == want
        chosen_at |= {m: clock.now for m in order[:most]}
        carried = {m: flags[m] for m in order[most:]}


def test_as_the_sink_of_a_stream(spark, tmp_path):
    for i in range(3):
        scored(spark, *((m, 1.0) for m in range(i * 2, i * 2 + 2))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new and loses nothing
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(cycles(tmp_path, Clock(), most=1)).start()
        q.awaitTermination(120)
        assert q.exception() is None
    out = spark.read.parquet(f"{tmp_path}/cycles/decided")
    assert out.where("outcome = 'chosen'").select("mmsi").distinct().count() == out.where("outcome = 'chosen'").count() == 3
    assert out.where("cycle = 2 and outcome = 'deferred'").count() == 3


@pytest.mark.parametrize("shape", [0, 1])
def test_empty_batches(spark, tmp_path, shape):
    cycles(tmp_path, Clock(), thresholds=lambda: Thresholds(0.5) if shape else None)(scored(spark), 0)
    assert outcomes(spark, tmp_path, 0) == {}
    assert sum(stats(spark, tmp_path, 0).histogram) == 0


def test_the_replayed_query_equals_a_plain_version(spark):
    from wakeline.operators.detectors import votes
    from wakeline.operators.windows import scoreable, with_error
    from wakeline.plans.queries import MAX_GAP, A, B, _steps

    voted = votes(with_error(_steps(spark, SF)), A).where(scoreable(MAX_GAP) & (F.col("n_votes") > 0)).select("mmsi", "received_at", "error", "n_votes").collect()
    carried, chosen_at, want = {}, {}, {}
    for n, day in enumerate(range(6, 11)):
        now, flags = dt.datetime(2024, 1, day + 1), dict(carried)
        for r in voted:
            if r.received_at.date() == dt.date(2024, 1, day) and (r.mmsi not in flags or (r.n_votes, r.error, r.received_at) > flags[r.mmsi]):
                flags[r.mmsi] = (r.n_votes, r.error, r.received_at)
        free = sorted((m for m in flags if m not in chosen_at or now - chosen_at[m] >= dt.timedelta(hours=6)), key=lambda m: (-flags[m][0], -flags[m][1], -flags[m][2].timestamp(), m))
        for m, (v, e, at) in flags.items():
            want[n, m] = (at, round(e, 6), v, "B" if e >= B and e > A else "A", "debounced" if m not in free else "chosen" if m in free[:3] else "deferred")
        chosen_at |= {m: now for m in free[:3]}
        carried = {m: flags[m] for m in free[3:]}
    from wakeline.plans import QUERIES

    rows = QUERIES["cycles_replayed"](spark, SF).collect()
    got = {(r.cycle, r.mmsi): (r.flagged_at, r.error, r.n_votes, r.tier, r.outcome) for r in rows}
    assert got == want and {o[-1] for o in got.values()} >= {"chosen", "deferred"}
