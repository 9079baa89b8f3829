"""What op4 and the pipeline's second stage keep off the driver."""

import numpy as np
import pytest

from wakeline.llm import jaccard_join
from wakeline.llm.jaccard_join import sketch


@pytest.fixture
def plans(spark, capsys):
    """Runs a frame, and gives its rows and its plan; what Spark itself would broadcast is off."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, -1)

    def run(df):
        capsys.readouterr()
        df.explain()
        return sorted(map(tuple, df.collect())), capsys.readouterr().out

    yield run
    spark.conf.set(name, was)


def _sketches(spark):
    base = np.arange(1, 101, dtype=np.uint64)
    sets = {1: base, 2: base[:90], 3: base + np.uint64(1 << 40) * np.uint64(3) + np.uint64(7), 4: base[:60]}
    return spark.createDataFrame([(k, len(s), bytearray(sketch(s))) for k, s in sets.items()], "node long, n_shingles long, sketch binary")


def test_sketches_of_candidates_are_joined_without_the_driver(spark, plans):
    pairs = spark.createDataFrame([(1, 2), (1, 4)], "a long, b long")
    rows, plan = plans(jaccard_join.sifted(pairs, _sketches(spark)))
    assert rows == [(1, 2)]
    assert "Broadcast" not in plan


def test_sketches_of_open_groups_are_joined_without_the_driver(spark, plans):
    groups = spark.createDataFrame([(9, n, n, 3) for n in (1, 2, 4)], "mark long, node long, component long, use long")
    rows, plan = plans(jaccard_join.close_pairs(groups, _sketches(spark), False))
    assert rows == [(1, 2)]
    assert "sketch" in plan
    assert not any("sketch" in line for line in plan.splitlines() if "BroadcastExchange" in line)
    assert "BroadcastHashJoin [node" not in plan
