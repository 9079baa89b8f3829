"""op4's exchanges: what one task holds follows from the number of shingles, not of documents."""

import numpy as np

from wakeline.llm import jaccard_join
from wakeline.llm.common import arrays, shingle_sets


def test_few_long_documents_go_to_many_buckets(spark, monkeypatch):
    asked = []
    spread = jaccard_join._spread
    monkeypatch.setattr(jaccard_join, "_spread", lambda docs, nodes, buckets: asked.append(buckets) or spread(docs, nodes, buckets))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "node long, text string")
    nodes = spark.createDataFrame([(1, 1, 30_000_000), (2, 2, 30_000_000)], "node long, component long, n_shingles long")
    assert jaccard_join.able(docs, nodes).collect() == []
    assert asked[0] >= 60


def test_a_pack_is_dealt_once_and_names_only_documents_in_the_bucket(spark):
    texts = {i: " ".join(f"w{i}x{j}" for j in range(40)) * (i % 7 > 0) for i in range(50)} | {77: "one"}
    long = {i: t if i % 5 else " ".join([t] + [f"long{i}y{j}" for j in range(60_000)]) for i, t in texts.items()}
    docs = spark.createDataFrame(list(long.items()), "node long, text string").coalesce(1)
    nodes = spark.createDataFrame([(i, 1000 + i) for i in long], "node long, component long")
    got = jaccard_join._spread(docs, nodes, 9).toArrow()
    seen = {i: [] for i in long}
    assert len(set(got["bucket"].to_pylist())) == got.num_rows
    for ids, components, shingles, places in zip(*(arrays(got[c], k) for c, k in (("ids", np.int64), ("sizes", np.int64), ("sigs", np.uint64), ("uses", np.uint32))), strict=True):
        assert (components == ids + 1000).all()
        assert set(places.tolist()) == set(range(len(ids)))
        for place, s in zip(places.tolist(), shingles.tolist(), strict=True):
            seen[int(ids[place])].append(s)
    for i, t in long.items():
        assert sorted(seen[i]) == shingle_sets([t.encode()])[0].tolist()
