"""Connected components by alternating stars, in tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.sources.tables import written


def components(edges: DataFrame, *keys: str) -> DataFrame:
    """keys, node, component: the least node that links reach, for every node of ``edges`` (keys, a, b); graphs of different keys are apart.

    Each round hangs all greater neighbours of a node to the least one, then all lesser ones; a component of n nodes is
    a star after some log(n) rounds, which go on until nothing changes. Neighbours are never gathered: a round is two
    grouped minima and two joins.
    """
    own = list(keys)
    links = written(edges.where("a <> b").select(*own, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(*own, F.col("a").alias("node")).union(edges.select(*own, F.col("b").alias("node"))).distinct()
    state = _state(links)
    while state[0]:
        both = links.union(links.select(*own, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*own, "a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        large = both.where("b > a").join(least, [*own, "a"]).select(*own, F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        below = large.groupBy(*own, "a").agg(F.min("b").alias("_m"))
        small = large.join(below, [*own, "a"]).select(*own, F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct(F.col("a").alias("a"), F.col("_m").alias("b")))).alias("_e")).select(*own, "_e.*")
        links = written(small.where("a <> b").distinct(), "links")
        was, state = state, _state(links)
        if was == state:
            break
    return nodes.join(links.groupBy(*own, F.col("a").alias("node")).agg(F.min("b").alias("_m")), [*own, "node"], "left").select(*own, "node", F.coalesce("_m", "node").alias("component"))


def _state(links: DataFrame) -> tuple[int, int]:
    """Count and sum of hashes, which tell whether a round changed anything."""
    r = links.agg(F.count("*"), F.sum(F.xxhash64(*links.columns).cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)
