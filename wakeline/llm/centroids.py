"""Centroid clustering with one upper and one lower bound for each vector.

Vectors are dealt in packed chunks to a table bucketed by chunk; a second table, bucketed alike, holds each vector's
cluster, an upper bound of its distance to that centroid and a lower bound of its distance to any other. A round
joins the two without a shuffle, loosens the bounds by how far the centroids went, and only a vector whose bounds
no longer tell (and don't after its own distance is exact) is held against all centroids, in exact integers. Each
task sends on its sums only, and a round's bounds are a written table, so that a lost executor costs its tasks only.

Defined cases: null vec_id, null vectors, and vectors of another length or with null, non-finite or too large
components (beyond `LARGEST` after scaling; their squares would not fit) are left out. Rows that repeat a vec_id are
vectors of their own; of equal hashes the lesser vector starts first. Fewer vectors than clusters give fewer
clusters, none gives no rows. Equal vectors are dealt over all chunks like any others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import checkpoint, tidy
from wakeline.llm.topk import integer_vectors

CLUSTERS, ROUNDS, WIDTH, SEED = 8, 10, 64, 3
CHUNK_ROWS, BUCKET_BYTES = 4096, 64 << 20
#: Bounds are doubles: each is loosened by this share, far above their rounding.
SLACK = 1e-9
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_STATE = "chunk long, near binary, upper binary, lower binary, sums array<long>, inertia array<long>"


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors (n, d) to centroids (m, d), exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x.astype(np.int64) - c
        out[:, j] = (d * d).sum(1)
    return out


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (of ties the first), its distance as an upper and the second's as a lower bound."""
    d = distances(x, centroids)
    near = d.argmin(1)
    own = d[np.arange(len(x)), near]
    d[np.arange(len(x)), near] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(x), np.inf)
    return near, np.sqrt(own.astype(np.float64)) * (1 + SLACK), second * (1 - SLACK)


def reassign(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The bounds loosened by the centroids' drift, and the clusters by the new centroids; also how many were scanned."""
    drift = np.array([float(d) for d in np.sqrt(np.diag(distances(before, after)).astype(np.float64))]) * (1 + SLACK)
    others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(len(drift))])
    upper, lower = (upper + drift[near]) * (1 + SLACK), lower - others[near]
    lower = np.where(lower > 0, lower * (1 - SLACK), lower)
    apart = distances(after, after).astype(np.float64)
    np.fill_diagonal(apart, np.inf)
    half = np.sqrt(apart.min(1)) / 2 * (1 - SLACK)
    bound = np.maximum(lower, half[near])
    open_ = np.flatnonzero(upper >= bound)
    if len(open_):
        own = x[open_]
        exact = np.empty(len(open_))
        for j in np.unique(near[open_]):
            mine = near[open_] == j
            exact[mine] = np.sqrt(distances(own[mine], after[j : j + 1])[:, 0].astype(np.float64))
        upper[open_] = exact * (1 + SLACK)
        open_ = open_[upper[open_] >= bound[open_]]
    if len(open_):
        near, lower = near.copy(), lower.copy()
        near[open_], upper[open_], lower[open_] = scan(x[open_], after)
    return near, upper, lower, len(open_)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().astype(np.int32).reshape(-1, width)
            ids = batch.column("vec_id").to_numpy()
            for s in range(0, len(ids), CHUNK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids[s : s + CHUNK_ROWS].tobytes()], pa.binary()), pa.array([x[s : s + CHUNK_ROWS].tobytes()], pa.binary())], names=["chunk", "ids", "vectors"])
                number += 1

    return rows.mapInArrow(pack, "chunk long, ids binary, vectors binary")


def _chunks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            yield r, np.frombuffer(r["vectors"], np.int32).reshape(-1, width)


def _round(before: np.ndarray | None, after: np.ndarray, width: int):
    """One round over chunks; ``before`` is None in the first, which scans all."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, x in _chunks(batches, width):
            if before is None:
                near, upper, lower = scan(x, after)
            else:
                held = (np.frombuffer(r[c], t) for c, t in (("near", np.int32), ("upper", np.float64), ("lower", np.float64)))
                near, upper, lower, _ = reassign(x, *held, before, after)
            sums, inertia = np.zeros((len(after), width + 1), np.int64), np.zeros(len(after), np.int64)
            for j in np.unique(near):
                own = x[near == j]
                sums[j] = [len(own), *own.sum(0, dtype=np.int64)]
                inertia[j] = distances(own, after[j : j + 1]).sum()
            values = [[r["chunk"]], [near.astype(np.int32).tobytes()], [upper.tobytes()], [lower.tobytes()], [sums.ravel().tolist()], [inertia.tolist()]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["chunk", "near", "upper", "lower", "sums", "inertia"])

    return run


def _summed(table: DataFrame, column: str, n: int) -> list[int]:
    """The arrays of a column added up place by place: one array a task is exchanged, one comes to the driver."""

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += batch.column(column).flatten().to_numpy().reshape(-1, n).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(total)], names=["i", "n"])

    out = [0] * n
    for r in table.select(column).mapInArrow(add, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    return out


def _assigned(centroids: np.ndarray, width: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, x in _chunks(batches, width):
            near = np.frombuffer(r["near"], np.int32)
            distance = np.empty(len(near), np.int64)
            for j in np.unique(near):
                distance[near == j] = distances(x[near == j], centroids[j : j + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], np.int64)), pa.array(near), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, F.size("embedding") == width)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key, "v").select("v").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    after, before = np.array([r.v for r in first], np.int64), None
    run = uuid.uuid4().hex
    made: list[str] = []

    def bucketed(df: DataFrame, name: str) -> str:
        made.append(f"wakeline_{name}_{run}")
        df.write.bucketBy(n_buckets, "chunk").sortBy("chunk").format("parquet").saveAsTable(made[-1])
        return made[-1]

    n_buckets = 1 + rows.count() * (4 * width + 8) // BUCKET_BYTES
    n_buckets = max(n_buckets, min(spark.sparkContext.defaultParallelism, 64))
    table = bucketed(_packed(rows, width).repartition(n_buckets, "chunk"), "vectors")
    held = ""
    try:
        for i in range(rounds + 1):
            chunks = spark.table(table)
            if before is not None:
                chunks = chunks.join(spark.table(held).select("chunk", "near", "upper", "lower").hint("merge"), "chunk")
            was, held = held, bucketed(chunks.mapInArrow(_round(before, after, width), _STATE), f"round{i}")
            if was:
                spark.sql(f"DROP TABLE {was}")
                made.remove(was)
            if i < rounds:
                sums = np.array(_summed(spark.table(held), "sums", len(after) * (width + 1)), np.int64).reshape(len(after), -1)
                before, after = after, np.where(sums[:, :1] > 0, np.floor_divide(sums[:, 1:], np.maximum(sums[:, :1], 1)), after)
        inertia = _summed(spark.table(held), "inertia", len(after))
        found = checkpoint(spark.table(table).join(spark.table(held).select("chunk", "near").hint("merge"), "chunk").mapInArrow(_assigned(after, width), "vec_id long, cluster int, distance long"))
    finally:
        for name in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    told = [(j, inertia[j], sum(inertia), hashlib.sha256(",".join(str(int(c)) for c in after[j]).encode()).hexdigest()) for j in range(len(after))]
    return found.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
