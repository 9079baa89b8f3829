"""Exact top-k by inner product with the three phases of a uniform threshold.

A vector's integer components are split into ``lists`` runs; its score is the sum of what it has in each list.
Packed chunks of candidates are the nodes, each with its part of every list. Phase 1 gathers each task's heads of
every list (with whole scores, as a node holds all lists of its rows) and each list's least value: the (k+1)-th
best score seen is a safe cutoff, and a candidate below cutoff / lists (counted from the least values) in every
list can't reach it. Phase 2 broadcasts these cutoffs and collects the entries that reach one in some list.
Phase 3 adds the lists that are missing for these, exactly, and sends on what still reaches the cutoff.

Queries go in blocks of bounded size (`BLOCK_BYTES`), so that only bounded data is broadcast; every block reads all
candidates. Equal vectors are one candidate with its k+1 smallest ids, which is all of them that a result can hold.

Defined cases: null vec_id, null vectors and vectors with null, non-finite or too large components (beyond
`LARGEST` after scaling) take no part. Only vectors of the same length meet; those without components score 0. Rows
that repeat a vec_id are rows of their own: each is a query, and only the row itself is left out. Ties go to the
smaller vec_id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import checkpoint, ensure_checkpoint_dir, tidy

SCALE, LARGEST = 1024, 1 << 24
#: Rows of a packed chunk, bytes of a block of query vectors, entries that a task holds before it keeps the best.
CHUNK_ROWS, BLOCK_BYTES, HELD = 2048, 1 << 19, 1 << 20
RESULT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(rows: DataFrame, sound: Column | None = None) -> DataFrame:
    """vec_id and v, the components floor(1024 * x) as integers, of the rows whose vectors can take part."""
    e = F.col("embedding")
    fits = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / SCALE), F.lit(False)))
    good = F.col("vec_id").isNotNull() & e.isNotNull() & fits
    return rows.where(good if sound is None else good & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).try_cast("int")).alias("v"))


def _runs(width: int, lists: int) -> list[slice]:
    cuts = [width * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _packed(rows: DataFrame, lists: int) -> DataFrame:
    """Chunks of vectors of one length: their lists as matrices, and the ids of each."""

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ids = batch.column("v"), batch.column("ids")
            width, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
            n_ids, flat_ids = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            at, at_ids = np.concatenate(([0], np.cumsum(width))), np.concatenate(([0], np.cumsum(n_ids)))
            out = []
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                for s in range(0, len(own), CHUNK_ROWS):
                    r = own[s : s + CHUNK_ROWS]
                    x = flat[at[r][:, None] + np.arange(w)].astype(np.int32)
                    more = np.concatenate([flat_ids[at_ids[i] : at_ids[i + 1]] for i in r])
                    out.append((int(w), len(r), [np.ascontiguousarray(x[:, c]).tobytes() for c in _runs(w, lists)], n_ids[r].astype(np.int32).tobytes(), more.astype(np.int64).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary()), strict=True)], names=["width", "n", "parts", "n_ids", "ids"])

    return rows.mapInArrow(pack, "width int, n int, parts array<binary>, n_ids binary, ids binary")


def _parts(queries: dict[int, np.ndarray], chunk: dict, lists: int) -> list[np.ndarray]:
    """The chunk's values in every list for each query of its length, exact."""
    w, n = chunk["width"], chunk["n"]
    q, out = queries[w], []
    for c, raw in zip(_runs(w, lists), chunk["parts"], strict=True):
        x = np.frombuffer(raw, np.int32).reshape(n, c.stop - c.start)
        most = int(np.abs(q[:, c]).max(initial=0)) * int(np.abs(x.astype(np.int64)).max(initial=0)) * w
        if most >= 1 << 61:
            raise OverflowError("a score would not fit in 64 bits")
        kind = np.float64 if most < 1 << 52 else np.int64
        out.append((q[:, c].astype(kind) @ x.T.astype(kind)).astype(np.int64))
    return out


def _chunks(batches: Iterable[pa.RecordBatch], known: dict[int, np.ndarray]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            chunk = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if chunk["width"] in known:
                yield chunk


def _heads(queries: dict[int, np.ndarray], names: dict[int, np.ndarray], lists: int, most: int):
    """Phase 1: for each query and task, the least value of each list and the scores of the lists' heads."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        best: dict[int, np.ndarray] = {}
        for chunk in _chunks(batches, queries):
            w, n = chunk["width"], chunk["n"]
            parts = _parts(queries, chunk, lists)
            least = np.stack([p.min(axis=1) for p in parts], 1)
            whole = sum(parts)
            seen = np.zeros(whole.shape, bool)
            for p in parts:
                head = np.argpartition(p, n - most, axis=1)[:, n - most :] if n > most else np.broadcast_to(np.arange(n), p.shape)
                np.put_along_axis(seen, head, True, axis=1)
            gathered = np.where(seen, whole, np.iinfo(np.int64).min)
            keep = min(most, n)
            gathered = np.partition(gathered, n - keep, axis=1)[:, n - keep :]
            if w in low:
                least, gathered = np.minimum(low[w], least), np.concatenate((best[w], gathered), axis=1)
                if gathered.shape[1] > most:
                    gathered = np.partition(gathered, gathered.shape[1] - most, axis=1)[:, -most:]
            low[w], best[w] = least, gathered
        for w, least in low.items():
            yield pa.RecordBatch.from_arrays([pa.array(names[w], pa.int32()), pa.array(list(least), pa.list_(pa.int64())), pa.array(list(best[w]), pa.list_(pa.int64()))], names=["q", "lows", "scores"])

    return run


def _collected(queries: dict[int, np.ndarray], names: dict[int, np.ndarray], cutoffs: dict[int, np.ndarray], reach: dict[int, np.ndarray], lists: int, most: int):
    """Phases 2 and 3: entries that reach the cutoff of some list, completed; each task's best ``most`` for a query."""

    def best(held: list[tuple]) -> list[tuple]:
        q, score, first, ids = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((first, -score, q))
        q = q[order]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(q)]))))
        order = order[place < most]
        return [(q[place < most], score[order], first[order], ids[order])]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for chunk in _chunks(batches, queries):
            w = chunk["width"]
            parts = _parts(queries, chunk, lists)
            some = np.zeros(parts[0].shape, bool)
            for b, p in enumerate(parts):
                some |= p >= cutoffs[w][:, b : b + 1]
            i, j = np.nonzero(some)
            score = sum(p[i, j] for p in parts)
            enough = score >= reach[w][i]
            i, j, score = i[enough], j[enough], score[enough]
            if not len(i):
                continue
            n_ids, flat = np.frombuffer(chunk["n_ids"], np.int32), np.frombuffer(chunk["ids"], np.int64)
            at = np.concatenate(([0], np.cumsum(n_ids)))
            every = np.empty(chunk["n"], object)
            for r in np.unique(j):
                every[r] = flat[at[r] : at[r + 1]]
            held.append((names[w][i], score, flat[at[j]], every[j]))
            size += len(i)
            if size > HELD:
                held = best(held)
                size = min(HELD // 2, len(held[0][0]))
        if held:
            q, score, _, ids = best(held)[0]
            for s in range(0, len(q), 10_000):
                e = s + 10_000
                yield pa.RecordBatch.from_arrays([pa.array(q[s:e], pa.int32()), pa.array(score[s:e], pa.int64()), pa.array(list(ids[s:e]), pa.list_(pa.int64()))], names=["q", "score", "ids"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest score of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    most = k + 1
    rows = integer_vectors(vectors)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= most)
    packed = checkpoint(_packed(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), lists))
    asked = integer_vectors(vectors, is_query)
    total, longest = asked.select("v").distinct().agg(F.count("*"), F.max(F.size("v"))).first()
    n_blocks = -(-total * 4 * max(1, longest or 0) // block_bytes)
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("v"), F.lit(max(1, n_blocks))))
    distinct = checkpoint(asked.select("_block", "v").distinct())
    folder = f"{ensure_checkpoint_dir(spark)}/topk-{uuid.uuid4().hex}"
    found = 0
    for block in range(n_blocks):
        own = [np.array(r.v, np.int64) for r in distinct.where(F.col("_block") == block).select("v").collect()]
        if not own:
            continue
        names = {w: np.array([i for i, v in enumerate(own) if len(v) == w], np.int32) for w in {len(v) for v in own}}
        queries = {w: np.stack([own[i] for i in at]) for w, at in names.items()}
        gathered = checkpoint(packed.mapInArrow(_heads(queries, names, lists, most), "q int, lows array<long>, scores array<long>"))
        lows = gathered.groupBy("q").agg(*(F.min(F.col("lows")[b]).alias(f"low{b}") for b in range(lists)))
        each = gathered.select("q", F.explode("scores").alias("score"))
        nth = each.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("_n") <= most)
        cut = nth.groupBy("q").agg(F.max("_n").alias("n"), F.min("score").alias("score"))
        none = np.iinfo(np.int64).min
        low, reach = np.zeros((len(own), lists), np.int64), np.full(len(own), none)
        for r in lows.join(cut, "q").collect():  # one row for each query of the block
            low[r.q] = [r[f"low{b}"] for b in range(lists)]
            reach[r.q] = r.score if r.n == most else none
        free = reach == none  # fewer candidates than asked for: all are collected
        shift = np.where(free, 0, reach - low.sum(axis=1))
        cutoffs = np.where(free[:, None], none, low - (-shift // lists)[:, None])
        args = queries, names, {w: cutoffs[at] for w, at in names.items()}, {w: reach[at] for w, at in names.items()}, lists, most
        entries = packed.mapInArrow(_collected(*args), "q int, score long, ids array<long>")
        better = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
        entries = entries.withColumn("_n", F.row_number().over(better)).where(F.col("_n") <= most)
        pairs = entries.select("q", "score", F.explode("ids").alias("vec_id"))
        pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= most)
        tops = pairs.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "score", "vec_id"))), lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("tops"))
        keys = spark.createDataFrame([(i, v.tolist(), int(v @ v)) for i, v in enumerate(own)], "q int, v array<int>, own long")
        _answers(asked.where(F.col("_block") == block), keys.join(tops, "q"), k).write.mode("overwrite").parquet(f"{folder}/block={block}")
        found += 1
    return spark.read.parquet(folder).select("query_id", "rank", "vec_id", "score") if found else spark.createDataFrame([], RESULT)


def _answers(asked: DataFrame, tops: DataFrame, k: int) -> DataFrame:
    """Each query row's list without the row itself; ``tops`` has one short row for each vector of a block, so it is broadcast."""
    own = F.array_position("tops", F.struct(F.col("own").alias("score"), F.col("vec_id")))
    rest = F.when(own == 0, F.slice("tops", 1, k)).otherwise(F.concat(F.slice("tops", F.lit(1), (own - 1).cast("int")), F.slice("tops", (own + 1).cast("int"), F.lit(k))))
    at = asked.join(F.broadcast(tops), "v").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(rest, 1, k)))
    return at.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
