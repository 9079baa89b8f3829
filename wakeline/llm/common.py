"""Shared pieces of the corpus operators: checkpoints, guarded joins, vectorised word hashing.

Hashes are 64 bit; two different words or shingles share one with a chance near 1e-19 a pair.
"""

from __future__ import annotations

import ctypes
import inspect
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one vectorised step takes, in bytes (a single longer text is taken whole).
CHUNK_BYTES = 1 << 20
#: Largest table, in rows and in bytes, that bounded_join() broadcasts; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20

#: What names a document.
KEYS = ["doc_id", "text_hash"]

_M1, _M2, _R = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def tidy(f: Callable) -> Callable:
    """``f`` for a task; what it held is given back to the machine afterwards, since workers live on."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    if inspect.isgeneratorfunction(f):

        @wraps(f)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from f(batches)
            finally:
                give_back()

    else:

        @wraps(f)
        def run(table: pa.Table) -> pa.Table:
            try:
                return f(table)
            finally:
                give_back()

    return run


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a folder of its own only where none is set and all run on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wakeline-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable copy of ``df`` in the folder of spark.checkpoint.dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect garbage, upon which Spark deletes the shuffle files of tables that nothing refers to any more, on all executors."""
    spark.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id (a whole number), text_hash and text (null: empty), and what more is asked for; the first two are the document, also where a doc_id repeats."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), *more)


def bounded_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", rows: int | None = None, size: Column | None = None) -> DataFrame:
    """Joins with a broadcast of ``small`` if it is counted and proves small, else by a shuffle.

    ``size`` gives the bytes of a row's columns of no fixed width.
    """
    n, more = (rows, 0) if rows is not None and size is None else small.agg(F.count("*"), F.sum(size) if size is not None else F.lit(0)).first()
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS and 32 * n + (more or 0) <= BROADCAST_BYTES else small, on, how)


def n_buckets(docs: DataFrame, text: str = "text", mb: int = 32) -> int:
    """Buckets of an exchange so that each stands for about ``mb`` MB of text, however large the input."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(4, int(total // (mb << 20)) + 1)


def held_out(mod: int, remainder: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(mod)) == remainder


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
_INVERSE = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + 4096)
        for i, base in enumerate((_R, _INVERSE)):
            f = np.full(m, base, np.uint64)
            f[0] = 1
            _powers[i] = np.cumprod(f, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """p with p[e] - p[s] the polynomial sum of a[s:e]."""
    p = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_VALUE[a] * powers(len(a))[0], out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), equal for equal bytes."""
    inv = powers(len(p))[1]
    return mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of about ``limit`` bytes."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield at, run
            at, run, size = i, [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield at, run


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives none."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def arrays(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The packed arrays of a binary column without nulls, where they lie."""
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def present(owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that occur among the owners, and each owner's place among these."""
    hit = np.zeros(rows, bool)
    hit[owner] = True
    return np.flatnonzero(hit), (np.cumsum(hit) - 1)[owner]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, and each one's text index."""
    buf = (b"\n".join(texts) + b"\n").lower()
    a = np.frombuffer(buf, np.uint8)
    white = _WHITE[a]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    h = span_hash(prefix_hash(a), starts, ends)
    last = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(last, starts, "right")


_STEP = mix(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; with fewer words, one of the whole sequence."""
    h, doc = words(texts)
    counts = np.bincount(doc, minlength=len(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    if len(h) >= k:
        g = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            g += h[j : len(h) - k + 1 + j] * _STEP[j]
        g = mix(g)
    out = []
    for i, n in enumerate(counts):
        s = at[i]
        if n >= k:
            x = np.sort(g[s : s + n - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif n:
            out.append(mix(np.array([(h[s : s + n] * _STEP[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
