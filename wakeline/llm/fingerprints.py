"""Improbable-feature document fingerprints.

Every 64-byte window has an entropy; the fewer windows of a sample have one like it, the rarer the window.
The histograms of entropies are counted over the whole texts of all documents; they decide which windows are
preferred. In each run of 64 windows the rarest
(the first of equals) gets a point, and windows with enough points become features. A text of less than 600
bytes also gives windows of 16 bytes in the same way, since it has few of the long ones, and one of less than
128 bytes those of 8. Features go, by hash, into Bloom filters of 2048 bits, a new filter after every 160. Two digests compare by the overlap of
their filters' bits beyond chance.

A text without any is one feature; an empty or null text has the empty fingerprint, which is
alike (1.0) only to another empty one. The next document is the next distinct (doc_id, text) in
descending order of doc_id, then text hash; after the last comes the first. Equal rows share a result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import as_bytes, bounded_join, chunks, prefix_hash, span_hash, tidy
from wakeline.llm.sharding import number_rows

BITS, MOST, SUBS = 2048, 160, 5
#: Bytes of a window, windows of a run, points that make a feature; and the bytes of a text below which it gives such ones.
SHAPES = (((64, 64, 16), None), ((16, 16, 4), 600), ((8, 8, 2), 128))
LONGEST = 64
#: The width of a histogram's bins in bits, and the share of the highest entropy below which a window is trivial.
BIN, TRIVIAL = 0.02, 0.25
#: Bytes that one vectorised step takes, few enough for the caches.
STEP_BYTES = 1 << 17
BLOCK_ROWS = 1500

_COUNTS = np.arange(LONGEST + 1)
#: n * log2(n) in whole steps, small enough that 64 of them fit 16 bits.
_PARTS = np.round(np.where(_COUNTS > 0, _COUNTS * np.log2(np.maximum(_COUNTS, 1)), 0) * 128).astype(np.uint16)
#: What one more of a byte value adds to a sum of parts, by how many there are.
_STEPS = np.diff(_PARTS)


def entropies(span: int) -> np.ndarray:
    """The entropy that each possible sum of parts stands for."""
    return np.log2(span) - np.arange(int(_PARTS[span]) + 256) / 128 / span


def bin_of(span: int) -> np.ndarray:
    """The histogram's bin of each possible sum."""
    return np.floor(np.maximum(entropies(span), 0) / BIN).astype(np.int64)


def rarity(span: int, counts: np.ndarray) -> np.ndarray:
    """For each possible sum, how improbable its entropy is by the bins' counts, in thousandths of a bit and one more; 0 where it is trivial."""
    told = -np.log2((counts + 1) / (counts.sum() + len(counts)))
    at = np.interp(entropies(span), (np.arange(len(counts)) + 0.5) * BIN, told)
    return np.where(entropies(span) < TRIVIAL * np.log2(span), 0, 1 + np.round(at * 1000)).astype(np.int64)


def _windows(texts: list[bytes], span: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with gaps between them, each text's start, and of the window from each byte on its sum and whether it lies in a text."""
    pad = b"\0" * (span + run)
    a = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    n = len(a) - span + 1
    lengths = np.array([len(t) for t in texts])
    starts = len(pad) + np.concatenate(([0], np.cumsum(lengths + len(pad))[:-1]))
    # How many of the span - 1 bytes after, and before, each byte are equal to it.
    after, before = np.zeros(len(a), np.uint8), np.zeros(len(a), np.uint8)
    for d in range(1, span):
        same = (a[:-d] == a[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    # From one window to the next a byte goes and a byte comes; the sums of parts follow modulo 2**16, below which they are.
    sums = np.empty(n, np.uint16)
    sums[0] = _PARTS[np.bincount(a[:span])].sum()
    sums[1:] = _STEPS[before[span:]] - _STEPS[after[: n - 1]]
    np.cumsum(sums, dtype=np.uint16, out=sums)
    inside = np.zeros(n + 1, np.int8)
    whole = lengths >= span
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, starts[whole] + lengths[whole] - span + 1, -1)
    return a, starts, sums, np.cumsum(inside[:-1]) > 0


def _selected(texts: list[bytes], shape: tuple[int, int, int], rare: np.ndarray) -> list[np.ndarray]:
    """Hashes of the selected windows of one shape of each text, in order."""
    span, run, least = shape
    a, starts, sums, inside = _windows(texts, span, run)
    n = len(sums)
    rank = np.where(inside, rare[sums], 0)
    key = (rank << 32) + (0xFFFFFFFF - np.arange(n))
    step = 1
    while step < run:
        key[: n - step] = np.maximum(key[: n - step], key[step:])
        step *= 2
    top = key[: max(0, n - run + 1)]
    points = np.bincount(0xFFFFFFFF - (top[top >> 32 > 0] & 0xFFFFFFFF), minlength=n)
    chosen = np.flatnonzero(points >= least)
    hashes = span_hash(prefix_hash(a), chosen, chosen + span)
    cut = np.searchsorted(chosen, np.concatenate((starts, [len(a)])))
    return [hashes[cut[i] : cut[i + 1]] for i in range(len(texts))]


def _in_steps(texts: list[bytes], shape: tuple[int, int, int], rare: np.ndarray) -> list[np.ndarray]:
    """_selected() of runs of texts that a vectorised step takes at once."""
    out, run, size = [], [], 0
    for t in texts:
        if run and size + len(t) > STEP_BYTES:
            out += _selected(run, shape, rare)
            run, size = [], 0
        run.append(t)
        size += len(t) + shape[0] + shape[1]
    return out + _selected(run, shape, rare) if run else out


#: What is preferred of each shape's windows: the rarity of each possible sum.
Tables = list[np.ndarray]


def features(texts: list[bytes], tables: Tables) -> list[np.ndarray]:
    """Hashes of the selected windows of each text, the long ones first."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    for (shape, limit), rare in zip(SHAPES, tables, strict=True):
        own = [i for i, t in enumerate(texts) if limit is None or len(t) < limit]
        if own:
            for i, more in zip(own, _in_steps([texts[i] for i in own], shape, rare), strict=True):
                out[i] = np.concatenate((out[i], more))
    for i, t in enumerate(texts):
        if t and not len(out[i]):
            out[i] = np.frombuffer(hashlib.sha256(t).digest()[:8], "<u8").astype(np.uint64)
    return out


def rarity_tables(docs: DataFrame) -> Tables:
    """The tables by the entropies of all documents; a histogram of some hundred bins for each shape comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(int(bin_of(shape[0]).max()) + 1, np.int64) for shape, _ in SHAPES]
        for b in batches:
            for _, texts in chunks(as_bytes(b.column(0)), STEP_BYTES):
                for k, ((span, run, _), limit) in enumerate(SHAPES):
                    own = [t for t in texts if limit is None or len(t) < limit]
                    if own:
                        _, _, sums, inside = _windows(own, span, run)
                        held[k] += np.bincount(bin_of(span)[sums[inside]], minlength=len(held[k]))
        for k, h in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k), pa.int32()), pa.array(np.arange(len(h)), pa.int32()), pa.array(h)], ["kind", "bin", "n"])

    out = [np.zeros(int(bin_of(shape[0]).max()) + 1, np.int64) for shape, _ in SHAPES]
    for r in docs.select("text").mapInArrow(tidy(count), "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
        out[r.kind][r.bin] = r.n
    return [rarity(shape[0], n) for (shape, _), n in zip(SHAPES, out, strict=True)]


def digest(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, one row of 0 and 1 each."""
    chain = np.zeros((-(-len(hashes) // MOST), BITS), np.uint8)
    row = np.arange(len(hashes)) // MOST
    for i in range(SUBS):
        chain[row, (hashes >> np.uint64(11 * i)).astype(np.int64) % BITS] = 1
    return chain


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(1, dtype=np.int64)[:, None], b.sum(1, dtype=np.int64)[None]
    shared = a.astype(np.float32) @ b.T.astype(np.float32)
    chance = na * nb / BITS
    score = (shared - chance) / np.maximum(np.minimum(na, nb) - chance, 1e-9)
    weight = na[:, 0] / na.sum()
    return float(np.clip((np.clip(score, 0, 1).max(axis=1) * weight).sum(), 0, 1))


def digests(texts: list[str], tables: Tables) -> list[np.ndarray]:
    return [digest(h) for h in features([t.encode("utf-8", "replace") for t in texts], tables)]


def _text(chain: np.ndarray) -> str:
    return base64.b64encode(np.packbits(chain).tobytes()).decode() if len(chain) else ""


def _block(tables: Tables):
    def block(table: pa.Table) -> pa.Table:
        """Rows of a block and the row after each; those with _extra only serve as a next document."""
        rows = sorted(zip(table["row_no"].to_pylist(), table["_extra"].to_pylist(), table["doc_id"].to_pylist(), (t.decode("utf-8", "replace") for t in as_bytes(table["text"].combine_chunks())), strict=True), key=lambda r: (r[0], r[1]))
        place: dict[int, str] = {}
        for no, _, _, text in rows:
            place[no] = text
        own = [r for r in rows if not r[1]]
        mine = sorted({r[0] for r in own})
        total = table["_total"][0].as_py()
        need = sorted({*mine, *((no - 1) % total for no in mine)})
        base = dict(zip(need, digests([place[no] for no in need], tables), strict=True))
        after = {no: place[(no - 1) % total] for no in mine}
        edited = {no: place[no][: len(place[no]) - len(place[no]) // 2] + after[no][: len(place[no]) // 2] for no in mine}
        changed = dict(zip(mine, digests([edited[no] for no in mine], tables), strict=True))
        found = {no: (len(place[no]), hashlib.sha256(edited[no].encode("utf-8", "replace")).hexdigest(), _text(base[no]), _text(changed[no]), likeness(base[no], changed[no]), likeness(base[no], base[(no - 1) % total])) for no in mine}
        cols = list(zip(*((r[2], *found[r[0]]) for r in own), strict=True)) or [[]] * 7
        kinds = (table.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return block


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    tables = rarity_tables(own)
    numbered, total = number_rows(own.select("doc_id", "_hash").distinct(), ["doc_id", "_hash"])
    last = total - 1
    block = F.floor(F.col("row_no") / BLOCK_ROWS).cast("long")
    extra = F.when(F.col("row_no") == last, F.lit(0)).when((F.col("row_no") + 1) % BLOCK_ROWS == 0, block + 1)
    placed = bounded_join(own, numbered, ["doc_id", "_hash"], rows=total)
    sent = placed.select("doc_id", "text", "row_no", F.lit(total).alias("_total"), F.explode(F.filter(F.array(F.struct(block.alias("block"), F.lit(False).alias("extra")), F.when(extra.isNotNull(), F.struct(extra.cast("long").alias("block"), F.lit(True).alias("extra")))), lambda x: x.isNotNull())).alias("_to"))
    kind = dict(docs.dtypes)["doc_id"]
    return sent.select("doc_id", "text", "row_no", "_total", F.col("_to.block").alias("_block"), F.col("_to.extra").alias("_extra")).groupBy("_block").applyInArrow(
        tidy(_block(tables)), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
