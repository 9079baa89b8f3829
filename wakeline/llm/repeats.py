"""Removal of repeated byte passages by common-prefix interval trees of sparse enhanced suffix arrays.

Every byte covered by a string of `length` bytes that also starts earlier (smaller doc_id, or the same
document and an earlier start) goes; texts are judged as they came in. Suffixes are sampled: each
window of `length` bytes has an anchor, its 16-byte gram of least hash (the first of equals), so equal
windows have equal anchors at equal places. Anchors that occur once drop out. The others go with the
bytes around them to buckets by gram, where their suffixes are sorted, common prefixes computed and the
interval tree scanned with a stack. In each interval, all of whose members share a right context, the
reversed left contexts are sorted and scanned in the same way: an interval of these is a set of
occurrences that agree in so many bytes to the left and no more, its members' next bytes to the left
being diverse (or at an end of the text or of the context). Both together are a maximal repeat group,
with all its occurrences; groups shorter than `length` are dropped. All occurrences of a group but the
first are marked. repeat_groups_of() gives the groups themselves.

In remove_repeats(), texts equal to one of a smaller doc_id are wholly repeated, so one of them stands
for all, and so do equal contexts of a batch. A document is a (doc_id, text): rows that repeat both are
one and share its result; texts that share a doc_id follow each other by their hash. Null texts are
empty; matches never cross documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import KEYS, arrays, as_bytes, bounded_join, checkpoint, chunks, keyed, let_go, mix, n_buckets, prefix_hash, span_hash, tidy

GRAM = 16
#: New spans that a task holds before it makes those that overlap one.
SPANS_HELD = 100_000


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, place and gram hash of the anchors of all windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    a = np.frombuffer(b"".join(texts), np.uint8)
    width = length - GRAM + 1
    if len(a) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    at = np.arange(len(a) - GRAM + 1)
    h = span_hash(prefix_hash(a), at, at + GRAM)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    n, step = len(a) - length + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[width - step : width - step + n])
    inside = np.zeros(len(a) + 1, np.int8)
    long = sizes >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - length + 1, -1)
    chosen = (least[np.cumsum(inside[:n]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    chosen = np.unique(chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]) if len(chosen) else chosen
    text = np.searchsorted(starts + sizes, chosen, "right")
    return text, chosen - starts[text], h[chosen]


def _deal_anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = (np.asarray(b.column(c).to_numpy(zero_copy_only=False), np.int64) for c in KEYS)
            parts = []
            for at, run in chunks(as_bytes(b.column("text"))):
                text, place, h = anchors(run, length)
                parts.append((text + at, place, h))
            if not parts:
                continue
            text, place, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(cut[1:] > cut[:-1]):
                w = order[cut[k] : cut[k + 1]]
                new = np.concatenate(([True], text[w][1:] != text[w][:-1]))
                cols = (ids[text[w][new]], keys[text[w][new]], np.diff(np.concatenate((np.flatnonzero(new), [len(w)]))).astype(np.uint32), place[w].astype(np.uint32), h[w].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols)], ["bucket", "ids", "keys", "counts", "places", "grams"])

    return docs.mapInArrow(tidy(deal), "bucket int, ids binary, keys binary, counts binary, places binary, grams binary")


def _repeated(parts: int):
    """The places of each document whose grams occur more than once in the bucket, packed by a hash of the document."""

    def repeated(table: pa.Table) -> pa.Table:
        ids, keys, counts, places, grams = (np.concatenate(arrays(table[k], kind)) for k, kind in (("ids", np.int64), ("keys", np.int64), ("counts", np.uint32), ("places", np.uint32), ("grams", np.uint32)))
        order = np.argsort(grams, kind="stable")
        g = grams[order]
        same = np.concatenate(([False], g[1:] == g[:-1], [False]))
        often = np.zeros(len(g), bool)
        often[order] = same[1:] | same[:-1]
        owner = np.repeat(np.arange(len(ids)), counts)[often]
        places = places[often]
        many = np.bincount(owner, minlength=len(ids)).astype(np.uint32)
        part = (mix(ids.view(np.uint64) * np.uint64(3) + keys.view(np.uint64)) >> np.uint64(32)) % np.uint64(parts)
        order = np.lexsort((np.arange(len(owner)), part[owner]))
        places, at = places[order], np.concatenate(([0], np.cumsum(np.bincount(part[owner].astype(np.int64), minlength=parts))))
        out = []
        for k in np.flatnonzero(at[1:] > at[:-1]):
            own = np.flatnonzero((part == k) & (many > 0))
            out.append((k, *(x.tobytes() for x in (ids[own], keys[own], many[own], places[at[k] : at[k + 1]]))))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "ids", "keys", "counts", "places"])

    return repeated


def _gathered(table: pa.Table) -> pa.Table:
    """One row for each document of a part, with all its places."""
    ids, keys, counts, places = (np.concatenate(arrays(table[k], kind)) for k, kind in (("ids", np.int64), ("keys", np.int64), ("counts", np.uint32), ("places", np.uint32)))
    owner = np.repeat(np.arange(len(ids)), counts)
    order = np.lexsort((places, keys[owner], ids[owner]))
    owner, places = owner[order], places[order]
    first = np.flatnonzero(np.concatenate(([True], (ids[owner][1:] != ids[owner][:-1]) | (keys[owner][1:] != keys[owner][:-1]))))
    cut = np.append(first, len(places))
    return pa.table([pa.array(ids[owner[first]]), pa.array(keys[owner[first]]), pa.array([places[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "text_hash", "places"])


_CONTEXTS = "bucket int, doc_id long, text_hash long, place long, before int, context binary, start long, stop long"
_NAMES = ["bucket", "doc_id", "text_hash", "place", "before", "context", "start", "stop"]
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())


def _first_of_equals(doc: np.ndarray, key: np.ndarray, place: np.ndarray, context: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that come first (document, place) among those of equal context, all others, and the row that each of them repeats."""
    order = np.lexsort((place, key, doc))
    new = np.ones(len(order), bool)
    new[1:] = False
    for x in (doc, key, place):
        new[1:] |= x[order][1:] != x[order][:-1]
    seen: dict = {}
    first, later, of = [], [], []
    for i in order[new].tolist():
        j = seen.setdefault(context[i], i)
        if j == i:
            first.append(i)
        else:
            later.append(i), of.append(j)
    return np.array(first, np.int64), np.array(later, np.int64), np.array(of, np.int64)


def _runs(spans: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """The spans (document, start, stop), those that overlap or touch made one."""
    out: list[list[int]] = []
    for d, k, s, e in sorted(spans):
        if out and out[-1][:2] == [d, k] and s <= out[-1][3]:
            out[-1][3] = max(out[-1][3], e)
        else:
            out.append([d, k, s, e])
    return out


def _deal_contexts(docs: DataFrame, length: int, buckets: int, collapse: bool) -> DataFrame:
    """Contexts of repeated anchors by bucket; if ``collapse``, equal contexts of a batch go once and the later ones are spans, in buckets below 0."""
    reach = length - GRAM

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, key, place, before, context = [], [], [], [], []
            for d, k, t, packed in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), as_bytes(b.column("text")), b.column("places").to_pylist(), strict=True):
                for p in np.frombuffer(packed, np.uint32).tolist():
                    doc.append(d), key.append(k), place.append(p), before.append(min(reach, p)), context.append(t[max(0, p - reach) : p + length])
            if not doc:
                continue
            kept, later, _ = _first_of_equals(np.array(doc), np.array(key), np.array(place), list(zip(before, context, strict=True)))
            if not collapse:
                kept, later = np.sort(np.concatenate((kept, later))), later[:0]
            out = [(int(mix(np.array([int.from_bytes(hashlib.blake2b(context[i][before[i] : before[i] + GRAM], digest_size=8).digest(), "little")], np.uint64))[0] % np.uint64(buckets)), doc[i], key[i], place[i], before[i], context[i], None, None) for i in kept.tolist()]
            out += [(-1 - d % buckets, d, k, None, None, None, s, e) for d, k, s, e in _runs([(doc[i], key[i], place[i] - before[i], place[i] - before[i] + len(context[i])) for i in later.tolist() if len(context[i]) >= length])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)

    return docs.mapInArrow(tidy(deal), _CONTEXTS)


def lcp_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, common prefix) of the intervals of an array's neighbouring common prefixes, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i, common in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][1] > common:
            left, value = stack.pop()
            if value >= least:
                yield left, i, value
        if common and (not stack or stack[-1][1] < common):
            stack.append((left, common))


def _sorted_prefixes(a: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of bytes (of which ``sizes`` count), and the common prefixes of neighbours in it."""
    width = a.shape[1]
    padded = np.zeros((len(a), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = a
    columns = padded.view(">u8")
    order = np.lexsort([sizes, *(columns[:, i] for i in range(columns.shape[1] - 1, -1, -1))])
    a, sizes = a[order], sizes[order]
    differ = a[1:] != a[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))


def _diverse(side: np.ndarray, sizes: np.ndarray, members: np.ndarray, shared: int) -> bool:
    """Whether the members' next bytes behind the ``shared`` ones differ, or one of them has none."""
    return bool((sizes[members] <= shared).any() or (side[members, shared] != side[members[0], shared]).any())


def repeat_groups(context: np.ndarray, before: np.ndarray, after: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, bytes they share before the anchor, bytes they share from it on) of every maximal repeat group.

    context rows hold `length - GRAM` bytes before the anchor and `length` from it on.
    """
    reach = length - GRAM
    right = context[:, reach:]
    suffixes, common = _sorted_prefixes(right, after)
    left = np.ascontiguousarray(context[:, :reach][:, ::-1])
    one, two = suffixes[:-1], suffixes[1:]
    differ = left[one] != left[two]
    beside = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), reach), np.minimum(before[one], before[two])).tolist()
    for i, j, value in lcp_intervals(common.tolist(), GRAM):
        members = suffixes[i : j + 1]
        if j == i + 1:
            if beside[i] + value >= length:
                yield members, beside[i], value
            continue
        if value == length and _diverse(left, before, members, 0):
            yield members, 0, value
        able = members[before[members] >= max(1, length - value)]
        if len(able) < 2:
            continue
        order, shared = _sorted_prefixes(left[able], before[able])
        for x, y, grown in lcp_intervals(shared.tolist(), max(1, length - value)):
            group = able[order[x : y + 1]]
            if value == length or _diverse(right, after, group, value):
                yield group, grown, value


def _contexts(table: pa.Table, length: int) -> tuple:
    """The arrays of a bucket: documents, keys, places, contexts; rows that stand for equal contexts, the others, and whom these repeat."""
    doc, key, place, before = (np.asarray(table[k].to_numpy(), np.int64) for k in ("doc_id", "text_hash", "place", "before"))
    texts = table["context"].to_pylist()
    first, later, of = _first_of_equals(doc, key, place, list(zip(before.tolist(), texts, strict=True)))
    reach = length - GRAM
    after = np.array([len(texts[i]) for i in first]) - before[first]
    context = np.frombuffer(b"".join(b"\0" * (reach - n) + texts[i] + b"\0" * (length - m) for i, n, m in zip(first.tolist(), before[first].tolist(), after.tolist(), strict=True)), np.uint8).reshape(len(first), reach + length)
    return doc, key, place, before, texts, first, later, of, context, after


def _scan(length: int):
    def scan(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.select([*KEYS, "start", "stop"])
        doc, key, place, before, texts, first, later, _, context, after = _contexts(table, length)
        out = [np.array([(doc[i], key[i], place[i] - before[i], place[i] - before[i] + len(texts[i])) for i in later.tolist() if len(texts[i]) >= length], np.int64).reshape(-1, 4)]
        doc, key, place, before = doc[first], key[first], place[first], before[first]
        # first holds the rows in order of occurrence, so that the least member of a group is its first occurrence.
        held = len(out[0])
        for members, grown, value in repeat_groups(context, before, after, length):
            rest = members[members != members.min()]
            out.append(np.stack((doc[rest], key[rest], place[rest] - grown, place[rest] + value), 1))
            held += len(rest)
            if held > SPANS_HELD:
                out = [_merged(np.concatenate(out))]
                held = 0
        spans = _merged(np.concatenate(out))
        return pa.table([pa.array(np.ascontiguousarray(spans[:, i])) for i in range(4)], names=["doc_id", "text_hash", "start", "stop"])

    return scan


def _merged(spans: np.ndarray) -> np.ndarray:
    """The spans (document, key, start, stop), those that overlap or touch made one."""
    spans = spans[np.lexsort((spans[:, 3], spans[:, 2], spans[:, 1], spans[:, 0]))]
    if not len(spans):
        return spans
    new = np.concatenate(([True], (spans[1:, :2] != spans[:-1, :2]).any(axis=1)))
    document = np.cumsum(new)
    wide = np.int64(1 << 33)
    reached = np.maximum.accumulate(spans[:, 3] + document * wide) - document * wide
    new[1:] |= spans[1:, 2] > reached[:-1]
    first = np.flatnonzero(new)
    out = spans[first]
    out[:, 3] = np.maximum.reduceat(spans[:, 3], first)
    return out


def _groups(length: int):
    """Every occurrence of every group of a bucket."""

    def groups(table: pa.Table) -> pa.Table:
        doc, key, place, before, texts, first, later, of, context, after = _contexts(table, length)
        copies: dict[int, list[int]] = {}
        for i, j in zip(later.tolist(), of.tolist(), strict=True):
            copies.setdefault(j, []).append(i)
        found = [([i], int(before[i]), len(texts[i]) - int(before[i])) for i in copies if len(texts[i]) >= length]
        found += [(first[members].tolist(), grown, value) for members, grown, value in repeat_groups(context, before[first], after, length)]
        rows = []
        for members, grown, value in found:
            i = members[0]
            name = hashlib.blake2b(texts[i][before[i] - grown : before[i] + value], digest_size=16).hexdigest()
            rows += [(name, grown + value, int(doc[k]), int(key[k]), int(place[k]) - grown) for m in members for k in (m, *copies.get(m, ()))]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["repeat", "length", "doc_id", "text_hash", "start"])

    return groups


def _held(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """The documents (doc_id, text_hash, text) that have anchors that occur more than once, and the places of these."""
    packed = _deal_anchors(docs, length, buckets).groupBy("bucket").applyInArrow(tidy(_repeated(buckets)), "part int, ids binary, keys binary, counts binary, places binary")
    places = checkpoint(packed.groupBy("part").applyInArrow(tidy(_gathered), "doc_id long, text_hash long, places binary"))
    del packed
    let_go(docs.sparkSession)  # the anchors' exchange is over before the contexts' begins
    return bounded_join(docs, places, KEYS, size=F.octet_length("places"))


def repeat_groups_of(docs: DataFrame, length: int = 100) -> DataFrame:
    """repeat, length, doc_id, text_hash, start: all occurrences of all maximal repeat groups.

    A repeat of `length` bytes or more is seen through each of its anchors' contexts, which reach
    `length` minus 16 bytes before the anchor and `length` from it on; a group of more appears cut to that reach too.
    """
    docs, buckets = keyed(docs), n_buckets(docs)
    return _deal_contexts(_held(docs, length, buckets), length, 4 * buckets, False).groupBy("bucket").applyInArrow(tidy(_groups(length)), "repeat string, length long, doc_id long, text_hash long, start long").distinct()


def without_twins(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that are the first of their text, and (doc_id, text_hash) of all others."""
    keys = checkpoint(docs.select(*KEYS, F.sha2("text", 256).alias("key")))
    first = keys.groupBy("key").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").drop("_last")
    twins = checkpoint(bounded_join(keys, checkpoint(first), "key").where("doc_id > _first").select(*KEYS).distinct())
    return bounded_join(docs, twins, KEYS, "left_anti"), twins


def repeat_spans(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, text_hash, start, stop) to remove from texts that are the first of their kind, and the keys of copies."""
    firsts, twins = without_twins(docs)
    buckets = n_buckets(docs)
    contexts = _deal_contexts(_held(firsts, length, buckets), length, 8 * buckets, True)
    spans = checkpoint(contexts.groupBy("bucket").applyInArrow(tidy(_scan(length)), "doc_id long, text_hash long, start long, stop long"))
    del contexts
    let_go(docs.sparkSession)
    return spans, twins


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, the number of removed bytes, and of maximal removed runs; spans come sorted."""
    kept, at, removed, runs = [], 0, 0, 0
    for start, stop in spans:
        if not runs or start > at:
            runs += 1
            kept.append(raw[at:start])
        removed += max(0, stop - max(start, at))
        at = max(at, stop)
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, length: int = 100, as_text: bool = False, along: Column | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept and text_hash of every row, and `along`, a column of the row's own, if one is given.

    kept holds the remaining bytes, or, ``as_text``, the characters that are still whole in them. What goes along with
    the text need not be joined to it again.
    """
    rows = keyed(docs) if along is None else keyed(docs, along.alias("along"))
    docs = keyed(docs)
    spans, twins = repeat_spans(docs, length)
    ordered = Window.partitionBy(*KEYS).orderBy("start", "stop")
    reached = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("_new", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int")).withColumn("_run", F.sum("_new").over(ordered))
    runs = numbered.groupBy(*KEYS, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    packed = runs.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    marked = packed.join(twins.withColumn("twin", F.lit(True)), KEYS, "full")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, k, raw, spans, twin in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), as_bytes(b.column("text")), b.column("spans").to_pylist(), b.column("twin").to_pylist(), strict=True):
                pairs = [(0, len(raw))] if twin and len(raw) >= length else [(x["start"], x["stop"]) for x in spans or ()]
                kept, removed, runs = _cut(raw, pairs)
                out.append((d, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if as_text else kept, k))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            made = [pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.string(), pa.string() if as_text else pa.binary(), pa.int64()), strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text_hash"]
            yield pa.RecordBatch.from_arrays([*made, *(b.column(c) for c in more)], [*names, *more])

    more = [c for c in rows.columns if c == "along"]
    held = bounded_join(rows, checkpoint(marked), KEYS, "left", size=F.coalesce(F.size("spans"), F.lit(0)) * 40)
    shape = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}, text_hash long"
    return held.select(*KEYS, "text", "spans", "twin", *more).mapInArrow(tidy(cut), ", ".join([shape, *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in more)]))
