"""Exact n-gram Jaccard join by universe-partition pigeonhole.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Sizes fall into bands whose
ends lie a factor 4/3 apart, so sets that link at 0.75 are in one band or two that follow each other.
In a band the universe of shingles is cut by hash into segments. Sets that link differ in at most H
shingles, so of any H + 1 non-empty segments of the smaller one at least one is the same in the larger
one. A segment looked up together with its one-deletion neighbourhood counts twice, since two
differences are needed to miss it; the first of every PART segments are indexed with theirs. Each set
looks up the cheapest segments that add up to H + 1: those of more than one shingle first, and by
shingle frequencies in a bounded sample (they steer cost, never the result). If some set has too few
segments, all bands get more of them, so the guarantee holds for every set. Pairs that meet are sifted
by counts in hashed cells, which bound the difference of two sets from below.

Signatures that meet in small groups give pairs. In a larger group every member is compared with one
centre only, the member that meets most others over all groups; texts decide. Of equal sets only the
first takes part; the others are put into its component at the end. Where a group's members then lie in several components, only sets of
which three quarters also occur in other components can have a link across: the rest is left out, round
after round; groups that are mostly the same documents become one. What remains is compared by cells in blocks of bounded size inside the tasks. Of the pairs
still open a first round checks those that could join components as a forest, a second one all others
that lie in different components after it. So no link between different components is lost, and the
pairs that become rows don't grow with the square of a group.

A document is a (doc_id, text): rows that repeat both share a component, rows that repeat a doc_id with
other texts are linked by their own texts. Null texts and texts without words have no set and no link;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import arrays, as_bytes, bounded_join, checkpoint, chunks, keyed, let_go, mix, n_buckets, present, shingle_sets, tidy
from wakeline.llm.components import components

#: Rows of the sample of shingle frequencies, and the frequent shingles kept of it.
SAMPLE_ROWS, FREQUENT = 10_000, 200_000
#: One of so many segments is indexed with its one-deletion neighbourhood.
PART = 16
#: Segments for each shingle of a band's smallest set.
PER_SHINGLE = 0.6
#: Rows whose signatures are dealt at once, and bits that hold a row's place among them.
PACK_ROWS, PLACE_BITS = 4000, 12
#: Text, in MB, whose signatures make one bucket, and shingles that make one.
BUCKET_MB, BUCKET_SHINGLES = 16, 1_000_000
#: Members compared with one centre at once; larger groups are split.
SPLIT = 256
#: A signature's group up to this size gives the pairs of its members, a larger one a star.
SMALL_GROUP = 3
#: Members of a block of a group whose pairs are compared inside a task.
BLOCK = 512
#: Rows that one comparison task takes at once.
TASK_ROWS, TEXT_ROWS = 10_000, 500

_EDGES = [1]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(max(_EDGES[-1] + 1, -(-4 * _EDGES[-1] // 3)))
BAND_STARTS = np.array(_EDGES)


_STARTS, _ENDS = BAND_STARTS[:-1], BAND_STARTS[1:]
_SEGMENTS = np.maximum(8, PER_SHINGLE * _STARTS) + np.where(_STARTS < 64, 24, 2)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(BAND_STARTS, n, "right") - 1


def differences(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Most shingles in which a set of n and a set in the band, no smaller, can differ and still link."""
    return (n + np.minimum(_ENDS[band] - 1, 4 * n // 3)) // 7


class Frequencies:
    """Estimated document counts of frequent shingles; 0 for all others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.flag = np.zeros(1 << 20, bool)
        self.flag[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        if len(self.keys):
            at = np.flatnonzero(self.flag[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.keys, s[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[i] == s[at], self.counts[i], 0)
        return out


def _rank_within(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each row's rank in its group, rows taken in ``order``, which keeps groups together."""
    g = group[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    rank = np.empty(len(g), np.int64)
    rank[order] = np.arange(len(g)) - np.repeat(first, np.diff(np.concatenate((first, [len(g)]))))
    return rank


def signatures(s: np.ndarray, owner: np.ndarray, n: np.ndarray, frequency: np.ndarray, band: np.ndarray, finer: float, index: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Signatures of many sets, their uses (1 looked up, 2 indexed, 3 both) and owners; whether every set has enough.

    s holds the sets' shingles, owner each one's set; n and band are given by set.
    """
    many = (_SEGMENTS[band] * finer).astype(np.uint64)
    key = (owner.astype(np.uint64) << np.uint64(40)) | ((s >> np.uint64(20)) % many[owner])
    order = np.argsort(key, kind="stable")
    key, s, frequency = key[order], s[order], frequency[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sized = np.diff(np.concatenate((first, [len(s)])))
    mixed = mix(s)
    sums, cost = np.add.reduceat(mixed, first), np.minimum.reduceat(frequency, first)
    of, number = (key[first] >> np.uint64(40)).astype(np.int64), key[first] & np.uint64((1 << 40) - 1)
    seed = mix(number + (band[of].astype(np.uint64) << np.uint64(40)))
    need = differences(n, band) + 1
    rank = _rank_within(of, np.lexsort((cost, sized == 1, cost > 0, of)))
    looked = rank < need[of]
    missing = np.maximum(need - np.bincount(of, minlength=len(n)), 0)
    # Segments looked up with their one-deletion neighbourhood count twice; each saves the dearest one, or fills what is missing.
    near = number % np.uint64(PART) == 0
    good, spare, dear = near & looked & (cost == 0) & (sized > 2), near & looked, looked & (cost > 0)
    total = lambda x: np.bincount(of[x], minlength=len(n))
    twice = np.minimum(total(spare), np.maximum(missing, np.minimum(total(good), missing + total(dear))))
    upgraded = spare & (_rank_within(of, np.lexsort((~good, ~spare, of))) < twice[of])
    looked &= ~(dear & (_rank_within(of, np.lexsort((-cost, upgraded, ~dear, of))) < (twice - missing)[of]))
    kept = looked | index
    out, use, own = [mix(sums + seed)[kept]], [np.where(looked, 3 if index else 1, 2)[kept]], [of[kept]]
    wide = np.repeat(near & (index | (upgraded & looked)), sized)
    if wide.any():
        segment = np.repeat(np.arange(len(first)), sized)[wide]
        out.append(mix(sums[segment] - mixed[wide] + seed[segment]))
        use.append(np.where((upgraded & looked)[segment], 3 if index else 1, 2))
        own.append(of[segment])
    return np.concatenate(out), np.concatenate(use).astype(np.uint8), np.concatenate(own), bool((missing <= twice).all())


#: What each byte value holds: four counts of 0 to 3.
_COUNTS = (np.arange(256, dtype=np.uint8)[:, None] >> np.arange(0, 8, 2, dtype=np.uint8)) & np.uint8(3)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles, three at most, fall in each of a power of two of cells, one in each or fewer on average; four cells a byte."""
    cells = 32
    while cells < len(s) and cells < 1 << 20:
        cells *= 2
    n = np.minimum(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 3).astype(np.uint8).reshape(4, -1)
    return (n[0] | n[1] << 2 | n[2] << 4 | n[3] << 6).tobytes() if len(s) else b""


def cells_of(sketches: list[bytes]) -> np.ndarray:
    """The counts of the sketches as rows, all in the cells of the smallest: counts of 3 at most add up to the same ones."""
    held = np.array([len(x) for x in sketches])
    least = int(held.min())
    out = np.zeros((len(sketches), 4 * least), np.int8)
    for size in np.unique(held).tolist():
        at = np.flatnonzero(held == size)
        packed = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint8).reshape(len(at), size)
        cells = _COUNTS[packed].transpose(0, 2, 1).reshape(len(at), -1, 4 * least)
        out[at] = np.minimum(cells.sum(axis=1), 3)
    return out


def may_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """False only where the cells' counts, which never differ by more than the sets do, differ by more than linked sets can."""
    x, y = cells_of([a, b])
    return 7 * int(np.abs(x - y).sum(dtype=np.int64)) <= na + nb


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, run in chunks(as_bytes(batch.column("text"))):
        yield at, shingle_sets(run)


def set_hash(s: np.ndarray) -> int:
    """A hash of the whole set, equal for equal sets."""
    sums = np.array([s.sum(), np.bitwise_xor.reduce(mix(s)), len(s)], np.uint64) if len(s) else np.zeros(3, np.uint64)
    return int((mix(sums[:1]) ^ mix(sums[1:2] + mix(sums[2:]))).view(np.int64)[0])


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, n_shingles, the sketch and the hash of each set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(len(s), sketch(s), set_hash(s)) for _, sets in _sets(b) for s in sets]
            cols = [pa.array([x[i] for x in got], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text_hash", "node")), *cols], ["doc_id", "text_hash", "node", "n_shingles", "sketch", "set_hash"])

    return docs.mapInArrow(tidy(measure), "doc_id long, text_hash long, node long, n_shingles long, sketch binary, set_hash long")


def equal_sets(sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the least one of the same set, which is another."""
    shared = sizes.where("n_shingles > 0").groupBy("set_hash").agg(F.min("node").alias("a"), F.max("node").alias("_last")).where("a < _last").select("set_hash", "a")
    return bounded_join(sizes.where("n_shingles > 0"), checkpoint(shared), "set_hash").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def without(docs: DataFrame, sizes: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents but for the nodes that are gone, by a join with the fewer of those that go and those that stay."""
    if 2 * gone.count() <= sizes.count():
        return bounded_join(docs, gone, "node", "left_anti")
    return bounded_join(docs, checkpoint(bounded_join(sizes.select("node"), gone, "node", "left_anti").distinct()), "node", "left_semi")


def frequent_shingles(docs: DataFrame, rows: int) -> Frequencies:
    """Shingles in two or more texts of a bounded sample, and in how many."""
    drawn = docs.where(F.pmod(F.col("node"), F.lit(1_000_000)) < F.lit(min(1.0, SAMPLE_ROWS / max(1, rows)) * 1_000_000))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sets in _sets(b):
                if len(s := np.concatenate(sets)):
                    u, n = np.unique(s, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["s", "n"])

    top = drawn.mapInArrow(tidy(each), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas()
    keys, counts = top["s"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return Frequencies(keys[order], counts[order])


def _dealt(docs: DataFrame, buckets: int, finer: float, frequent: Frequencies) -> DataFrame:
    """Per batch and bucket: the signatures of the sets as packed arrays, with the places of their rows in the batch.

    So a row's share of an exchange does not grow with the number of buckets. A row in bucket -1 says that some set
    has too few segments; buckets below have the nodes of each batch in order, once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(start, PACK_ROWS) for whole in batches for start in range(0, whole.num_rows, PACK_ROWS)):
            ids = np.asarray(b.column("node").to_numpy(zero_copy_only=False), np.int64)
            pack, repeated, parts = pack_of(ids), np.ones(len(ids), bool), []
            repeated[np.unique(ids, return_index=True)[1]] = False
            for at, sets in _sets(b):
                n = np.where(repeated[at : at + len(sets)], 0, [len(s) for s in sets])
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                s, n = np.concatenate([sets[i] for i in full]), n[full]
                owner, band, cost = np.repeat(np.arange(len(full)), n), band_of(n), shared.value(s)
                for up, index in ((0, True), (1, False)):
                    sig, use, own, enough = signatures(s, owner, n, cost, band + up, finer, index)
                    if not enough:
                        yield _signed(-1, pack, b"", b"")
                    parts.append((sig, use, at + full[own]))
            if not parts:
                continue
            yield _signed(-2 - pack % buckets, pack, ids.tobytes(), b"")
            sig, use, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(cut[1:] > cut[:-1]):
                w = order[cut[k] : cut[k + 1]]
                yield _signed(int(k), pack, sig[w].astype(np.uint32).tobytes(), (owner[w].astype(np.uint16) << np.uint16(2) | use[w]).tobytes())

    return docs.mapInArrow(tidy(deal), "bucket int, pack long, sigs binary, uses binary")


def pack_of(ids: np.ndarray) -> int:
    """A batch's number, which follows from its nodes, so that a task that runs again gives the same; room is left for a row's place."""
    order = np.arange(1, 2 * len(ids), 2, dtype=np.uint64)
    return int(mix((mix(ids.view(np.uint64)) * order).sum(keepdims=True))[0]) >> (PLACE_BITS + 1)


def _signed(bucket: int, pack: int, sigs: bytes, uses: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([pack], pa.int64()), pa.array([sigs], pa.binary()), pa.array([uses], pa.binary())], ["bucket", "pack", "sigs", "uses"])


def _packed(bucket: int, *parts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], ["bucket", "ids", "sizes", "sigs", "uses"])


def _meet(table: pa.Table) -> pa.Table:
    """Of a bucket, all by place: kind 1 are pairs to be compared; 2 members (a) of a large group (b), n their use and the group's size; 3 places (a) and their nodes (b)."""
    bucket, packs = table["bucket"][0].as_py(), np.asarray(table["pack"].to_numpy(), np.int64) << PLACE_BITS
    if bucket == -1:
        return _pairs([(-1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))])
    if bucket < -1:
        held = dict(zip(packs.tolist(), arrays(table["sigs"], np.int64), strict=True))
        return _pairs([(3, p + np.arange(len(x)), x, np.zeros(len(x), np.int64)) for p, x in held.items()])
    sig, use, owner = [], [], []
    for i, (c, x) in enumerate(zip(arrays(table["sigs"], np.uint32), arrays(table["uses"], np.uint16), strict=True)):
        sig.append(c), use.append((x & 3).astype(np.uint8)), owner.append((x >> 2).astype(np.uint32) + np.uint32(i << PLACE_BITS))
    sig, use, owner = map(np.concatenate, (sig, use, owner))
    place_of = lambda own: packs[own >> np.uint32(PLACE_BITS)] + (own & np.uint32((1 << PLACE_BITS) - 1))
    order = np.argsort(sig, kind="stable")
    sig, use, owner = sig[order], use[order], owner[order]
    del order
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    counts = np.diff(np.concatenate((starts, [len(sig)])))
    live = (counts > 1) & (np.bitwise_or.reduceat(use, starts) == 3)
    if not live.any():
        return _pairs([])
    keep = np.repeat(live, counts)
    use, owner, counts = use[keep], owner[keep], counts[live]
    group = np.repeat(np.arange(len(counts)), counts)
    small = counts[group] <= SMALL_GROUP
    found: list[np.ndarray] = []
    for d in range(1, SMALL_GROUP):
        x = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        fits = (((use[x] & 1) & (use[x + d] >> 1)) | ((use[x + d] & 1) & (use[x] >> 1))).astype(bool)
        found.append(np.sort(np.stack((place_of(owner[x[fits]]), place_of(owner[x[fits] + d])), 1), axis=1))
    pairs = np.concatenate(found)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    out = [(1, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))]
    place = np.flatnonzero(~small)
    if len(place):
        # Groups with the same members are one group, in which a member has all its uses.
        mark = np.zeros(len(counts), np.uint64)
        np.add.at(mark, group[place], mix(place_of(owner[place]).view(np.uint64)))
        of, own, uses, many = mark[group[place]], owner[place], use[place], counts[group[place]]
        order = np.lexsort((own, of))
        of, own, uses, many = of[order], own[order], uses[order], many[order]
        first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (own[1:] != own[:-1]))))
        out.append((2, place_of(own[first]), of[first].view(np.int64), np.bitwise_or.reduceat(uses, first).astype(np.int64) | many[first] << 2))
    return _pairs(out)


def _pairs(parts: list[tuple]) -> pa.Table:
    cols = [np.concatenate([np.zeros(0, np.int64), *(np.full(len(p[1]), p[0]) if i == 0 else p[i] for p in parts)]) for i in range(4)]
    return pa.table([pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])], names=["kind", "a", "b", "n"])


def stars(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of each group's members with its centre, the member that meets most others over all groups."""
    met = checkpoint(groups.groupBy("node").agg(F.sum(F.shiftright("n", 2) - 1).alias("_met")))
    centres = checkpoint(bounded_join(groups, met, "node").groupBy("mark").agg(F.max_by("node", F.struct("_met", "node")).alias("_centre")))
    return bounded_join(groups, centres, "mark").where("node <> _centre").select(F.least("node", "_centre").alias("a"), F.greatest("node", "_centre").alias("b")).distinct()


def _compare(table: pa.Table) -> pa.Table:
    """Pairs (centre, member) whose sets link; a part's centre comes before its members."""
    nodes, centres, parts, roles = (np.asarray(table[k].to_numpy(), np.int64) for k in ("node", "centre", "part", "role"))
    order = np.lexsort((nodes, roles, parts, centres))
    texts = as_bytes(table["text"].combine_chunks())
    of, lead, a, b = (0, -1), np.zeros(0, np.uint64), [], []
    for at, run in chunks(texts[i] for i in order):
        for i, s in zip(order[at : at + len(run)], shingle_sets(run), strict=True):
            if not roles[i]:
                of, lead = (centres[i], parts[i]), s
            elif of == (centres[i], parts[i]) and len(lead) and len(s):
                at_lead = np.minimum(np.searchsorted(lead, s), len(lead) - 1)
                same = int((lead[at_lead] == s).sum())
                if 100 * same >= 75 * (len(lead) + len(s) - same):
                    a.append(centres[i]), b.append(nodes[i])
    return pa.table([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, a's text being compared with its partners' in split groups."""
    ranked = pairs.withColumn("_i", F.row_number().over(Window.partitionBy("a").orderBy("b"))).withColumn("part", F.floor((F.col("_i") - 1) / SPLIT).cast("int"))
    members = ranked.select(F.col("b").alias("node"), F.col("a").alias("centre"), "part", F.lit(1).alias("role"))
    leads = ranked.select(F.col("a").alias("node"), F.col("a").alias("centre"), "part", F.lit(0).alias("role")).distinct()
    sent = checkpoint(members.union(leads))
    rows = sent.count()
    bin_of = F.pmod(F.xxhash64("centre", "part"), F.lit(rows // TEXT_ROWS + 4))
    return bounded_join(docs.select("node", "text"), sent, "node", rows=rows).withColumn("bin", bin_of).groupBy("bin").applyInArrow(tidy(_compare), "a long, b long").distinct()


def sifted(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sets' sizes and sketches leave open; sketches are too wide for the driver to pass them on."""
    nodes = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    known = checkpoint(bounded_join(sizes, nodes, "node").select("node", "n_shingles", "sketch").dropDuplicates(["node"]))
    one = pairs.join(known.toDF("a", "na", "sa"), "a")
    kind = one.join(known.toDF("b", "nb", "sb"), "b").where("na > 0 and 4 * least(na, nb) >= 3 * greatest(na, nb)")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [may_link(*x) for x in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield b.select([0, 1]).filter(pa.array(left, pa.bool_()))

    return kind.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(tidy(sift), "a long, b long")


def open_pairs(component: np.ndarray, n: np.ndarray, use: np.ndarray, block: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Rows (i, j, cells' difference in thousandths of the sizes) of pairs in different components that sizes, uses and sketches leave open.

    Pairs of one block are left out if there are two.
    """
    two = (block != block[0]).any()
    cells = cells_of(sketches)
    out = []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        fits = (component[j] != component[i]) & (4 * np.minimum(n[j], n[i]) >= 3 * np.maximum(n[j], n[i])) & (((use[j] & 1) & (use[i] >> 1)) | ((use[i] & 1) & (use[j] >> 1))).astype(bool)
        j = j[fits & (block[j] != block[i])] if two else j[fits]
        if not len(j):
            continue
        differ = np.abs(cells[j] - cells[i]).sum(axis=1, dtype=np.int64)
        left = 7 * differ <= n[j] + n[i]
        j, differ = j[left], differ[left]
        if len(j):
            out.append(np.stack((np.full(len(j), i), j, 1000 * differ // (n[j] + n[i])), 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _close(forest: bool):
    """Open pairs of many blocks; as a forest, only those that join components, the most alike first."""

    def close(table: pa.Table) -> pa.Table:
        mark, lo, hi, block, node, component, n, use = (np.asarray(table[k].to_numpy(), np.int64) for k in ("mark", "lo", "hi", "block", "node", "component", "n_shingles", "use"))
        sketches = table["sketch"].to_pylist()
        order = np.lexsort((node, block, hi, lo, mark))
        new = np.zeros(len(order), bool)
        for x in (mark, lo, hi):
            new[1:] |= x[order][1:] != x[order][:-1]
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := top.get(c, c)) != c:
                top[c] = top.get(up, up)
                c = up
            return c

        out: list[np.ndarray] = []
        for w in np.split(order, np.flatnonzero(new)):
            if (component[w] == component[w[0]]).all():
                continue
            got = open_pairs(component[w], n[w], use[w], block[w], [sketches[i] for i in w])
            a, b = w[got[:, 0]], w[got[:, 1]]
            if forest:
                chosen = []
                for k in np.argsort(got[:, 2], kind="stable"):
                    x, y = root(int(component[a[k]])), root(int(component[b[k]]))
                    if x != y:
                        top[max(x, y)] = min(x, y)
                        chosen.append(k)
                a, b = a[chosen], b[chosen]
            out.append(np.sort(np.stack((node[a], node[b]), 1), axis=1))
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return close


def close_pairs(groups: DataFrame, sketches: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of groups (mark, node, component, use) that lie in different components and may link by their sketches (node, n_shingles, sketch)."""
    marks = groups.groupBy("mark").agg(F.count("*").alias("_n"), F.min("component").alias("_l"), F.max("component").alias("_m")).where("_l < _m")
    marks = checkpoint(marks.select("mark", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"), "_n"))
    rows = marks.agg(F.sum(F.col("_n") * F.col("_blocks"))).first()[0] or 0
    dealt = bounded_join(groups, marks, "mark").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    parts = dealt.select("mark", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", "node", "component", "use")
    sent = parts.join(sketches, "node")
    return sent.withColumn("bin", F.pmod(F.xxhash64("mark", "lo", "hi"), F.lit(rows // TASK_ROWS + 4))).groupBy("bin").applyInArrow(tidy(_close(forest)), "a long, b long").distinct()


def families(groups: DataFrame) -> DataFrame:
    """Groups (mark, node, component, use) with those made one that are mostly the same documents under many marks.

    A group's family is the least node that its members' groups, or theirs in turn, begin with; so each group is in one
    family as a whole. Where comparing all of a family's nodes once takes no more comparisons than comparing every
    group by itself, the family is one group: no pair is lost, and few are met under each of the marks that their
    documents share. All other groups stay as they are.
    """
    leads = checkpoint(groups.groupBy("mark").agg(F.min("node").alias("family")))
    for _ in range(2):
        near = checkpoint(bounded_join(groups, leads, "mark").groupBy("node").agg(F.min("family").alias("family")))
        leads = checkpoint(bounded_join(groups, near, "node").groupBy("mark").agg(F.min("family").alias("family")))
    placed = bounded_join(groups, leads, "mark")
    apart = placed.groupBy("family", "mark").agg(F.count("*").alias("n")).groupBy("family").agg(F.sum(F.col("n") * F.col("n")).alias("_apart"))
    nodes = placed.select("family", "node").distinct().groupBy("family").agg(F.count("*").alias("_n"))
    one = checkpoint(apart.join(nodes, "family").where("_n * _n <= _apart").select("family"))
    whole = bounded_join(placed, one, "family").groupBy(F.xxhash64("family").alias("mark"), "node").agg(F.max("component").alias("component"), F.lit(3).cast("long").alias("use"))
    found = checkpoint(bounded_join(placed, one, "family", "left_anti").select("mark", "node", "component", F.col("use").cast("long").alias("use")).unionByName(whole))
    let_go(groups.sparkSession)
    return found


def _spread(docs: DataFrame, nodes: DataFrame, buckets: int) -> DataFrame:
    """Per batch and bucket: the shingles of the nodes' texts with their nodes and components."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(start, PACK_ROWS) for whole in batches for start in range(0, whole.num_rows, PACK_ROWS)):
            ids, groups = (np.asarray(b.column(k).to_numpy(zero_copy_only=False), np.int64) for k in ("node", "component"))
            parts = [(np.concatenate(sets), np.repeat(np.arange(at, at + len(sets)), [len(x) for x in sets])) for at, sets in _sets(b)]
            if not parts:
                continue
            s, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = ((s >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(cut[1:] > cut[:-1]):
                w = order[cut[k] : cut[k + 1]]
                own, place = present(owner[w], len(ids))
                yield _packed(int(k), ids[own].tobytes(), groups[own].tobytes(), s[w].tobytes(), place.astype(np.uint32).tobytes())

    return bounded_join(docs.select("node", "text"), nodes, "node").mapInArrow(tidy(deal), "bucket int, ids binary, sizes binary, sigs binary, uses binary")


def _shared(table: pa.Table) -> pa.Table:
    """How many shingles of each node in this bucket also occur in another component."""
    ids, groups, s, owner, base = [], [], [], [], 0
    for a, b, c, d in zip(*(arrays(table[k], kind) for k, kind in (("ids", np.int64), ("sizes", np.int64), ("sigs", np.uint64), ("uses", np.uint32))), strict=True):
        ids.append(a), groups.append(b), s.append(c), owner.append(d + np.uint32(base))
        base += len(a)
    ids, groups, s, owner = map(np.concatenate, (ids, groups, s, owner))
    order = np.argsort(s, kind="stable")
    s, owner = s[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    of = groups[owner]
    several = np.repeat(np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first), np.diff(np.concatenate((first, [len(s)]))))
    n = np.bincount(owner[several], minlength=len(ids))
    return pa.table([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["node", "n"])


def able(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes (node, component, n_shingles) that can have a link to another component of these."""
    now = nodes
    while True:
        rows, shingles = now.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
        buckets = shingles // BUCKET_SHINGLES + 4
        found = _spread(docs, now.select("node", "component"), buckets).groupBy("bucket").applyInArrow(tidy(_shared), "node long, n long").groupBy("node").agg(F.sum("n").alias("_n"))
        left = checkpoint(now.join(found, "node").where("4 * _n >= 3 * n_shingles").drop("_n"))
        if left.count() >= 0.9 * rows:
            return left
        now = left


def by_node(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What met by place, by node: pairs (a, b), and groups (node, mark, n), each once however many buckets it met in."""
    places = met.where("kind = 3")
    at = lambda place, node: places.select(F.col("a").alias(place), F.col("b").alias(node))
    pairs = checkpoint(met.where("kind = 1").select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct())
    near = bounded_join(bounded_join(pairs, at("_a", "x"), "_a"), at("_b", "y"), "_b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    members = bounded_join(met.where("kind = 2").select(F.col("a").alias("place"), F.col("b").alias("mark"), "n"), at("place", "node"), "place")
    return near, members.groupBy("node", "mark").agg(F.max(F.shiftright("n", 2)).alias("_many"), F.bit_or(F.col("n") % 4).alias("_use")).select("node", "mark", (F.col("_many") * 4 + F.col("_use")).alias("n"))


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, node, n_shingles of all rows and components (node, component) of the linked nodes."""
    docs = keyed(docs).withColumn("node", F.xxhash64("doc_id", "text_hash"))
    sizes = checkpoint(set_sizes(docs))
    twins = checkpoint(equal_sets(sizes))
    found = _linked(without(docs, sizes, twins.select(F.col("b").alias("node"))), sizes.drop("set_hash"), sizes.count() - twins.count())
    return sizes.drop("sketch", "set_hash"), found.union(bounded_join(twins.toDF("node", "twin"), found, "node", "left").select(F.col("twin").alias("node"), F.coalesce("component", "node").alias("component")))


def _linked(docs: DataFrame, sizes: DataFrame, rows: int) -> DataFrame:
    """Components (node, component) of the linked nodes of about so many documents, of which no two have equal sets."""
    frequent, buckets, finer = frequent_shingles(docs, rows), n_buckets(docs, mb=BUCKET_MB), 1.0
    while True:
        met = checkpoint(_dealt(docs, buckets, finer, frequent).groupBy("bucket").applyInArrow(tidy(_meet), "kind int, a long, b long, n long"))
        if met.where("kind = -1").isEmpty():
            break
        finer *= 2
    let_go(docs.sparkSession)  # the signatures' exchange is over
    near, groups = map(checkpoint, by_node(met))
    candidates = checkpoint(near.union(stars(groups)).distinct())
    links = checkpoint(verified(docs, checkpoint(sifted(candidates, sizes))))
    found = components(links)
    placed = bounded_join(groups, found, "node", "left").select("node", "mark", (F.col("n") % 4).alias("use"), F.coalesce("component", "node").alias("component"))
    split = checkpoint(placed.groupBy("mark").agg(F.min("component").alias("_l"), F.max("component").alias("_m")).where("_l < _m").select("mark"))
    in_split = checkpoint(bounded_join(placed, split, "mark"))
    if in_split.isEmpty():
        return found
    nodes = checkpoint(bounded_join(sizes, checkpoint(in_split.select("node", "component").distinct()), "node").select("node", "component", "n_shingles", "sketch").dropDuplicates(["node"]))
    left = able(docs, nodes.drop("sketch")).select("node")
    sketches = checkpoint(bounded_join(nodes, left, "node").select("node", "n_shingles", "sketch"))
    open_groups = families(checkpoint(bounded_join(in_split, left, "node")))
    for forest in (True, False):
        rest = checkpoint(close_pairs(open_groups, sketches, forest).join(candidates, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            continue
        candidates = candidates.union(rest)
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verified(docs, rest)))
        open_groups = bounded_join(open_groups.drop("component"), found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return found


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, text_hash, and whether it is the first (doc_id, text_hash) of its component."""
    sizes, found = link(docs)
    found = checkpoint(found.union(found.select(F.col("component").alias("node"), "component").distinct()))
    linked = checkpoint(bounded_join(sizes, found, "node"))
    least = linked.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    labels = checkpoint(found.join(least, "component").select("node", "least"))
    first = F.col("least").isNull() | (F.col("least") == F.struct("doc_id", "text_hash"))
    return bounded_join(sizes, labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"), "text_hash", first.alias("is_first"))
