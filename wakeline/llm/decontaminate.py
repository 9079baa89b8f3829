"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Test texts are cut into windows of 10 words (a shorter text is one window). The corpus frequency of
every test term is counted; each window is looked up by its two rarest terms. Postings (document,
position) of these terms are stored; the lists of a window's terms, adjusted by their offsets in the
window, are intersected by an equi-join, and the words stored around the rarest term's posting decide
the exact match. Windows that hold a term the corpus lacks are dropped: they can't occur. A window is near
a place where all its words stand, in any order, within as many words as it has and SLOP more; such a
stretch holds the rarest term too, so that the words around its postings decide that as well.

Null texts have no words and no hits. Rows that repeat a doc_id and text share one result; a repeated
item_id counts once. Without test texts nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import BROADCAST_ROWS, checkpoint
from wakeline.llm.url_graph import ascii_lower

WINDOW = 10
#: Words more than a window's own in which a near match has to find them all.
SLOP = 5
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def _small(df: DataFrame) -> DataFrame:
    """Marks a table for broadcast if its counted rows are few; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window_id, words: the distinct windows of each item."""
    cut = items.select("item_id", word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    spans = cut.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda i: F.slice("w", i + 1, size))).alias("words"))
    return spans.distinct().withColumn("window_id", F.sha2(F.array_join("words", " "), 256))


def postings(docs: DataFrame, windows: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """Windows with their two rarest terms and these terms' places in them; and the index of these terms.

    The index has term, doc_id, text_hash, pos and, for terms that are some window's rarest, the words less than ``reach`` around it (from `from`).
    """
    unique = checkpoint(windows.select("window_id", "words").dropDuplicates(["window_id"]))
    terms = checkpoint(unique.select(F.explode("words").alias("term")).distinct())
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), word_list(F.col("text")).alias("w"))
    frequency = checkpoint(texts.select(F.explode("w").alias("term")).join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("n")))
    placed = unique.select("window_id", F.size("words").alias("size"), F.posexplode("words").alias("place", "term")).join(frequency, "term")
    rank = Window.partitionBy("window_id").orderBy("n", "term", "place")
    rare = (
        placed.withColumn("rank", F.row_number().over(rank))
        .groupBy("window_id", "size")
        .agg(F.count("*").alias("known"), *(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("term", "place")))
        .where("known = size")
    )
    lookup = checkpoint(rare.join(unique, "window_id").select("window_id", "size", "words", "term1", "place1", F.coalesce("term2", "term1").alias("term2"), F.coalesce("place2", "place1").alias("place2")))
    first = lookup.select(F.col("term1").alias("term")).distinct().withColumn("leads", F.lit(True))
    wanted = lookup.select(F.col("term2").alias("term")).union(first.select("term")).distinct().join(first, "term", "left")
    index = checkpoint(
        texts.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "term"))
        .join(_small(wanted), "term")
        .select("term", "doc_id", "text_hash", "pos", F.greatest(F.col("pos") - reach + 1, F.lit(0)).alias("from"), F.when(F.col("leads"), F.slice("w", F.greatest(F.col("pos") - reach + 2, F.lit(1)), 2 * reach - 1)).alias("around"))
    )
    return lookup, index


def exact_hits(lookup: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, text_hash, window_id, start, stop (word positions, stop excluded) of every occurrence of a window."""
    around = F.col("around")
    lead = index.where("around is not null").join(_small(lookup), F.col("term") == F.col("term1"))
    leading = lead.withColumn("start", F.col("pos") - F.col("place1")).where("start >= 0").select("doc_id", "text_hash", "window_id", "start", "size", "words", "around", "from")
    second = index.join(_small(lookup.select("window_id", "term2", "place2")), F.col("term") == F.col("term2")).select("doc_id", "text_hash", "window_id", (F.col("pos") - F.col("place2")).alias("start")).distinct()
    both = leading.join(second, ["doc_id", "text_hash", "window_id", "start"])
    exact = F.slice(around, F.col("start") - F.col("from") + 1, F.col("size")) == F.col("words")
    return both.where(exact).select("doc_id", "text_hash", "window_id", "start", (F.col("start") + F.col("size")).alias("stop")).distinct()


def near_hits(lookup: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """doc_id, text_hash, window_id of every window all of whose words stand within its size and ``slop`` more words of a document."""
    lead = index.where("around is not null").join(_small(lookup), F.col("term") == F.col("term1"))
    holds = lambda words: F.size(F.array_except("words", words)) == 0
    wide, at = F.col("size") + slop, F.col("pos") - F.col("from")
    starts = F.sequence(F.greatest(at - wide + 1, F.lit(0)), at)
    close = lead.where(holds(F.col("around"))).where(F.exists(starts, lambda s: holds(F.slice("around", s + 1, wide))))
    return close.select("doc_id", "text_hash", "window_id").distinct()


def _items_of(hits: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """doc_id, text_hash and the sorted item ids whose windows hit."""
    each = hits.select("doc_id", "text_hash", "window_id").distinct().join(windows.select("item_id", "window_id"), "window_id").select("doc_id", "text_hash", "item_id").distinct()
    return each.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias(name))


def contamination(docs: DataFrame, items: DataFrame, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and text_hash of every row; with ``slop``, also n_near_items and near_items_sha256."""
    windows = checkpoint(test_windows(items))
    lookup, index = postings(docs, windows, WINDOW + (slop or 0))
    hits = checkpoint(exact_hits(lookup, index))
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("doc_id", "text_hash", "start").agg(F.max("stop").alias("stop"))
    covered = spans.withColumn("_reached", F.coalesce(F.max("stop").over(before), F.lit(0))).groupBy("doc_id", "text_hash").agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", "_reached"), F.lit(0))).alias("n_hit"))
    found = covered.join(_items_of(hits, windows, "items"), ["doc_id", "text_hash"])
    if slop is not None:
        found = found.join(_items_of(near_hits(lookup, index, slop), windows, "near"), ["doc_id", "text_hash"], "full")
    every = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    named = lambda c, n, digest: [F.size(F.coalesce(c, none)).cast("long").alias(n), F.sha2(F.array_join(F.coalesce(c, none), ","), 256).alias(digest)]
    return every.join(found, ["doc_id", "text_hash"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        *named("items", "n_items", "items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *(named("near", "n_near_items", "near_items_sha256") if slop is not None else ()),
        "text_hash",
    )
