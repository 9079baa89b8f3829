"""A corpus in five stages: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. run() writes every stage's result as Parquet in the shared folder and
reads it again, so that a lost executor costs a stage's tasks only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import KEYS, bounded_join, checkpoint, ensure_checkpoint_dir
from wakeline.llm.decontaminate import contamination
from wakeline.llm.jaccard_join import jaccard_components
from wakeline.llm.language_id import identify
from wakeline.llm.packing import pack
from wakeline.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CAPACITY, PASSAGE_BYTES = 2048, 100
#: Rows of whole texts that go to a Python worker at once.
BATCH_ROWS = 2000


def named(docs: DataFrame) -> DataFrame:
    """The columns of documents (others are dropped), and text_hash.

    Rows that repeat doc_id and text are one document and share its fate; rows that repeat a doc_id alone are not.
    """
    return docs.select(*(F.col(c).cast("long").alias(c) if c == "doc_id" else c for c in COLUMNS), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_ROWS for what runs inside; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that could be named, and names it where lang is null; null and letterless texts go."""
    own = named(docs)
    with small_batches(spark):
        found = checkpoint(identify(docs, F.lit(True)).where("lang_pred <> 'und'").select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "lang_pred").dropDuplicates(KEYS))
    return bounded_join(own, found, KEYS).select(*(F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else c for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id (then text hash) of each group of linked documents; documents without words have no group and stay."""
    own = named(docs)
    with small_batches(spark):
        dropped = checkpoint(jaccard_components(docs).where("not is_first").select(*KEYS).distinct())
    return bounded_join(own, dropped, KEYS, "left_anti").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that occurred before; bytes that no longer make a character go with them; a document left empty stays as an empty text."""
    with small_batches(spark):
        kept = remove_repeats(docs, PASSAGE_BYTES, as_text=True, along=F.struct("lang", "source", "n_chars", F.isnull("text").alias("none")))
    changed = F.col("n_removed") > 0
    text = F.when(changed | ~F.col("along.none"), F.col("kept"))
    return kept.select("doc_id", text.alias("text"), F.col("along.lang").alias("lang"), F.col("along.source").alias("source"), F.when(changed, F.length("kept")).otherwise(F.col("along.n_chars")).alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a test text; null texts hold none and stay."""
    hit = checkpoint(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash").distinct())
    return bounded_join(named(docs), hit, KEYS, "left_anti").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row's text, with its sequence and place there."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packing", packing)]
#: EM, sketches and greedy matching have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
