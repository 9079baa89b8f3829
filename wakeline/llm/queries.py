"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.centroids import cluster
from wakeline.llm.common import documents, held_out
from wakeline.llm.decontaminate import SLOP, contamination
from wakeline.llm.fingerprints import fingerprints
from wakeline.llm.html_text import extract
from wakeline.llm.jaccard_join import jaccard_components
from wakeline.llm.katz import katz_scores
from wakeline.llm.language_id import identify
from wakeline.llm.oracle import SQL
from wakeline.llm.packing import pack
from wakeline.llm.repeats import remove_repeats
from wakeline.llm.resampling import resample
from wakeline.llm.sharding import feistel_shards
from wakeline.llm.topk import exact_top_k
from wakeline.llm.url_graph import judge

CAPACITY = 2048


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, ~held_out(4, 2)).withColumn("held_out", held_out(4, 2))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).drop("text_hash", "is_first")


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op7_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir), ~held_out(7, 2)).withColumn("held_out", held_out(7, 2))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept", "text_hash")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), SLOP).drop("text_hash")


def op11_uniform_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_hamerly_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_mixture, op2_best_fit_packing, op3_html_extraction, op4_ngram_jaccard_join, op5_feistel_sharding, op6_fingerprints, op7_url_graph, op8_katz_backoff, op9_suffix_array_dedup, op10_decontamination, op11_uniform_threshold_top_k, op12_importance_resampling, op13_hamerly_clustering)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
