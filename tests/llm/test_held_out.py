"""Held-out accuracy of op1 and discrimination of op6, over the whole small documents table."""

from pyspark.sql import functions as F

from wakeline.llm import queries

SF_DIR = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    got = queries.op1_language_mixture(spark, SF_DIR)
    assert got.count() == docs.count()
    n, right = got.where("held_out").join(docs.where("lang is not null"), "doc_id").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100
    assert right >= 0.98 * n


def test_fingerprints_tell_edited_from_next(spark):
    got = queries.op6_fingerprints(spark, SF_DIR).where("n_chars >= 200")
    edited, following = got.agg(F.percentile("near_edited", 0.05), F.percentile("near_next", 0.95)).first()
    assert edited > 2 * following
