"""Each stage of the pipeline on odd tables: nulls, repeated rows, ties, empty tables, clashing columns, very long texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES

EN = "the house and the garden of the man who was not there when we came to see him in the evening of that day"
OTHER = "le chat est dans la maison et il ne veut pas sortir de son lit parce que dehors il fait trop froid pour lui ce soir"
CLASH = ["text_hash", "kept", "along", "spans", "node", "bucket", "lang_pred", "n_removed", "_text", "piece", "length", "component", "start"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def table(spark, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH)).repartition(3)


ROWS = [(i, f"{EN} {i} {OTHER if i % 2 else EN} number {i}", "en" if i % 3 else None, "a") for i in range(12)]
ROWS += [(100, EN, "en", "a"), (100, EN, "en", "a"), (101, EN, "en", None), (100, OTHER, "fr", "b"), (102, None, "en", "a"), (103, "", None, None), (104, "?? 12", "en", "a")]
ROWS += [(105, "a leak: one two three four five six seven eight nine ten here", "en", "a"), (106, "word " * 50_000, "en", "a")]


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in STAGES])
def test_empty_tables_and_shapes(spark, sf, name):
    out = dict(STAGES)[name](spark, table(spark, ROWS).limit(0), sf)
    assert out.count() == 0
    if name != "packing":
        assert out.columns == COLUMNS


@pytest.mark.parametrize("name", [n for n, _ in STAGES])
def test_the_setting_of_the_session_stays(spark, sf, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    dict(STAGES)[name](spark, table(spark, ROWS[:15]), sf).count()
    assert spark.conf.get(key) == was


def test_language(spark, sf):
    got = rows_of(corpus_pipeline.language(spark, table(spark, ROWS), sf))
    gone = {102, 103, 104}
    assert [(r[0], r[1]) for r in got] == sorted(((r[0], r[1]) for r in ROWS if r[0] not in gone), key=lambda r: repr((r[0], r[1])))
    assert all(r[2] for r in got)
    assert {r[2] for r in got if r[0] == 100} == {"en", "fr"}


def test_near_duplicates(spark, sf):
    got = corpus_pipeline.near_duplicates(spark, table(spark, ROWS), sf)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert kept.count((100, EN)) == 2  # rows that repeat both are one document
    assert (101, EN) not in kept and (100, OTHER) in kept
    assert {(102, None), (103, "")} <= set(kept)


def test_repeated_passages(spark, sf):
    got = {}
    for r in corpus_pipeline.repeated_passages(spark, table(spark, ROWS), sf).collect():
        got.setdefault((r.doc_id, r.source), []).append((r.text, r.n_chars))
    assert got[102, "a"] == [(None, 0)] and got[103, None] == [("", 0)] and got[104, "a"] == [("?? 12", 5)]
    assert got[0, "a"][0][0].startswith(EN) and len(got[2, "a"][0][0]) < len(EN)
    assert all(n == len(t or "") for rows in got.values() for t, n in rows)
    assert got[106, "a"][0][1] < 250_000 and len(got[100, "a"]) == 2


def test_benchmark_leaks(spark, sf):
    got = rows_of(corpus_pipeline.benchmark_leaks(spark, table(spark, ROWS), sf))
    assert got == sorted(((*r, len(r[1] or "")) for r in ROWS if r[0] != 105), key=repr)


def test_packing(spark, sf):
    pieces = corpus_pipeline.packing(spark, table(spark, ROWS), sf)
    n = {r.doc_id: r["count"] for r in pieces.where("piece = 0").groupBy("doc_id").count().collect()}
    assert n == {i: sum(r[0] == i for r in ROWS) for i in {r[0] for r in ROWS}}
    fill = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= corpus_pipeline.CAPACITY for r in fill)
