"""Files in and out: labelled readings, JSON lines, splits, shards, reports and the archive of a stream.

Every sink can be run again: parts are written over, or rows that are there already are left out.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

READINGS = ["SOG", "COG", "Heading", "speed_calc", "acceleration", "delta_heading", "prediction_error"]


def labelled_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings labelled Normal or Spoofed, all others left out; blanks are null, a place that is no number stops the read."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    text = lambda c: F.trim(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    number = lambda c: F.nullif(text(c), F.lit("")).try_cast("double")
    label = text("Label")
    return raw.where(label.isin("Normal", "Spoofed")).select(
        text("MMSI").alias("mmsi"), text("BaseDateTime").alias("said_at"), text("LAT").cast("double").alias("lat"), text("LON").cast("double").alias("lon"), *(number(c).alias(c.lower()) for c in READINGS), (label == "Spoofed").alias("spoofed")
    )


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are passed over, and one that is no JSON stops the read with its file, line number and text."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    read = lines.withColumn("_r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = read.where("_r is null or _r._bad is not null").select("file", "value").first()
    if bad:
        raise ValueError(f"{bad.file}:{_line_of(spark, bad.file, bad.value)}: not valid JSON: {bad.value[:200]}")
    return read.select("_r.*").drop("_bad")


def _line_of(spark: SparkSession, file: str, line: str) -> int | str:
    """The number of the first such line of one file, which is read as a whole; only a failed read asks."""
    each = spark.read.text(file, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "value"))
    found = each.where(F.col("value") == line).agg(F.min("i")).first()[0]
    return "?" if found is None else found + 1


def read_labels(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """id and label of each id once; missing, unknown and conflicting labels stop the read."""
    rows = read_lines(spark, path, "id string, label string")
    if (r := rows.where("id is null or label is null").first()) is not None:
        raise ValueError(f"a row needs id and label: {r}")
    if (r := rows.where(~F.col("label").isin(known)).first()) is not None:
        raise ValueError(f"unknown label: {r}")
    each = rows.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    if (r := each.where("label <> _other").first()) is not None:
        raise ValueError(f"conflicting labels: {r.id}")
    return each.drop("_other")


def write_splits(rows: DataFrame, folder: str) -> DataFrame:
    """Rows as JSON lines by `split`, with a manifest of rows and vessels of each, which is returned."""
    rows.write.mode("overwrite").partitionBy("split").json(f"{folder}/rows")
    manifest = rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("mmsi").alias("vessels"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return rows.sparkSession.read.schema(manifest.schema).json(f"{folder}/manifest")


def append_new(rows: DataFrame, folder: str, keys: list[str], time: str = "received_at") -> None:
    """Appends rows whose key the folder lacks, by day; of the folder only the days of the new rows are read."""
    spark = rows.sparkSession
    dated = rows.dropDuplicates(keys).withColumn("event_date", F.to_date(time))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        held = spark.read.schema(dated.schema).parquet(folder).select("event_date", *keys)
        dated = dated.join(held, ["event_date", *keys], "left_anti")
    dated.repartition("event_date", F.pmod(F.xxhash64(*keys), F.lit(8))).write.mode("append").partitionBy("event_date").parquet(folder)


def with_row_id(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds `id`, which follows from the keys, so that a row that is written again has the same one."""
    return rows.withColumn("id", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), 256))


def dataset_checks(rows: DataFrame, labels: list[str], few: int = 50) -> DataFrame:
    """split, label, n, few (fewer than wanted) of every split and label, those without rows too; a vessel in two splits stops the read."""
    both = rows.groupBy("mmsi").agg(F.count_distinct("split").alias("n")).where("n > 1").orderBy("mmsi").limit(5).collect()
    if both:
        raise ValueError(f"vessels in more than one split: {[r.mmsi for r in both]}")
    grid = rows.select("split").distinct().select("split", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    n = rows.groupBy("split", "label").agg(F.count("*").alias("n"))
    return grid.join(n, ["split", "label"], "left").select("split", "label", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < few).alias("few"))


def batches(spark: SparkSession, folder: str, size: int, seed: int | None = None, *keys: str) -> Iterator[list[Row]]:
    """Rows of a folder's shards in lists of ``size`` (the last may be shorter), in the order of the seed if one is given; a partition at a time comes to the driver."""
    rows = spark.read.parquet(folder)
    held: list[Row] = []
    for row in (rows if seed is None else shuffled(rows, seed, *keys)).toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def write_report(report: DataFrame, folder: str, name: str) -> None:
    """A report of one row as JSON with its nulls, written over when it is made again."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")


def write_shards(rows: DataFrame, folder: str, most: int = 2048) -> None:
    """Parquet shards of at most ``most`` rows, by split."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", most).partitionBy("split").parquet(folder)


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in an order that follows from the seed and the keys, the same however they are partitioned."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def read_reports(spark: SparkSession, folder: str, schema: str, needed: str) -> DataFrame:
    """JSON reports, one to a file; files that can't be read or lack ``needed`` are passed over."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(schema).json(folder).where(F.col(needed).isNotNull())


def archive(envelopes: DataFrame, at: Column, folder: str, checkpoints: str) -> DataStreamWriter:
    """Every envelope of a stream as a line of text by day, the ignored ones too; can be read again as a stream."""
    lines = envelopes.select(F.col("envelope").alias("value"), F.date_format(at, "yyyy-MM-dd").alias("day"))
    return lines.writeStream.format("text").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoints)
