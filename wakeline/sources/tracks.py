"""Readers: position reports of the driver's tables, import files, labelled readings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMPORT_COLUMNS = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading"]


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as position reports; `signup` stands for a historical one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        u.alias("mmsi"),
        "event_id",
        F.col("ts").alias("received_at"),
        (F.col("value") / 20).alias("sog"),
        F.col("event_type").alias("message_type"),
        (F.lit(51) + (u % 10) * F.lit(0.01) + (i % 97) * F.lit(0.001)).alias("lat"),
        (F.lit(4) + (i % 89) * F.lit(0.001)).alias("lon"),
        (i * 37 % 360).cast("double").alias("cog"),
        F.when(i % 7 != 0, i * 11 % 360).alias("heading"),
        "props",
    )


def live(df: DataFrame, historical: str = "signup") -> DataFrame:
    return df.where(~F.col("message_type").eqNullSafe(historical))


def import_csv(spark: SparkSession, path: str) -> DataFrame:
    """Position files: every column read as text, then cast; text that is no number gives null."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if missing := [c for c in IMPORT_COLUMNS if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    whole = lambda c: F.when(number(c) == F.floor(number(c)), number(c).cast("long"))
    return raw.select(
        whole("MMSI").alias("mmsi"), F.expr("try_cast(BaseDateTime as timestamp_ntz)").alias("received_at"), number("LAT").alias("lat"), number("LON").alias("lon"), number("SOG").alias("sog"), number("COG").alias("cog"), whole("Heading").alias("heading")
    ).where("mmsi is not null and received_at is not null and lat is not null and lon is not null")


def as_historical(imported: DataFrame) -> DataFrame:
    """Imported rows in the shape of stored positions: marked historical, without what such files don't tell."""
    none = lambda kind: F.lit(None).cast(kind)
    return imported.select("mmsi", "received_at", "lat", "lon", "sog", "cog", "heading", none("double").alias("rate_of_turn"), F.lit("historical").alias("message_type"))


def box_scan(positions: DataFrame, start: str, end: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """Reports of a half-open range of times inside a closed box; of a table by `event_date` only the range's days are read."""
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    inside = positions.where((F.col("received_at") >= first) & (F.col("received_at") < last) & F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return inside.where(F.col("event_date").between(F.to_date(first), F.to_date(last))) if "event_date" in positions.columns else inside
