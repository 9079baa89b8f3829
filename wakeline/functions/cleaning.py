"""Values that stand for nothing become null; rows that can't be placed get a reason."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_speed(c: Column) -> Column:
    return F.when(~F.isnan(c) & (c >= 0) & (c < 102.3), c)


def known_course(c: Column) -> Column:
    return F.when(~F.isnan(c) & (c >= 0) & (c < 360), c)


def known_heading(c: Column) -> Column:
    return F.when((c >= 0) & (c <= 359), c)


def trimmed(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def placed(lat: Column, lon: Column) -> Column:
    """Whether a place is finite and on the globe; null counts as not."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def drop_reason(df: DataFrame) -> DataFrame:
    """Adds `reason`: the first of bad_mmsi, bad_timestamp, invalid_flag, invalid_coordinate, else null."""
    return df.withColumn(
        "reason",
        F.when(F.col("mmsi").isNull(), "bad_mmsi")
        .when(F.col("received_at").isNull(), "bad_timestamp")
        .when(~F.coalesce("valid", F.lit(True)), "invalid_flag")
        .when(~placed(F.col("lat"), F.col("lon")), "invalid_coordinate"),
    )


def normalize(df: DataFrame) -> DataFrame:
    """Rows without a drop reason, their unknown motion values null."""
    clean = drop_reason(df).where("reason is null").drop("reason")
    return clean.withColumns({"sog": known_speed(F.col("sog")), "cog": known_course(F.col("cog")), "heading": known_heading(F.col("heading"))})


def not_told(c: Column) -> Column:
    """null in place of -1, which stands for a value that was not told."""
    return F.nullif(c, F.lit(-1).cast("double"))


def as_time(text: Column) -> Column:
    """A time from ISO text, with or without a zone (then UTC); null for any other text."""
    return F.call_function("try_to_timestamp", F.when(text.rlike(r"([+-]\d{2}:?\d{2}|Z)$"), text).otherwise(F.concat(text, F.lit("Z"))))
