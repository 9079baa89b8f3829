"""Feed envelopes (JSON text) as records: the first spelling that is present, typed, or the reason why a message is dropped."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.cleaning import known_course, known_heading, known_speed, placed, trimmed

# Fixed values of the feed.
POSITION_TYPES = ["PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport"]
STATIC_TYPES = ["ShipStaticData"]
TIME_UTC = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(\.\d{1,6})?\d* \+0000 UTC$"


def time_utc(c: Column) -> Column:
    """`2024-01-01 00:00:00[.digits] +0000 UTC` in microseconds, further digits cut off; null for any other text."""
    said = F.trim(c)
    text = F.concat(F.regexp_extract(said, TIME_UTC, 1), F.regexp_extract(said, TIME_UTC, 2))
    return F.when(said.rlike(TIME_UTC), F.call_function("try_to_timestamp", F.concat(text, F.lit("+00:00"))))


def first_present(c: Column, *paths: str) -> Column:
    return F.coalesce(*(F.get_json_object(c, p) for p in paths))


def from_envelopes(df: DataFrame, column: str = "envelope", now: Column | None = None) -> DataFrame:
    """Adds kind (position, static, dropped, ignored), reason and the record's fields; a missing time is ``now``.

    Other message types, and messages without an identity or a place, are ignored; what can't be read is dropped with a reason.
    """
    c = F.col(column)
    df = df.withColumn("message_type", F.get_json_object(c, "$.MessageType"))
    body = lambda name: F.coalesce(*(F.when(F.col("message_type") == t, F.get_json_object(c, f"$.Message.{t}.{name}")) for t in POSITION_TYPES + STATIC_TYPES))
    number = lambda text: text.try_cast("double")
    raw_time = F.nullif(first_present(c, "$.MetaData.time_utc", "$.MetaData.TimeUtc"), F.lit(""))
    df = df.withColumns(
        {
            "_mmsi": first_present(c, "$.MetaData.MMSI", "$.MetaData.mmsi"),
            "_time": raw_time,
            "_lat": F.coalesce(first_present(c, "$.MetaData.Latitude", "$.MetaData.latitude"), body("Latitude")),
            "_lon": F.coalesce(first_present(c, "$.MetaData.Longitude", "$.MetaData.longitude"), body("Longitude")),
            "ship_name": trimmed(first_present(c, "$.MetaData.ShipName", "$.MetaData.shipname")),
        }
    ).withColumns({"mmsi": F.trim("_mmsi").try_cast("long"), "received_at": F.when(F.col("_time").isNull(), now or F.current_timestamp()).otherwise(time_utc(F.col("_time"))), "lat": number(F.col("_lat")), "lon": number(F.col("_lon"))})
    static = F.col("message_type").isin(STATIC_TYPES)
    unknown = ~F.coalesce(F.col("message_type").isin(POSITION_TYPES + STATIC_TYPES), F.lit(False)) | F.col("_mmsi").isNull()
    reason = (
        F.when(unknown, None)
        .when(F.col("mmsi").isNull(), "bad_mmsi")
        .when(F.col("received_at").isNull(), "bad_timestamp")
        .when(static | F.col("_lat").isNull() | F.col("_lon").isNull(), None)
        .when(body("Valid") == "false", "invalid_flag")
        .when(~placed(F.col("lat"), F.col("lon")), "invalid_coordinate")
    )
    df = df.withColumn("reason", reason)
    kind = F.when(unknown, "ignored").when(F.col("reason").isNotNull(), "dropped").when(static, "static").when(F.col("_lat").isNull() | F.col("_lon").isNull(), "ignored").otherwise("position")
    return df.withColumns(
        {
            "kind": kind,
            "sog": known_speed(number(body("Sog"))),
            "cog": known_course(number(body("Cog"))),
            "heading": known_heading(number(body("TrueHeading")).cast("long")),
            "rate_of_turn": number(body("RateOfTurn")),
            "ship_type": body("Type").try_cast("long"),
            "call_sign": F.nullif(body("CallSign"), F.lit("")),
            "destination": trimmed(body("Destination")),
        }
    ).drop("_mmsi", "_time", "_lat", "_lon")
