"""Zones as GeoJSON text: one row for each feature, with the first rule that it breaks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the file format.
PROPERTIES = "name string, source_name string, source_url string, source_date string, confidence double, first_seen string, last_seen string, notes string"
RINGS = "array<array<array<double>>>"


def _day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def parse_zones(documents: DataFrame, column: str = "document") -> DataFrame:
    """name, source_url, confidence, dates, polygons (arrays of rings of [lon, lat]) and `problem`, null where a feature is sound."""
    features = documents.select(F.explode(F.from_json(F.get_json_object(column, "$.features"), "array<string>")).alias("_f"))
    props = F.from_json(F.get_json_object("_f", "$.properties"), PROPERTIES)
    kind, shape = F.get_json_object("_f", "$.geometry.type"), F.get_json_object("_f", "$.geometry.coordinates")
    z = features.select(props.alias("_p"), kind.alias("_kind"), F.when(kind == "Polygon", F.array(F.from_json(shape, RINGS))).when(kind == "MultiPolygon", F.from_json(shape, f"array<{RINGS}>")).alias("polygons"))
    z = z.select("_p.*", "_kind", "polygons").withColumns({"name": F.trim("name"), "source_url": F.trim("source_url"), "_first": _day(F.col("first_seen")), "_last": _day(F.col("last_seen")), "_date": _day(F.col("source_date"))})
    rings = F.flatten("polygons")
    open_or_short = F.exists(rings, lambda r: (F.size(r) < 4) | ~F.get(r, F.lit(0)).eqNullSafe(F.get(r, F.size(r) - 1)))
    outside = F.exists(rings, lambda r: F.exists(r, lambda p: F.coalesce((F.abs(F.get(p, F.lit(0))) > 180) | (F.abs(F.get(p, F.lit(1))) > 90), F.lit(True))))
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(True))
    tests = {
        "name": empty("name"),
        "source_url": no(~F.col("source_url").rlike(r"^https?://\S+$")),
        "confidence": no(~F.col("confidence").between(0, 1)),
        "dates": (F.col("first_seen").isNotNull() & F.col("_first").isNull()) | (F.col("last_seen").isNotNull() & F.col("_last").isNull()) | F.coalesce(F.col("_last") < F.col("_first"), F.lit(False)),
        "source_name": empty("source_name"),
        "source_date": F.col("_date").isNull(),
        "geometry": F.col("polygons").isNull() | (F.size("polygons") == 0) | no(F.exists("polygons", lambda p: F.size(p) < 1)),
        "ring": no(open_or_short),
        "position": no(outside),
    }
    problem = F.coalesce(*(F.when(t, k) for k, t in tests.items()))
    return z.withColumn("problem", problem).select("name", "source_name", "source_url", "confidence", "notes", F.col("_first").alias("first_seen"), F.col("_last").alias("last_seen"), F.col("_date").alias("source_date"), "polygons", "problem")


def sound_zones(zones: DataFrame) -> DataFrame:
    """The zones of a file, or an error when one is unsound or a key comes twice: nothing of such a file is loaded."""
    bad = zones.where("problem is not null").select(F.concat_ws(": ", F.coalesce("name", F.lit("?")), "problem").alias("p"))
    twice = zones.groupBy("name", "source_url").count().where("count > 1").select(F.concat_ws(": ", "name", F.lit("twice")).alias("p"))
    if found := bad.union(twice).limit(5).collect():
        raise ValueError("; ".join(r.p for r in found))
    return zones.drop("problem")
