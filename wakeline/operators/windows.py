"""Windows of a fixed number of reports for each vessel, and what is derived along them."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wakeline.functions.cleaning import placed
from wakeline.functions.geo import angle_between, bearing, haversine_km
from wakeline.settings import FREEZE_IMPLIED, FREEZE_VOTE, KNOTS_PER_KM_H, MAX_GAP_S, WINDOW


def track() -> WindowSpec:
    return Window.partitionBy("mmsi").orderBy("received_at", "event_id")


def chunk() -> WindowSpec:
    return Window.partitionBy("mmsi", "window_index").orderBy("received_at", "event_id")


def seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Adds _n (place in the key's order of time, from 0) and _all (the key's count) without ordering a key's rows as a whole.

    Counts of each key and day give where a day's numbers start; rows are then numbered inside their day only, so
    that a vessel with very many reports is spread over its days.
    """
    day = F.coalesce(F.unix_date(F.to_date("received_at")), F.lit(-(2**31)))
    dated = df.withColumn("_day", day)
    counts = dated.groupBy(*keys, "_day").agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*keys)
    starts = counts.select(*keys, "_day", (F.sum("_c").over(own.orderBy("_day")) - F.col("_c")).alias("_start"), F.sum("_c").over(own).alias("_all"))
    within = Window.partitionBy(*keys, "_day").orderBy("received_at", "event_id")
    return dated.join(starts, [*keys, "_day"]).withColumn("_n", F.row_number().over(within) - 1 + F.col("_start")).select(*df.columns, "_n", "_all")


def fixed_windows(df: DataFrame, size: int = WINDOW) -> DataFrame:
    """Adds window_index and place: runs of ``size`` reports that don't overlap; what is left over goes."""
    cut = numbered(df, "mmsi").withColumn("window_index", F.floor(F.col("_n") / size)).withColumn("place", F.col("_n") % size)
    return cut.where(F.col("window_index") < F.floor(F.col("_all") / size)).drop("_n", "_all")


def last_reports(df: DataFrame, size: int = WINDOW) -> DataFrame:
    """Each vessel's newest ``size`` reports."""
    newest = Window.partitionBy("mmsi").orderBy(F.desc("received_at"), F.desc("event_id"))
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= size).drop("_n")


def recent_reports(df: DataFrame, since: Column, size: int = WINDOW, least: int = WINDOW) -> DataFrame:
    """Each vessel's newest ``size`` reports after a time, with `short_history` where it has fewer than ``least``."""
    kept = last_reports(df.where(F.col("received_at") > since), size)
    return kept.withColumn("short_history", F.count("*").over(Window.partitionBy("mmsi")) < least)


def first_of(windows: DataFrame, vessels: int | None = None, most: int | None = None) -> DataFrame:
    """Windows (mmsi, window_index) of the first ``vessels``, and of these the first ``most``, in order."""
    if vessels is not None:
        windows = windows.join(F.broadcast(windows.select("mmsi").distinct().orderBy("mmsi").limit(vessels)), "mmsi", "left_semi")
    return windows if most is None else windows.orderBy("mmsi", "window_index").limit(most)


def steps(df: DataFrame, along: WindowSpec | None = None) -> DataFrame:
    """Adds gap_s, step_km, implied (knots; -1 without a step), bearing, dlat, dlon and sog_change, all to the report before."""
    along = along or chunk()
    before = lambda c: F.lag(c).over(along)
    at = seconds("received_at")
    lagged = df.withColumns({"_lat": before("lat"), "_lon": before("lon"), "_sog": before("sog"), "_at": F.lag(at).over(along)})
    km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    gap = at - F.col("_at")
    return lagged.withColumns(
        {
            "gap_s": gap,
            "step_km": km,
            "implied": F.when(gap > 0, km * 3600 / gap * KNOTS_PER_KM_H).otherwise(-1.0),
            "step_bearing": bearing(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")),
            "dlat": F.col("lat") - F.col("_lat"),
            "dlon": F.col("lon") - F.col("_lon"),
            "sog_change": F.col("sog") - F.col("_sog"),
        }
    ).drop("_lat", "_lon", "_sog", "_at")


def skip_reason(max_gap_s: float = MAX_GAP_S) -> Column:
    """First failing reason of a step, in fixed order; null where it can be judged."""
    return F.when(F.col("gap_s").isNotNull() & ~placed(F.col("lat"), F.col("lon")), "invalid_coordinate").when(F.col("gap_s").isNull(), None).when(F.col("gap_s") <= 0, "non_positive_dt").when(F.col("gap_s") > max_gap_s, "long_gap").when(F.abs("dlon") > 180, "antimeridian")


def scoreable(max_gap_s: float = MAX_GAP_S) -> Column:
    """Whether a report of a window has a step that can be judged."""
    return (F.col("place") > 0) & skip_reason(max_gap_s).isNull()


def with_error(df: DataFrame, along: WindowSpec | None = None) -> DataFrame:
    """Adds `error`: how far a step lies from the step before (degrees); 0 where there is none."""
    along = along or chunk()
    ahead = lambda c: F.col(c) - F.lag(c).over(along)
    return df.withColumn("error", F.coalesce(F.sqrt(ahead("dlat") * ahead("dlat") + ahead("dlon") * ahead("dlon")), F.lit(0.0)))


def freeze_score() -> Column:
    """Speed that is told while the vessel stands; 0 elsewhere."""
    told = F.greatest(F.lit(0.0), F.col("sog") - F.col("implied"))
    return F.when(F.col("sog").isNotNull() & F.col("implied").between(0, FREEZE_IMPLIED), told).otherwise(0.0)


def freeze_pair() -> Column:
    return (F.col("gap_s") > 0) & F.col("implied").between(0, FREEZE_IMPLIED) & (F.col("sog") > FREEZE_VOTE)


def valid_step() -> Column:
    return F.col("implied") != -1


def course_off() -> Column:
    return angle_between(F.col("cog"), F.col("step_bearing"))


def runs(df: DataFrame, claim: Column) -> DataFrame:
    """mmsi and the longest run of reports that claim (a null claim ends a run)."""
    said = df.withColumn("_c", F.coalesce(claim, F.lit(False))).withColumn("_island", F.sum((~F.col("_c")).cast("int")).over(track()))
    lengths = said.groupBy("mmsi", "_island").agg(F.count_if("_c").alias("n"))
    return lengths.groupBy("mmsi").agg(F.max("n").alias("longest_run"))


def revisited(df: DataFrame, *chunks: str) -> DataFrame:
    """Adds `revisited`: the report stands where one before its last stood (5 decimals), having been elsewhere just before."""
    at = df.withColumns({"_y": F.round("lat", 5), "_x": F.round("lon", 5)})
    order = Window.partitionBy(*chunks).orderBy("received_at", "event_id")
    numbered = at.withColumns({"_i": F.row_number().over(order), "_moved": ~(F.col("_y").eqNullSafe(F.lag("_y").over(order)) & F.col("_x").eqNullSafe(F.lag("_x").over(order)))})
    first = F.min("_i").over(Window.partitionBy(*chunks, "_y", "_x"))
    return numbered.withColumn("revisited", (first < F.col("_i") - 1) & F.col("_moved")).drop("_y", "_x", "_i", "_moved")
