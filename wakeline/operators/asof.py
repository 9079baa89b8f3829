"""The row in force at a time: an as-of join by union and last value, cut into time slots."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.windows import seconds


def as_of(rows: DataFrame, states: DataFrame, at: str, since: str, tie: str, keys: tuple[str, ...] = (), slot_s: float = 86400) -> DataFrame:
    """``rows`` with `state`: the columns of the newest of ``states`` whose ``since`` is at or before ``at`` (of equals, the greatest ``tie``); null without one.

    Both sides are met by key and time slot, and the last state of each slot is carried to the ones after it, so
    that neither one key nor a table without keys is ordered as a whole, and no row is met with all earlier states.
    """
    own = list(keys)
    values = [c for c in states.columns if c not in keys]
    held = states.where(F.col(since).isNotNull()).select(*own, F.struct(*values).alias("_v"), seconds(since).alias("_t"), F.col(tie).cast("long").alias("_tie"))
    held = held.withColumn("_slot", F.floor(F.col("_t") / slot_s))
    asked = rows.withColumn("_t", seconds(at)).withColumn("_slot", F.floor(F.col("_t") / slot_s))
    last = held.groupBy(*own, "_slot").agg(F.max_by("_v", F.struct("_t", "_tie")).alias("_v"))
    slots = last.unionByName(asked.select(*own, "_slot").distinct(), allowMissingColumns=True).groupBy(*own, "_slot").agg(F.first("_v", ignorenulls=True).alias("_v"))
    before = Window.partitionBy(*own).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*own, "_slot", F.last("_v", ignorenulls=True).over(before).alias("_v")).where("_v is not null")
    shape = lambda d, side, t, n: d.select(*own, "_slot", t.alias("_t"), n.alias("_tie"), F.lit(side).alias("_side"), *_either(d, side, rows))
    nothing, start = F.lit(None).cast("long"), F.lit(float("-inf"))
    every = shape(carried, 0, start, nothing).unionByName(shape(held, 1, F.col("_t"), F.col("_tie"))).unionByName(shape(asked, 2, F.col("_t"), nothing))
    upto = Window.partitionBy(*own, "_slot").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    met = every.withColumn("state", F.last("_v", ignorenulls=True).over(upto)).where("_side = 2")
    return met.select("_row.*", "state")


def _either(d: DataFrame, side: int, rows: DataFrame) -> list[Column]:
    row = F.struct(*rows.columns)
    shape = rows.select(row.alias("_row")).schema["_row"].dataType
    return [F.lit(None).alias("_v"), row.alias("_row")] if side == 2 else [F.col("_v"), F.lit(None).cast(shape).alias("_row")]
