"""New rows and changes against a stored table, as joins whose result is the table's next state."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target lacks, each key once (keys compare as equal nulls don't)."""
    return rows.dropDuplicates(keys).join(target.select(keys), keys, "left_anti")


def last_of_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], may_change: Column | None = None) -> DataFrame:
    """The table after inserts and updates, and `action` of each row: kept, inserted, updated or skipped.

    ``rows`` has one row for each key and the target's columns; ``may_change`` is asked of the stored row (columns by their names).
    """
    values = [c for c in target.columns if c not in keys]
    old = target.withColumn("_free", F.lit(True) if may_change is None else F.coalesce(may_change, F.lit(False))).select(*keys, F.struct(*values, "_free").alias("_old"))
    new = rows.select(*keys, F.struct(*values).alias("_new"))
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.col("_old._free"), "updated").otherwise("skipped")
    both = old.join(new, keys, "full").withColumn("action", action)
    taken = F.col("action").isin("inserted", "updated")
    return both.select(*keys, *(F.when(taken, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in values), "action")


def record_verdicts(incidents: DataFrame, verdicts: DataFrame, force: bool = False) -> DataFrame:
    """incident_id, verdict, outcome for each verdict given: recorded, already_reviewed or not_found."""
    met = verdicts.join(incidents.select("incident_id", F.col("verdict").alias("_was"), F.lit(True).alias("_there")), "incident_id", "left")
    free = F.col("_was").isNull() | F.lit(force)
    outcome = F.when(F.col("_there").isNull(), "not_found").when(free, "recorded").otherwise("already_reviewed")
    return met.select("incident_id", F.when(outcome == "recorded", F.col("verdict")).otherwise(F.col("_was")).alias("verdict"), outcome.alias("outcome"))


def expire_reports(reports: DataFrame, as_of: Column) -> DataFrame:
    """Report texts whose time is over become null with the reason `expired`."""
    over = F.coalesce(F.col("report_text").isNotNull() & (F.col("expires_at") < as_of), F.lit(False))
    return reports.withColumns({"delete_reason": F.when(over, "expired").otherwise(F.col("delete_reason")), "report_text": F.when(~over, F.col("report_text"))})


def upsert_zones(stored: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored zones after a file's, by name and source_url, and the counts (inserted, updated, skipped); rows whose `origin` isn't manual are never touched."""
    after = upsert(stored, zones.withColumn("origin", F.lit("manual")).select(*stored.columns), ["name", "source_url"], F.col("origin") == "manual")
    counts = after.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "skipped")))
    return after.drop("action"), counts
