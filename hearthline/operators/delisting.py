"""Objects that vanished: consecutive misses in complete runs, guards against broken runs, reactivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.ranks import least_before


def home_configs(runs: DataFrame, sightings: DataFrame) -> DataFrame:
    """object_id, config_id, last_found_at: the configuration of the last complete run that found the object, else of its first record.

    runs: run_id, config_id, started_at, completeness; sightings: object_id, run_id, fetched_at.
    """
    seen = sightings.join(runs, "run_id")
    complete = F.col("completeness") == "complete"
    return seen.groupBy("object_id").agg(
        F.coalesce(F.max_by(F.when(complete, F.col("config_id")), F.when(complete, F.struct("started_at", "run_id"))), F.min_by("config_id", F.struct("fetched_at", "run_id"))).alias("config_id"),
        F.max(F.when(complete, F.col("started_at"))).alias("last_found_at"))


def misses(runs: DataFrame, sightings: DataFrame) -> DataFrame:
    """object_id, misses: complete runs of the home configuration after the last that found the object. Runs that aren't complete never count.

    Runs are numbered per configuration; what an object missed is the difference of two numbers, so objects and runs are never paired.
    """
    home = home_configs(runs, sightings)
    complete = runs.where("completeness = 'complete'")
    placed = complete.select("config_id", "started_at", F.rank().over(Window.partitionBy("config_id").orderBy(F.desc("started_at"))).alias("place")).distinct()
    totals = complete.groupBy("config_id").agg(F.count("*").alias("total"))
    joined = home.join(totals, "config_id", "left").join(placed.withColumnRenamed("started_at", "last_found_at"), ["config_id", "last_found_at"], "left")
    return joined.select("object_id", F.coalesce(F.when(F.col("last_found_at").isNull(), F.col("total")).otherwise(F.col("place") - 1), F.lit(0)).cast("long").alias("misses"))


def delist_pass(objects: DataFrame, missed: DataFrame, least_misses: int = 2, max_share_pct: float = 25, min_objects: int = 10, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects after the pass, one-row report with candidates, active, anomaly).

    If the candidates' share of the active objects is over max_share_pct (with min_objects active at least), nothing
    changes. verdicts (object_id, verdict) of asking for the address: alive keeps the object, relisted is a reason, null changes nothing.
    """
    if least_misses < 2:
        raise ValueError("least_misses must be 2 or more")
    joined = objects.join(missed.withColumnRenamed("object_id", "id"), "id", "left").withColumn("due", (F.col("status") == "active") & (F.coalesce("misses", F.lit(0)) >= least_misses))
    report = joined.agg(F.count_if("due").alias("candidates"), F.count_if(F.col("status") == "active").alias("active"))
    report = report.withColumn("anomaly", (F.col("active") >= min_objects) & (100.0 * F.col("candidates") > max_share_pct * F.col("active")))
    checked = joined.join(verdicts.withColumnRenamed("object_id", "id"), "id", "left") if verdicts is not None else joined.withColumn("verdict", F.lit("unknown"))
    gone = F.col("due") & ~report.select("anomaly").scalar() & F.coalesce(F.col("verdict").isin("unknown", "relisted"), F.lit(False))
    new = {"status": F.when(gone, "delisted").otherwise(F.col("status")), "delisted_reason": F.when(gone, F.col("verdict")).otherwise(F.col("delisted_reason"))}
    return checked.select(*[new[c].alias(c) if c in new else F.col(c) for c in objects.columns]), report


def reactivate(objects: DataFrame, seen: DataFrame) -> DataFrame:
    """Delisted objects that were seen again are active, without a reason."""
    again = seen.select(F.col("object_id").alias("id")).distinct().withColumn("__seen", F.lit(True))
    back = (F.col("status") == "delisted") & F.col("__seen").isNotNull()
    new = {"status": F.when(back, "active").otherwise(F.col("status")), "delisted_reason": F.when(~back, F.col("delisted_reason"))}
    return objects.join(again, "id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in objects.columns])


def moved_forward(postings: DataFrame, keys: list[str], order: str, posted: str) -> DataFrame:
    """postings with moved_forward: an earlier sighting of the same listing says an older date of posting."""
    rows = least_before(postings, keys, order, posted, "__oldest")
    return rows.withColumn("moved_forward", F.coalesce(F.col("__oldest") < F.col(posted), F.lit(False))).drop("__oldest")
