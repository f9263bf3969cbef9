"""Quality of predicted probabilities: calibration deciles, Brier score and its parts, C-index. p is a prediction, y is 0 or 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.ranks import deciles, prefix_sums


def calibration(rows: DataFrame, p: str, y: str, tie: list[str]) -> DataFrame:
    """decile, n, predicted, actual."""
    return deciles(rows, [p, *tie]).groupBy("decile").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("actual"))


def worst_decile(table: DataFrame) -> DataFrame:
    return table.agg(F.max(F.abs(F.col("predicted") - F.col("actual"))).alias("max_deviation"))


def brier(rows: DataFrame, p: str, y: str) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def brier_parts(table: DataFrame) -> DataFrame:
    """reliability, resolution, uncertainty over calibration()'s at most ten rows."""
    based = table.withColumn("base", table.agg(F.sum(F.col("n") * F.col("actual")) / F.sum("n")).scalar())
    weighted = lambda a, b: F.sum(F.col("n") * F.pow(F.col(a) - F.col(b), 2)) / F.sum("n")
    return based.agg(weighted("predicted", "actual").alias("reliability"), weighted("actual", "base").alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def c_index(rows: DataFrame, p: str, y: str) -> DataFrame:
    """c_index, pairs: the share of (event, non-event) pairs where the event has the higher p, ties half; null without pairs.

    Rows are counted per distinct p, then a distributed running sum gives the non-events below each.
    """
    counted = rows.groupBy(p).agg(F.sum(F.col(y).cast("long")).alias("ones"), F.sum(1 - F.col(y).cast("long")).alias("zeros"))
    below = prefix_sums(counted, [p], {"upto": F.col("zeros")})
    won = F.sum(F.col("ones") * (F.col("upto") - F.col("zeros")) + 0.5 * F.col("ones") * F.col("zeros"))
    pairs = F.sum("ones") * F.sum("zeros")
    return below.agg(F.when(pairs > 0, won / pairs).alias("c_index"), F.coalesce(pairs, F.lit(0)).alias("pairs"))
