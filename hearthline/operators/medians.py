"""Exact medians of groups of any size, without gathering a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import materialised


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"of_{k}"]) for k in keys], F.lit(True))


def exact_median(rows: DataFrame, keys: list[str], value: str, name: str = "median", bins: int = 1024, few: int = 4096) -> DataFrame:
    """keys and the median of a numeric column as a double, the mean of the middle two of an even number; nulls and NaN don't count, and a group without numbers has no row.

    Each round counts the values of a group that are still in question in bins between the least and the greatest, summed in each task first, and goes on with the bin that holds the wanted rank. A bin with one value is the
    answer; one of `few` values or less is sorted. So a group with half of all rows takes one or two passes more, and no task sees more than `few` of its values at once.
    """
    number = F.col(value).cast("double")
    values = materialised(rows.where(number.isNotNull() & ~F.isnan(number)).select(*keys, number.alias("v")))
    ranks = F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))).alias("rank")
    state = values.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    of = [f"of_{k}" for k in keys]
    state = materialised(state.select(*[F.col(k).alias(o) for k, o in zip(keys, of)], ranks, "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("held")))
    settled = (F.col("low") == F.col("high")) | (F.col("held") <= few)
    inside = F.col("v").between(F.col("low"), F.col("high"))
    while not (open_ := state.where(~settled)).isEmpty():
        wide = F.col("high") - F.col("low")
        bin_ = F.least(F.floor((F.col("v") - F.col("low")) / wide * bins), F.lit(bins - 1))
        counted = values.join(open_, _same(values, open_, keys)).where(inside).groupBy(*of, "rank", "before", bin_.alias("bin")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("held"))
        ahead = Window.partitionBy(*of, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
        placed = counted.withColumn("before", F.col("before") + F.coalesce(F.sum("held").over(ahead), F.lit(0)))
        picked = placed.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("held")))
        state = materialised(state.where(settled).unionByName(picked.select(*state.columns)))
    small = state.where("low < high")
    sorted_ = values.join(small, _same(values, small, keys)).where(inside).groupBy(*of, "rank", "before").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    found = state.where("low = high").select(*of, F.col("low").alias("v")).unionByName(sorted_.select(*of, F.element_at("vs", (F.col("rank") - F.col("before") + 1).cast("int")).alias("v")))
    return found.groupBy(*[F.col(o).alias(k) for k, o in zip(keys, of)]).agg(F.avg("v").alias(name))
