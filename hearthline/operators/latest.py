"""One row per key: latest, first and last, dominant, distinct-on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key. Spark limits each partition before the shuffle, so a hot key sends k rows a task."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """DISTINCT ON (keys) ... ORDER BY time DESC, tie DESC; null times come last."""
    return top_per_key(df, keys, [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def first_last(df: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """keys, first_value, last_value, n_points: aggregated map-side, no window needed."""
    at = F.struct(time, tie)
    return df.groupBy(*keys).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.count("*").alias("n_points"))


def trend(first: str | Column, last: str | Column, n: str | Column) -> Column:
    """reduced, increased, or null where there are fewer than two points or no change."""
    first, last, n = (F.col(c) if isinstance(c, str) else c for c in (first, last, n))
    return F.when((n >= 2) & (last < first), "reduced").when((n >= 2) & (last > first), "increased")


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: the most frequent value of each key, the alphabetically first of ties."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return top_per_key(counted, keys, [F.desc("n"), F.asc(value)])


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, value, mixed: the value most rows have; null and mixed where several share the lead."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    led = counted.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("c").alias("lead"), F.collect_list(F.struct("c", value)).alias("all"))
    leaders = F.filter("all", lambda x: x["c"] == F.col("lead"))  # there are as many as classes
    mixed = F.size(leaders) > 1
    return led.select(*keys, "n", F.when(~mixed, F.element_at(leaders, 1)[value]).alias(value), mixed.alias("mixed"))


def last_two(df: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """keys, last_value, previous_value (null where there is one point)."""
    few = top_per_key(df, keys, [F.col(time).desc(), F.col(tie).desc()], 2, "__rank")
    pick = lambda k: F.max(F.when(F.col("__rank") == k, F.col(value)))
    return few.groupBy(*keys).agg(pick(1).alias("last_value"), pick(2).alias("previous_value"))
