"""Running sums and ranks over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import materialised


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum of its expression over the rows up to and including this one.

    Rows are dealt by ranges of order and written, so that every later read sees the same ranges; a table of one row
    per range is scanned for the offsets, and the sums within a range run in its own task. Order must be unique
    for a repeatable result; values of one range that tie are split by the later columns of order.
    """
    named = {f"__add{i}": e for i, e in enumerate(sums.values())}
    dealt = materialised(df.withColumns(named).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"{c}t") for c in named])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"{c}t").over(before), F.lit(0)).alias(f"{c}o") for c in named])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.join(F.broadcast(offsets), "__range")
    return joined.select(*df.columns, *[(F.col(f"{c}o") + F.sum(c).over(within)).alias(n) for n, c in zip(sums, named)])


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with 1, 2, ... in order."""
    return prefix_sums(df, order, {name: F.lit(1)})


def deciles(df: DataFrame, order: list[str], name: str = "decile") -> DataFrame:
    """df with floor(10 * position / n), at most 9; unlike ntile the first groups aren't the larger ones."""
    ranked = global_rank(df, order, "__rank")
    n = df.agg(F.count("*")).scalar()
    return ranked.withColumn(name, F.least(F.lit(9), F.floor((F.col("__rank") - 1) * 10 / n).cast("int"))).drop("__rank")


def folds(df: DataFrame, key: str, k: int, name: str = "fold") -> DataFrame:
    """df with a round-robin fold by position in the order of key."""
    return global_rank(df, [key], "__rank").withColumn(name, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def least_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str, bucket: int = 65536) -> DataFrame:
    """rows with the least value of the key's rows before each in order, an integer; null for a key's first. A key's rows are cut into buckets of the order, whose least values are carried on, so a hot key is spread."""
    cut = rows.withColumn("__bucket", F.expr(f"`{order}` div {bucket}"))
    here = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "__bucket").agg(F.min(value).alias("__least"))
    carried = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bucket").alias("__b"), F.min("__least").over(ahead).alias("__carry"))
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return cut.withColumn("__own", F.min(value).over(here)).join(carried, same).select(*rows.columns, F.least("__own", "__carry").alias(name))
