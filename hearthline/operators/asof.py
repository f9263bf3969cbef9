"""Backward as-of joins: for each row the last fact of its key at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_tie: str, values: list[str],
              bucket: Column | None = None, bucket_of: str = "day") -> DataFrame:
    """left with the values of the last row of right (order right_time, right_tie) with right_time <= left_time; null if none.

    Both sides are merged and cut into time buckets of a key, so that a key with very many rows is spread over tasks.
    Within a bucket a running last value is taken; a table of one row per key and bucket carries what earlier buckets end with.
    Both tables share the names of keys; left mustn't have columns named as values. Null keys find nothing.
    """
    held = F.struct(F.col(right_time).alias("__at"), F.col(right_tie).alias("__tie"), *[F.col(v).alias(v) for v in values])
    facts = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), held.alias("__fact"), F.lit(None).cast(left.schema.simpleString()).alias("__row"))
    rows = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(facts.schema["__fact"].dataType).alias("__fact"), F.struct(*left.columns).alias("__row"))
    both = facts.unionByName(rows).withColumn("__bucket", F.date_trunc(bucket_of, "__t") if bucket is None else bucket)
    here = Window.partitionBy(*keys, "__bucket").orderBy("__t", "__side", F.col("__fact.__tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = both.withColumn("__last", F.last("__fact", ignorenulls=True).over(here))
    ends = facts.withColumn("__bucket", F.date_trunc(bucket_of, "__t") if bucket is None else bucket).groupBy(*keys, "__bucket").agg(F.max_by("__fact", F.struct("__t", "__fact.__tie")).alias("__end"))
    buckets = both.select(*keys, "__bucket").distinct().join(ends, [*keys, "__bucket"], "left")
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*keys, "__bucket", F.last("__end", ignorenulls=True).over(earlier).alias("__carry"))
    found = running.where("__side = 1").join(carried, [*keys, "__bucket"], "left")
    last = F.coalesce("__last", "__carry")
    return found.select("__row.*", *[last[v].alias(v) for v in values])


def rate_for(amounts: DataFrame, rates: DataFrame, on: str = "on_date", base: str = "EUR") -> DataFrame:
    """amounts (quote, on_date, ...) with rate, rate_date and stale (the rate is older than asked for)."""
    facts = rates.where(F.col("base") == base).select("quote", "rate", "rate_date", F.col("rate_date").cast("timestamp").alias("__rt"))
    asked = amounts.withColumn("__at", F.col(on).cast("timestamp"))
    found = asof_join(asked, facts, ["quote"], "__at", "__rt", "rate_date", ["rate", "rate_date"], bucket_of="year").drop("__at")
    return found.withColumn("stale", F.col("rate_date") < F.col(on))


def with_previous(rows: DataFrame, keys: list[str], time: str, tie: str, value: str, bucket_of: str = "month", name: str = "previous") -> DataFrame:
    """rows with the value of the key's row before, in order of time and tie; null for a key's first row.

    A key's rows are cut into time buckets, so that a key with very many rows is spread over tasks; a table of one row per key and bucket carries the last value over.
    """
    cut = rows.withColumn("__bucket", F.date_trunc(bucket_of, time))
    here = Window.partitionBy(*keys, "__bucket").orderBy(time, tie)
    ends = cut.groupBy(*keys, "__bucket").agg(F.max(F.struct(time, tie, F.col(value).alias("__v"))).alias("__end"))
    over = Window.partitionBy(*keys).orderBy("__bucket")
    carried = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bucket").alias("__b"), F.lag("__end.__v").over(over).alias("__carry"))
    placed = cut.withColumn("__lag", F.lag(F.struct(F.col(value).alias("v"))).over(here))
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return placed.join(carried, same).select(*rows.columns, F.when(F.col("__lag").isNull(), F.col("__carry")).otherwise(F.col("__lag.v")).alias(name))


def price_steps(history: DataFrame, key: str, time: str, tie: str, price: str) -> DataFrame:
    """history with step: down, up, or null where the price is the key's first or stays."""
    rows = with_previous(history, [key], time, tie, price, name="__previous")
    return rows.withColumn("step", F.when(F.col(price) < F.col("__previous"), "down").when(F.col(price) > F.col("__previous"), "up")).drop("__previous")


def price_changes(observations: DataFrame, keys: list[str], time: str, tie: str, price: str) -> DataFrame:
    """The observations whose price differs from the one before of their keys; the first of each always does."""
    rows = with_previous(observations, keys, time, tie, price, name="__previous")
    return rows.where(~F.col(price).eqNullSafe(F.col("__previous"))).drop("__previous")


def price_behaviour(marks: DataFrame, history: DataFrame, key: str, mark_time: str, time: str, tie: str, price: str) -> DataFrame:
    """marks with reductions, drop_pct, days_since, increased: the price changes of the key up to the mark's time.

    Only rows with time <= mark_time count, so nothing leaks from the future; without any all four are zero. Counts run within months of a key and are carried over by month.
    """
    stepped = with_previous(history, [key], time, tie, price, name="__previous").withColumn("__month", F.date_trunc("month", time)).withColumn("__step", F.col(price) - F.col("__previous"))
    down, up = F.count_if(F.col("__step") < 0), F.count_if(F.col("__step") > 0)
    months = stepped.groupBy(key, "__month").agg(down.alias("__d"), up.alias("__u"), F.min(F.struct(time, tie, F.col(price).alias("__p")))["__p"].alias("__p"))
    over = Window.partitionBy(key).orderBy("__month")
    earlier, reach = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = months.select(F.col(key).alias("__key"), F.col("__month").alias("__of"), F.coalesce(F.sum("__d").over(earlier), F.lit(0)).alias("__downs"), F.coalesce(F.sum("__u").over(earlier), F.lit(0)).alias("__ups"), F.first("__p").over(reach).alias("__start"))
    run = Window.partitionBy(key, "__month").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = stepped.select("*", down.over(run).alias("__here_down"), up.over(run).alias("__here_up")).join(ahead, (F.col("__month") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")))
    facts = counted.select(
        key, F.col(time).alias("__pt"), F.col(tie).alias("__ptie"), F.col(price).alias("__price"), (F.col("__downs") + F.col("__here_down")).alias("__down"), (F.col("__ups") + F.col("__here_up")).alias("__up"), "__start")
    found = asof_join(marks, facts, [key], mark_time, "__pt", "__ptie", ["__pt", "__price", "__down", "__up", "__start"], bucket_of="month")
    fell = (F.col("__start") > 0) & (F.col("__price") < F.col("__start"))
    return found.select(
        *marks.columns, F.coalesce("__down", F.lit(0)).cast("int").alias("reductions"),
        F.when(fell, 100 * (F.col("__start") - F.col("__price")) / F.col("__start")).otherwise(0.0).alias("drop_pct"),
        F.coalesce(F.floor(F.timestamp_diff("SECOND", F.col("__pt"), F.col(mark_time)) / 86400), F.lit(0)).cast("int").alias("days_since"),
        F.when(F.col("__up") > 0, 1).otherwise(0).alias("increased"))
