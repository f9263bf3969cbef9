"""What to crawl now: yields per slot, window weights, cooldowns, the plan of a moment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions.scheduling import effective_cap, local_slot, slot_key, window_weight
from hearthline.operators.folding import fold_by_key
from hearthline.operators.latest import top_per_key


def slot_yields(runs: DataFrame, zone: str = "UTC") -> DataFrame:
    """source_id, slot_key, day, scans, new_objects of complete runs, in local time."""
    day, hour = local_slot(F.col("started_at"), zone)
    rows = runs.where("completeness = 'complete'").select("source_id", slot_key(day, hour).alias("slot_key"), F.to_date(F.from_utc_timestamp("started_at", zone)).alias("day"), "new_objects")
    return rows.groupBy("source_id", "slot_key", "day").agg(F.count("*").alias("scans"), F.sum("new_objects").alias("new_objects"))


def window_weights(windows: DataFrame, yields: DataFrame, as_of: dt.date, days: int = 14, least_scans: int = 14, epsilon: float = 0.1) -> DataFrame:
    """windows (source_id, window_id, day_of_week, hour_start, hour_end, ...) with average, scans, warming, weight.

    A window's yield is pooled over its slots: new objects / scans. A source warms up until it has least_scans in the trailing days.
    """
    recent = yields.where(F.col("day") >= F.date_sub(F.lit(as_of), days)).groupBy("source_id", "slot_key").agg(F.sum("scans").alias("scans"), F.sum("new_objects").alias("new_objects"))
    total = recent.groupBy("source_id").agg(F.sum("scans").alias("all_scans"))
    slots = windows.select("source_id", "window_id", F.explode(F.sequence(F.col("hour_start"), F.col("hour_end") - 1)).alias("hour"), "day_of_week").withColumn("slot_key", slot_key(F.col("day_of_week"), F.col("hour")))
    pooled = slots.join(recent, ["source_id", "slot_key"], "left").groupBy("source_id", "window_id").agg(F.coalesce(F.sum("scans"), F.lit(0)).alias("scans"), (F.coalesce(F.sum("new_objects"), F.lit(0)) / F.greatest(F.coalesce(F.sum("scans"), F.lit(0)), F.lit(1))).alias("average"))
    most = pooled.groupBy("source_id").agg(F.max("average").alias("most"))
    joined = windows.join(pooled, ["source_id", "window_id"]).join(most, "source_id").join(total, "source_id", "left")
    warming = F.coalesce("all_scans", F.lit(0)) < least_scans
    return joined.select(*windows.columns, "average", "scans", warming.alias("warming"), window_weight(F.col("average"), F.col("most"), warming, epsilon).alias("weight"))


def matching_windows(moments: DataFrame, windows: DataFrame, time: str, weight: str = "weight", cap: str = "cap") -> DataFrame:
    """moments (source_id, time, ...) that are in a window of their source (source_id, day_of_week, hour_start, hour_end), with the greatest weight and the least cap of those. Windows become hours first, so this is an equality join."""
    hours = windows.select("source_id", "day_of_week", F.explode(F.sequence(F.col("hour_start"), F.col("hour_end") - 1)).alias("__hour"), weight, cap)
    slots = hours.groupBy("source_id", F.col("day_of_week").alias("__day"), "__hour").agg(F.max(weight).alias(weight), F.min(cap).alias(cap))
    day, hour = local_slot(F.col(time), "UTC")
    return moments.withColumns({"__day": day, "__hour": hour}).join(slots, ["source_id", "__day", "__hour"]).drop("__day", "__hour")


def overlapping_windows(windows: DataFrame) -> DataFrame:
    """source_id, day_of_week, a, b: windows of a source and day that share an hour."""
    a, b = windows.alias("a"), windows.alias("b")
    same = (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.day_of_week") == F.col("b.day_of_week")) & (F.col("a.window_id") < F.col("b.window_id"))
    cross = (F.col("a.hour_start") < F.col("b.hour_end")) & (F.col("b.hour_start") < F.col("a.hour_end"))
    return a.join(b, same & cross).select("a.source_id", "a.day_of_week", F.col("a.window_id").alias("a"), F.col("b.window_id").alias("b"))


def next_configs(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """source_id, config_id: the active configuration that ran longest ago; one that never ran comes first."""
    last = runs.groupBy("config_id").agg(F.max("started_at").alias("last_at"))
    return top_per_key(configs.where("active").join(last, "config_id", "left"), ["source_id"], [F.col("last_at").asc_nulls_first(), F.asc("config_id")]).select("source_id", "config_id")


def recovered(sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Sources whose cooldown is over are active again; their rate factor stays."""
    over = (F.col("state") == "cooldown") & (F.col("cooldown_until") <= F.lit(as_of))
    return sources.withColumn("state", F.when(over, "active").otherwise(F.col("state")))


def plan(sources: DataFrame, weighted: DataFrame, configs: DataFrame, runs: DataFrame, as_of: dt.datetime, zone: str = "UTC") -> DataFrame:
    """source_id, config_id, slot_key, weight, remaining, warming of active sources that are in a window and under its cap, best first.

    Of several windows the greatest weight and the least cap count; the cap is lowered by the source's runs of this local hour.
    """
    now = F.lit(as_of)
    day, hour = local_slot(now, zone)
    inside = weighted.where((F.col("day_of_week") == day) & hour.between(F.col("hour_start"), F.col("hour_end") - 1))
    active = recovered(sources, as_of).where("state = 'active'")
    caps = inside.join(active.select("source_id", "rate_factor"), "source_id").groupBy("source_id").agg(
        F.max("weight").alias("weight"), F.min(effective_cap(F.col("max_requests_per_hour"), F.col("rate_factor"))).alias("cap"), F.first("warming").alias("warming"))
    this_hour = F.date_trunc("hour", F.from_utc_timestamp("started_at", zone)) == F.date_trunc("hour", F.from_utc_timestamp(now, zone))
    used = runs.where(this_hour & (F.col("started_at") <= now)).groupBy("source_id").agg(F.count("*").alias("used"))
    left = F.col("cap") - F.coalesce("used", F.lit(0))
    return (caps.join(used, "source_id", "left").where(left > 0).join(next_configs(configs, runs), "source_id")
            .select("source_id", "config_id", slot_key(day, hour).alias("slot_key"), "weight", left.cast("int").alias("remaining"), "warming").orderBy(F.desc("weight"), "source_id"))


def cooldown_ladder(outcomes: DataFrame, base_minutes: float = 60, multiplier: float = 2, cap_minutes: float = 72 * 60, recovery: float = 1.5, least_factor: float = 0.25) -> DataFrame:
    """source_id, at, ok, strikes, rate_factor, cooldown_minutes after each outcome (source_id, at, ok) in order of time.

    A failure adds a strike, halves the factor (not below least_factor) and starts a cooldown that doubles with each strike; a success clears the strikes
    and raises the factor by one step, to 1 at most.
    """
    def step(state: tuple[int, float], row: tuple) -> tuple[tuple[int, float], tuple]:
        strikes, factor = state
        if row[2]:
            strikes, factor, minutes = 0, min(1.0, factor * recovery), 0.0
        else:
            strikes += 1
            factor, minutes = max(least_factor, factor / 2), min(cap_minutes, base_minutes * multiplier ** min(strikes - 1, 60))
        return (strikes, factor), (*row, strikes, factor, minutes)

    rows = outcomes.select("source_id", "at", "ok")
    kinds = dict(rows.dtypes)
    return fold_by_key(rows, ["source_id"], ["at"], lambda: (0, 1.0), step, f"source_id {kinds['source_id']}, at {kinds['at']}, ok boolean, strikes int, rate_factor double, cooldown_minutes double")
