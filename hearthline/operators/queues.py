"""Queues held as tables: what is due, what is stale, alerts that mustn't repeat too soon, budgets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.folding import fold_by_key
from hearthline.operators.ranks import prefix_sums


def queue_depth(notifications: DataFrame, as_of: dt.datetime, limit_minutes: int = 5, namespace: str = "prod") -> DataFrame:
    """One row: pending_total, pending_older, oldest_minutes of a namespace's queue."""
    age = F.timestamp_diff("MINUTE", F.col("created_at"), F.lit(as_of))
    rows = notifications.where((F.col("queue_ns") == namespace) & (F.col("status") == "pending"))
    return rows.agg(F.count("*").alias("pending_total"), F.count_if(F.col("created_at") < F.lit(as_of - dt.timedelta(minutes=limit_minutes))).alias("pending_older"), F.coalesce(F.max(age), F.lit(0)).alias("oldest_minutes"))


def depth_alert(notifications: DataFrame, as_of: dt.datetime, limit_minutes: int = 5, realert_minutes: int = 60, namespace: str = "prod") -> DataFrame:
    """The alert row that is due (none if the queue moves, or the last alert is younger than realert_minutes)."""
    last = notifications.where((F.col("kind") == "queue_depth") & (F.col("queue_ns") == namespace)).agg(F.max("created_at")).scalar()
    due = (F.col("pending_older") > 0) & F.coalesce(last <= F.lit(as_of - dt.timedelta(minutes=realert_minutes)), F.lit(True))
    return queue_depth(notifications, as_of, limit_minutes, namespace).where(due)


def without_repeats(alerts: DataFrame, keys: list[str], time: str, tie: str, seconds: float) -> DataFrame:
    """Alerts that come at least `seconds` after the last one of their keys that was let through."""
    def step(last: float | None, row: tuple) -> tuple[float | None, tuple | None]:
        if last is not None and row[-1] - last < seconds:
            return last, None
        return row[-1], row[:-1]

    kinds = dict(alerts.dtypes)
    rows = alerts.select(*keys, tie, (F.unix_micros(time) / 1e6).alias("__s"))
    kept = fold_by_key(rows, keys, ["__s", tie], lambda: None, step, ", ".join(f"{c} {kinds[c]}" for c in [*keys, tie]))
    return alerts.join(kept, [*keys, tie], "left_semi")


def within_budget(tasks: DataFrame, order: list[str], cost: str, budget: float) -> DataFrame:
    """The tasks that are started in order before the budget is spent; the rest stay queued."""
    spent = prefix_sums(tasks, order, {"__spent": F.coalesce(F.col(cost), F.lit(0))})
    return spent.where(F.col("__spent") - F.coalesce(F.col(cost), F.lit(0)) < budget).drop("__spent")


def due_candidates(candidates: DataFrame, as_of: dt.datetime, least_minutes: int = 60, pinned: list[str] = ()) -> DataFrame:
    """Pending domains never probed or not for least_minutes; pinned ones first."""
    due = (F.col("class") == "pending") & (F.col("probed_at").isNull() | (F.col("probed_at") <= F.lit(as_of - dt.timedelta(minutes=least_minutes))))
    return candidates.where(due).orderBy(F.col("domain").isin(list(pinned)).desc(), "domain")


def confirmed_class(observed: str, previous: str, reason: str, minutes_since: str, twice: list[str]):
    """struct(class, confirmed): classes in twice stay pending until seen again, an hour later at least."""
    seen = F.coalesce(F.nullif(F.col(observed), F.lit("")), F.lit("pending"))
    again = (F.col(minutes_since) >= 60) & (F.col(previous).eqNullSafe(seen) | F.contains(F.coalesce(F.col(reason), F.lit("")), seen))
    return F.when(~seen.isin(twice) | F.coalesce(again, F.lit(False)), seen).otherwise("pending")


def shadow_sample(hits: DataFrame, percent: int, key: str = "object_id") -> DataFrame:
    """The same rows each time: ids whose last two digits are under percent."""
    return hits.where(F.col(key) % 100 < max(percent, 0))


def seeded_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in the order of md5(key || seed)."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), key).limit(n)
