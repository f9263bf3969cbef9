"""Streams of observations: price changes, life cycles, yields per slot, alerts, upserts into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearthline.functions.scheduling import local_slot, slot_key
from hearthline.session import materialised


def price_changes(observations: DataFrame) -> DataFrame:
    """object_id, source_id, price_minor, currency, change_at of a stream of the same: only prices that differ from the last of the object and source.

    Within a micro-batch rows go in order of time; a row older than the last one seen is late and dropped.
    """
    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, currency, at = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values("change_at", kind="stable")
        kept = []
        for row in rows.itertuples(index=False):
            micros = row.change_at.value // 1000
            if at is not None and micros < at:
                continue
            if (row.price_minor, row.currency) != (price, currency):
                kept.append(row)
            price, currency, at = int(row.price_minor), row.currency, micros
        if at is not None:
            state.update((price, currency, at))
        yield pd.DataFrame(kept, columns=rows.columns) if kept else rows.iloc[:0]

    few = observations.where("price_minor is not null").select("object_id", "source_id", "price_minor", "currency", "change_at")
    return few.groupBy("object_id", "source_id").applyInPandasWithState(
        step, "object_id long, source_id string, price_minor long, currency string, change_at timestamp", "price long, currency string, at long", "append", GroupStateTimeout.NoTimeout)


def lifecycle(sightings: DataFrame, least_misses: int = 2) -> DataFrame:
    """object_id, status, run_at of a stream (object_id, run_at, found) of complete runs: a row whenever an object is delisted or comes back."""
    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, missed = state.get if state.exists else ("active", 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("run_at", kind="stable").itertuples(index=False):
            missed = 0 if row.found else missed + 1
            new = "active" if row.found else "delisted" if missed >= least_misses else status
            if new != status:
                status = new
                out.append((key[0], status, row.run_at))
        state.update((status, missed))
        yield pd.DataFrame(out, columns=["object_id", "status", "run_at"])

    return sightings.groupBy("object_id").applyInPandasWithState(step, "object_id long, status string, run_at timestamp", "status string, missed int", "append", GroupStateTimeout.NoTimeout)


def slot_yield_stream(runs: DataFrame, zone: str = "UTC", late: str = "1 hour") -> DataFrame:
    """source_id, slot_key, hour_start, scans, new_objects per local hour of complete runs, final once the watermark has passed."""
    hourly = runs.where("completeness = 'complete'").withWatermark("started_at", late).groupBy("source_id", F.window("started_at", "1 hour").alias("w")).agg(F.count("*").alias("scans"), F.sum("new_objects").alias("new_objects"))
    return hourly.select("source_id", slot_key(*local_slot(F.col("w.start"), zone)).alias("slot_key"), F.col("w.start").alias("hour_start"), "scans", "new_objects")


def first_alerts(alerts: DataFrame, keys: list[str], time: str = "created_at", within: str = "1 hour") -> DataFrame:
    """Alerts without those whose keys had one within the time before; a key is free again once the watermark has passed, at the next batch."""
    return alerts.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def upserting(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataStreamWriter:
    """A writer that merges each micro-batch into a table: write(merge(read(), batch)).

    The merged table is materialised before it is written, as it is read from the place that write replaces; a batch that is run again
    gives the same table if merge is idempotent.
    """
    def batch(df: DataFrame, _: int) -> None:
        write(materialised(merge(read(), df)))

    return stream.writeStream.foreachBatch(batch)
