"""Sums of outer products over a table, in two levels so that neither a task nor the driver holds more than a few matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram_sums(rows: DataFrame, width: int, weigh: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], by: str | None = None, slots: int = 32) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each value of by (0 if None): X'WX, X'r and a vector of totals.

    rows: x array<double> of `width`, y double, and the int column by. weigh(X, y) gives the weights W, the vector r, and any totals.
    A task sends one matrix per value of by; `slots` tasks add them up; the driver gets slots * values matrices of width^2 numbers.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
            y, keys = batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False)
            for key in np.unique(keys):
                own, target = x[keys == key], y[keys == key]
                w, r, totals = weigh(own, target)
                new = [own.T @ (own * w[:, None]), own.T @ r, totals]
                held[int(key)] = [a + b for a, b in zip(held[int(key)], new)] if int(key) in held else new
        for key, parts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *[pa.array([p.astype("<f8").tobytes()], pa.binary()) for p in parts]], ["k", "a", "b", "t"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        sums = [sum(np.frombuffer(v, "<f8") for v in frame[c]) for c in "abt"]
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "a": [sums[0].tobytes()], "b": [sums[1].tobytes()], "t": [sums[2].tobytes()]})

    schema = "k int, a binary, b binary, t binary"
    few = rows.select("x", F.col("y").cast("double"), (F.col(by).cast("int") if by else F.lit(0)).alias("k"))
    parts = few.mapInArrow(partial, schema).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(slots)))
    out: dict[int, list[np.ndarray]] = {}
    for row in sorted(parts.groupBy("k", "slot").applyInPandas(added, schema).collect(), key=lambda r: (r["k"], bytes(r["a"]))):
        new = [np.frombuffer(bytes(row[c]), "<f8") for c in "abt"]
        out[row["k"]] = [a + b for a, b in zip(out[row["k"]], new)] if row["k"] in out else new
    return {k: (a.reshape(width, width), b, t) for k, (a, b, t) in out.items()}
