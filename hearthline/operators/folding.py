"""State machines folded over each key's rows in order, with memory for one state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold_by_key(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple | None]], schema: str) -> DataFrame:
    """For each row, in order within its keys, step(state, row) -> (new state, output row or None); rows are tuples, keys must be the first columns.

    Rows are dealt by key and sorted; a task passes through them batch by batch, so a key with very many rows needs no more memory
    than others. The fold itself is sequential within a key.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch[c].tolist() for c in batch.columns)):
                own = row[:len(keys)]
                if own != key:
                    key, state = own, start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
