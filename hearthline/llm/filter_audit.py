"""Which filter removes what, in every order, by a Walsh-Hadamard audit.

Each document fails some of five filters: a mask of five bits. Per part and label, one pass sums 32 signed parities, (-1) to the number of bits that the mask shares with t, for each t. The transform
is its own inverse but for a factor of 32, so the counts of the 32 masks come back exactly, and the 120 orders are evaluated on them: a filter removes the masks that have its bit and none of an earlier one's. Over all
orders a document with k failures is removed by each of them in 120 / k orders, which gives the Shapley sums in closed form.

Copies: equal texts fail the first four filters alike, so documents are grouped by text, part and labels before they are compared with the smallest id of their text; a text that very many documents share costs each task
a few rows. Rows that share the smallest id all pass; rows with a null id pass the copy filter and have no labels. Null texts count as empty, null parts as the empty string, and very long texts are judged whole. Of several labels of one id, any counts.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.shared import WS, text_or_empty, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
SERIES = ("documents", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails: short, repetitive, in capitals, with symbols."""
    words = F.array_remove(F.split(text, WS, -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = (n < 200, distinct * 100 < n * 50, capitals * 100 > F.length(text) * 2, text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, good, toxic, mask, n): documents by what they fail; several rows may hold counts of one mask."""
    text = text_or_empty(text_col)
    judged = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("mask")))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1)).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    named = judged.where("doc_id is not null").join(known, "doc_id", "left").unionByName(judged.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    named = named.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["digest", "part", "good", "toxic"]
    rows = named.groupBy(*kind, "doc_id").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    classes = rows.groupBy(*kind).agg(F.first("mask").alias("mask"), F.sum("n").alias("n"), least, nameless)
    smallest = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a digest has as many rows as parts and labels at most
    first = F.col("nameless") + F.when(F.col("least.doc_id") == smallest, F.col("least.n")).otherwise(0)
    split = classes.withColumn("first", first).select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))))
    return split.where("n > 0")


def parity_sums(counted: DataFrame) -> DataFrame:
    """part and, for each series, an array of 32 sums of n with the sign of the mask's parity under t."""
    sign = lambda t: 1 - 2 * F.bit_count(F.col("mask").bitwiseAND(F.lit(t))).bitwiseAND(F.lit(1))
    of = {"documents": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    summed = counted.groupBy("part").agg(*[F.sum(of[s] * sign(t)).alias(f"{s}{t}") for s in SERIES for t in range(MASKS)])
    return summed.select("part", *[F.array(*[F.col(f"{s}{t}") for t in range(MASKS)]).alias(s) for s in SERIES])


def cells(sums: np.ndarray) -> np.ndarray:
    """Counts by mask from parity sums, along the last axis: butterflies, then an exact division."""
    out = np.array(sums, np.int64)
    half = 1
    while half < MASKS:
        pairs = out.reshape(*out.shape[:-1], -1, 2, half)
        out = np.stack((pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]), axis=-2).reshape(out.shape)
        half *= 2
    if (out % MASKS).any():
        raise ArithmeticError("these are not parity sums of counts")
    return out // MASKS


def steps() -> list[tuple[str, int, dict[str, np.ndarray]]]:
    """(order, step, weight of each mask in each count) of the 120 orders."""
    mask = np.arange(MASKS)
    failed = np.array([m.bit_count() for m in range(MASKS)])
    share = np.where(failed > 0, 120 // np.maximum(failed, 1), 0)
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            has, gone = (mask & bit) > 0, (mask & before) > 0
            removed = (has & ~gone).astype(np.int64)
            out.append(("".join(order), step, {"kept": (~has & ~gone).astype(np.int64), "removed": removed, "redundant": (has & gone).astype(np.int64), "unique_fails": (mask == bit).astype(np.int64), "good_lost": removed, "toxic_lost": removed, "shapley": has * share}))
            before |= bit
    return out


def audited(sums: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts: 600 rows per part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = steps()
        series = {"good_lost": "good", "toxic_lost": "toxic"}
        weights = {c: np.array([w[c] for _, _, w in plan]) for c in COUNTS}
        orders, numbers = pa.array([o for o, _, _ in plan]), pa.array([s for _, s, _ in plan], pa.int32())
        for batch in batches:
            for k, part in enumerate(batch.column("part").to_pylist()):
                by_mask = {s: cells(np.array(batch.column(s)[k].as_py())) for s in SERIES}
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(plan)), orders, numbers, *[pa.array(weights[c] @ by_mask[series.get(c, "documents")]) for c in COUNTS]], ["part", "filter_order", "step", *COUNTS])

    return sums.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audited(parity_sums(masks(docs, labels, id_col, text_col, part_col)))
