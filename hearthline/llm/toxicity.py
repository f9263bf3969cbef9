"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Documents are learnt from by the presence of character n-grams (4 to 10 characters of the lower-cased text, within a word and the
spaces around it). Spark counts, for each n-gram, the toxic and the clean training documents that hold it; the
likelihood ratio of the counts selects features; a logistic regression on presence times log-count ratio is fitted on the driver. Scoring reads every whole text.

Bounds, all of training: it reads at most max_rows labelled rows (chosen by the ids' hash), an n-gram has to be in least_documents of them and to pass a likelihood-ratio test at `least` (9: one in 370 by chance), and of those that do the
max_features with the greatest ratio are used, of equal ratios the ones with the smallest hash.

Null and empty texts have no features and get the score of the intercept. Very long texts are read in parts. Of several rows with one labelled id the text with the smallest hash is learnt from; several labels of one id count as toxic if one is.
Null labels and labels without a document are ignored, and so are null ids. Without rows of both classes every score is 0; without a feature it is the share of toxic rows. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.shared import text_or_empty, written
from hearthline.llm.word_hashes import mixed

SIZES = (4, 5, 6, 8, 10)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


def _grams(text: str | None, inside: bool = False) -> Iterator[np.ndarray]:
    """For each n a 64-bit hash of each n-gram of the text; with repeats. inside: only those within a word and its borders."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), "<u4")
    raw = np.where((raw >= 9) & (raw <= 13), np.uint32(32), raw)
    step = 1 << 18
    for at in range(0, len(raw), step):
        part = raw[at:at + step + SIZES[-1] - 1].astype(np.uint64) + np.uint64(1)
        spaces = np.concatenate(([0], np.cumsum(part == 33)))
        key = np.zeros(len(part) + 1, np.uint64)
        for n in range(1, min(SIZES[-1], len(part)) + 1):
            key = key[:len(part) - n + 1] * _MULTIPLIER + part[n - 1:]
            if n in SIZES:
                within = spaces[n - 1:-1] == spaces[1:len(part) - n + 2]  # no space but at the ends
                yield mixed((key[:step][within[:step]] if inside else key[:step]) + np.uint64(n))


def gram_set(text: str | None) -> np.ndarray:
    """The n-grams within words. Scoring needn't leave out the others: a model has none of them."""
    parts = [np.unique(g) for g in _grams(text, True)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float
    trained: bool

    def table(self) -> np.ndarray:
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[_slot(self.keys)] = True
        return seen

    def score(self, text: str | None, table: np.ndarray) -> float:
        if not self.trained:
            return 0.0
        hits = []
        for keys in _grams(text) if len(self.keys) else ():
            some = np.unique(keys[table[_slot(keys)]])
            at = np.searchsorted(self.keys, some)
            at[at == len(self.keys)] = 0
            hits.append(at[self.keys[at] == some])
        found = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[found].sum(), -35, 35))))


def _fit(rows: list[np.ndarray], toxic: np.ndarray, ratios: np.ndarray, strength: float, rounds: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by Newton steps, each solved by conjugate gradients; rows hold feature positions.

    The n-grams of one word are nearly the same feature, which plain gradient steps would take thousands of rounds for.
    """
    n, k = len(rows), len(ratios)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    where = np.concatenate(rows) if n else np.zeros(0, np.int64)
    value = ratios[where]
    ridge = np.append(np.full(k, strength), 1e-9)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, value * x[where], n) + x[k]

    def backward(e: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(where, value * e[owner], k), e.sum())

    def loss(x: np.ndarray) -> float:
        margin = forward(x)
        return float(np.logaddexp(0, margin).sum() - toxic @ margin + ridge @ (x * x) / 2)

    x = np.zeros(k + 1)
    x[k] = np.log((toxic.mean() + 1e-6) / (1 - toxic.mean() + 1e-6))
    now = loss(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(x), -35, 35)))
        slope, weight = backward(p - toxic) + ridge * x, p * (1 - p)
        step, left = np.zeros(k + 1), -slope
        way, size = left.copy(), left @ left
        for _ in range(100):
            if size <= 1e-4 * (slope @ slope):
                break
            bent = backward(weight * forward(way)) + ridge * way
            scale = size / (way @ bent)
            step, left = step + scale * way, left - scale * bent
            size, before = left @ left, size
            way = left + size / before * way
        part = 1.0
        while loss(x + part * step) > now and part > 1e-6:
            part /= 2
        x = x + part * step
        now, last = loss(x), now
        if last - now < 1e-7 * n:
            break
    return x[:k] * ratios, float(x[k])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = 16_000, max_features: int = 4096, least: float = 9.0, least_documents: int = 3, strength: float = 1.0, rounds: int = 40) -> Model:
    """Fit on at most max_rows of the labelled documents whose crc32(id) mod 5 isn't 0."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("d")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = marked.where(F.crc32(F.col("d").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("d"), "d").limit(max_rows)
    found = docs.select(F.col(id_col).alias("d"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "d")
    sample = written(found.groupBy("d", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                sets, marks = [], []
                for text, toxic in zip(batch.column(0).slice(at, 64), batch.column(1).slice(at, 64)):
                    sets.append(gram_set(text.as_py()))
                    marks.append(np.full(len(sets[-1]), toxic.as_py()))
                keys, inverse, total = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                bad = np.bincount(inverse, np.concatenate(marks), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(total - bad)], ["gram", "bad", "good"])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad_rows, good_rows = sizes.get(1, 0), sizes.get(0, 0)
    if not bad_rows or not good_rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, False)
    totals = sample.select("text", "toxic").mapInArrow(count, "gram long, bad long, good long").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = F.log((F.col("bad") + 0.5) / (bad_rows + 1) / ((F.col("good") + 0.5) / (good_rows + 1)))
    bad, good, rows = F.col("bad"), F.col("good"), float(bad_rows + good_rows)
    term = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * rows / (row * column))).otherwise(0.0)
    held, absent = bad + good, rows - bad - good
    likelihood = 2 * (term(bad, held, bad_rows) + term(good, held, good_rows) + term(bad_rows - bad, absent, bad_rows) + term(good_rows - good, absent, good_rows))
    best = totals.where(held >= least_documents).select("gram", ratio.alias("ratio"), likelihood.alias("likelihood")).where(F.col("likelihood") >= least)
    picked = sorted(best.orderBy(F.desc("likelihood"), "gram").limit(max_features).select("gram", "ratio").collect(), key=lambda r: r["gram"] % (1 << 64))
    keys = np.array([r["gram"] for r in picked], np.int64).view(np.uint64)
    if not len(keys):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(bad_rows / good_rows)), True)
    ratios = np.array([r["ratio"] for r in picked])

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.flatnonzero(np.isin(keys, gram_set(t.as_py()))).astype(np.int32) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), batch.column(1)], ["held", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(present, "held array<int>, toxic int").toArrow()
    held = [np.asarray(h.values.to_numpy(zero_copy_only=False), np.int64) for h in rows.column("held").combine_chunks()]
    weights, bias = _fit(held, rows.column("toxic").to_numpy().astype(float), ratios, strength, rounds)
    return Model(keys, weights, bias, True)


def toxicity_score(model: Model, text: str | Column) -> Column:
    """The probability of label 1, for a string column; a model is a few ten thousand numbers."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = model.table()
        for part in texts:
            yield part.map(lambda t: model.score(t, table)).astype(float)

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **training) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs. held_out is null for a null id, which is never learnt from."""
    model = train(docs, labels, id_col, text_col, **training)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", toxicity_score(model, "text").alias("score"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
