"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into the fewest segments of which one must differ by at most one bit:
3 for 4 differing bits. Each segment is indexed once for each of its bits with that bit as a wildcard; equal
variants are joined and the whole fingerprints compared. A pair is only emitted at the first variant that it
shares, so each link comes once. Only distinct fingerprints are joined: copies cost one row. A variant's key has 20 to 21 bits besides the
wildcard's place, so beyond some ten million distinct fingerprints candidates grow with the square of their number; that is the price of few segments.

Null and empty texts, and texts of white space only, have fingerprint zero and link like any other. Very long texts are hashed whole, in parts. Rows
that share a doc_id are rows of their own. Null ids are carried along and never name a group unless nothing
else does. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.shared import components, written

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority of each bit over the XXH64 of all word shingles; unsigned."""
    words = (text or "").encode().lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    hash_of = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 65536):
        hashes = np.array([hash_of(joined[a:b], seed) for a, b in zip(starts[at:at + 65536], stops[at:at + 65536])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, "doc_id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(start, stop) of the fewest near-equal segments of which one has at most one of max_bits differing bits."""
    count = max_bits // 2 + 1
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return list(zip(edges, edges[1:]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(classes: DataFrame, max_bits: int = 4) -> DataFrame:
    """(rep, fp) with distinct fp -> (a, b), a < b: all pairs whose fingerprints differ in at most max_bits bits."""
    parts = segments(max_bits)
    whole = [_signed(sum(1 << i for i in range(lo, hi))) for lo, hi in parts]
    part_of = [k for k, (lo, hi) in enumerate(parts) for _ in range(lo, hi)]
    wild = [_signed(sum(1 << i for i in range(*parts[part_of[p]]) if i != p)) for p in range(BITS)]
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    variants = classes.select("rep", "fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("wildcard")).select(
        "rep", "fp", "wildcard", F.col("fp").bitwiseAND(pick([F.lit(w).cast("long") for w in wild], F.col("wildcard"))).alias("rest"))
    a, b = variants.alias("a"), variants.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    at = F.col("a.wildcard")

    def first_shared() -> Column:
        here = F.lit(False)
        for k, (lo, hi) in enumerate(parts):
            earlier = F.lit(True)
            for mask in whole[:k]:
                earlier &= F.bit_count(differ.bitwiseAND(F.lit(mask).cast("long"))) > 1
            here |= at.between(lo, hi - 1) & earlier & ((at == lo) | (differ.bitwiseAND(F.lit(whole[k]).cast("long")) != 0))
        return here

    # Spark takes what explode makes for as small as the fingerprints, so without the hint the driver would gather 64 rows of each
    joined = a.join(b.hint("merge"), (F.col("a.wildcard") == F.col("b.wildcard")) & (F.col("a.rest") == F.col("b.rest"))
                    & (F.col("a.rep") < F.col("b.rep")) & (F.bit_count(differ) <= max_bits) & first_shared())
    return joined.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach), component (smallest fingerprint that they reach): one row per row of docs.

    component tells apart components whose smallest ids are equal, as ids may repeat.
    """
    table = written(fingerprints(docs, id_col, text_col, shingle))
    classes = written(table.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = components(links(classes.select(F.col("fp").alias("rep"), "fp"), max_bits))
    named = classes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.select("fp", "component").join(least, "component")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0").alias(c if c == "component" else "fingerprint")
    return table.join(named, "fp").select("doc_id", digits("fp"), "component_id", digits("component"))
