"""Mixing sources to target weights with blocks, multinomial counts and index permutations.

1. A source's words lie end to end, its documents in the order of a hash, and are cut into blocks of equal length; the last one may be shorter. 2. The mix has so many slots of a block as the targets need. A source takes all of
its blocks as often as they fit its target, and of one more round as many as come nearest to what is left. 3. Slots are dealt to output shards: from the root of a binary tree over the shards,
each half's counts by source are drawn from a multinomial distribution over what the node holds (draws beyond that are drawn again), with a generator seeded by the node. So each shard finds its counts, and how many slots of each
source come before it, on its own, and the totals are exact. 4. A source's slot of index i reads the block that a pseudorandom permutation (a Feistel network, one per source and round) gives for i; a shorter last block comes last in its round. Slots and
blocks are joined by source and block.

No block is read more often than its source's rounds, so no document is taken beyond most times its size. Null texts count as empty; documents without words have size 0 and are taken 0 times. Null sources are one source, the last.
Very long documents are cut into blocks like others. Rows that share an id are rows of their own; of equal rows, which comes first makes no difference. An empty table gives an empty result. Other columns are ignored. Sources are the
entries of a mix: their totals, max_sources rows at most, go through the driver; a table with more is refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.shared import WS, text_or_empty, written

SLOTS = "shard long, slot long, number int, round int, block long"


def shares(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Targets by weight of all sizes, none above most times its source's size; the excess is shared again by weight until none is."""
    target, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in open_:
                target[k] = left * weights[k] / whole
            break
        for k in over:
            target[k] = most * sizes[k]
        left -= sum(target[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return target


def slots_of(size: int, target: float, block: int) -> int:
    """How many slots come nearest to the target: whole rounds, and blocks of another."""
    if not size:
        return 0
    blocks = -(-size // block)
    rounds = int(target // size)
    rest = target - rounds * size
    more = min(blocks, int(rest / block + 0.5))
    if more == blocks or abs(size - rest) < abs(more * block - rest):
        rounds, more = rounds + (size - rest < rest), 0
    return rounds * blocks + more


def drawn(rng: np.random.Generator, n: int, held: np.ndarray) -> np.ndarray:
    """n slots by source, drawn by what is held; what a draw has beyond it is drawn again from what is left."""
    if n >= held.sum():
        return held.copy()
    got = np.zeros_like(held)
    while n:
        room = held - got
        more = np.minimum(rng.multinomial(n, room / room.sum()), room)
        got += more
        n -= int(more.sum())
    return got


def shard_counts(totals: Sequence[int], shards: int, shard_slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before the shard, slots of each source in it)."""
    held, before, low, high = np.array(totals, np.int64), np.zeros(len(totals), np.int64), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        left = drawn(np.random.default_rng([seed, low, high]), (middle - low) * shard_slots, held)
        if shard < middle:
            held, high = left, middle
        else:
            before, held, low = before + left, held - left, middle
    return before, held


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0 to size - 1, one for each key: a Feistel network over the least even number of bits, walked until it is back within size."""
    half = np.ceil(np.ceil(np.log2(np.maximum(size, 2))) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        a, b = x >> h, x & m
        for r in range(rounds):
            mixed = (b + key[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            a, b = b, a ^ (mixed & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def blocks_of(number: np.ndarray, index: np.ndarray, sizes: np.ndarray, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(round, block) of the slots by source number and index among the source's slots."""
    count, full = -(-sizes // block), sizes // block
    turn, at = index // count[number], index % count[number]
    inside = at < full[number]
    key = np.random.default_rng([seed, 1]).integers(1 << 62, size=len(sizes), dtype=np.uint64)[number] + turn.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    out = at.copy()
    out[inside] = permuted(at[inside], full[number[inside]], key[inside])
    return turn, out


def laid_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_text: bool = True) -> DataFrame:
    """doc_id, source, size, start (words of the source before the document), place (documents of the source before it), and text."""
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(F.array_remove(F.split(text, WS, -1), "")).cast("long").alias("size"),
                      F.xxhash64(F.col(id_col), text).alias("order"), *([text.alias("text")] if with_text else []))
    order = ["order", "doc_id", "size"]
    dealt = written(own.repartitionByRange("source", *order).withColumn("range", F.spark_partition_id()))
    inner = Window.partitionBy("range", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    zero = lambda c: F.coalesce(c, F.lit(0))
    ahead = dealt.groupBy("range", "source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    ahead = ahead.select(F.col("range").alias("of"), F.col("source").alias("name"), zero(F.sum("words").over(outer)).alias("words"), zero(F.sum("rows").over(outer)).alias("rows"))
    inside = dealt.select("*", zero(F.sum("size").over(inner)).alias("start"), F.count("*").over(inner).alias("place"))
    joined = inside.join(ahead, (F.col("range") == F.col("of")) & F.col("source").eqNullSafe(F.col("name")))
    return joined.select("doc_id", "source", "size", (F.col("start") + F.col("words")).alias("start"), (F.col("place") + F.col("rows")).alias("place"), *(["text"] if with_text else []))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0, block: int = 64,
                shard_slots: int = 16384, seed: int = 42, max_sources: int = 100_000, with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(mix, documents).

    mix: shard, slot, source, round, block, number, place, doc_id, first (the piece's first word in its document), words, and text (the words with one space between): a row for each document's piece of each slot, so that
    shard, slot and first word order the mixed tokens. documents: laid_out() with number, source_size and target. Weights go to the sources by code point, null last, and repeat.
    """
    spark = docs.sparkSession
    placed = written(laid_out(docs, id_col, text_col, source_col, with_text))
    totals = placed.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.asc_nulls_last("source")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = np.array([r["size"] for r in totals], np.int64)
    targets = shares(sizes.tolist(), [weights[k % len(weights)] for k in range(len(sizes))], most)
    slots = [slots_of(s, t, block) for s, t in zip(sizes.tolist(), targets)]
    shards = -(-sum(slots) // shard_slots)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                before, counts = shard_counts(slots, shards, shard_slots, shard, seed)
                number = np.repeat(np.arange(len(counts)), counts)
                index = np.concatenate([b + np.arange(c) for b, c in zip(before, counts)])
                order = np.random.default_rng([seed, 2, shard]).permutation(len(number))
                number, index = number[order], index[order]
                turn, at = blocks_of(number, index, sizes, block, seed)
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(number)), "number": number.astype(np.int32), "round": turn.astype(np.int32), "block": at})

    mix_slots = spark.range(0, shards, 1, max(1, min(shards, 10_000))).mapInPandas(deal, SLOTS)
    listed = spark.createDataFrame([(r["source"], k, int(sizes[k]), float(targets[k])) for k, r in enumerate(totals)], "name string, number int, source_size long, target double")
    documents = placed.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    stop = F.col("start") + F.col("size")
    each = documents.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    pieces = each.select("number", "block", "source", "place", "doc_id", (first - F.col("start")).alias("first"), (F.least(stop, (F.col("block") + 1) * block) - first).alias("words"), *(["text"] if with_text else []))
    if with_text:
        words = F.array_remove(F.split("text", WS, -1), "")
        pieces = pieces.withColumn("text", F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " "))
    # the planner takes the slots, which Python makes from a short range of shards, for a small table; they grow with the corpus
    return mix_slots.hint("merge").join(pieces, ["number", "block"]), documents


def mix_counts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    mix, documents = mix_sources(docs, with_text=False)
    taken = mix.groupBy("number", "place").agg(F.sum("words").alias("taken"))
    return documents.join(taken, ["number", "place"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
