"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document's cost is estimated as linear plus quadratic in its pieces' lengths: attention works within a piece.
Whole sequences are cut off long documents first; what remains of each is assigned in descending order
of length to the sequence of least cost that has room, and what fits nowhere whole is cut over the
sequences with most room. Each task packs its own rows in pools of bounded token count and carries its unfinished
sequence from pool to pool, so nothing is shuffled and a task pads at most one sequence.

Null texts count as empty; each document ends with the end id, so an empty one is one token long; very long ones fill sequences of their own first. Of equal lengths the first row goes first, of equal costs the first sequence. Rows that share
an id are packed as rows of their own; null ids are carried along. An empty table gives an empty result. Other
columns are ignored. Sequence ids are unique; they number the sequences of a task within a range of its own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.byte_tokens import byte_tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cost(length: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> float:
    return linear * length + quadratic * length * length


def pack_lengths(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (item, start, length, sequence, offset) and the number of sequences; all but one sequence are full.

    ceil(total / capacity) sequences are opened, so a greedy pass that finds no room for a whole piece
    can always cut it over the room that is left.
    """
    pieces, sequence, tails = [], 0, []
    for item, length in enumerate(lengths):
        at = 0
        while length - at >= capacity:
            pieces.append((item, at, capacity, sequence, 0))
            at, sequence = at + capacity, sequence + 1
        if at < length:
            tails.append((length - at, item, at))
    count = -(-sum(t[0] for t in tails) // capacity)
    used = [0] * count
    tails.sort(key=lambda t: (-t[0], t[1]))
    whole, waiting = placed(tails, used, capacity)
    pieces += [(item, start, length, sequence + k, offset) for item, start, length, k, offset in whole]
    rooms = sorted((k for k in range(count) if used[k] < capacity), key=lambda k: (used[k], k), reverse=True)
    for length, item, start in waiting:
        while length:
            k = rooms[-1]
            part = min(length, capacity - used[k])
            pieces.append((item, start, part, sequence + k, used[k]))
            used[k] += part
            start, length = start + part, length - part
            if used[k] == capacity:
                rooms.pop()
    # what room is left goes to as few sequences as it can: fill the rest from the last ones
    return _tightened(pieces, used, sequence, capacity), sequence + count


def placed(tails: list[tuple[int, int, int]], used: list[int], capacity: int) -> tuple[list, list]:
    """Whole pieces (item, start, length, sequence, offset), each in the sequence of least cost of all that have room, and the tails that fit nowhere; fills used.

    Sequences lie in a heap by cost for each room that is left; a tree over the rooms holds the least of each range of them.
    """
    none = (float("inf"), -1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    tree = [none] * (2 * capacity + 2)

    def refresh(room: int) -> None:
        at = room + capacity + 1
        tree[at] = heaps[room][0] if heaps[room] else none
        while at > 1:
            at //= 2
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    heaps[capacity] = [(0.0, k) for k in range(len(used))]
    refresh(capacity)
    pieces, waiting = [], []
    for length, item, start in tails:
        best, low, high = none, length + capacity + 1, 2 * capacity + 2
        while low < high:
            if low & 1:
                best, low = min(best, tree[low]), low + 1
            if high & 1:
                high -= 1
                best = min(best, tree[high])
            low, high = low // 2, high // 2
        spent, k = best
        if k < 0:
            waiting.append((length, item, start))
            continue
        room = capacity - used[k]
        heapq.heappop(heaps[room])
        refresh(room)
        pieces.append((item, start, length, k, used[k]))
        used[k] += length
        if used[k] < capacity:
            heapq.heappush(heaps[room - length], (spent + cost(length), k))
            refresh(room - length)
    return pieces, waiting


def _tightened(pieces: list, used: list[int], base: int, capacity: int) -> list:
    """Move tokens from the emptiest sequence into the room of the others until at most one isn't full."""
    short = sorted((k for k in range(len(used)) if used[k] < capacity), key=lambda k: (used[k], k))
    if len(short) < 2:
        return pieces
    donor = base + short[0]
    moving = sorted((p for p in pieces if p[3] == donor), key=lambda p: p[4])
    pieces = [p for p in pieces if p[3] != donor]
    for k in short[1:]:
        while used[k] < capacity and moving:
            item, start, length, _, _ = moving.pop()
            part = min(length, capacity - used[k])
            pieces.append((item, start + length - part, part, base + k, used[k]))
            used[k] += part
            if part < length:
                moving.append((item, start, length - part, donor, 0))
    at = 0
    for item, start, length, _, _ in moving:
        pieces.append((item, start, length, donor, at))
        at += length
    return pieces


def cost_packing(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = 1024, end_id: int = 0, pool_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(json_path, ranks_path)
        ending = np.array([end_id], "<u4").tobytes()
        pool, size, first = [], 0, TaskContext.get().partitionId() << 40
        held: list = []  # pieces of the unfinished sequence
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.encode(text.as_py() or "") + ending
                pool.append((doc, ids, 0))
                size += len(ids) // 4
                if size >= pool_tokens:
                    out, held, first = flush(pool, held, first, False)
                    yield out
                    pool, size = [], 0
        if pool or held:
            out, _, _ = flush(pool, held, first, True)
            yield out
        tokens.words.clear()  # the worker goes on to other tasks

    def flush(pool: list, held: list, first: int, last: bool):
        """Held pieces take part as items of their own that keep their place in their document."""
        items = [(doc, ids, at, at + length) for doc, ids, at, length in held] + [(doc, ids, at, len(ids) // 4) for doc, ids, at in pool]
        pieces, count = pack_lengths([stop - at for _, _, at, stop in items], capacity)
        fill = [0] * count
        for p in pieces:
            fill[p[3]] += p[2]
        left, rows, number = [], [], {}
        for item, start, length, sequence, offset in pieces:
            doc, ids, at, _ = items[item]
            if fill[sequence] < capacity and not last:
                left.append((doc, ids, at + start, length))
                continue
            own = ids[4 * (at + start): 4 * (at + start + length)]
            rows.append((doc, at + start, length, zlib.crc32(own), len(ids) // 4, first + number.setdefault(sequence, len(number)), offset))
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], _NAMES)
        return batch, left, first + len(number)

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, SCHEMA)
