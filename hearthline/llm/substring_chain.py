"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds are word k-mers: the least of each `window` neighbours by hash, or all of them with window 1. 50 words of which 0.8 of the 5-word shingles are equal hold two equal stretches of 18 or more 5-mers in all (or a longer one),
so that at window 10 each gives a seed, and the two are within max_gap. For 0.8 of equal words instead (shingle 1), it takes all 4-mers: of n words with e edited ones at least n - 3 - 4e are left. 2. A seed at up to `most` places of the corpus is matched with each earlier one. A more frequent seed is paired with the next frequent one beside it,
the pairs are matched in that way, and so are pairs of frequent pairs; what is frequent is also matched with its first and its nearest earlier holder. Tasks match the frequent seeds of their own rows before
anything is shuffled and send on one place of each, so that a seed that every document holds comes to no task in full. 3. The matches of a document with an owner are chained in order: matches on one diagonal merge to runs, and each
run follows the best of the runs that end within max_gap of it on both sides, under a linear gap cost; Fenwick trees over slabs of the owner's words give the best one. 4. The words of both sides are fetched in fixed blocks, and each chain
is aligned: extended over its ends, and switched between its diagonals where that matches most. An alignment under the similarity is cut to its stretches that reach it. Passages are what alignments cover, min_words words or more.

A document's passages repeat text of documents with smaller ids, or earlier text of the document itself (of which they may overlap the end); without `within`, the latter only where it repeats another document too; copies thus are passages of their first holder's text.
Rows that share an id are documents of their own, told apart by text_key, a hash of the text; equal rows count once. Null and empty texts have no passages, and rows with a null id neither. Texts of any length are read whole, in parts of bounded size.
Of passages with equal claims the one of the smallest owner and place counts. Words are what stands between ASCII white space, A-Z lower-cased. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.shared import discard, written
from hearthline.llm.word_hashes import kmers, minimizers, mixed, word_hashes

_BLOCK = 64
_ROWS = 50_000  # rows of a batch that goes to the JVM
_HELD = 1 << 18  # places that a task holds before it matches the frequent ones among them
_MARGIN = 46  # words beyond a chain's ends that alignment may extend over: with the chain's least words they make a passage of 50
_PLAIN, _STANDS_FOR_MANY, _FREQUENT, _MATCH = range(4)
_PLACED = "kind int, h long, doc_id long, pos long, owner long, at long"


def text_key(text: str | Column) -> Column:
    """30 bits of a text's hash. A row's words are numbered from text_key * 2^32 on, so that rows which share an id lie apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 34)


def _batch(kind: int, rows: np.ndarray, owners: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Places, or matches with owners' places, in the columns of _PLACED."""
    for at in range(0, len(rows), _ROWS):
        part = rows[at:at + _ROWS]
        other = [pa.nulls(len(part), pa.int64())] * 2 if owners is None else [pa.array(owners[at:at + _ROWS, i]) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(3)), *other], ["kind", "h", "doc_id", "pos", "owner", "at"])


def _sorted_once(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))] if len(rows) else rows


def met(rows: np.ndarray, most: int, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices (later, earlier) of matched rows, of the rows of frequent hashes, and of the first one of each; rows (h, doc_id, pos, stands for many) in order.

    Rows of up to most with one hash are matched each with each. Of more, a text's first place is matched with the nearest earlier text's last one and with
    the first holder, and a later place with the one before. The first `known` rows stand for earlier rows of the first hash and are only matched with.
    """
    h, doc, base = rows[:, 0], rows[:, 1], rows[:, 2] >> 32
    new = np.concatenate(([True], h[1:] != h[:-1]))
    begins = new | np.concatenate(([True], (doc[1:] != doc[:-1]) | (base[1:] != base[:-1])))
    text = np.cumsum(begins)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(rows)))
    many = (sizes > most) | (np.add.reduceat(rows[:, 3], starts) > 0)
    many[:1] |= known > 0
    first, often = np.repeat(starts, sizes), np.repeat(many, sizes)
    at, later, earlier = np.flatnonzero(~often & np.repeat(sizes > 1, sizes)), [], []
    for back in range(1, most):
        at = at[at - back >= first[at]]
        later.append(at)
        earlier.append(at - back)
    often = np.flatnonzero(often)
    often = often[often >= known]
    after = often[often > first[often]]
    ahead = after[begins[after] & (text[after - 1] != text[first[after]])]
    return np.concatenate([*later, after, ahead]), np.concatenate([*earlier, after - 1, first[ahead]]), often, often[often == first[often]]


def combined(found: Iterator[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Places (h, doc_id, pos) as rows of _PLACED: what is frequent among a task's places is matched here, and one place of it is sent on."""
    def flush() -> Iterator[pa.RecordBatch]:
        rows = _sorted_once(np.concatenate(held))
        rows = np.column_stack([rows, np.zeros(len(rows), np.int64)])
        later, earlier, often, firsts = met(rows, most)
        many = np.zeros(len(rows), bool)
        many[often] = True
        yield from _batch(_PLAIN, rows[~many])
        yield from _batch(_STANDS_FOR_MANY, rows[firsts])
        here = many[later]
        yield from _batch(_MATCH, rows[later[here]], rows[earlier[here]])
        many[firsts] = False
        yield from _batch(_FREQUENT, rows[many])

    held, size = [], 0
    for rows in found:
        for at in range(0, len(rows), _HELD):
            held.append(rows[at:at + _HELD])
            size += len(held[-1])
            if size >= _HELD:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def seeds(docs: DataFrame, k: int = 4, window: int = 1, most: int = 16) -> DataFrame:
    """_PLACED of the seeds of docs (doc_id, base, text)."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for doc, base, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = kmers(word_hashes(text.as_py()), k)
                at = minimizers(own, window) if window > 1 else np.arange(len(own))
                yield np.column_stack([own[at].view(np.int64), np.full(len(at), doc, np.int64), base + at])

    return docs.select("doc_id", "base", "text").mapInArrow(lambda batches: combined(places(batches), most), _PLACED)


def meetings(found: DataFrame, most: int) -> DataFrame:
    """_PLACED rows of kind _MATCH (matches with earlier places) and _FREQUENT (places of frequent hashes) out of found rows of _PLACED."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros((0, 4), np.int64), 0  # rows of the last hash of a batch may go on in the next
        for batch in batches:
            kind = batch.column(0).to_numpy()
            settled = kind >= _FREQUENT
            if settled.any():
                yield batch.filter(pa.array(settled))
            rows = np.column_stack([*(batch.column(i).to_numpy(zero_copy_only=False)[~settled] for i in (1, 2, 3)), (kind[~settled] == _STANDS_FOR_MANY).astype(np.int64)])
            if not len(rows):
                continue
            rows = np.concatenate([held, rows])
            whole = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if whole:
                yield from matched(rows[:whole], known)
                held, known = rows[whole:], 0
            else:
                held = rows
            if len(held) > _HELD:
                yield from matched(held, known)
                held, known = held[[0, -1]], 2
        if len(held):
            yield from matched(held, known)

    def matched(rows: np.ndarray, known: int) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([rows[:known], rows[known:][np.concatenate(([True], (rows[known + 1:, :3] != rows[known:-1, :3]).any(axis=1)))]]) if len(rows) > known else rows
        later, earlier, often, _ = met(rows, most, known)
        yield from _batch(_MATCH, rows[later], rows[earlier])
        yield from _batch(_FREQUENT, rows[often])

    settled = F.col("kind") >= _FREQUENT
    placed = found.repartition(F.when(settled, F.xxhash64("doc_id", "pos")).otherwise(F.col("h"))).sortWithinPartitions("h", "doc_id", "pos")
    return placed.mapInArrow(run, _PLACED)


def neighbours(often: DataFrame, width: int, max_gap: int, most: int) -> DataFrame:
    """_PLACED of pairs of frequent places: each with the next one of its document that is width words on or more; the last 5 bits of h are the gap."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held = np.zeros((0, 3), np.int64)  # a pair may lie in two batches
        for batch in batches:
            rows = np.concatenate([held, np.column_stack([batch.column(i).to_numpy() for i in range(3)])])
            if not len(rows):
                continue
            rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))]
            whole = len(rows) - int(((rows[:, 0] == rows[-1, 0]) & (rows[:, 1] >= rows[-1, 1] - max_gap)).sum())
            yield found(rows, whole)
            held = rows[whole:]
        yield found(held, len(held))

    def found(rows: np.ndarray, count: int) -> np.ndarray:
        doc, pos, h = rows.T
        at = np.arange(count)
        then = at.copy()
        for _ in range(width):  # positions of a document grow, so the next one width words on is at most width rows away
            then = np.where((then < len(rows) - 1) & (doc[then] == doc[:count]) & (pos[then] < pos[:count] + width), then + 1, then)
        gap = pos[then] - pos[:count]
        good = (doc[then] == doc[:count]) & (gap >= width) & (gap <= max_gap)
        at, then, gap = at[good], then[good], gap[good]
        key = mixed(mixed(h[at].view(np.uint64)) + h[then].view(np.uint64) * np.uint64(0xD1342543DE82EF95) + gap.view(np.uint64)).view(np.int64)
        return np.column_stack([(key & ~np.int64(31)) | gap, doc[at], pos[at]])

    if max_gap >= 32:
        raise ValueError("max_gap has to be under 32")
    placed = often.select("doc_id", "pos", "h").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    return placed.mapInArrow(lambda batches: combined(pairs(batches), most), _PLACED)


def matches(found: DataFrame, k: int = 4, max_gap: int = 24, most: int = 16, used: list[str] | None = None) -> DataFrame:
    """(doc_id, pos, owner, at, gap): each seed with the earlier places that hold it; a pair's match is one of gap words further on too, and has gap 0 if there is none.

    Seeds at up to most places are matched with all of them. More frequent ones are paired with their next frequent neighbour, frequent pairs with the next
    frequent pair, and both are matched in the same way; what is frequent is also matched with its first and its nearest earlier holder. The tables that it reads are added to used.
    """
    level = written(meetings(found, most), used)
    match, gap = F.col("kind") == _MATCH, F.col("h").bitwiseAND(F.lit(31)).cast("int").alias("gap")
    out, width = level.where(match).select("doc_id", "pos", "owner", "at", F.lit(0).alias("gap")), k
    while 2 * width <= max_gap:
        level = written(meetings(neighbours(level.where(F.col("kind") == _FREQUENT), width, max_gap, most), most), used)
        out, width = out.unionByName(level.where(match).select("doc_id", "pos", "owner", "at", gap)), 2 * width
    return out


def diagonal_runs(x: np.ndarray, y: np.ndarray, k: int, apart: int) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, seeds) of matches that follow each other on a diagonal as they do in equal text, at most apart words on, in order of x0; x1, y1 past the end."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    cut = np.flatnonzero((np.diff(y - x) != 0) | (np.diff(x) > apart)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(x) - 1]))
    return sorted((int(x[a]), int(y[a]), int(x[b]) + k, int(y[b]) + k, int(b - a + 1)) for a, b in zip(first, last))


class FenwickSlabs:
    """The best of the points whose y lies in a window and whose x isn't too old, points and questions coming in order of x.

    y is cut into slabs of `width` places with two Fenwick trees each, for the maximum from the slab's first place up and from its last place down. A node is a heap, so that points
    which have become too old fall out of it when they come up. A window wider than a slab is the end of one slab, whole slabs, and the beginning of another.
    """

    def __init__(self, width: int):
        self.width = width
        self.nodes: dict[tuple[int, int, int], list[tuple[int, int, int]]] = defaultdict(list)

    def add(self, x: int, y: int, value: int, name: int) -> None:
        slab, at = divmod(y, self.width)
        for side, node in ((0, at + 1), (1, self.width - at)):
            while node <= self.width:
                heapq.heappush(self.nodes[slab, side, node], (-value, x, name))
                node += node & -node

    def _most(self, slab: int, side: int, node: int, since: int) -> tuple[int, int, int] | None:
        best = None
        while node > 0:
            heap = self.nodes.get((slab, side, node))
            while heap and heap[0][1] < since:
                heapq.heappop(heap)
            if heap and (best is None or heap[0] < best):
                best = heap[0]
            node -= node & -node
        return best

    def best(self, low: int, high: int, since: int) -> tuple[int, int]:
        """(value, name) of the greatest value at low <= y <= high, x >= since; (0, -1) if there is none. high - low is width or more."""
        (first, a), (last, b) = divmod(low, self.width), divmod(high, self.width)
        found = [self._most(first, 1, self.width - a, since), self._most(last, 0, b + 1, since), *(self._most(slab, 0, self.width, since) for slab in range(first + 1, last))]
        found = [f for f in found if f is not None]
        return (-min(found)[0], min(found)[2]) if found else (0, -1)


def chains(runs: list[tuple[int, int, int, int, int]], max_gap: int, worth: int = 10, overlap: int = 3) -> list[list[int]]:
    """Collinear chains of runs, best first; each run is in one chain. Runs are in order of x0 and longer than overlap.

    Each word of a run counts `worth` points, each word of a gap on either side costs one; points are whole, as places are large numbers. A run may follow those that end within max_gap words before its start, on both sides; their ends may overlap its start by a few words.
    """
    slabs, score, back = FenwickSlabs(max_gap), [0] * len(runs), [-1] * len(runs)
    for at, asks, i in sorted([(r[2], 0, i) for i, r in enumerate(runs)] + [(r[0] + overlap, 1, i) for i, r in enumerate(runs)]):
        x0, y0, x1, y1, _ = runs[i]
        if asks:
            value, before = slabs.best(y0 - max_gap, y0 + overlap, x0 - max_gap)
            gain = value - (x0 + y0) if before >= 0 else 0
            score[i], back[i] = (worth * (x1 - x0) + gain, before) if gain > 0 else (worth * (x1 - x0), -1)
        else:
            slabs.add(x1, y1, score[i] + x1 + y1, i)
    used, out = set(), []
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        line = []
        while i >= 0 and i not in used:
            used.add(i)
            line.append(i)
            i = back[i]
        if line:
            out.append(line[::-1])
    return out


def chained(matched: DataFrame, k: int, window: int, max_gap: int, least_seeds: int) -> DataFrame:
    """(doc_id, owner, x0, runs): a row per chain; runs holds x0, y0, x1, y1 of each run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)  # rows of the last owner of a batch may go on in the next
        for batch in batches:
            rows = np.concatenate([held, np.column_stack([batch.column(i).to_numpy() for i in range(5)])])
            if not len(rows):
                continue
            other = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            whole = int(other[-1]) + 1 if len(other) else 0
            held = rows[whole:]
            yield table(rows[:whole])
        yield table(held)

    def table(rows: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        if len(rows):
            on = rows[rows[:, 4] > 0]
            rows = np.concatenate([rows[:, :4], on[:, :4] + on[:, 4:] * np.array([0, 0, 1, 1])])
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
            rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))]
            starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
            sizes = np.diff(np.append(starts, len(rows)))
            enough = sizes >= least_seeds
            two = starts[enough & (sizes == 2)]  # two matches that lie too far apart make no chain
            enough[enough & (sizes == 2)] = (np.abs(rows[two + 1, 2:] - rows[two, 2:]) <= max_gap + k).all(axis=1)
            for a, n in zip(starts[enough].tolist(), sizes[enough].tolist()):
                part = rows[a:a + n]
                runs = diagonal_runs(part[:, 2], part[:, 3], k, max(k, window))
                for line in chains(runs, max_gap) if len(runs) > 1 else [[0]]:
                    if sum(runs[i][4] for i in line) >= least_seeds:
                        out.append((int(part[0, 0]), int(part[0, 1]), runs[line[0]][0], [v for i in line for v in runs[i][:4]]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], ["doc_id", "owner", "x0", "runs"])

    sorted_rows = matched.select("doc_id", "owner", "pos", "at", F.col("gap").cast("long")).repartition("doc_id").sortWithinPartitions("doc_id", "owner")
    return sorted_rows.mapInArrow(run, "doc_id long, owner long, x0 long, runs array<long>")


def _stretches(equal: np.ndarray, least: int, similarity: float) -> list[tuple[int, int]]:
    """What the spans of least columns or more cover that begin and end with an equal one and have a share of similarity or more of equal ones."""
    at = np.flatnonzero(equal)
    if len(at) < similarity * least:
        return []
    over = np.concatenate(([0.0], np.cumsum(equal - similarity)))
    before, after = over[at], over[at + 1]
    furthest = np.maximum.accumulate(after[::-1])[::-1]
    last = at[np.searchsorted(-furthest, -before + 1e-9, side="right") - 1] + 1
    good = last - at >= least
    out: list[tuple[int, int]] = []
    for a, b in zip(at[good].tolist(), last[good].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _grown(equal: np.ndarray) -> int:
    """How many columns to go on for, so that equal ones outweigh others most at three to one."""
    if not len(equal):
        return 0
    gain = np.where(equal, 1, -3).cumsum()
    best = int(gain.argmax())
    return best + 1 if gain[best] > 0 else 0


def _sums(values: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _shingles(equal: np.ndarray, size: int) -> np.ndarray:
    """Of each run of size columns whether all are equal."""
    out = equal[:max(0, len(equal) - size + 1)].copy()
    for i in range(1, size):
        out &= equal[i:len(equal) - size + 1 + i]
    return out


Columns = list[tuple[np.ndarray, int, int]]  # stretches of alignment columns: whether words are equal, and whether a column takes a word of the left and of the right side


def _outward(u: np.ndarray, v: np.ndarray) -> tuple[Columns, int]:
    """Columns from two places on, and how many of them to keep: words on one diagonal while that pays, then on one up to 3 words beside it whose next words are equal."""
    out: Columns = []
    i = j = kept = done = 0
    while True:
        n = min(len(u) - i, len(v) - j)
        equal = u[i:i + n] == v[j:j + n]
        grown = _grown(equal)
        done += grown
        if grown:
            out.append((equal[:grown], 1, 1))
            i, j, kept = i + grown, j + grown, done
        for s in (1, -1, 2, -2, 3, -3):
            a, b = i + max(0, -s), j + max(0, s)
            if a < len(u) and b < len(v) and u[a] == v[b]:
                m = min(len(u) - a, len(v) - b)
                if m > 3 * abs(s) and np.where(u[a:a + m] == v[b:b + m], 1, -3).cumsum().max() > 3 * abs(s):
                    out.append((np.zeros(abs(s), bool), int(s < 0), int(s > 0)))
                    i, j, done = a, b, done + abs(s)
                    break
        else:
            out.append((equal[grown:], 1, 1))
            return out, kept


def _bridge(u: np.ndarray, v: np.ndarray) -> Columns:
    """The columns that align two short stretches whole: two points for equal words, minus one for others, minus two for a word of one side only."""
    a, b = u.tolist(), v.tolist()
    rows = [[-2 * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        before, row = rows[-1], [-2 * i]
        for j, y in enumerate(b):
            row.append(max(before[j] + (2 if x == y else -1), before[j + 1] - 2, row[j] - 2))
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((np.array([a[i] == b[j]]), 1, 1))
        elif i and rows[i][j] == rows[i - 1][j] - 2:
            i -= 1
            out.append((np.zeros(1, bool), 1, 0))
        else:
            j -= 1
            out.append((np.zeros(1, bool), 0, 1))
    return out[::-1]


def aligned(runs: list[int], left: tuple[int, np.ndarray], right: tuple[int, np.ndarray], least: int = 50, similarity: float = 0.8, shingle: int = 1) -> list[tuple[int, int, int, int, int, int]]:
    """(x0, x1, y0, y1, equal, all) of the parts of a chain that reach the similarity; left and right are the first word's position and the words of either side.

    equal and all count shingles of aligned words. Ends lie where equal words outweigh others three to one. An alignment of fewer than least words is extended further, to the span of least
    words or more with the greatest share of equal shingles. One under the similarity gives its stretches that reach it.
    """
    (lx, a), (ly, b) = left, right
    pieces = [tuple(runs[i:i + 4]) for i in range(0, len(runs), 4)]

    def same(x: int, y: int, n: int) -> np.ndarray:
        n = max(0, min(n, lx + len(a) - x, ly + len(b) - y))
        return a[x - lx:x - lx + n] == b[y - ly:y - ly + n]

    x, y = pieces[0][:2]
    before, grown = _outward(a[max(0, x - lx - _MARGIN):x - lx][::-1], b[max(0, y - ly - _MARGIN):y - ly][::-1])
    columns: Columns = [(equal[::-1], takes_x, takes_y) for equal, takes_x, takes_y in before[::-1]]
    size = sum(len(c[0]) for c in columns)
    first = size - grown
    x -= sum(len(equal) * takes_x for equal, takes_x, _ in columns)
    y -= sum(len(equal) * takes_y for equal, _, takes_y in columns)
    px = py = None
    for nx, ny, x1, y1 in pieces:
        if px is not None:
            overlap = max(0, px - nx, py - ny)
            nx, ny = nx + overlap, ny + overlap
            if nx >= x1:
                continue
            gap = min(nx - px, ny - py)  # on the old diagonal first, then on this one
            old, new = same(px, py, gap), same(nx - gap, ny - gap, gap)
            held = _sums(old) + _sums(new[::-1])[::-1]
            turn = int(held.argmax())
            skipped = nx - px - (ny - py)  # words of one side only
            if gap - held[turn] > 3:  # or on others in between
                columns += _bridge(a[px - lx:nx - lx], b[py - ly:ny - ly])
            else:
                columns += [(old[:turn], 1, 1), (np.zeros(abs(skipped), bool), int(skipped > 0), int(skipped < 0)), (new[turn:], 1, 1)]
        columns.append((same(nx, ny, x1 - nx), 1, 1))
        px, py = x1, y1
    after, grown = _outward(a[px - lx:px - lx + _MARGIN], b[py - ly:py - ly + _MARGIN])
    last = sum(len(c[0]) for c in columns) + grown
    columns += after
    good = _shingles(np.concatenate([c[0] for c in columns]), shingle)
    total = _sums(good)
    sizes = [len(c[0]) for c in columns]
    if all(c[1] and c[2] for c in columns):  # one diagonal
        xs = x + np.arange(sum(sizes) + 1)
        ys = xs + (y - x)
    else:
        xs, ys = x + _sums(np.repeat([c[1] for c in columns], sizes)), y + _sums(np.repeat([c[2] for c in columns], sizes))

    def span(i: int, j: int) -> tuple[int, int, int, int, int, int]:
        return int(xs[i]), int(xs[j]), int(ys[i]), int(ys[j]), int(total[j - shingle + 1] - total[i]), int(words(i, j)) - shingle + 1

    def words(i: int, j: int) -> np.ndarray:
        return np.maximum(xs[j] - xs[i], ys[j] - ys[i])

    if (short := least - int(words(first, last))) > 0:
        if total[-1] < similarity * (least - shingle + 1):
            return []
        i, j = np.arange(max(0, first - short), first + 1)[::-1, None], np.arange(last, min(len(xs) - 1, last + short) + 1)[None, :]
        length = words(i, j)
        share = np.where(length >= least, (total[j - shingle + 1] - total[i]) / (length - shingle + 1), 0)
        at = np.unravel_index(int(share.argmax()), share.shape)
        return [span(int(i[at[0], 0]), int(j[0, at[1]]))] if share[at] >= similarity else []
    whole = span(first, last)
    if whole[4] >= similarity * whole[5]:
        return [whole]
    return [span(first + i, first + j + shingle - 1) for i, j in _stretches(good[first:last - shingle + 1], least - shingle + 1, similarity)]


def _bytes(values: pa.Array) -> Iterator[bytes]:
    """The values of a binary array; null is empty."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1].tolist() if len(values) else [0]
    whole = memoryview(data) if data is not None else memoryview(b"")
    return (bytes(whole[a:b]) for a, b in zip(ends, ends[1:]))


def _blocks(low: Column, high: Column) -> Column:
    """Numbers of the blocks from _MARGIN words before low to as many after high, none of them of another text."""
    start = F.shiftleft(F.shiftright(low, 32), 32)
    return F.sequence(F.shiftright(F.greatest(low - _MARGIN, start), 6), F.shiftright(high + _MARGIN, 6))


def alignments(docs: DataFrame, candidates: DataFrame, least: int = 50, similarity: float = 0.8, shingle: int = 1) -> DataFrame:
    """(doc_id, x0, x1, owner, y0, y1, equal, all) of chains; docs (doc_id, base, text)."""
    ends = candidates.select("*", F.element_at("runs", -2).alias("x1"), F.element_at("runs", 2).alias("y0"), F.element_at("runs", -1).alias("y1"))
    key = ["doc_id", "owner", "x0", "y0"]
    none = F.lit(None).cast("long")
    own = ends.select("doc_id", F.explode(_blocks(F.col("x0"), F.col("x1"))).alias("block")).distinct()
    own = own.select("doc_id", none.alias("owner"), none.alias("x0"), none.alias("y0"), F.lit(0).alias("side"), F.col("doc_id").alias("of"), "block")
    sides = own.unionByName(ends.select(*key, F.lit(1).alias("side"), F.col("owner").alias("of"), F.explode(_blocks(F.col("y0"), F.col("y1"))).alias("block")))
    needed = sides.select("of", "block").distinct().groupBy("of").agg(F.collect_list("block").alias("blocks"))  # a document has so many at most
    sides, needed = sides.hint("merge"), needed.hint("merge")  # blocks grow with the passages' lengths, which the planner doesn't see, so they aren't broadcast

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                part = batch.slice(at, 256)
                for doc, base, text, blocks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)):
                    words = word_hashes(text.as_py()).astype(np.uint32)
                    blocks = blocks.values.to_numpy()
                    for block in blocks[(blocks >= base // _BLOCK) & (blocks * _BLOCK < base + len(words))].tolist():
                        out.append((doc, block, words[block * _BLOCK - base:(block + 1) * _BLOCK - base].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], ["of", "block", "words"])

    words = docs.join(needed, docs.doc_id == needed.of).select("of", "base", "text", "blocks").mapInArrow(cut, "of long, block long, words binary")
    pieces = sides.join(words, ["of", "block"]).select(*key, "side", "block", "words", F.lit(None).cast("array<long>").alias("runs"))
    rows = pieces.unionByName(ends.select(*key, F.lit(2).alias("side"), none.alias("block"), F.lit(None).cast("binary").alias("words"), "runs"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, chain, out = None, None, []
        mine: dict[int, bytes] = {}
        theirs: dict[int, bytes] = {}
        for batch in batches:
            numbers = [pc.fill_null(batch.column(i), -1).to_numpy(zero_copy_only=False).tolist() for i in range(6)]  # to_pylist makes an object of each value first
            ends, held = batch.column(7).offsets.to_numpy(), batch.column(7).values.to_numpy(zero_copy_only=False)
            for row, (doc, owner, x0, y0, side, block, words) in enumerate(zip(*numbers, _bytes(batch.column(6)))):
                if of != doc:
                    of, mine = doc, {}
                if side == 0:
                    mine[block] = words
                    continue
                if chain != (doc, owner, x0, y0):
                    chain, theirs = (doc, owner, x0, y0), {}
                if side == 1:
                    theirs[block] = words
                    continue
                runs = held[ends[row]:ends[row + 1]].tolist()
                first = max(x0 - _MARGIN, x0 >> 32 << 32) // _BLOCK
                wanted = [mine[i] for i in range(first, (runs[-2] + _MARGIN) // _BLOCK + 1) if i in mine]
                if wanted and theirs:
                    left = first * _BLOCK, np.frombuffer(b"".join(wanted), np.uint32)
                    right = min(theirs) * _BLOCK, np.frombuffer(b"".join(theirs[i] for i in sorted(theirs)), np.uint32)
                    out += [(doc, a0, a1, owner, b0, b1, *counts) for a0, a1, b0, b1, *counts in aligned(runs, left, right, least, similarity, shingle)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 8)], ["doc_id", "x0", "x1", "owner", "y0", "y1", "equal", "all"])
            out = []

    placed = rows.repartition("doc_id").sortWithinPartitions(*key, "side", "block")  # a document's own blocks, which have no owner, come first
    return placed.mapInArrow(align, "doc_id long, x0 long, x1 long, owner long, y0 long, y1 long, equal long, all long")


def _across(found: DataFrame, least: int) -> DataFrame:
    """Alignments with other documents, and those with the same text of which the source repeats least words or more of another document itself, by way of others or not.

    A text's sources lie before what repeats them, so one pass over its alignments in order settles them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, covered = None, []  # ends of what is covered so far, in order
        for batch in batches:
            keep = []
            for doc, x0, x1, owner, y0, y1 in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if doc != of:
                    of, covered = doc, []
                own = owner == doc and x0 >> 32 == y0 >> 32
                first = bisect_left(covered, y0, key=lambda c: c[1])
                held = 0
                for a, b in covered[first:] if own else ():
                    if a >= y1:
                        break
                    held += min(b, y1) - max(a, y0)
                keep.append(not own or held >= least)
                if keep[-1]:
                    if covered and x0 <= covered[-1][1]:
                        covered[-1] = (covered[-1][0], max(covered[-1][1], x1))
                    else:
                        covered.append((x0, x1))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return found.repartition("doc_id").sortWithinPartitions("doc_id", "x0", "x1", "owner", "y0").mapInArrow(run, found.schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, window: int = 1, max_gap: int = 24,
                      least_seeds: int = 4, most: int = 16, similarity: float = 0.8, shingle: int = 1, min_words: int = 50, within: bool = True) -> DataFrame:
    """doc_id, text_key, start, n_words, first_doc_id, n_sources, similarity: one row per repeated passage, in words of the text."""
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    few = few.select("doc_id", F.shiftleft(text_key("text"), 32).alias("base"), "text")
    used: list[str] = []
    candidates = written(chained(matches(seeds(few, k, window, most), k, max_gap, most, used), k, window, max_gap, least_seeds))
    discard(docs.sparkSession, used)
    found = alignments(few, candidates, min_words, similarity, shingle)
    if not within:
        found = _across(found, min_words)
    by_doc = Window.partitionBy("doc_id").orderBy("x0", "x1", "owner", "y0")
    reach = F.max("x1").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("x0") > F.coalesce(reach, F.lit(-1)) + 1, 1).otherwise(0))
    numbered = marked.withColumn("passage", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = numbered.groupBy("doc_id", "passage").agg(
        F.min("x0").alias("x0"), (F.max("x1") - F.min("x0")).alias("n_words"), F.min("owner").alias("first_doc_id"), F.countDistinct("owner").alias("n_sources"),
        (F.sum("equal") / F.sum("all")).alias("similarity"))
    return merged.where(F.col("n_words") >= min_words).select(
        "doc_id", F.shiftright("x0", 32).alias("text_key"), F.col("x0").bitwiseAND(F.lit((1 << 32) - 1)).alias("start"), "n_words", "first_doc_id", "n_sources", "similarity")


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each passage cut out of its row's text; all columns stay. Rows with a null id or text stay as they are."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            if text is None or own is None or not len(own):
                out.append(text)
                continue
            words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
            kept, at = [], 0
            for span in sorted((s["start"], s["n_words"]) for s in own):
                first, last = span[0], min(span[0] + span[1], len(words)) - 1
                kept.append(text[at:words[first].start()])
                at = words[last].end()
            out.append("".join([*kept, text[at:]]))
        return pd.Series(out, dtype=object)

    spans = passages.groupBy(F.col("doc_id").alias("of"), "text_key").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"))).alias("spans"))
    spans = spans.hint("merge")  # passages grow with the documents, so they aren't broadcast
    rows = docs.select(docs[id_col].alias("id"), text_key(docs[text_col]).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # a struct, whatever its columns are called
    joined = rows.join(spans, (rows["id"] == spans["of"]) & (rows["key"] == spans["text_key"]), "left")
    text = F.col("row")[text_col]
    changed = F.when(F.col("spans").isNull(), text).otherwise(cut(text, F.col("spans"))).alias(text_col)
    return joined.select(*(changed if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
