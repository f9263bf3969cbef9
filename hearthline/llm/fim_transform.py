"""Fill-in-middle transformation with cuts at unit boundaries, found by a table-driven byte automaton.

A unit is a word with the white space before it, or trailing white space. The automaton's state is the kind of the last byte
(none, white, word) times how much of a sentinel was just read; its table gives, for each state and byte, the next state and what the transition counts: a unit's
first byte, a code point's first byte, a sentinel's last byte. Texts lie in lanes of 256 bytes that run in step, column by column; as the state depends on the last few bytes only, each
lane starts so many bytes earlier and needs no other lane. The scan keeps three counts a lane. A second pass runs the lanes again into which the cuts fall and finds their bytes.

Null texts count as empty. Empty texts and texts that hold a sentinel stay plain, and so do those that the draw leaves alone. Very long texts are cut whole; a task holds a few copies of its longest one.
The draw depends on seed and id only, so rows that share an id are drawn alike, and cut alike if they have equally many units; null ids draw as one id of their own, the empty string. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE = 256
#: Not a byte of UTF-8: it stands before each text and fills its last lane.
RESET = 0xFF
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
UNIT, POINT, SENTINEL = 1, 2, 4
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@cache
def automaton(sentinels: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(next, counts) by 256 * state + byte; next holds 256 * state."""
    heads = sorted({s[:k] for s in sentinels for k in range(len(s) + 1)}, key=lambda h: (len(h), h))
    number = {h: i for i, h in enumerate(heads)}
    kinds = 3  # 0: nothing read yet, 1: after white space, 2: after a word's byte
    following, counts = np.zeros(kinds * len(heads) * 256, np.uint16), np.zeros(kinds * len(heads) * 256, np.uint8)
    for kind in range(kinds):
        for head, i in number.items():
            for byte in range(256):
                at = (kind * len(heads) + i) * 256 + byte
                if byte == RESET:
                    continue
                white = byte in WHITE
                read = head + bytes([byte])
                kept = next(read[k:] for k in range(len(read) + 1) if read[k:] in number)
                following[at] = ((1 if white else 2) * len(heads) + number[kept]) * 256
                counts[at] = UNIT * (kind == 0 or (kind == 2 and white)) + POINT * (byte & 0xC0 != 0x80) + SENTINEL * any(read.endswith(s) for s in sentinels)
    return following, counts


def run_lanes(lanes: np.ndarray, sentinels: tuple[bytes, ...]) -> np.ndarray:
    """What each byte's transition counts, as (LANE, lanes); a row of lanes holds the bytes before the lane too."""
    following, counts = automaton(sentinels)
    columns = np.ascontiguousarray(lanes.T).astype(np.uint16)
    before = len(columns) - LANE
    state, out = np.zeros(columns.shape[1], np.uint16), np.empty((LANE, columns.shape[1]), np.uint8)
    for j, column in enumerate(columns):
        column += state
        if j >= before:
            np.take(counts, column, out=out[j - before])
        state = following.take(column)
    return out


class Scan:
    """The lanes of some texts and what the automaton counts in each."""

    def __init__(self, texts: list[bytes], sentinels: tuple[bytes, ...], together: int = 16384):
        self.sentinels, ahead = sentinels, max(map(len, sentinels))
        sizes = np.array([-(-(len(t) + 1) // LANE) for t in texts], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        filled = bytearray([RESET]) * (ahead + LANE * int(self.first[-1]))
        for t, at in zip(texts, self.first.tolist()):
            filled[ahead + LANE * at + 1: ahead + LANE * at + 1 + len(t)] = t
        self.lanes = np.lib.stride_tricks.sliding_window_view(np.frombuffer(filled, np.uint8), ahead + LANE)[::LANE]
        self.counts = np.zeros((3, len(self.lanes)), np.int64)
        for at in range(0, len(self.lanes), together):
            out = run_lanes(self.lanes[at:at + together], sentinels)
            for row, bit in enumerate((UNIT, POINT, SENTINEL)):
                self.counts[row, at:at + together] = np.count_nonzero(out & bit, axis=0)
        self.before = np.concatenate((np.zeros((3, 1), np.int64), np.cumsum(self.counts, axis=1)), axis=1)

    def totals(self) -> np.ndarray:
        """Units, code points and sentinels of each text."""
        return self.before[:, self.first[1:]] - self.before[:, self.first[:-1]]

    def cuts(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code point) at which the unit of that number, from 0, starts in the text; each text has that unit."""
        first = self.first[text]
        wanted = self.before[0, first] + unit
        lane = np.searchsorted(self.before[0], wanted, side="right") - 1
        place, points = np.empty(len(lane), np.int64), np.empty(len(lane), np.int64)
        for at in range(0, len(lane), 16384):
            some = slice(at, at + 16384)
            out = run_lanes(self.lanes[lane[some]], self.sentinels)
            starts = np.cumsum(out & UNIT, axis=0, dtype=np.int32)
            place[some] = np.argmax(starts > wanted[some] - self.before[0, lane[some]], axis=0)
            points[some] = np.count_nonzero((out & POINT) * (np.arange(LANE)[:, None] < place[some]), axis=0)
        return (lane - first) * LANE + place - 1, self.before[1, lane] - self.before[1, first] + points


def draws(doc: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of `seed:doc`."""
    digits = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(digits[k:k + 8], 16) for k in (0, 8, 16, 24)]


def transformed(docs: list[int | None], texts: list[bytes], sentinels: tuple[bytes, bytes, bytes], seed: int, percent: int, spm_percent: int) -> list[tuple]:
    """(id, units, form, code points of prefix and middle, output) of each text."""
    scan = Scan(texts, sentinels)
    units, points, held = scan.totals()
    drawn = [draws(d, seed) for d in docs]
    formed = [k for k, h in enumerate(drawn) if texts[k] and not held[k] and h[2] % 100 < percent]
    ends = np.array([sorted((drawn[k][0] % (units[k] + 1), drawn[k][1] % (units[k] + 1))) for k in formed], np.int64).reshape(-1, 2)
    text = np.repeat(np.array(formed, np.int64), 2)
    unit = ends.reshape(-1)
    inside = unit < units[text]
    byte = np.array([len(texts[k]) for k in text], np.int64)
    point = points[text].copy()
    byte[inside], point[inside] = scan.cuts(text[inside], unit[inside])
    pre, suf, mid = sentinels
    rows = [(d, int(units[k]), "plain", None, None, texts[k]) for k, d in enumerate(docs)]
    for k, (a, b), (pa_, pb) in zip(formed, byte.reshape(-1, 2).tolist(), point.reshape(-1, 2).tolist()):
        t = texts[k]
        spm = drawn[k][3] % 100 < spm_percent
        parts = (suf, t[b:], pre, t[:a], mid, t[a:b]) if spm else (pre, t[:a], suf, t[b:], mid, t[a:b])
        rows[k] = (docs[k], int(units[k]), "spm" if spm else "psm", pa_, pb - pa_, b"".join(parts))
    return rows


def fim_transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80,
                  sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"), pool_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output: one row per row of docs.

    percent of the texts are cut, of which spm_percent come suffix first (spm), the others prefix first (psm); sentinels come before prefix, suffix and middle.
    """
    if len(set(sentinels)) < 3 or not all(sentinels) or any(a in b for a in sentinels for b in sentinels if a != b):
        raise ValueError("three sentinels are needed of which none holds another")
    marks = tuple(s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pool, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                pool.append((text.as_py() or "").encode())
                size += len(pool[-1]) + LANE
                if size >= pool_bytes:
                    yield _batch(transformed(ids, pool, marks, seed, percent, spm_percent))
                    ids, pool, size = [], [], 0
            if ids:
                yield _batch(transformed(ids, pool, marks, seed, percent, spm_percent))

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, n, form, prefix, middle, output = zip(*rows)
    longs = lambda c: pa.array(c, pa.int64())
    return pa.RecordBatch.from_arrays([longs(doc), longs(n), pa.array(form), longs(prefix), longs(middle), pa.array(output, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that gave the output: no cut text holds a sentinel, so the three in the output are those that were put in."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fim_digests(docs: DataFrame) -> DataFrame:
    """The transformation with SHA-256 digests of output and restored text instead of the output."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fim_transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
