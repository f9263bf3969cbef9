"""Document lengths out of flat, unindexed token files, found by their end-of-document identifiers.

A token file is a run of uint16 ids without an index. It is held as rows (file, block, ids) of fixed-length blocks,
cut without regard to documents; the rows may come in any order. Each block is searched for separators in
one vectorised comparison. The blocks' sums (tokens, separators, last separator) go through a prefix scan in
block order, in two levels: over ranges of blocks, and over the blocks of each range, so that no task holds all blocks of a file. It gives each block the tokens and documents before it and the place of the last separator before
it; a document that spans blocks is thus stitched without moving tokens.

token_files() writes such files from documents, one file for each task, with a manifest (file, ordinal, doc_id); ids that don't fit 16 bits raise an error. flat_blocks() reads real files, of up to 2 GB each.
Null texts count as empty; texts of any length go through whole. Tokens after a file's last separator are a document that has no end; it is reported with
closed = false. Rows that share an id are documents of their own; null ids are carried along. Null ids columns of blocks count as empty blocks. Empty tables and files give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.llm.byte_tokens import byte_tokens
from hearthline.llm.shared import written


def token_files(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
                separator: int = 50256, block_tokens: int = 65536) -> tuple[DataFrame, DataFrame]:
    """(blocks, manifest) of docs: blocks (file, block, ids binary), manifest (file, ordinal, doc_id); both are written tables."""
    if not 0 <= separator <= 0xFFFF:
        raise ValueError("the separator has to fit 16 bits, so be 65535 at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(json_path, ranks_path, True)
        file, block, ordinal = TaskContext.get().partitionId(), 0, 0
        ending, size = np.array([separator], "<u2").tobytes(), 2 * block_tokens
        held = bytearray()
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(tokens.encode(text.as_py() or ""), "<u4")
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("token ids over 65535 don't fit a file of 16-bit ids")
                held += ids.astype("<u2").tobytes() + ending
                rows.append((file, None, None, ordinal, doc))
                ordinal += 1
                cut = 0
                while len(held) - cut >= size:
                    rows.append((file, block, bytes(held[cut:cut + size]), None, None))
                    block, cut = block + 1, cut + size
                del held[:cut]
                if len(rows) >= 256:
                    yield table(rows)
                    rows = []
        if held:
            rows.append((file, block, bytes(held), None, None))
        if rows:
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "block", "ids", "ordinal", "doc_id"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = written(few.mapInArrow(run, "file int, block long, ids binary, ordinal long, doc_id long"))
    return both.where("block is not null").select("file", "block", "ids"), both.where("block is null").select("file", "ordinal", "doc_id")


def flat_blocks(spark: SparkSession, path: str, block_tokens: int = 65536) -> DataFrame:
    """(file, block, ids) of flat files of little-endian 16-bit ids; file is the path. A file of an odd number of bytes raises an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, size = memoryview(content.as_buffer()), 2 * block_tokens
                if len(data) % 2:
                    raise ValueError(f"{name} holds half an id")
                for k, at in enumerate(range(0, len(data), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([bytes(data[at:at + size])], pa.binary())], ["file", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, ids binary")


def _before(rows: DataFrame, sums: dict[str, Column], blocks: int) -> DataFrame:
    """rows (file, block, ...) with running aggregates over the blocks before each, null for a file's first."""
    wide = rows.withColumn("__range", F.floor(F.col("block") / blocks))
    inner = Window.partitionBy("file", "__range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    of_range = wide.groupBy("file", "__range").agg(*[f.alias(f"__{n}") for n, f in sums.items()])
    ahead = of_range.select("file", "__range", *[(F.max if n == "open" else F.sum)(f"__{n}").over(outer).alias(f"__{n}") for n in sums])
    both = wide.join(ahead, ["file", "__range"])
    joined = lambda n, f: F.greatest(f.over(inner), F.col(f"__{n}")) if n == "open" else F.coalesce(f.over(inner), F.lit(0)) + F.coalesce(F.col(f"__{n}"), F.lit(0))
    return both.select(*rows.columns, *[joined(n, f).alias(n) for n, f in sums.items()])


def separator_scan(blocks: DataFrame, separator: int = 50256, range_blocks: int = 4096) -> DataFrame:
    """file, ordinal, start, n_tokens (without the separator), closed: one row per document of the token files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for ids in batch.column(2):
                ids = np.frombuffer(ids.as_py() or b"", "<u2")
                found.append(np.flatnonzero(ids == separator))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["file", "block", "size", "places"])

    kind = dict(blocks.dtypes)["file"]
    scanned = written(blocks.select("file", F.col("block").cast("long").alias("block"), "ids").mapInArrow(run, f"file {kind}, block long, size long, places array<long>"))
    sums = scanned.select("file", "block", "size", F.size("places").alias("ends"), F.array_max("places").alias("last"))
    offsets = _before(sums, {"base": F.sum("size"), "first": F.sum("ends")}, range_blocks)
    stitched = _before(offsets.withColumn("at", F.col("base") + F.col("last")), {"open": F.max("at")}, range_blocks).select("file", "block", "base", "first", F.coalesce("open", F.lit(-1)).alias("open"))
    each = F.transform("places", lambda p, k: F.struct(k.alias("k"), p.alias("place"), F.when(k > 0, F.col("places")[k - 1]).alias("before")))
    closed = scanned.where(F.size("places") > 0).select("file", "block", each.alias("each")).join(stitched, ["file", "block"]).select("file", "base", "first", "open", F.inline("each")).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"), F.coalesce(F.col("base") + F.col("before"), "open").alias("previous"), (F.col("base") + F.col("place")).alias("stop"))
    whole = closed.select("file", "ordinal", (F.col("previous") + 1).alias("start"), (F.col("stop") - F.col("previous") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = offsets.groupBy("file").agg(F.sum("size").alias("total"), F.max(F.col("base") + F.col("last")).alias("last"), F.sum("ends").alias("ordinal"))
    open_end = ends.select("file", "ordinal", (F.coalesce("last", F.lit(-1)) + 1).alias("start"), (F.col("total") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return whole.unionByName(open_end)


def token_counts(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 65536) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens: documents written to flat token files and counted by the scan."""
    blocks, manifest = token_files(docs, json_path, ranks_path, id_col, text_col, block_tokens=block_tokens)
    return separator_scan(blocks).join(manifest, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
