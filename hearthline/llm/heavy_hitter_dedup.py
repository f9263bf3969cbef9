"""Exact deduplication that keeps heavy digests out of the shuffle.

A Misra-Gries style frequent-items sketch (Spark's approx_top_k) names the digests that may be
frequent; exact counts verify them; the verified winners, at most a few thousand rows, are broadcast and
their rows are settled where they are read. All other digests are grouped by an ordinary shuffle.
DataFrame functions only.

Null texts count as empty; very long ones are hashed whole. Rows that share a doc_id are counted one by one; of equal texts every row
that has the smallest doc_id is kept. A null doc_id never is the smallest unless all of the group are
null; such a group keeps its rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.shared import WS, text_or_empty, written


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text after each run of white space became one space."""
    plain = F.regexp_replace(text_or_empty(text_col), WS, " ")
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"))


def heavy_digests(table: DataFrame, winners: int = 1000, tracked: int = 16000) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that hold over 1/winners of the rows: fewer than `winners` rows."""
    found = table.agg(
        F.expr(f"approx_top_k(xxhash64(digest), {winners}, {tracked})").alias("top"), F.count("*").alias("total"))
    candidates = found.select(F.explode("top.item").alias("key"), "total")
    counted = (
        table.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("key"))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("total").alias("total")))
    return counted.where(F.col("group_size") * winners > F.col("total")).where("group_size > 1").drop("total")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", winners: int = 1000, tracked: int = 16000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    table = written(digests(docs, id_col, text_col))
    heavy = written(heavy_digests(table, winners, tracked))
    hot = table.join(F.broadcast(heavy), "digest")
    cold = table.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    settled = hot.unionByName(cold.join(groups, "digest"))
    return settled.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
