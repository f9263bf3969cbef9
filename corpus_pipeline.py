"""A training-corpus pipeline: reject toxic documents, drop copies and near copies, cut repeated passages, pack."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.cost_packing import cost_packing
from hearthline.llm.heavy_hitter_dedup import exact_dedup
from hearthline.llm.queries import BYTE_BPE, PASSAGES
from hearthline.llm.shared import WS, discard, written
from hearthline.llm.simhash_dedup import fingerprint, simhash_dedup
from hearthline.llm.substring_chain import repeated_passages, without_passages
from hearthline.llm.toxicity import toxicity_score, train


def _kept(docs: DataFrame, decided: DataFrame, key: Callable[[str], Column]) -> DataFrame:
    """The rows of docs that decided keeps, and one of each set of rows that share an id and key.

    decided (doc_id, key, kept): a row for each row of docs. An id of one row is decided by itself, so texts are shuffled once and nothing is computed from them again; only rows that share their id, or have none, are told apart by the key of their text.
    Rows travel as one struct, whatever their columns are called.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    by_id = decided.groupBy(F.col("doc_id").alias("named")).agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"))
    named = written(by_id.where("n > 1 or not kept or named is null"))
    rest = rows.join(named.select("named").hint("merge"), rows["id"].eqNullSafe(named["named"]), "left_anti")  # what is dropped grows with the documents, so it isn't broadcast
    shared = named.where("n > 1 or (kept and named is null)").select("named")
    if not shared.isEmpty():
        alike = decided.join(shared, decided["doc_id"].eqNullSafe(shared["named"]), "left_semi").where("kept").select(F.col("doc_id").alias("of"), F.col("key").alias("decided")).distinct()
        keyed = rows.join(shared.hint("merge"), rows["id"].eqNullSafe(shared["named"]), "left_semi").withColumn("key", key("row.text"))
        mine = keyed["id"].eqNullSafe(alike["of"]) & (keyed["key"] == alike["decided"])
        rest = rest.unionByName(keyed.join(alike.hint("merge"), mine, "left_semi").dropDuplicates(["id", "key"]).drop("key"))
    return rest.select("row.*")


def _fingerprints(text: str) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(t):016x}" for t in texts], dtype=object)

    return run(text)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores under 0.5. Each row is judged by the whole of its own text, however long and whatever its id; null and empty texts get the intercept's score, and an empty table gives none. Other columns go along."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity_score(model, "text") < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts one row with the smallest id; null texts count as empty, null ids come last, very long texts are compared by the hash of all of them. Other columns, whatever their names, go along."""
    decided = written(exact_dedup(docs.select("doc_id", "text")).select("doc_id", F.col("text_sha256").alias("key"), "kept"))
    return _kept(docs, decided, lambda text: F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WS, " "), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row with the smallest id. Texts without words are near copies of each other, very long ones are hashed whole; of rows that share an id each goes by its own fingerprint. Other columns, whatever their names, go along."""
    rows = written(simhash_dedup(docs.select("doc_id", "text")).select("doc_id", F.col("fingerprint").alias("key"), "component_id", "component"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = rows.where(first).groupBy("component").agg(F.min("key").alias("stays"), F.count_distinct("key").alias("prints")).where("prints > 1").drop("prints")
    decided = rows.join(stays, "component", "left").select("doc_id", "key", (first & F.coalesce(F.col("key") == F.col("stays"), F.lit(True))).alias("kept"))
    return _kept(docs, written(decided), _fingerprints)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one, or its own text before, has; n_chars, where docs has it, counts what is left."""
    cut = without_passages(docs, written(repeated_passages(docs, **PASSAGES)))
    sized = F.length(cut["text"]).cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None
    return cut.select(*(sized if c == "n_chars" else cut[c] for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces of sequences; rows that share an id are packed each, null texts as one end id, very long texts over as many sequences as they need. Other columns are ignored."""
    return cost_packing(docs, *BYTE_BPE)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("substring_dedup", cut_passages), ("packing", pack)]
#: The classifier, fingerprints and chaining have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage is written and read again, and deleted when the next is written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        new: list[str] = []
        docs = written(stage(spark, docs, sf_dir), new)
        discard(spark, old)
        old = new
    return STAGES[-1][1](spark, docs, sf_dir)
