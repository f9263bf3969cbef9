"""Helpers that several corpus operators use: tables in the shared folder, components, text arrays."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts, as a Java regular expression.
WS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset, and all run in one local process, a folder of our own."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, used: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, and a lost executor loses nothing. The path is added to used."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/hearthline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if used is not None:
        used.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, used: list[str]) -> None:
    """Delete written tables that nothing will read again."""
    for path in used:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    used.clear()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of longs -> (node, component), component being the smallest node that links reach.

    Alternates large-star and small-star steps. Each takes the least neighbour with a pre-aggregating
    groupBy and joins it back, so that a node with very many links is never gathered in one place.
    Each round is a written table, deleted after the next; the loop ends when a round changes nothing. Nodes without links
    aren't in the result; links of a node with itself or with null are ignored.
    """
    edge = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    old: list[str] = []
    edge, before = written(edge, old), None
    for _ in range(rounds):
        both = edge.select("u", "v").union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new: list[str] = []
        edge = written(small, new)
        discard(links.sparkSession, old)
        old = new
        now = edge.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edge.select(F.col("v"), F.col("v")).distinct())


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
