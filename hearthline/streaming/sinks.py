"""A keyed table of files that a stream of upserts changes only where its rows are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, LongType, StructType

from hearthline.session import materialised

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """Rows in a Parquet folder, dealt to `buckets` partitions by a hash of their keys; each partition knows the last batch that wrote it.

    A batch rewrites the partitions that hold its keys (dynamic overwrite) and reads no others. A partition that already has the batch is left alone, so a batch that is run again, also after it
    failed between two partitions, changes nothing that it has changed before; this holds for merges that add, too. One writer at a time. Choose buckets so that one fits a task.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def stored(self) -> DataFrame:
        """The rows with the columns bucket_ and batch_; an absent folder has none."""
        whole = StructType(list(self.schema.fields)).add("batch_", LongType()).add("bucket_", IntegerType())
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self.path)

    def read(self) -> DataFrame:
        return self.stored().drop("bucket_", "batch_")

    def apply(self, changes: DataFrame, merge: Merge, batch: int) -> list[int]:
        """The partitions that were rewritten as merge(their rows, their changes); merge must keep each row's keys."""
        new = materialised(changes.withColumn("bucket_", self.bucket()))
        hit = [r[0] for r in new.select("bucket_").distinct().collect()]  # at most `buckets`
        old = self.stored().where(F.col("bucket_").isin(hit))
        has = {r["bucket_"] for r in old.groupBy("bucket_").agg(F.max("batch_").alias("last")).where(F.col("last") >= batch).collect()} if hit else set()
        due = sorted(set(hit) - has)
        if due:
            mine = lambda df: df.where(F.col("bucket_").isin(due)).drop("bucket_", "batch_")
            after = merge(mine(old), mine(new)).select(*self.schema.names, F.lit(batch).cast("long").alias("batch_")).withColumn("bucket_", self.bucket())
            after.repartition(min(len(due), self.buckets), "bucket_").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_").parquet(self.path)
        return due


def upserting_into(stream: DataFrame, table: KeyedTable, merge: Merge) -> DataStreamWriter:
    """A writer that merges each micro-batch into the table, exactly once per partition and batch id; keep one checkpoint per table."""
    def batch(changes: DataFrame, number: int) -> None:
        table.apply(changes, merge, number)

    return stream.writeStream.foreachBatch(batch)
