"""Substring search over very many short texts: a written table from trigrams to ids prunes, and the texts of what is left are compared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-case text; shorter texts have none."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(low, k, F.lit(3))))


@dataclass(frozen=True)
class TrigramIndex:
    """Postings (gram, id) in partitions by a hash of the gram, sorted by gram, and the number of ids of each gram.

    add() appends, so a row may be added again when its text changes: an id too many costs a comparison, as whoever asks compares the text. The partitions are dealt by ranges of gram and id: a gram that nearly
    all texts hold is spread over files. Null texts and texts under three characters are in no posting.
    """

    spark: SparkSession
    path: str
    id_type: DataType
    buckets: int = 256

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int").alias("bucket")

    def add(self, rows: DataFrame, id_col: str, text_col: str) -> None:
        grams = rows.select(F.col(id_col).alias("id"), F.explode(trigrams(F.col(text_col))).alias("gram")).select(self._bucket(), "gram", "id")
        counts = grams.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        grams.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        counts.write.mode("append").parquet(f"{self.path}/counts")

    def _rarest(self, term: str, most: int) -> list[tuple[str, int]] | None:
        """(gram, bucket) of up to `most` of the term's trigrams, the rarest; None if no text holds one of them."""
        grams = sorted({term[k:k + 3] for k in range(len(term) - 2)})
        counted = self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(grams)).groupBy("gram", "bucket").agg(F.sum("n").alias("n")).collect()  # as many rows as the term has trigrams
        if len(counted) < len(grams):
            return None
        return [(r["gram"], r["bucket"]) for r in sorted(counted, key=lambda r: (r["n"], r["gram"]))[:most]]

    def candidates(self, term: str, most: int = 3) -> DataFrame:
        """(id) of all texts that may hold the term, read from the partitions of its rarest trigrams only; the term has three characters or more."""
        term = term.lower()
        if len(term) < 3:
            raise ValueError("a term of the index has three characters or more")
        rarest = self._rarest(term, most)
        if not rarest:
            return self.spark.range(0).select(F.col("id").cast(self.id_type))
        postings = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(sorted({b for _, b in rarest})) & F.col("gram").isin([g for g, _ in rarest]))
        if len(rarest) == 1:
            return postings.select("id").distinct()
        return postings.groupBy("id").agg(F.count_distinct("gram").alias("held")).where(F.col("held") == len(rarest)).select("id")

    def search(self, rows: DataFrame, id_col: str, text_col: str, term: str) -> DataFrame:
        """The rows whose text holds the term, whatever the case; terms under three characters compare all texts."""
        kept = rows.join(self.candidates(term).withColumnRenamed("id", id_col), id_col, "left_semi") if len(term) >= 3 else rows
        return kept.where(F.lower(text_col).contains(term.lower()))
