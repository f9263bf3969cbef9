"""The test tables and plain table reads and writes; connectors by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, by_core: int = 4) -> DataFrame:
    """df's rows dealt evenly over tasks, `by_core` for each core: for work that is long for the few bytes of a row, as files are split by bytes and not within a row group."""
    return df.repartition(by_core * df.sparkSession.sparkContext.defaultParallelism)


def append(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Add immutable observations."""
    (df.write.mode("append").partitionBy(*by) if by else df.write.mode("append")).parquet(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A database table, read in ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def newest_folder(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """The files of the folder whose path is last in order of names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    last = named.agg(F.max("folder").alias("folder"))  # one row
    return named.join(F.broadcast(last), "folder", "left_semi")


#: connector name -> function of (pages DataFrame) that gives listings
CONNECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, scan: Callable[[DataFrame], DataFrame]) -> None:
    if name in CONNECTORS:
        raise ValueError(f"connector {name} is registered twice")
    CONNECTORS[name] = scan


def connector(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in CONNECTORS:
        raise ValueError(f"unknown connector {name}; known: {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[name]
