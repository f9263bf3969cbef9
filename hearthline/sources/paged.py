"""Pages of a source as a Spark data source: batch and stream, a partition per range of pages, and what kept a page from being read as data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from hearthline.functions.text import protection
from hearthline.sources.pages import cards, completeness

FORMAT = "listing_pages"
SCHEMA = "page int, html string, problem string"
SUFFIX = ".html"


@dataclass
class PageRange(InputPartition):
    first: int
    last: int  # included


class _Folder:
    """Pages 00001.html, 00002.html, ... of a folder in any file system that Arrow knows by its address. A page that can't be read is a problem, not an error."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"].rstrip("/"), int(options.get("pagesperpartition", 50))
        self.expected = int(options["pages"]) if "pages" in options else None
        if self.size < 1:
            raise ValueError("pagesPerPartition must be 1 or more")

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":" in self.path.split("/")[0] else f"file://{self.path}")

    def known(self) -> int:
        """The number of pages there are: as stated, or that of the last file."""
        if self.expected is not None:
            return self.expected
        system, path = self._open()
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        numbers = [f.base_name.removesuffix(SUFFIX) for f in found if f.base_name.endswith(SUFFIX)]
        return max((int(n) for n in numbers if n.isdigit()), default=0)

    def ranges(self, after: int, until: int) -> list[PageRange]:
        return [PageRange(k, min(k + self.size - 1, until)) for k in range(after + 1, until + 1, self.size)]

    def read(self, part: PageRange) -> Iterator[tuple[int, str | None, str | None]]:
        system, path = self._open()
        for page in range(part.first, part.last + 1):
            try:
                with system.open_input_stream(f"{path}/{page:05d}{SUFFIX}") as f:
                    yield page, f.read().decode(), None
            except UnicodeDecodeError:
                yield page, None, "layout_change"
            except OSError:
                yield page, None, "network"


class _Batch(_Folder, DataSourceReader):
    def partitions(self) -> list[PageRange]:
        return self.ranges(0, self.known())


class _Stream(_Folder, DataSourceStreamReader):
    """Offsets are the number of the last page read; pages that come later are the next batch, and a restarted stream goes on behind its last one."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.known()}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        return self.ranges(start["page"], end["page"])


class ListingPages(DataSource):
    """Options: path, pages (how many a complete run has; else the folder's last), pagesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingPages)


def with_problems(pages: DataFrame) -> DataFrame:
    """pages whose problem says captcha or challenge where a page was delivered that isn't the source's."""
    return pages.withColumn("problem", F.coalesce("problem", protection(F.lit(200), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("html"))))


def scan(pages: DataFrame, base: str = "") -> tuple[DataFrame, DataFrame]:
    """(listings, one-row report: completeness, pages, failed_pages, bad_cards, issues) of a run's pages. What was read counts, also where the run isn't complete; issues maps kinds of problems to numbers of pages or cards."""
    judged = with_problems(pages)
    found = cards(judged.where("problem is null").drop("problem"), base=base)
    of_pages = judged.agg(F.count("*").alias("pages"), F.count_if(F.col("problem").isNotNull()).alias("failed_pages"))
    bad = found.where("problem is not null")
    kinds = judged.where("problem is not null").select("problem").unionByName(bad.select(F.lit("layout_change").alias("problem"))).groupBy("problem").agg(F.count("*").alias("n"))
    issues = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("problem", "n")))).alias("issues"))  # a few kinds
    report = of_pages.join(F.broadcast(bad.agg(F.count("*").alias("bad_cards")))).join(F.broadcast(issues))
    return found.where("problem is null").drop("problem", "html", "card", "card_no"), report.select(completeness(F.col("bad_cards"), F.col("failed_pages"), F.col("pages")).alias("completeness"), "pages", "failed_pages", "bad_cards", "issues")
