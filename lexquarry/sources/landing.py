"""Landing zones of nested JSON records, page files, and a paged source that Spark reads as a table."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Declared shapes of the records; nothing is inferred.
SCHEMAS = {
    "act": "eli string, title string, type string, status string, published string, effective string, keywords array<string>, publisher string, year int, pos int",
    "voting": "id int, term int, session int, sitting int, votingNumber int, date date, title string, yesVotes int, noVotes int, abstainVotes int, totalVotes int, deputyVotes array<struct<deputyId:int,deputyName:string,club:string,vote:string>>",
    "deputy": "id int, firstName string, lastName string, club string, active boolean, term int",
    "sitting": "id int, term int, number int, title string, dates array<string>, agenda array<string>",
    "interpellation": "term int, num int, title string, receiptDate string, authors array<string>",
    "print": "term int, number string, title string, documentDate string, deliveryDate string, attachments array<string>, additionalPrints array<struct<number:string,title:string>>",
}
BROKEN = "__broken"


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of one declared shape; lines that do not parse are dropped, as a service client would drop them."""
    schema = StructType.fromDDL(f"{SCHEMAS[kind]}, {BROKEN} string")
    d = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    return d.where(F.col(BROKEN).isNull()).drop(BROKEN)


def votes(votings: DataFrame) -> DataFrame:
    """One row for each deputy's vote, and the turnout of its voting."""
    total = F.col("totalVotes")
    turnout = F.when(total > 0, (F.col("yesVotes") + F.col("noVotes") + F.col("abstainVotes")) / total).otherwise(0.0)
    return votings.withColumn("participation", turnout).select("id", "term", "participation", F.explode_outer("deputyVotes").alias("v")).select("id", "term", "participation", "v.*")


def print_text(prints: DataFrame) -> DataFrame:
    """A legislative print as one text: title, dates, attachments and additional prints, a line each."""
    extra = F.transform("additionalPrints", lambda p: F.concat_ws(": ", p["number"], p["title"]))
    text = F.concat_ws("\n", F.col("title"), F.concat(F.lit("Data: "), "documentDate"), F.concat(F.lit("Doręczono: "), "deliveryDate"), F.concat(F.lit("Załączniki: "), F.array_join("attachments", ", ")), F.array_join(extra, "\n"))
    return prints.select(F.concat_ws("_", "term", "number").alias("id"), "title", text.alias("content"), (F.length(text) >= 100).alias("complete"))


def page_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Page text files as rows of path and bytes, for the page text operators."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("content").alias("pdf_raw_content"))


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    """Reads the pages of one endpoint in parallel, a page for each task; broken items are left out."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        limit, offset = int(options.get("limit", 100)), int(options.get("offset", 0))
        if not 1 <= limit <= 1000 or offset < 0:
            raise ValueError("limit must lie in 1..1000 and offset must not be negative")

    def partitions(self) -> list[InputPartition]:
        folder = self.options["path"]
        return [Page(os.path.join(folder, f)) for f in sorted(os.listdir(folder)) if f.endswith(".json")]

    def read(self, partition: Page) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            page = json.load(f)
        for item in page.get("items", []):
            try:
                yield tuple(item[name] if name in item else None for name in self.schema.fieldNames())
            except (TypeError, KeyError):
                continue


class PagedSource(DataSource):
    """``spark.read.format("paged_json").schema(...).load(folder)``: pages saved as ``{"items": [...]}``."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
