"""Generated tables and a Python data source."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def random_rows(spark: SparkSession, rows: int, columns: int = 4, size: int = 100, seed: int = 0, start: int = 0) -> DataFrame:
    """id and string columns of random letters and digits."""
    return spark.range(start, start + rows).select("id", *(F.randstr(F.lit(size), F.lit(seed + k)).alias(f"c{k}") for k in range(columns)))


def stepped_rows(spark: SparkSession, start: int, rows: int, offsets: dict[str, int]) -> DataFrame:
    """id from start on; every column its offset and two more for each row."""
    return spark.range(rows).select((F.col("id") + start).cast("int").alias("id"), *((F.lit(o) + 2 * F.col("id")).cast("int").alias(c) for c, o in offsets.items()))


def register_numbers(spark: SparkSession) -> None:
    """Makes the format millrace_numbers known. Its classes travel by value, as workers that plan streams import nothing sent along."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(NumbersSource)


class _Span(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class NumbersSource(DataSource):
    """The numbers 1 to `rows` (10) as text in `partitions` (2) parts, read at once or as a stream of `rate` (5) a batch."""

    @classmethod
    def name(cls) -> str:
        return "millrace_numbers"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(int(self.options.get("rows", 10)), int(self.options.get("partitions", 2)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(int(self.options.get("rows", 10)), int(self.options.get("rate", 5)))


class _Reader(DataSourceReader):
    def __init__(self, rows: int, parts: int):
        self.rows, self.parts = rows, parts

    def partitions(self) -> list[InputPartition]:
        return [_Span(self.rows * k // self.parts, self.rows * (k + 1) // self.parts) for k in range(self.parts)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for k in range(partition.first, partition.end):
            yield (str(k + 1),)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, rows: int, rate: int):
        self.rows, self.rate, self.at = rows, rate, 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.rows, self.at + self.rate)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(start["at"], end["at"])]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for k in range(partition.first, partition.end):
            yield (str(k + 1),)


def read_file(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options) -> DataFrame:
    """csv, json, parquet, orc or text."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write_file(df: DataFrame, kind: str, path: str, part_rows: int = 0, mode: str = "errorifexists", **options) -> None:
    df.write.options(maxRecordsPerFile=part_rows, **options).format(kind).mode(mode).save(path)


def labelled_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, label (the file's folder), length and content of every file below a folder, such as images sorted by label."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("label"), "length", "content")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, ns, text of the pages of a wiki's XML dump, redirects left out."""
    schema = "title string, ns int, redirect struct<_title: string>, revision struct<text: string>"
    rows = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return rows.filter("redirect is null").select("title", "ns", F.col("revision.text").alias("text"))
