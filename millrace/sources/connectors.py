"""Kafka streams, a logging sink, and latency figures of a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True, **options: str) -> DataFrame:
    """Messages as key, value (text), ts. Needs Spark's Kafka package on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("ts"))


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str):
    writer = df.select(F.to_json(F.struct(*df.columns)).alias("value")).writeStream.format("kafka")
    return writer.option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def latency(df: DataFrame, sent: Column, received: Column) -> DataFrame:
    """Mean and percentiles of the milliseconds between two timestamps."""
    ms = F.unix_micros(received.cast("timestamp")) / 1000 - F.unix_micros(sent.cast("timestamp")) / 1000
    at = lambda p: F.percentile(F.col("ms"), F.lit(p))
    return df.select(ms.alias("ms")).agg(F.avg("ms").alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.count(F.lit(1)).alias("n"))


class _Count(WriterCommitMessage):
    def __init__(self, rows: int):
        self.rows = rows


class LogSink(DataSource):
    """Prints rows on the workers and, at the end, their number: a sink to try writers with."""

    @classmethod
    def name(cls) -> str:
        return "millrace_log"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LogWriter()


class _LogWriter(DataSourceWriter):
    def write(self, rows: Iterator) -> WriterCommitMessage:
        n = 0
        for row in rows:
            print(row)
            n += 1
        return _Count(n)

    def commit(self, messages: list) -> None:
        print(f"{sum(m.rows for m in messages if m)} rows")

    def abort(self, messages: list) -> None:
        print("aborted")


def ticks(spark: SparkSession, channel: str, rate: int = 1) -> DataFrame:
    """A live stream of numbered messages on a channel, from the rate source."""
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.lit(channel).alias("channel"), F.col("value").alias("message_id"), F.concat(F.lit("tick "), F.col("value").cast("string")).alias("message"), F.col("timestamp").alias("ts"))
