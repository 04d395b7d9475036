"""Event streams: windows, sessions, duplicates, keyed state, and commits of micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.ship import ship
from millrace.sources.log import ROOT
from millrace.sources.store import Store
from millrace.workspace import fresh_path

MONEY = "decimal(18,2)"


def source(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """A file stream of events with `ts` as an event time under a watermark."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema)
    # A single file is read through its folder.
    stream = stream.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else stream.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def finished(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; in complete mode the last batch's table."""
    spark = stream.sparkSession
    path, last = fresh_path(spark, name), {"id": None}

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{'whole' if mode == 'complete' else f'batch-{k:08d}'}")
        last["id"] = k

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if last["id"] is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def _naive(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast(MONEY)).cast("double").alias("total")]


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(*_sums()).select(_naive(F.col("w.start")).alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(*_sums()).select(_naive(F.col("w.start")).alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(*_sums()).select(_naive(F.col("w.start")).alias("start"), _naive(F.col("w.end")).alias("end"), "user_id", "n", "total")


def first_only(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key; the state of keys stays as long as the stream."""
    return events.select(*keys).dropDuplicates(list(keys))


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, events) after each batch, kept in state of its own: a custom stateful operator."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n]})

    ship(events.sparkSession)
    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, events bigint", "events bigint", "update", GroupStateTimeout.NoTimeout)


def commit_stream(stream: DataFrame, store: Store, name: str, checkpoint: str, branch: str = "main") -> None:
    """Every micro-batch as a commit. The batch's name is in the commit, so a batch that runs again after a failure is not put twice."""

    def put(batch: DataFrame, k: int) -> None:
        mark = f"{name}/{k}"
        _, head = store.log.head_id(branch)
        # Batches are committed in order, so the stream's newest commit tells; only other writers' commits since then are read.
        own = (c.application for c in store.log.lineage(store.log.commit(head)) if c.application.startswith(f"{name}/")) if head != ROOT else iter(())
        if next(own, None) == mark:
            return
        store.append(batch, branch=branch, application=mark, message=f"batch {k}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
