"""Shared helpers: staged tables, bounded broadcasts and Arrow mapping."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.ship import ship
from millrace.workspace import Files, fresh_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


#: Drops a query's shuffle files when it is done, instead of when the driver happens to collect its garbage.
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when the query ends; for queries whose result is read again from where they wrote it."""
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP)
        else:
            spark.conf.set(_DROP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    Files(df.sparkSession).delete(df.staged_at)
    _written.remove((df.sparkSession, df.staged_at))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end all that was staged inside, but for the tables given to what it yields. Nothing else made inside may be read later."""
    first, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.staged_at)
        return df

    yield keep
    for spark, path in _written[first:]:
        if path not in kept:
            Files(spark).delete(path)
    _written[first:] = [x for x in _written[first:] if x[1] in kept]


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n (null where the column is null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


_kept: dict[str, object] = {}


def remember(key: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task, such as a model or a memory of words: one thing at a time, so that operators that follow each
    other in a session do not add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


#: Bytes of an Arrow batch; the workers hold a few batches at once, and so does the JVM beside its heap.
BATCH_BYTES = 8 << 20


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a URI, and the path in it; Hadoop's names of S3 are taken too."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


_UNITS = {u: 1 << 10 * k for k, u in enumerate("bkmgtp")}


def bytes_of(setting: str) -> int:
    """The bytes that a size setting such as 8388608, 64m or 1gb names."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([bkmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) * _UNITS[unit or "b"]


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, so that long texts do not make large ones. Plans read the bound when they run,
    so it stays lowered; a session that has a smaller bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < bytes_of(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def with_id(slim: DataFrame, ddl: str) -> T.StructType:
    """The fields of a DDL text after the field `id` of slim, whatever its type."""
    return T.StructType([T.StructField("id", slim.schema["id"].dataType), *T.StructType.fromDDL(ddl)])


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """One output batch for each Arrow batch. step is built on the executor's side once for each task if it has an `open` method; it must go by
    the columns' places, as columns whose names would need quotes come under others."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = step.open() if hasattr(step, "open") else step
        for batch in batches:
            if batch.num_rows:
                out = call(batch)
                if out is not None:
                    yield out if out.schema.names == names else pa.RecordBatch.from_arrays(out.columns, names=names)

    ship(df.sparkSession)
    modest_batches(df.sparkSession)
    plain = df if all(re.fullmatch(r"\w+", c) for c in df.columns) else df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as UTF-8 bytes, null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


#: Bytes that a table may take in memory to be broadcast, taking ROW for a row of a few numbers and ITEM for each item of its arrays.
BROADCAST_BYTES, ROW, ITEM = 96 << 20, 200, 100


def is_small(df: DataFrame, items: Column | None = None) -> bool:
    """Whether df, a staged table, may be broadcast: its rows are counted, and the items of its array column if it has one."""
    n, k = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if items is None else items), F.lit(0))).first()
    return n * ROW + k * ITEM <= BROADCAST_BYTES


def if_small(df: DataFrame, items: Column | None = None) -> DataFrame:
    """df marked for broadcast if it is small; else a join with it shuffles."""
    return F.broadcast(df) if is_small(df, items) else df
