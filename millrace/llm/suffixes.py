"""A distributed suffix array by the difference-cover algorithm.

Places that are not 0 modulo 3 are the sample. Their triples of symbols are sorted and named in order; if names repeat, the string of names is
sorted by the same algorithm. Then places that are 0 modulo 3 are merged in: their suffixes compare with sampled ones by one or two
symbols and the rank of the sampled suffix behind them. Every order is a range partitioning with counts carried from partition to
partition, so no task holds more than a range. Adjacent suffixes with a long common prefix are repeats.

It shuffles many times its input (figures in the README) and is meant for corpora of some megabytes, and to check faster ways.

Cases: null and empty texts have no suffixes; equal suffixes of different texts are told apart by the end of their text, which sorts before any byte;
repeated rows are texts of their own; an empty table gives an empty array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, staged, utf8

#: Strings of at most so many symbols are sorted in one task.
BASE = 2000


def ranked(df: DataFrame, order: list[str], counts: dict[str, str]) -> DataFrame:
    """df with `name`, the number of its key among the distinct keys from 0, and for each `counts` entry the number of rows with smaller keys
    for which that SQL condition holds."""
    spark = df.sparkSession
    keys = df.groupBy(*order).agg(*(F.sum(F.expr(f"cast({c} as bigint)")).alias(k) for k, c in counts.items()))
    keys = staged(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "keys")
    sums = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("name"), *(F.sum(k).alias(k) for k in counts)).orderBy("_part").collect()
    at, rows = dict.fromkeys(["name", *counts], 0), []
    for r in sums:  # as many as there are partitions
        rows.append((r["_part"], *at.values()))
        at = {k: v + (r[k] or 0) for k, v in at.items()}
    base = spark.createDataFrame(rows or [(-1, *at.values())], ", ".join(["_part int", *(f"_{k} bigint" for k in at)]))
    line = W.partitionBy("_part").orderBy(*order)
    before = [(F.col(f"_{k}") + F.sum(k).over(line) - F.col(k)).alias(f"before_{k}") for k in counts]
    keys = keys.join(F.broadcast(base), "_part").select(*order, (F.col("_name") + F.row_number().over(line) - 1).alias("name"), *before)
    return df.join(keys, order)


def _small(string: DataFrame) -> DataFrame:
    """Sorted in one task; only for strings of at most BASE symbols."""
    found = [r["sym"] for r in string.orderBy("pos").collect()]
    order = sorted(range(len(found)), key=lambda k: found[k:])
    return string.sparkSession.createDataFrame([(p, r) for r, p in enumerate(order)], "pos bigint, rank bigint")


def suffix_array(string: DataFrame, base: int = BASE) -> DataFrame:
    """string: (pos, sym), places from 0 without gaps and symbols from 1. Returns (pos, rank), ranks from 0."""
    n = string.count()
    if n <= max(base, 3):
        return _small(string)
    spread = string.select(F.explode(F.array(*(F.struct((F.col("pos") - k).alias("pos"), F.lit(k).alias("k"), "sym") for k in range(3)))).alias("x")).select("x.*")
    symbol = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("sym"))), F.lit(0)).alias("abc"[k])
    at = staged(spread.filter("pos >= 0").groupBy("pos").agg(*(symbol(k) for k in range(3))), "triples")
    sample = at.filter("pos % 3 <> 0")
    dummy = int(n % 3 == 1)  # then the last sampled triple of class 1 needs an end of its own
    if dummy:
        sample = sample.union(string.sparkSession.createDataFrame([(n, 0, 0, 0)], "pos bigint, a bigint, b bigint, c bigint"))
    named = staged(ranked(sample, ["a", "b", "c"], {"all": "true"}).select("pos", (F.col("name") + 1).alias("name")), "names")
    total, distinct = named.agg(F.count(F.lit(1)), F.max("name")).first()
    if distinct < total:
        first = named.filter("pos % 3 = 1").count()
        place = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(F.floor(F.col("pos") / 3) + first).cast("bigint")
        inner = suffix_array(staged(named.select(place.alias("pos"), F.col("name").alias("sym")), "string"), base)
        back = F.when(F.col("pos") < first, F.col("pos") * 3 + 1).otherwise((F.col("pos") - first) * 3 + 2)
        ranks = staged(inner.select(back.alias("pos"), (F.col("rank") + 1).alias("r")), "ranks")
    else:
        ranks = named.select("pos", F.col("name").alias("r"))
    behind = lambda k: ranks.select((F.col("pos") - k).alias("pos"), F.col("r").alias(f"r{k}"))
    all_ = at.join(ranks, "pos", "left").join(behind(1), "pos", "left").join(behind(2), "pos", "left").select("pos", (F.col("pos") % 3).alias("cls"), "a", "b", "r", F.coalesce("r1", F.lit(0)).alias("r1"), F.coalesce("r2", F.lit(0)).alias("r2"))
    all_ = staged(all_, "suffixes")
    one = ranked(all_.filter("cls <> 2"), ["a", "r1"], {"zero": "cls = 0", "one": "cls = 1"})
    two = ranked(all_.filter("cls <> 1"), ["a", "b", "r2"], {"zero": "cls = 0", "two": "cls = 2"})
    low = one.filter("cls = 0").select("pos", (F.col("before_zero") + F.col("before_one")).alias("x")).join(two.filter("cls = 0").select("pos", "before_two"), "pos")
    out = low.select("pos", (F.col("x") + F.col("before_two")).alias("rank"))
    for part, cls in ((one, 1), (two, 2)):
        out = out.union(part.filter(f"cls = {cls}").select("pos", (F.col("before_zero") + F.col("r") - 1 - dummy).alias("rank")))
    return staged(out, "suffix-array")


class _Letters:
    """Symbols of texts, one more for each text's end, and whether a window starts there and its hash."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        from millrace.llm.repeats import Hashes

        places, symbols, windows, owners = [], [], [], []
        for start, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            data = np.frombuffer(text, np.uint8)
            h = np.zeros(len(data) + 1, np.uint64)
            if len(data) >= self.size:
                h[: len(data) - self.size + 1] = Hashes(data).every(self.size) | np.uint64(1)
            places.append(np.arange(start, start + len(data) + 1))
            symbols.append(np.r_[data.astype(np.int64) + 2, 1])
            windows.append(h.view(np.int64))
            owners.append(np.full(len(data) + 1, start))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (places, symbols, windows, owners)], ["pos", "sym", "window", "start"])


def repeated_starts(df: DataFrame, text_col: str = "text", size: int = 200, base: int = BASE) -> DataFrame:
    """(text, first): every place of a text, at most a megabyte long here, where a string of `size` bytes starts that starts elsewhere too."""
    rows = staged(df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("n", F.octet_length("text") + 1).withColumn("id", F.monotonically_increasing_id()), "texts")
    placed = staged(ranked(rows, ["id"], {"all": "true"}).select("id", "n", "text"), "placed")
    sizes = placed.select("id", F.explode(F.sequence(F.lit(1), "n")).alias("x"))
    starts = ranked(sizes, ["id"], {"all": "true"}).select("id", "before_all").distinct()
    letters = staged(map_batches(placed.join(starts, "id").select(F.col("before_all").alias("start"), "text"), _Letters(size), "pos bigint, sym bigint, window bigint, start bigint"), "letters")
    array = suffix_array(letters.select("pos", "sym"), base).join(letters, "pos").select("rank", "pos", "window", "start")
    array = staged(array, "array")
    # Suffixes with a common prefix of `size` bytes are neighbours, so each has one beside it.
    beside = array.select(F.explode(F.array(F.col("rank") - 1, F.col("rank") + 1)).alias("rank"), F.col("window").alias("other"))
    hit = array.filter("window <> 0").join(beside, "rank").filter("window = other").select("pos", "start").distinct()
    texts = placed.join(starts, "id").select(F.col("before_all").alias("start"), "text")
    return hit.join(texts, "start").select("text", (F.col("pos") - F.col("start")).alias("first"))
