"""As-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, prefix: str = "r_", bucket: Column | None = None) -> DataFrame:
    """Each left row with the latest right row of its key that is not later; nulls where there is none.

    Both sides are put in one line by key and time and the last right row is carried forward: one shuffle, no pairs. `bucket`, an expression over
    `_t` that never falls as time rises, splits the line of a key with very many rows: each bucket is a window of its own, and the last
    right row of each bucket, pre-aggregated, is carried to the buckets after it in a line of one row a bucket."""
    values = [c for c in right.columns if c not in on]
    a = left.select(*on, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType).alias("_r"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"))
    b = right.select(*on, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"))
    both, parts = a.unionByName(b), list(on)
    if bucket is not None:
        both, parts = both.withColumn("_b", bucket), [*on, "_b"]
    line = W.partitionBy(*parts).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(line)).filter("_side = 1")
    if bucket is not None:
        ends = both.groupBy(*parts).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_end"))
        before = ends.withColumn("_end", F.last("_end", ignorenulls=True).over(W.partitionBy(*on).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
        out = out.join(before.withColumnsRenamed({c: f"_k{k}" for k, c in enumerate(parts)}), [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(parts)], "left").withColumn("_r", F.coalesce("_r", "_end"))
    return out.select("_l.*", *(F.col("_r")[v].alias(prefix + v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Points with every range low <= point < high: both go to buckets of `width`, a range to each it touches, so the join is an equi-join."""
    on = on or []
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - F.lit(1)) / width))))
    return p.join(r, [*on, "_b"]).filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")
