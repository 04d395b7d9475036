"""Time-series generators, weighted and decaying means, formatting."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sine_wave(spark: SparkSession, start_ns: int, interval_ns: int, steps: int, frequency: float = 1.0, phase: float = 0.0, amplitude: float = 1.0) -> DataFrame:
    """start_ns, time_ns, value: a gauge that follows a sine of the seconds since its start."""
    t = F.col("id") * F.lit(interval_ns) / F.lit(1e9)
    return spark.range(steps).select(F.lit(start_ns).cast("bigint").alias("start_ns"), (F.lit(start_ns) + F.col("id") * interval_ns).cast("bigint").alias("time_ns"), (F.sin(t * (2 * pi * frequency) - phase) * amplitude).alias("value"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of values over sum of weights: values come weighted already."""
    return F.try_divide(F.sum(value), F.sum(weight))


def decayed_mean(value: Column, weight: Column, seconds: Column, latest: Column, rate: float) -> Column:
    """The mean whose members count by exp(-rate * age); a negative rate makes older ones count more."""
    fade = F.exp(-F.lit(rate) * (latest - seconds))
    return F.try_divide(F.sum(value * fade), F.sum(weight * fade))


def format_value(value: Column) -> Column:
    return F.format_string("%.4f", value)


def format_series(values: Column, width: int) -> Column:
    """Values of four decimals in one line; those that do not fit before the last give way to three dots."""
    texts = F.transform(values, format_value)
    whole = F.concat_ws(" ", texts)
    fits = F.greatest(F.floor((F.lit(width) - F.length(F.element_at(texts, -1)) - 4) / (F.length(F.get(texts, 0)) + 1)).cast("int"), F.lit(0))
    return F.when(F.size(texts) == 0, F.lit("")).when(F.length(whole) <= width, whole).otherwise(F.concat_ws(" ", F.slice(texts, F.lit(1), fits), F.lit("..."), F.element_at(texts, -1)))


def plot_pairs(time_ns: Column, value: Column) -> Column:
    return F.struct((time_ns / F.lit(1e9)).alias("x"), value.alias("y"))
