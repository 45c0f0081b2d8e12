"""Median and average as timing reports use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def median(x: Column, integral: bool = True) -> Column:
    """Mean of the middle values; of integers, cut to an integer."""
    middle = F.percentile(x, F.lit(0.5))
    return middle.cast("long") if integral else middle


def average(x: Column, integral: bool = True) -> Column:
    mean = F.avg(x)
    return mean.cast("long") if integral else mean


def timing_report(metadata: DataFrame, columns: tuple[str, ...] = ("spmv_ns", "exchange_ns", "overhead_ns")) -> DataFrame:
    """(stage, phase, median_ns, average_ns) from the timings of each iteration in run metadata."""
    phases = F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("phase", "times")
    each = metadata.select("stage", phases).select("stage", "phase", F.explode("times").alias("ns"))
    return each.groupBy("stage", "phase").agg(median(F.col("ns")).alias("median_ns"), average(F.col("ns")).alias("average_ns"))
