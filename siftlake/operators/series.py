"""Series for charts: adaptive buckets and min/max down-sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.operators.monitor import bucket, mean

STEPS = (10, 30, 60, 300, 900, 1800, 3600, 10_800, 21_600, 43_200, 86_400)


def step_for(events: DataFrame, most: int) -> int:
    """The least step (seconds) that cuts the events' time span into at most so many buckets."""
    low, high = events.agg(F.min(F.unix_micros("created_at")), F.max(F.unix_micros("created_at"))).first()
    span = ((high or 0) - (low or 0)) / 1_000_000
    return next((s for s in STEPS if span / s <= most), STEPS[-1])


def resource_series(events: DataFrame, most: int = 240) -> DataFrame:
    """Mean resource use over time, in buckets whose length follows the span, with samples and runs."""
    told = events.where("cpu_usage IS NOT NULL OR memory_usage_percent IS NOT NULL")
    return told.groupBy(bucket("created_at", step_for(told, most)).alias("bucket")).agg(mean("cpu_usage").alias("avg_cpu"), mean("memory_usage_percent").alias("avg_memory_percent"), F.count("*").alias("samples"), F.countDistinct("seed_id").alias("runs"))


def downsample(points: DataFrame, keys: list[str], x: str, y: str, most: int = 900) -> DataFrame:
    """At most about `most` points of each series (keys): the first, the last, and the least and greatest y of equal runs of points between.

    Series with no more points stay whole.
    """
    series = Window.partitionBy(*keys)
    numbered = points.withColumn("_n", F.row_number().over(series.orderBy(x))).withColumn("_all", F.count("*").over(series))
    width = F.greatest(F.ceil((F.col("_all") - 2) / F.lit(max(1, (most - 2) // 2))), F.lit(1))
    inner = F.when((F.col("_n") > 1) & (F.col("_n") < F.col("_all")), F.floor((F.col("_n") - 2) / width))
    run = Window.partitionBy(*keys, "_run")
    numbered = numbered.withColumn("_run", inner)
    low = F.min(F.struct(y, "_n")).over(run)["_n"]
    high = F.max(F.struct(F.col(y), -F.col("_n"))).over(run).getField("col2")
    keep = (F.col("_all") <= most) | F.col("_run").isNull() | (F.col("_n") == low) | (F.col("_n") == -high)
    return numbered.withColumn("_keep", keep).where("_keep").drop("_n", "_all", "_run", "_keep")
