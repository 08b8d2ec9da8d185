"""Statistics of ordered samples: running over a batch, and over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N

#: An ordered group is cut into so many ranges, so that no window holds all of it.
RANGES = 64


def partials(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean and M2 (sum of squared deviations) per group: states that merge in any order."""
    v = N.present(F.col(value))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merged(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """States merged by the parallel variance rule, as sums around the common mean; then n, mean, var, std."""
    total = states.groupBy(*by).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    joined = N.matched(states, total, by) if by else states.crossJoin(total)
    m2 = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean")))
    out = joined.groupBy(*by).agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), (m2 / F.first("_n")).alias("var"))
    return out.withColumn("std", F.sqrt("var"))


def running_statistics(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """For each row, also of a null group, n, mean, var and std of its group's values up to and including it, in the given order.

    The first order column must be numeric or a time. Groups are cut into
    RANGES ranges of it; running sums within a range start from the totals of
    the ranges before. Sums are taken around the overall mean, so that
    variances keep their precision far from zero.
    """
    v = N.present(F.col(value))
    center = df.groupBy(*by).agg(F.avg(v).alias("_center"), F.min(order[0]).alias("_first"), F.max(order[0]).alias("_last"))
    number = lambda c: F.unix_micros(c.cast("timestamp")).cast("double") if dict(df.dtypes)[order[0]].startswith("timestamp") else c.cast("double")
    df = N.matched(df, center, by) if by else df.crossJoin(center)
    width = number(F.col("_last")) - number(F.col("_first"))
    place = F.when(width > 0, F.floor((number(F.col(order[0])) - number(F.col("_first"))) / width * RANGES)).otherwise(0)
    d = v - F.col("_center")
    df = df.withColumn("_range", F.least(place, F.lit(RANGES - 1)).cast("int")).withColumn("_d", d)
    sums = [F.count("_d"), F.sum("_d"), F.sum(F.col("_d") * F.col("_d"))]
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "_range").agg(*[s.alias(f"_t{i}") for i, s in enumerate(sums)])
    totals = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(3)])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = N.matched(df, totals, [*by, "_range"])
    n, s, q = (F.col(f"_b{i}") + F.coalesce(x.over(inside), F.lit(0)) for i, x in enumerate(sums))
    out = out.withColumn("n", n.cast("long")).withColumn("_s", s).withColumn("_q", q)
    mean = F.col("_s") / F.col("n")
    var = F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0))
    keep = [c for c in df.columns if not c.startswith("_")]
    some = F.col("n") > 0
    return out.select(*keep, "n", F.when(some, F.col("_center") + mean).alias("mean"), F.when(some, var).alias("var"), F.when(some, F.sqrt(var)).alias("std"))


def stream_statistics(stream: DataFrame, by: Sequence[str], value: str, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream to its present end and returns count, mean and variance per group."""
    v = N.present(F.col(value))
    states = stream.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))
    query = states.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def windowed_statistics(stream: DataFrame, time: str, by: Sequence[str], value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statistics per event-time window; values later than `late` are not awaited."""
    v = N.present(F.col(value))
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))
