"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarlake.functions.levels import finite
from sonarlake.plans.lineage import range_sorted


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """keys, n and p<percent> for each of ``ps``: linear between the two nearest ranks.

    Rows are range-sorted past the keys; the ranks of a partition's rows follow from the counts of the partitions before it, so that a
    group that holds a third of all rows is spread over many tasks (the built-in aggregate keeps a group's distinct values in one). Null, NaN and
    infinite values and null keys take no part; an empty table gives an empty result; other columns are ignored.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(finite(F.col("v"))).dropna(subset=keys)
    ranged = range_sorted(rows, [*keys, "v"])
    counts = ranged.groupBy(*keys, "pid").agg(F.count("*").alias("c"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition that holds some of the group
    offsets = counts.select(*keys, "pid", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"), F.sum("c").over(every).alias("n"))
    placed = ranged.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "pid").orderBy("v")) - 1).join(offsets, [*keys, "pid"]).withColumn("rank", F.col("off") + F.col("rn"))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in ps]
    wanted = F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)])
    near = placed.where(F.array_contains(wanted, F.col("rank")))
    out = []
    for p, a in zip(ps, at):
        low, high = (F.max(F.when(F.col("rank") == f(a).cast("long"), F.col("v"))) for f in (F.floor, F.ceil))
        part = F.max(a - F.floor(a))
        out.append((low + (high - low) * part).alias(f"p{round(100 * p):02d}"))
    return near.groupBy(*keys).agg(F.max("n").alias("n"), *out)
