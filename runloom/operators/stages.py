"""Cluster metrics per (application, stage)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from runloom.operators.scans import running
from runloom.operators.skew import default_share, hot_keys, is_hot
from runloom.session import cut_lineage

# The metric columns of a stage row, in their stored order.
METRICS = (
    "Duration",
    "Scheduler_Delay",
    "Task_Deserialization_Time",
    "GC_Time",
    "Result_Serialization_Time",
    "Getting_Result_Time",
    "Peak_Execution_Memory",
    "Input_Size",
    "Shuffle_Read_Size",
    "Shuffle_Read_Blocked_Time",
    "Shuffle_Remote_Reads",
    "Input_Size___Records",
)


def stage_sums(
    tasks: DataFrame, keys: Sequence[str], metric: str = "metric", value: str = "value", metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Sum of each metric over the task rows of a stage, one column per metric.

    The metric list is fixed, so no extra pass finds it and no value is lost to a
    column that happens to be missing. Sums combine map-side before the shuffle.
    """
    sums = [F.sum(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in metrics]
    return tasks.groupBy(*keys).agg(*sums)


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", share: int | None = None
) -> DataFrame:
    """Exact median per group, the mean of the two middle values for an even count.

    ``percentile`` keeps a whole group's values in one task. Here equal values are counted
    first, the counts are accumulated in value order, and only the one or two values whose
    range covers the middle positions are kept. Groups with very many different values are
    accumulated by the block scan, and their totals, of which there are few, are broadcast.
    The counts are checkpointed, as they are read several times.
    """
    counted = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    share = share or default_share(df.sparkSession)
    hot = hot_keys(counted, keys, share)
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("_upto")
    total = F.sum("_n").over(group).alias("_total")
    if not hot:
        placed = counted.select("*", upto, total)
    else:
        large, rest = counted.where(is_hot(keys, hot)), counted.where(~is_hot(keys, hot))
        totals = large.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.sum("_n").alias("_total"))
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        scanned = running(large, keys, [value], {"_upto": ("sum", F.col("_n"))}, share=share, hot=hot)
        whole = scanned.join(F.broadcast(totals), same)  # one row per hot group
        columns = [*counted.columns, "_upto", "_total"]
        placed = rest.select("*", upto, total).select(*columns).unionByName(whole.select(*columns))
    low = F.floor((F.col("_total") + 1) / 2)
    high = F.floor((F.col("_total") + 2) / 2)
    covers = lambda p: (F.col("_upto") >= p) & (F.col("_upto") - F.col("_n") < p)
    middle = placed.where(covers(low) | covers(high))
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2.0).alias(name))
