"""Set operations on frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from runloom.operators.skew import salted_join


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that are not in ``right``.

    Both sides are tagged and counted per distinct row, so repeats are merged before the shuffle.
    """
    right = right.toDF(*left.columns)
    tagged = left.withColumn("_right", F.lit(0)).unionByName(right.withColumn("_right", F.lit(1)))
    return tagged.groupBy(*left.columns).agg(F.max("_right").alias("_right")).where("_right = 0").drop("_right")


def keep_matching(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a match. Keys of ``right`` are made distinct first, so a hot one travels once."""
    return salted_join(left, right.select(*on).distinct(), on, "left_semi")


def drop_matching(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a match."""
    return salted_join(left, right.select(*on).distinct(), on, "left_anti")


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of counts: rows only in a, rows only in b, and repeats within either.

    Both sides are tagged and counted per distinct row, one shuffle in all, combined
    map-side. The sets agree when every count is 0.
    """
    columns = a.columns
    tagged = a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per_row = tagged.groupBy(*columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    count = lambda cond: F.count(F.when(cond, 1))
    return per_row.agg(
        count(F.col("_b") == 0).alias("only_left"),
        count(F.col("_a") == 0).alias("only_right"),
        count((F.col("_a") > 1) | (F.col("_b") > 1)).alias("repeated"),
    )


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same rows, each without repeats."""
    return not any(row_differences(a, b).first())
