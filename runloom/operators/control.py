"""Controlled-variable joins between run configurations and run data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from runloom.operators.records import RUN_KEY, require_columns
from runloom.operators.skew import salted_join


def control_columns(meta: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> list[str]:
    """The configuration columns held fixed: all but the studied ones, the keys and the stamp."""
    return [c for c in meta.columns if c not in variables and c not in keys and c != RUN_KEY]


def control_key(columns: Sequence[str]) -> Column:
    """``a=1,b=x``: names one combination of fixed columns."""
    if not columns:
        return F.lit("")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    return F.concat_ws(",", *[F.concat(F.lit(f"{c}="), shown(c)) for c in columns])


def control_dim(
    meta: DataFrame, data: DataFrame, *variables: str, keys: Sequence[str] = (RUN_KEY,), name: str = "control_key"
) -> DataFrame:
    """Join run data with the studied variables, labelled by the combination of all others.

    One join for every combination. No hint is given: a small configuration table is
    broadcast on its measured size, a larger one is shuffled, with salts for a run that holds
    much of the data. ``meta`` has one row per key.
    """
    require_columns(meta, [*variables, *keys])
    require_columns(data, keys)
    fixed = control_columns(meta, variables, keys)
    left = meta.select(*keys, *[v for v in variables if v not in keys], control_key(fixed).alias(name))
    kept = [c for c in data.columns if c not in variables]
    joined = salted_join(data.select(*kept), left, keys)
    return joined.select(name, *variables, *[c for c in kept if c not in variables])


def control_catalogue(
    meta: DataFrame, data: DataFrame, *variables: str, keys: Sequence[str] = (RUN_KEY,), name: str = "control_key"
) -> DataFrame:
    """Every combination of fixed columns with its runs and joined rows, also without rows.

    Data rows are counted per run before the join, so no hot run is shuffled.
    """
    fixed = control_columns(meta, variables, keys)
    per_run = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    runs = meta.select(*keys, control_key(fixed).alias(name)).join(per_run, list(keys), "left")
    return runs.groupBy(name).agg(
        F.count(F.lit(1)).alias("num_runs"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("num_rows")
    )


def join_input_output(outputs: DataFrame, inputs: DataFrame, keys: Sequence[str] = (RUN_KEY, "idx")) -> DataFrame:
    """Inner join; input columns without the keys first, then the output columns.

    Many outputs (one per epoch and batch) may share an input row, which is unique per key.
    """
    joined = salted_join(outputs, inputs, keys)
    return joined.select(*[c for c in inputs.columns if c not in keys], *outputs.columns)


def category_lookup(df: DataFrame, category: str, lookup: DataFrame, name: str, index: str) -> DataFrame:
    """Add ``index`` from the lookup; a category it does not know fails the query.

    The lookup is a small dictionary; the planner broadcasts it by its size.
    """
    found = df.join(lookup.select(F.col(name).alias("_name"), index), F.col(category) == F.col("_name"), "left")
    known = F.when(F.col("_name").isNotNull(), F.col(index)).otherwise(
        F.raise_error(F.concat(F.lit("unknown category: "), F.col(category).cast("string"))).cast("int")
    )
    return found.select(*df.columns, known.alias(index))


def config_grid(datasets: DataFrame, values: dict[str, Sequence]) -> DataFrame:
    """Every data set with every combination of the listed values.

    The lists are literals that each row expands, outermost first, so there is no join.
    """
    return reduce(
        lambda df, item: df.withColumn(item[0], F.explode(F.array(*[F.lit(v) for v in item[1]]))),
        values.items(),
        datasets,
    )
