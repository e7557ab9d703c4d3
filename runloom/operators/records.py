"""Operators on run-profile tables: append, delete, add and drop columns, normalise, export."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import DataType, StringType

from runloom.functions.text import STAMP_STRFTIME
from runloom.operators.skew import salted_join

RUN_KEY = "populate_time"


def new_stamp() -> str:
    return time.strftime(STAMP_STRFTIME)


def profile_rows(
    rows: DataFrame, constants: dict[str, Any] | None = None, stamp: str | None = None, with_stamp: bool = True
) -> DataFrame:
    """Rows ready to append: run stamp, constants repeated on every row, then the columns."""
    lead = [F.lit(stamp or new_stamp()).alias(RUN_KEY)] if with_stamp else []
    return rows.select(*lead, *[F.lit(v).alias(k) for k, v in (constants or {}).items()], "*")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column(s): {missing}; have {df.columns}")


def require_new_column(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"column {name!r} is there already")


def require_same_schema(have: DataFrame, add: DataFrame) -> None:
    """Names and types must agree in order; nullability may differ."""
    shape = lambda d: [(f.name, f.dataType.simpleString()) for f in d.schema.fields]
    if shape(have) != shape(add):
        raise ValueError(f"schema mismatch: {shape(have)} against {shape(add)}")


def equals_all(values: dict[str, Any]) -> Column:
    """Conjunction of equalities; NULL equals NULL."""
    if not values:
        raise ValueError("at least one column is needed")
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()])


def delete_where(df: DataFrame, names: str | Sequence[str], values: Any) -> DataFrame:
    """Rows that do not match; an unknown column raises before anything is touched."""
    names = [names] if isinstance(names, str) else list(names)
    values = list(values) if isinstance(values, (list, tuple)) else [values]
    if len(names) != len(values):
        raise ValueError("as many values as columns are needed")
    require_columns(df, names)
    return df.where(~equals_all(dict(zip(names, values))))


def last_runs(frames: Sequence[DataFrame], num_run: int, key: str = RUN_KEY) -> list[Row]:
    """The last ``num_run`` distinct run stamps over all frames, by string order."""
    stamps = reduce(DataFrame.union, [f.select(key) for f in frames if key in f.columns]).distinct()
    return stamps.orderBy(F.desc(key)).limit(num_run).collect()


def without_last_runs(frames: dict[str, DataFrame], num_run: int = 1, key: str = RUN_KEY) -> dict[str, DataFrame]:
    """Remove the last runs from every frame that carries the run stamp.

    The stamps to remove are a list of ``num_run``, so they filter in place of a join.
    Frames without the key come back unchanged.
    """
    keyed = [f for f in frames.values() if key in f.columns]
    if not keyed:
        return dict(frames)
    gone = [r[key] for r in last_runs(keyed, num_run, key)]
    kept = ~F.coalesce(F.col(key).isin(gone), F.lit(False))
    return {n: f.where(kept) if key in f.columns else f for n, f in frames.items()}


def load_columns(df: DataFrame, columns: Sequence[str], size: int = -1, order_by: Sequence[str] | None = None) -> DataFrame:
    """Project, and keep the first ``size`` rows of a total order; -1 keeps all."""
    out = df.select(*columns) if size < 0 else df.orderBy(*(order_by or columns)).select(*columns).limit(size)
    return out


def add_col(
    df: DataFrame, name: str, dtype: str | DataType, f: Callable[..., Any], *dependencies: str
) -> DataFrame:
    """New column f(dependencies), cast to ``dtype``.

    ``f`` gets Columns and returns a Column; pass a pandas UDF for plain Python work.
    """
    require_columns(df, dependencies)
    require_new_column(df, name)
    return df.withColumn(name, f(*[F.col(d) for d in dependencies]).cast(dtype))


def drop_col(df: DataFrame, *names: str) -> DataFrame:
    """Unknown names are ignored; order and types of the rest stay."""
    return df.drop(*names)


def normalize_col(df: DataFrame, col: str, group_by: str) -> DataFrame:
    """Append ``<col>_norm`` = value / largest value of its group; NULL when that is 0.

    A window would sort every group in one task. The group maxima are combined map-side
    and joined back, hot groups by salts. Group keys may be NULL.
    """
    require_new_column(df, f"{col}_norm")
    top = df.groupBy(group_by).agg(F.max(col).alias("_top"))
    joined = salted_join(df, top, [group_by], "left", null_safe=True)
    return joined.select(*df.columns, F.try_divide(F.col(col), F.col("_top")).cast("double").alias(f"{col}_norm"))


def export_lines(df: DataFrame, order_by: str, *columns: str) -> DataFrame:
    """Distinct rows as ``", "``-joined lines, sorted by the smallest ``order_by`` of each."""
    line = F.concat_ws(", ", *[F.coalesce(F.col(c).cast(StringType()), F.lit("None")) for c in columns])
    first = df.groupBy(*columns).agg(F.min(order_by).alias("_first"))
    return first.orderBy("_first", *columns).select(line.alias("line"))


def export_to_text(df: DataFrame, path: str, order_by: str, *columns: str) -> None:
    """Append the lines below ``path``; part files keep the order."""
    export_lines(df, order_by, *columns).write.mode("append").text(path)
