"""Compare a Spark result with DuckDB's answer to the same question."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    """Type and text: 3 and 3.0, or 0.0 and -0.0, count as different."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return f"{type(value).__name__} {value!r}"


def _sort_key(row):
    return tuple((v is None, v or "") for v in row)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_sort_key)


def difference(spark_df, con, sql: str) -> str | None:
    """A description of the first difference, None when both agree exactly."""
    got = spark_df.toArrow().to_pydict()
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    ours = rows_of(list(got), zip(*got.values()))
    theirs = rows_of(names, want.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} rows differ, first {sorted(names)}: {bad[0][0]} against {bad[0][1]}" if bad else None
