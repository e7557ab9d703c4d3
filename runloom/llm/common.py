"""What several operators of this package share: folds, Arrow mapping, per-worker state."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# The characters that separate words, [\x20\x09-\x0D]: exactly those bytes.split() splits at.
SPACES = " \t\n\x0b\x0c\r"


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def per_worker(key: object, build: Callable[[], object]) -> object:
    """A value built once per Python worker and kept for its later tasks.

    Task code is pickled by value, so its own globals last one task; an entry of
    ``sys.modules`` lasts as long as the worker.
    """
    held = sys.modules.setdefault("_runloom_llm_worker", types.ModuleType("_runloom_llm_worker")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


def newest(name: str, token: str, build: Callable[[], object]) -> object:
    """Like ``per_worker``, but a new token replaces what was held under the name."""
    held = per_worker(("newest", name), dict)
    if held.get("token") != token:
        held.update(token=token, value=build())
    return held["value"]


def with_columns(fields: list, ddl: str) -> StructType:
    """Fields and what a DDL string adds to them."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def map_arrow(df: DataFrame, process: Callable[[pa.RecordBatch], dict], schema: str | StructType, rows: int = 256) -> DataFrame:
    """``process`` over slices of at most ``rows`` rows, each giving a dictionary of equally long columns.

    Spark cuts Arrow batches by size; the slices keep what a task holds at once small.
    """
    schema = with_columns([], schema) if isinstance(schema, str) else schema
    fields = schema.fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = process(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(out.values(), kinds, strict=True)],
                    names=names,
                )

    return df.mapInArrow(run, schema)
