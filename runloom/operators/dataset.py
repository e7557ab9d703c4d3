"""Labelled array datasets: split, chunk, slice, concatenate, shuffle, rescale.

A dataset is a frame with a numeric ``id`` (position in stored order), ``data``
(flat row-major array) and ``label`` or ``target``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from runloom.functions import arrays
from runloom.operators.scans import hash_blocks, row_index

SPLITS = ("train", "valid", "test")


def shuffle(
    df: DataFrame, seed: int = 0, epoch: int = 0, id_col: str = "id", sort_key: Column | None = None, name: str = "idx"
) -> DataFrame:
    """Repeatable random order as a 0-based position column.

    Rows are ordered by a hash of (seed, epoch, id), whose top bits are evenly spread
    blocks. Another ``sort_key`` may be given; ``id`` decides among equal keys.
    """
    if sort_key is not None:
        return row_index(df.withColumn("_order", sort_key), ["_order", id_col], name).drop("_order")
    hashed = df.withColumn("_order", F.xxhash64(F.lit(seed), F.lit(epoch), F.col(id_col)))
    top = hash_blocks(F.col("_order"), df.sparkSession)
    return row_index(hashed, ["_order", id_col], name, block=top).drop("_order")


def split(df: DataFrame, train: int, valid: int, test: int, position: str = "idx") -> DataFrame:
    """Contiguous train / valid / test parts by position; rows beyond are dropped."""
    p = F.col(position)
    named = F.when(p < train, SPLITS[0]).when(p < train + valid, SPLITS[1]).otherwise(SPLITS[2])
    return df.where(p < train + valid + test).withColumn("set", named)


def chunk(df: DataFrame, size: int, position: str = "idx", name: str = "chunk") -> DataFrame:
    """Contiguous slices named by their first position; the last may be short."""
    return df.withColumn(name, F.col(position) - F.pmod(F.col(position), F.lit(size)))


def batch_number(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("long")


def stride_slice(df: DataFrame, start: int, stop: int | None, step: int = 1, position: str = "idx") -> DataFrame:
    p = F.col(position)
    inside = (p >= start) & (F.pmod(p - start, F.lit(step)) == 0)
    return df.where(inside if stop is None else inside & (p < stop))


def _check_same(frames: Sequence[DataFrame], dtypes: bool) -> None:
    shape = lambda d: sorted((f.name, f.dataType.simpleString() if dtypes else "") for f in d.schema.fields)
    first = shape(frames[0])
    for f in frames[1:]:
        if shape(f) != first:
            raise ValueError(f"inputs differ: {first} against {shape(f)}")


def concat_shuffle(*frames: DataFrame, seed: int = 0, id_cols: Sequence[str] = ("id",), sort_key: Column | None = None) -> DataFrame:
    """All rows of inputs with the same columns, in a shuffled order (column ``idx``).

    Ids may repeat across inputs, so the source number takes part in the order.
    """
    _check_same(frames, dtypes=False)
    tagged = reduce(DataFrame.unionByName, [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)])
    if sort_key is not None:
        return row_index(tagged.withColumn("_order", sort_key), ["_order", *id_cols, "_src"]).drop("_order", "_src")
    hashed = tagged.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_src"), *[F.col(c) for c in id_cols]))
    top = hash_blocks(F.col("_order"), tagged.sparkSession)
    return row_index(hashed, ["_order", *id_cols, "_src"], block=top).drop("_order", "_src")


def array_width(df: DataFrame, data: str = "data") -> int:
    """The common array length; raises when rows differ."""
    low, high = df.agg(F.min(F.size(data)), F.max(F.size(data))).first()
    if low != high:
        raise ValueError(f"rows of {low} and of {high} values in one dataset")
    return low


def concat_ordered(*frames: DataFrame, id_col: str = "id", data: str | None = "data") -> DataFrame:
    """Inputs one after the other, numbered through (column ``idx``).

    Columns, types and array widths must agree.
    """
    _check_same(frames, dtypes=True)
    if data is not None:
        widths = {array_width(f, data) for f in frames} - {None}
        if len(widths) > 1:
            raise ValueError(f"array widths differ: {sorted(widths)}")
    tagged = reduce(DataFrame.unionByName, [f.withColumn("src_no", F.lit(i)) for i, f in enumerate(frames)])
    return row_index(tagged, [id_col], groups=["src_no"])


def set_range(df: DataFrame, data: str = "data") -> tuple[float, float]:
    """Smallest and largest value of the whole set."""
    low, high = df.agg(F.min(F.array_min(data)), F.max(F.array_max(data))).first()
    return low, high


def to_pixels(df: DataFrame, data: str = "data", each: bool = True, name: str = "pixels") -> DataFrame:
    """0..255 images, scaled one by one or by the range of the whole set."""
    if each:
        return df.withColumn(name, arrays.to_pixels(F.col(data)))
    low, high = set_range(df, data)
    return df.withColumn(name, arrays.to_pixels(F.col(data), F.lit(low), F.lit(high)))


def eight_bit(df: DataFrame, data: str = "data") -> DataFrame:
    """Byte round trip of a set that spans exactly [-1, 1]."""
    low, high = set_range(df, data)
    if (low, high) != (-1.0, 1.0):
        raise ValueError(f"the set must span [-1, 1], not [{low}, {high}]")
    return df.withColumn(data, arrays.eight_bit_round_trip(F.col(data)))


def target_range(df: DataFrame, label: str = "label") -> tuple[int, int]:
    """Smallest label and the number of classes up to the largest."""
    low, high = df.agg(F.min(label), F.max(label)).first()
    return low, high - low + 1


def with_one_hot(df: DataFrame, label: str = "label", classes: int | None = None, name: str = "target") -> DataFrame:
    """One-hot targets; without a class count it is inferred and the smallest label is class 0."""
    base, classes = target_range(df, label) if classes is None else (0, classes)
    return df.withColumn(name, arrays.one_hot(F.col(label), classes, base))


def write_parts(df: DataFrame, path: str, by: str, files_per_part: int | None = None) -> None:
    """One folder per split, chunk or class.

    As given, rows are not moved: no shuffle and no hot task, but every task may write a file
    per part. ``files_per_part`` moves rows by (part, salt) instead, so that a part holding
    much of the data is still written by that many tasks.
    """
    if files_per_part is not None:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != by]), F.lit(files_per_part))
        df = df.repartition(by, salt)
    df.write.mode("overwrite").partitionBy(by).parquet(path)
