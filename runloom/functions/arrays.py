"""Array expressions on flat, row-major (channel, y, x) data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    Writing ``transform(a, v -> v / aggregate(a))`` would fold the array again for
    every element; binding the fold through a one-element array keeps it linear.
    """
    return F.transform(F.array(value), body)[0]


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def argmax(values: Column) -> Column:
    """Zero-based position of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def ascending(values: Column) -> Column:
    """Order statistics of a row: element 0 is the smallest."""
    return F.array_sort(values)


def one_hot(label: Column, classes: int, base: int = 0) -> Column:
    """``classes`` doubles with a 1 at ``label - base``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: F.when(i == label - base, 1.0).otherwise(0.0),
    )


def _scaled(values: Column, low: Column, high: Column, finish: Callable[[Column, Column], Column]) -> Column:
    span = F.struct(low.alias("lo"), high.alias("hi"))
    return let(span, lambda s: F.transform(values, lambda v: finish(v - s["lo"], s["hi"] - s["lo"])))


def to_pixels(values: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Rescale to 0..255 and truncate; a constant image becomes 0.

    Without ``low``/``high`` each image is scaled by its own range, with them by
    the range of a whole set.
    """
    low = F.array_min(values) if low is None else low
    high = F.array_max(values) if high is None else high
    return _scaled(
        values,
        low,
        high,
        lambda v, span: F.floor(F.coalesce(F.try_divide(F.lit(255.0), span) * v, F.lit(0.0))).cast("int"),
    )


def to_unit_range(values: Column) -> Column:
    """Min-max to [-1, 1] over the whole array; NULL elements when it is constant."""
    return _scaled(
        values,
        F.array_min(values),
        F.array_max(values),
        lambda v, span: F.try_divide(v * 2.0, span) - 1.0,
    )


def to_unit_range_by_channel(values: Column, channels: int, pixels: int) -> Column:
    """Min-max to [-1, 1] separately for each channel plane of ``pixels`` cells."""
    planes = [to_unit_range(F.slice(values, c * pixels + 1, pixels)) for c in range(channels)]
    return planes[0] if channels == 1 else F.concat(*planes)


def eight_bit_round_trip(values: Column) -> Column:
    """What is left of [-1, 1] data after storing it as unsigned bytes."""
    return F.transform(values, lambda v: (F.floor((v + 1.0) / 2.0 * 255.0) / 255.0 - 0.5) * 2.0)


def from_eight_bit(values: Column) -> Column:
    """Unsigned bytes to [-1, 1]."""
    return F.transform(values, lambda v: v / 127.5 - 1.0)


def channels_first(values: Column, channels: int, height: int, width: int) -> Column:
    """(y, x, channel) order to (channel, y, x) order."""
    plane = height * width
    return F.transform(
        F.sequence(F.lit(0), F.lit(channels * plane - 1)),
        lambda i: F.get(values, (F.pmod(i, F.lit(plane)) * channels + F.floor(i / plane)).cast("int")),
    )


def cells(df: DataFrame, data: str, height: int, width: int, *keep: str, value: str = "v") -> DataFrame:
    """One row per array cell with its (c, y, x) coordinates."""
    plane = height * width
    flat = df.select(*keep, F.posexplode(data).alias("pos", value))
    return flat.select(
        *keep,
        F.floor(F.col("pos") / plane).cast("int").alias("c"),
        F.floor(F.pmod(F.col("pos"), F.lit(plane)) / width).cast("int").alias("y"),
        F.pmod(F.col("pos"), F.lit(width)).alias("x"),
        value,
    )


def spread(values: Column, prefix: str, count: int) -> list[Column]:
    """Array elements as columns ``prefix0 .. prefix{count-1}``."""
    return [F.get(values, F.lit(i)).alias(f"{prefix}{i}") for i in range(count)]
