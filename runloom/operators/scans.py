"""Ordered scans that no single task has to hold: global row index, running values.

A window without partition keys, or over one very large group, runs in one task.
Both operators here cut the order into blocks of about equal size first:

1. block bounds are quantiles of the order key in a thin sample (a bounded result);
   a value so frequent that it spans several quantiles gets a block of its own,
   cut once more by the quantiles of the tie-break column;
2. each block is summarised (count, max, ...) with a map-side combine, and the
   small block table is scanned for the value carried in from earlier blocks;
3. rows are numbered or accumulated inside their block and the carry is added.

Bounds only balance the work: any bounds give the same, exact result. The number of blocks
follows ``spark.sql.shuffle.partitions``, so it grows with the cluster's set-up.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from runloom.operators.skew import HotKeys, default_share, hot_keys, is_hot, sampling_fraction

# A value that covers this many quantiles is cut by its tie-break column.
TIE_QUANTILES = 4
_KEY, _TIE, _B1, _B2 = "_scan_key", "_scan_tie", "_scan_b1", "_scan_b2"
_COMBINE = {"max": F.max, "min": F.min, "sum": F.sum}


def hash_blocks(hashed: Column, spark: SparkSession) -> Column:
    """The top bits of a 64-bit hash as a block number: evenly spread, in hash order."""
    bits = math.ceil(math.log2(default_share(spark)))
    return F.shiftright(hashed, 64 - bits).cast("int")


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _scale(df: DataFrame, c: Column) -> Column | None:
    """The column as a double that orders alike; None for types that have none."""
    kind = df.select(c).schema[0].dataType
    if isinstance(kind, (NumericType, BooleanType)):
        return c.cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, TimestampNTZType):  # field by field: a zone with daylight saving would reorder it
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")
        return F.unix_date(c.cast("date")) * F.lit(86400.0) + seconds
    return None


def _edges(quantiles: Sequence[float] | None) -> tuple[list[float], list[int]]:
    """Strictly increasing bucket edges, and the numbers of single-value blocks to cut."""
    times = Counter(q for q in quantiles or () if math.isfinite(q))
    frequent = [q for q, n in times.items() if n >= TIE_QUANTILES]
    edges = sorted(set(times) | {math.nextafter(q, math.inf) for q in frequent})
    edges = [-math.inf, *(e for e in edges if math.isfinite(e)), math.inf]
    return edges, [edges.index(q) for q in frequent]


def _bucket(df: DataFrame, edges: list[float], source: str, target: str) -> DataFrame:
    if len(edges) < 3:
        return df.withColumn(target, F.lit(0))
    cut = Bucketizer(splits=edges, inputCol=source, outputCol=target, handleInvalid="keep")
    return cut.transform(df).withColumn(target, F.col(target).cast("int"))


def with_blocks(df: DataFrame, order: Sequence[Column], blocks: int) -> DataFrame:
    """Add block numbers that are non-decreasing in the order. NULL keys come first.

    The first column of the order must be a number or a time. Where the second is one as
    well, it cuts the blocks of very frequent first values.
    """
    lowest = F.lit(float("-inf"))
    key = _scale(df, order[0])
    if key is None:
        raise ValueError("the first order column must be a number or a time")
    tie = _scale(df, order[1]) if len(order) > 1 else None
    keyed = df.withColumn(_KEY, F.coalesce(key, lowest))
    probabilities = [i / blocks for i in range(1, blocks)]
    accuracy = max(10000, 4 * blocks)
    fraction = sampling_fraction(df.count() / blocks)
    wanted = [F.percentile_approx(_KEY, probabilities, accuracy).alias(_KEY)]
    if tie is not None:
        keyed = keyed.withColumn(_TIE, F.coalesce(tie, lowest))
        wanted.append(F.percentile_approx(_TIE, probabilities, accuracy).alias(_TIE))
    bounds = keyed.select(_KEY, *([_TIE] if tie is not None else []))
    bounds = bounds.sample(fraction, seed=0) if fraction < 1 else bounds
    found = bounds.agg(*wanted).first()
    edges, single = _edges(found[_KEY])
    out = _bucket(keyed, edges, _KEY, _B1)
    if tie is not None and single:
        tie_edges, _ = _edges(found[_TIE])
        out = _bucket(out, tie_edges, _TIE, _B2)
        out = out.withColumn(_B2, F.when(F.col(_B1).isin(single), F.col(_B2)).otherwise(0))
    else:
        out = out.withColumn(_B2, F.lit(0))
    return out.drop(_KEY, _TIE)


def row_index(
    df: DataFrame,
    order_by: Sequence[Column | str],
    name: str = "idx",
    start: int = 0,
    groups: Sequence[str] = (),
    block: Column | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Number the rows ``start, start+1, ...`` in a total order.

    ``groups``    leading order columns with few values (set number, flag), not NULL
    ``order_by``  the remaining order, first column a number or a time; give it a second one
                  where many rows may share the first
    ``block``     integer column non-decreasing in ``order_by``, for keys already
                  spread evenly, as hashes are; saves the quantile pass
    """
    order = [_as_column(c) for c in order_by]
    if block is None:
        blocked = with_blocks(df, order, blocks or default_share(df.sparkSession))
    else:
        blocked = df.withColumn(_B1, block).withColumn(_B2, F.lit(0))
    keys = [*groups, _B1, _B2]
    earlier = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocked.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    if block is not None or len(order) == 1:
        # One row per block and group value, so its size is bounded by the block count.
        carry = F.broadcast(carry)
    return (
        blocked.join(carry, keys, "left")
        .withColumn(name, F.col("_carry") + F.row_number().over(inside) + F.lit(start - 1))
        .drop(_B1, _B2, "_carry")
    )


def _merge(kind: str, carried: Column, inner: Column) -> Column:
    if kind == "max":
        return F.greatest(carried, inner)
    if kind == "min":
        return F.least(carried, inner)
    return F.when(carried.isNull(), inner).when(inner.isNull(), carried).otherwise(carried + inner)


def running(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[Column | str],
    outputs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    share: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Running max, min or sum inside each group, in a total order within the group.

    ``outputs`` maps a new column to (kind, expression). With ``inclusive=False`` a
    row sees the rows before it only. Ordinary groups take one window; groups holding
    more than 1/share of all rows are cut into blocks so that no task gets them whole.
    ``hot`` passes those groups on when they are known already.
    """
    order = [_as_column(c) for c in order_by]
    share = share or default_share(df.sparkSession)
    if hot is None:
        hot = hot_keys(df, group_by, share)
    last = 0 if inclusive else -1

    def scan(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return frame.select("*", *[_COMBINE[k](e).over(window).alias(n) for n, (k, e) in outputs.items()])

    if not hot:
        return scan(df, group_by)

    large = F.col("_scan_hot")
    blocked = with_blocks(df.withColumn("_scan_hot", is_hot(group_by, hot)), order, share)
    blocked = blocked.withColumn(_B1, F.when(large, F.col(_B1)).otherwise(0)).withColumn(
        _B2, F.when(large, F.col(_B2)).otherwise(0)
    )
    keys = [*group_by, _B1, _B2]
    summary = blocked.where(large).groupBy(*keys).agg(*[_COMBINE[k](e).alias(n) for n, (k, e) in outputs.items()])
    earlier = Window.partitionBy(*group_by).orderBy(_B1, _B2).rowsBetween(Window.unboundedPreceding, -1)
    # share groups x share blocks x share tie blocks at the very most, usually far fewer;
    # left to the planner's own size check rather than hinted.
    carry = summary.select(*keys, *[_COMBINE[k](F.col(n)).over(earlier).alias(f"_c_{n}") for n, (k, _) in outputs.items()])
    scanned = scan(blocked.join(carry, keys, "left"), keys)
    merged = [_merge(k, F.col(f"_c_{n}"), F.col(n)).alias(n) for n, (k, _) in outputs.items()]
    return scanned.select(*df.columns, *merged)
