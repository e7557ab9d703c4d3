"""Hot keys: finding them by sums over a few groups of keys, and joins that split them.

What is found only decides how work is cut. Every operator here gives the same, exact rows
whichever keys it lists.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import MapType, VariantType

# Sampled rows expected for a key just at the limit; far more for the keys that matter.
SAMPLED = 64
# Groups of keys that are summed for each part, and in all at most.
GROUPS_PER_PART, MOST_GROUPS = 64, 1 << 16
_BITS = 64


def default_share(spark: SparkSession) -> int:
    """Two parts per shuffle partition, 16 at least."""
    return max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_hash(keys: Sequence[str], like: DataFrame | None = None) -> Column:
    """Hash of the key columns, cast to the types of ``like`` so that two frames agree."""
    cast = lambda k: F.col(k) if like is None else F.col(k).cast(like.schema[k].dataType)
    return F.xxhash64(*[cast(k) for k in keys])


@dataclass(frozen=True)
class HotKeys:
    """Row counts by key hash, and the size above which a key counts as hot."""

    counts: dict[int, int]
    limit: float

    def __bool__(self) -> bool:
        return bool(self.counts)


def hot_keys(df: DataFrame, keys: Sequence[str], share: int) -> HotKeys:
    """Keys that hold more than about 1/share of all rows: no more than share of them.

    Only the share decides, at every size. Keys are dealt into groups by their hash, and one pass counts
    each group's rows and, bit by bit, those whose hash has the bit. A key with more than half of
    its group's rows is spelled by the majority of each bit, and how clear the majorities are tells its
    rows. Sums combine in tasks, so neither rows nor keys are shuffled. Two hot keys of one group
    hide each other, which costs balance and nothing else. A key of one row is never hot.
    """
    groups = min(GROUPS_PER_PART * share, MOST_GROUPS)
    hashes = df.select(key_hash(keys).alias("h"))
    ones = F.array(*[F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1))) for i in range(_BITS)]).alias("ones")
    sums = hashes.groupBy(F.pmod("h", F.lit(groups)).alias("g")).agg(F.count(F.lit(1)).alias("n"), ones)
    limit = F.greatest(F.sum("n").over(Window.partitionBy()) / share, F.lit(2.0))  # over the groups, which are few
    large = sums.select("*", limit.alias("limit")).where(F.col("n") >= F.col("limit")).collect()
    counts, most = {}, 2.0
    for r in large:
        n, most = r["n"], r["limit"]
        key = sum(1 << i for i, b in enumerate(r["ones"]) if 2 * b > n)
        key -= (key >> (_BITS - 1)) << _BITS
        # The other rows of the group have each bit about every second time.
        rows = n * (2 * sum(max(b, n - b) for b in r["ones"]) / (_BITS * n) - 1)
        if key % groups == r["g"] and rows > most / 2 and rows >= 2:
            counts[key] = max(rows, most)
    return HotKeys(counts, most)


def sampling_fraction(rows_per_part: float) -> float:
    """Thin enough to be cheap, with ``SAMPLED`` rows expected per part of that many rows."""
    return min(1.0, SAMPLED / max(rows_per_part, 1.0))


def is_hot(keys: Sequence[str], hot: HotKeys) -> Column:
    return key_hash(keys).isin(list(hot.counts)) if hot else F.lit(False)


def _salts(hashed: Column, hot: HotKeys) -> Column:
    """Parts of a key, a power of two that follows its size; 1 for ordinary keys."""
    levels: dict[int, list[int]] = {}
    for h, n in hot.counts.items():
        levels.setdefault(1 << math.ceil(math.log2(n / max(hot.limit, 1))), []).append(h)
    return reduce(lambda c, item: F.when(hashed.isin(item[1]), item[0]).otherwise(c), levels.items(), F.lit(1))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    share: int | None = None,
    split: bool = True,
) -> DataFrame:
    """Join where a key of ``left`` may hold much of the data and ``right`` is unique per key.

    Rows of a hot key are spread over salts by a hash of the row and its partition, which a
    repeated task computes alike, and the partner row is repeated once per salt: fewer than
    4 x share extra rows in all. Without hot keys this is a plain join, and the planner is
    free to broadcast either way, as it is with ``split`` off. Columns: those of ``left``, then
    the rest of ``right``.
    """
    on = list(on)
    share = share or default_share(left.sparkSession)
    hot = hot_keys(left, on, share) if split else HotKeys({}, 1.0)
    kept = [c for c in right.columns if c not in on] if how not in ("left_semi", "left_anti") else []
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) if null_safe else F.col(k) == F.col(f"_r_{k}") for k in on]
    rest = [c for c in right.columns if c not in on]
    if hot:
        hashed = F.xxhash64(*[f.name for f in left.schema.fields if not isinstance(f.dataType, (MapType, VariantType))])
        parts = _salts(key_hash(on), hot)
        salt = F.pmod(F.pmod(hashed, parts) + F.spark_partition_id(), parts)  # reduced first: no overflow
        left_columns, left = left.columns, left.withColumn("_salt", salt)
        repeat = F.sequence(F.lit(0), _salts(key_hash(on, left), hot) - 1)
        right = right.withColumn("_r_salt", F.explode(repeat))
        same.append(F.col("_salt") == F.col("_r_salt"))
        rest = [*rest, "_r_salt"]
    else:
        left_columns = left.columns
    partner = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *rest)
    return left.join(partner, reduce(lambda a, b: a & b, same), how).select(*left_columns, *kept)
