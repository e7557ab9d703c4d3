"""Sliding 2-D windows over long image tables ``(id, c, y, x, v)``.

Each cell is sent to the output positions whose window covers it. The positions follow
from the coordinates, so this is a local expansion of k x k rows per cell at most, not a
join. Maxima, minima and sums need none: rows first, then columns (``separable_windows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def output_size(size: int, kernel: int, stride: int, padding: int) -> int:
    """(size + 2p - k) / s + 1, which must divide exactly."""
    span = size + 2 * padding - kernel
    if span < 0 or span % stride:
        raise ValueError(f"kernel {kernel}, stride {stride}, padding {padding} do not fit {size}")
    return span // stride + 1


def patch_cells(
    cells: DataFrame, height: int, width: int, kernel: int, stride: int = 1, padding: int = 0
) -> DataFrame:
    """Rows ``(..., i, j, ky, kx)``: cell (y, x) is kernel cell (ky, kx) of window (i, j)."""
    if padding >= kernel:
        raise ValueError("windows that lie in the border only have no cells; use padding < kernel")
    rows, cols = output_size(height, kernel, stride, padding), output_size(width, kernel, stride, padding)

    def fits(position: Column, k: Column, count: int) -> Column:
        start = position + padding - k
        return (start >= 0) & (F.pmod(start, F.lit(stride)) == 0) & (start < stride * count)

    steps = F.sequence(F.lit(0), F.lit(kernel - 1))
    place = lambda p, k: F.floor((p + padding - k) / stride).cast("int")
    by_row = cells.select("*", F.explode(F.filter(steps, lambda k: fits(F.col("y"), k, rows))).alias("ky"))
    by_cell = by_row.select("*", F.explode(F.filter(steps, lambda k: fits(F.col("x"), k, cols))).alias("kx"))
    return by_cell.withColumn("i", place(F.col("y"), F.col("ky"))).withColumn("j", place(F.col("x"), F.col("kx")))


def window2d(
    cells: DataFrame,
    height: int,
    width: int,
    kernel: int,
    stride: int,
    padding: int,
    aggregates: dict[str, Column],
    with_padding: bool = False,
) -> DataFrame:
    """Any aggregate of ``v`` over each window of each channel.

    With ``with_padding`` the zero cells a window takes from the border are rows too;
    they are made for overhanging windows only.
    """
    inside = patch_cells(cells, height, width, kernel, stride, padding)
    if with_padding and padding:
        rows, cols = output_size(height, kernel, stride, padding), output_size(width, kernel, stride, padding)
        border = [
            (i, j, ky, kx)
            for i in range(rows)
            for j in range(cols)
            for ky in range(kernel)
            for kx in range(kernel)
            if not (0 <= i * stride - padding + ky < height and 0 <= j * stride - padding + kx < width)
        ]
        zeros = F.array(*[F.struct(*[F.lit(n).alias(a) for a, n in zip(("i", "j", "ky", "kx"), b)]) for b in border])
        corner = cells.where((F.col("y") == 0) & (F.col("x") == 0)).select("id", "c", F.explode(zeros).alias("b"))
        pad = corner.select("id", "c", F.lit(0.0).alias("v"), "b.*")
        inside = inside.select("id", "c", "v", "i", "j", "ky", "kx").unionByName(pad)
    return inside.groupBy("id", "c", "i", "j").agg(*[a.alias(n) for n, a in aggregates.items()])


def _field(name: str):
    return lambda x: x[name]


_REDUCE = {"max": F.array_max, "min": F.array_min, "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)}


def separable_windows(
    cells: DataFrame, height: int, width: int, kernel: int, stride: int, padding: int, kinds: dict[str, str], with_padding: bool = False
) -> DataFrame:
    """Rows ``(id, c, i, j)`` with the max, min or sum of ``v`` over each window: ``kinds`` maps names to them.

    The windows of one row of an image are taken first, and then of the columns of these: a cell is in
    k windows of its row and k of its column instead of k x k, and what goes on is a row or a column of an
    image as one array. Both passes are grouped within one exchange by image. With ``with_padding``
    the zero cells of the border take part. Cells that an image lacks take no part.
    """
    if padding >= kernel:
        raise ValueError("windows that lie in the border only have no cells; use padding < kernel")
    names = list(kinds)

    def along(frame: DataFrame, at: str, line: str, size: int, place: str) -> DataFrame:
        """One pass: (id, c, line, place, names) from (id, c, line, at, names), windows of length ``kernel`` over ``at``."""
        count = output_size(size, kernel, stride, padding)
        held = frame.groupBy("id", "c", line).agg(F.sort_array(F.collect_list(F.struct(at, *names))).alias("run"))

        def window(p: Column) -> Column:
            first = p * stride - padding
            # Where no cell lacks, positions are indexes.
            whole = F.slice("run", F.greatest(first, F.lit(0)) + 1, F.least(first + kernel, F.lit(size)) - F.greatest(first, F.lit(0)))
            some = F.filter("run", lambda x: (x[at] >= first) & (x[at] < first + kernel))
            inside = F.when(F.size("run") == size, whole).otherwise(some)
            overhangs = (first < 0) | (first + kernel > size)

            def reduced(values: Column) -> list[Column]:
                out = []
                for name, kind in kinds.items():
                    value = _REDUCE[kind](F.transform(values, _field(name)))
                    if with_padding and kind != "sum":
                        zero = F.greatest(value, F.lit(0.0)) if kind == "max" else F.least(value, F.lit(0.0))
                        value = F.when(overhangs, zero).otherwise(value)
                    out.append(value.alias(name))
                return out

            made = F.transform(F.array(inside), lambda values: F.struct(p.alias(place), *reduced(values)))[0]
            return F.when(F.size(inside) > 0, made)

        windows = F.filter(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), window), lambda x: x.isNotNull())
        return held.select("id", "c", line, F.explode(windows).alias("w")).select("id", "c", line, f"w.{place}", *[f"w.{n}" for n in names])

    start = cells.select("id", "c", "y", "x", *[F.col("v").cast("double").alias(n) for n in names]).repartition("id")
    by_row = along(start, "x", "y", width, "j")
    return along(by_row, "y", "j", height, "i").select("id", "c", "i", "j", *names)


def max_pool(cells: DataFrame, height: int, width: int, kernel: int, stride: int, padding: int) -> DataFrame:
    """Largest value of each window; border cells are 0 and take part."""
    pooled = separable_windows(cells, height, width, kernel, stride, padding, {"v": "max"}, with_padding=True)
    return pooled.select("id", "c", F.col("i").alias("y"), F.col("j").alias("x"), "v")


def dense_weight_gradient(inputs: DataFrame, deltas: DataFrame) -> DataFrame:
    """sum over rows of x[k] * delta[j], rows ``(k, j, g)``.

    Both sides are joined on the row id as arrays, so each id meets once and nothing is
    paired across ids.
    """
    x = inputs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("xs"))
    d = deltas.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("j", "d"))).alias("ds"))
    pairs = x.join(d, "id").select(F.explode("xs").alias("k", "v"), "ds").select("k", "v", F.explode("ds").alias("j", "d"))
    return pairs.groupBy("k", "j").agg(F.sum(F.col("v") * F.col("d")).alias("g"))


def convolve_weight_gradient(
    cells: DataFrame, deltas: DataFrame, height: int, width: int, kernel: int, stride: int, padding: int
) -> DataFrame:
    """Gradient of each kernel cell; deltas are ``(id, e, i, j, d)`` after the activation slope."""
    patches = patch_cells(cells, height, width, kernel, stride, padding)
    return (
        patches.join(deltas, ["id", "i", "j"])
        .groupBy("c", "e", "ky", "kx")
        .agg(F.sum(F.col("v") * F.col("d")).alias("g"))
    )


def max_pool_input_gradient(
    cells: DataFrame, pooled: DataFrame, deltas: DataFrame, height: int, width: int, kernel: int, stride: int, padding: int
) -> DataFrame:
    """Each cell equal to its window's maximum gets the full gradient; overlaps add up."""
    windows = pooled.select("id", "c", F.col("y").alias("i"), F.col("x").alias("j"), F.col("v").alias("_top"))
    patches = patch_cells(cells, height, width, kernel, stride, padding)
    hit = F.when(F.col("v") == F.col("_top"), F.col("d")).otherwise(0.0)
    return (
        patches.join(windows.join(deltas, ["id", "c", "i", "j"]), ["id", "c", "i", "j"])
        .groupBy("id", "c", "y", "x")
        .agg(F.sum(hit).alias("g"))
    )
