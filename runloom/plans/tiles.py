"""Layers as block products: image blocks meet weight tiles in cogrouped tasks, for models of any size.

A task holds the cells of one block of images and one tile of weights, never a whole model or a whole
layer: inputs are dealt by a hash of the image id, and every tile is sent to every image block. There
is one plan at every size; nothing is broadcast. Tiles come from a network on the driver or from a
Parquet table written by ``save_tiles``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from runloom.functions import neural
from runloom.operators import sliding
from runloom.operators.sliding import output_size
from runloom.plans.kernels import _add_windows, windows
from runloom.plans.network import NetConfig, Network
from runloom.session import cut_lineage

# A tile of a dense layer has so many inputs and outputs at most; a tile of kernels so many output channels.
TILE_INPUTS, TILE_OUTPUTS, TILE_CHANNELS = 4096, 256, 64
# Cells of the images of one block, as input or as output.
BLOCK_CELLS = 1 << 21
_TILES = "layer int, kt int, jt int, w binary, b binary, config string"


def tile_batches(net: Network) -> Iterator[pa.RecordBatch]:
    """The tiles of each layer that learns: (layer, kt, jt, w, b, config), arrays as raw doubles."""
    config = json.dumps(net.config.to_dict())
    for n, (w, b, conf) in enumerate(zip(net.weights, net.biases, net.config.network, strict=True)):
        if conf.type == "MAXPOOL":
            continue
        dense = w.ndim == 2
        step_in, step_out = (TILE_INPUTS, TILE_OUTPUTS) if dense else (w.shape[0], TILE_CHANNELS)
        for kt in range(-(-w.shape[0] // step_in)):
            for jt in range(-(-w.shape[1] // step_out)):
                k, j = slice(kt * step_in, (kt + 1) * step_in), slice(jt * step_out, (jt + 1) * step_out)
                columns = [[n], [kt], [jt], [np.ascontiguousarray(w[k, j]).tobytes()], [b[j].tobytes()], [config]]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["layer", "kt", "jt", "w", "b", "config"])


def tiles_of(spark: SparkSession, net: Network) -> DataFrame:
    batches = list(tile_batches(net))
    return spark.createDataFrame(pa.Table.from_batches(batches)) if batches else spark.createDataFrame([], _TILES)


def save_tiles(spark: SparkSession, net: Network, path: str) -> None:
    """The network as a Parquet table of tiles, a few at a time; what was there is replaced."""
    mode, held, size = "overwrite", [], 0
    batches = list(tile_batches(net))
    for i, batch in enumerate(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= 256 << 20 or i == len(batches) - 1:
            spark.createDataFrame(pa.Table.from_batches(held)).write.mode(mode).parquet(path)
            mode, held, size = "append", [], 0


def tiles_config(tiles: DataFrame) -> NetConfig:
    return NetConfig.from_dict(json.loads(tiles.select("config").first()[0]))


def image_blocks(spark: SparkSession, images: int, cells: int) -> int:
    """Blocks for so many images of so many cells each, as input or output of a layer."""
    return max(1, -(-images * cells // BLOCK_CELLS), min(images, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _met(inputs: DataFrame, tiles: DataFrame, blocks: int, kt: Column, jts: int, work: Callable, out: StructType) -> DataFrame:
    """``work`` over each image block and tile; inputs go to the tiles of their input range."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    left = inputs.select("*", block, kt.cast("int").alias("kt"), F.explode(F.sequence(F.lit(0), F.lit(jts - 1))).alias("jt"))
    right = tiles.select("kt", "jt", "w", "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["block", "kt", "jt"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, out)


def _fields(inputs: DataFrame, *names: str) -> StructType:
    whole = [StructField(n, IntegerType()) for n in names[:-1]]
    return StructType([StructField("id", inputs.schema["id"].dataType), *whole, StructField(names[-1], DoubleType())])


def _images(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The different ids, and for each row the number of its id."""
    ids = table.column("id").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    coded = ids.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _rows(ids: pa.Array, axes: list[tuple[str, np.ndarray]], values: np.ndarray, schema: StructType) -> pa.Table:
    """Long rows of an array (image, axis, ...) whose axes have the given labels."""
    at = np.unravel_index(np.arange(values.size), values.shape)
    columns = [ids.take(pa.array(at[0]))]
    columns += [pa.array(labels[i].astype(np.int32)) for (_, labels), i in zip(axes, at[1:], strict=True)]
    return pa.Table.from_arrays([*columns, pa.array(values.reshape(-1))], names=schema.fieldNames())


def dense(inputs: DataFrame, tiles: DataFrame, sizes: tuple[int, int], images: int) -> DataFrame:
    """x.W + b per (id, j, z) from rows ``(id, k, v)``; ``sizes`` are the numbers of inputs and outputs.

    Products of an input range and an output range are added up by image block and output range; where
    one range holds all inputs, the bias is added at once and nothing more is shuffled.
    """
    n_in, n_out = sizes
    blocks = image_blocks(inputs.sparkSession, images, max(sizes))
    jts, once = -(-n_out // TILE_OUTPUTS), n_in <= TILE_INPUTS
    out = _fields(inputs, "j", "z")

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([left.column("id"), pa.array([], pa.int32()), pa.array([], pa.float64())], names=["id", "j", "z"])
        ids, row = _images(left)
        kt, jt = right.column("kt")[0].as_py(), right.column("jt")[0].as_py()
        b = np.frombuffer(right.column("b")[0].as_py())
        w = np.frombuffer(right.column("w")[0].as_py()).reshape(-1, len(b))
        k, v = _numbers(left, "k", "v")
        x = np.zeros((len(ids), len(w)))
        x[row, k - kt * TILE_INPUTS] = v
        return _rows(ids, [("j", jt * TILE_OUTPUTS + np.arange(len(b)))], x @ w + (b if once else 0.0), out)

    made = _met(inputs.select("id", "k", "v"), tiles, blocks, F.floor(F.col("k") / TILE_INPUTS), jts, multiply, out)
    if once:
        return made

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([left.column("id"), pa.array([], pa.int32()), pa.array([], pa.float64())], names=["id", "j", "z"])
        ids, row = _images(left)
        b = np.frombuffer(right.column("b")[0].as_py())
        j, z = _numbers(left, "j", "z")
        first = right.column("jt")[0].as_py() * TILE_OUTPUTS
        order = np.lexsort((z, j, row))  # a retry adds in the same order
        sums = np.zeros((len(ids), len(b)))
        np.add.at(sums, (row[order], j[order] - first), z[order])
        return _rows(ids, [("j", first + np.arange(len(b)))], sums + b, out)

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = made.select("*", block.alias("block"), F.floor(F.col("j") / TILE_OUTPUTS).cast("int").alias("jt"))
    right = tiles.where("kt = 0").select("jt", "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return left.groupBy("block", "jt").cogroup(right.groupBy("block", "jt")).applyInArrow(add, out)


def _image(left: pa.Table, shape: tuple[int, int, int], names: tuple[str, str, str, str]) -> tuple[pa.Array, np.ndarray]:
    ids, row = _images(left)
    c, y, x, v = _numbers(left, *names)
    out = np.zeros((len(ids), *shape))
    out[row, c, y, x] = v
    return ids, out


def _none(schema: StructType, ids: pa.ChunkedArray) -> pa.Table:
    return pa.Table.from_arrays([ids.slice(0, 0), *[pa.array([], pa.int32())] * (len(schema) - 2), pa.array([], pa.float64())], names=schema.fieldNames())


def _kernels(right: pa.Table, c_in: int, kernel: int) -> tuple[int, np.ndarray, np.ndarray]:
    b = np.frombuffer(right.column("b")[0].as_py())
    w = np.frombuffer(right.column("w")[0].as_py()).reshape(c_in, len(b), kernel, kernel)
    return right.column("jt")[0].as_py() * TILE_CHANNELS, w, b


def _steps(images: int, cells: int) -> Iterator[slice]:
    step = max(1, BLOCK_CELLS // max(cells, 1))
    return (slice(i, i + step) for i in range(0, images, step))


def convolve(cells: DataFrame, tiles: DataFrame, shape: tuple[int, int, int], channels: int, kernel: int, stride: int, padding: int, images: int) -> DataFrame:
    """relu(b[e] + sum x * w) per (id, c, y, x, v); ``shape`` is (channels, height, width) of the input."""
    rows, cols = output_size(shape[1], kernel, stride, padding), output_size(shape[2], kernel, stride, padding)
    blocks = image_blocks(cells.sparkSession, images, max(shape[0] * shape[1] * shape[2], min(channels, TILE_CHANNELS) * rows * cols))
    out = _fields(cells, "c", "y", "x", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _none(out, left.column("id"))
        ids, x = _image(left, shape, ("c", "y", "x", "v"))
        first, w, b = _kernels(right, shape[0], kernel)
        parts = []
        for s in _steps(len(ids), shape[0] * rows * cols * kernel * kernel):
            z = np.tensordot(windows(x[s], kernel, stride, padding), w, axes=((1, 4, 5), (0, 2, 3))) + b
            parts.append(np.maximum(np.moveaxis(z, -1, 1), 0.0))
        axes = [("c", first + np.arange(len(b))), ("y", np.arange(rows)), ("x", np.arange(cols))]
        return _rows(ids, axes, np.concatenate(parts), out)

    return _met(cells.select("id", "c", "y", "x", "v"), tiles, blocks, F.lit(0), -(-channels // TILE_CHANNELS), run, out)


def convolve_input_gradient(
    deltas: DataFrame, tiles: DataFrame, shape: tuple[int, int, int], channels: int, kernel: int, stride: int, padding: int, images: int
) -> DataFrame:
    """Gradient ``g`` of each input cell (id, c, y, x): the transposed convolution of ``(id, e, i, j, d)``.

    Deltas meet the tile of their channels, and what the tiles add to a cell is summed; the cells' values
    are not needed.
    """
    rows, cols = output_size(shape[1], kernel, stride, padding), output_size(shape[2], kernel, stride, padding)
    blocks = image_blocks(deltas.sparkSession, images, max(shape[0] * shape[1] * shape[2], min(channels, TILE_CHANNELS) * rows * cols))
    out = _fields(deltas, "c", "y", "x", "g")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _none(out, left.column("id"))
        first, w, b = _kernels(right, shape[0], kernel)
        ids, row = _images(left)
        e, i, j, d = _numbers(left, "e", "i", "j", "d")
        delta = np.zeros((len(ids), len(b), rows, cols))
        delta[row, e - first, i, j] = d
        part = lambda ky, kx: np.einsum("neij,ce->ncij", delta, w[:, :, ky, kx])
        grid = _add_windows(part, (len(ids), *shape), (rows, cols), kernel, stride, padding)
        axes = [("c", np.arange(shape[0])), ("y", np.arange(shape[1])), ("x", np.arange(shape[2]))]
        return _rows(ids, axes, grid, out)

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    left = deltas.select("id", "e", "i", "j", "d", block, F.floor(F.col("e") / TILE_CHANNELS).cast("int").alias("jt"))
    right = tiles.select("jt", "w", "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    made = left.groupBy("block", "jt").cogroup(right.groupBy("block", "jt")).applyInArrow(run, out)
    if channels <= TILE_CHANNELS:
        return made
    return made.groupBy("id", "c", "y", "x").agg(F.sum("g").alias("g"))


def forward(cells: DataFrame, config: NetConfig, tiles: DataFrame, images: int | None = None) -> DataFrame:
    """The forward pass over long tables: no model broadcast, any model size.

    ``cells`` are ``(id, c, y, x, v)`` for images and ``(id, k, v)`` for dense input; the
    result is ``(id, j, y)``. A layer is one exchange by image block; pooling is columns over rows of
    an image, and softmax sums by image.
    """
    size = config.image()[1:] if config.image() else None
    inside, frame = config.input_num_channels, cells
    if images is None:
        images = -(-cells.count() // max(1, inside * (size[0] * size[1] if size else 1)))
    for n, (layer, shape, out_size) in enumerate(config.walk()):
        own = tiles.where(F.col("layer") == n)
        if layer.type == "MAXPOOL":
            frame = sliding.max_pool(frame, *size, layer.kernel_size, layer.stride, layer.padding)
        elif layer.type == "CONVOLUTION":
            frame = convolve(frame, own, (inside, *size), layer.num_channels, layer.kernel_size, layer.stride, layer.padding, images)
        else:
            if size is not None:
                k = F.col("c") * (size[0] * size[1]) + F.col("y") * size[1] + F.col("x")
                frame = frame.select("id", k.cast("int").alias("k"), "v")
            frame = activate(dense(frame, own, shape, images), layer.type).select("id", F.col("j").alias("k"), "v")
        size, inside = out_size, layer.num_channels
    return frame.select("id", F.col("k").alias("j"), F.col("v").alias("y")) if size is None else frame


def activate(z: DataFrame, kind: str) -> DataFrame:
    if kind == "FC_SIG":
        return z.withColumn("v", neural.sigmoid(F.col("z")))
    if kind == "FC_LIN":
        return z.withColumn("v", F.col("z"))
    if kind != "FC_SOFTMAX":
        raise ValueError(f"{kind} has no join form")
    power = F.exp(F.least(F.col("z"), F.lit(neural.EXP_CLAMP)))
    whole = z.groupBy("id").agg(F.sum(power).alias("_s"), F.collect_list(F.struct("j", power.alias("p"))).alias("_p"))
    return whole.select("id", F.explode("_p").alias("o"), "_s").select("id", "o.j", F.try_divide("o.p", F.col("_s")).alias("v"))


def relational_forward(cells: DataFrame, net: Network) -> DataFrame:
    """``forward`` with the weights of a network on the driver."""
    return forward(cells, net.config, tiles_of(cells.sparkSession, net))


def score_tiles(df: DataFrame, tiles: DataFrame, *keep: str, data: str = "data") -> DataFrame:
    """Add ``predicted`` and ``y`` to rows with an array column, by a model kept as a table of tiles.

    The form of scoring for models above the broadcast limit: a task holds one tile of it. Outputs of a row are
    put together as an array, so these must fit a row, as inputs do.
    """
    config = tiles_config(tiles)
    rows = df.select(*keep, F.col(data).alias("_data")).withColumn("_row", F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    image = config.image()
    at = rows.select(F.col("_row").alias("id"), F.posexplode("_data").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    if image:
        plane = image[1] * image[2]
        place = [F.floor(F.col("k") / plane), F.floor(F.pmod(F.col("k"), F.lit(plane)) / image[2]), F.pmod(F.col("k"), F.lit(image[2]))]
        at = at.select("id", *[p.cast("int").alias(n) for p, n in zip(place, "cyx", strict=True)], "v")
    out = forward(at, config, tiles, rows.count())
    if "j" not in out.columns:
        _, shape = config.image(), config.walk()
        *_, (_, _, size) = shape
        out = out.select("id", (F.col("c") * (size[0] * size[1]) + F.col("y") * size[1] + F.col("x")).alias("j"), F.col("v").alias("y"))
    whole = out.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("j", "y"))).alias("o"))
    whole = whole.select(F.col("id").alias("_row"), F.col("o.y").alias("y"))
    best = (F.array_position("y", F.array_max("y")) - 1).cast("int").alias("predicted")
    return rows.join(whole, "_row").select(*keep, best, "y")
