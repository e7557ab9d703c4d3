"""Scoring: the broadcast model meets the data where it lies, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from runloom.functions import arrays
from runloom.operators import reports
from runloom.plans.kernels import windows
from runloom.plans.network import Network, NetConfig, ann_bias, ann_weights
from runloom.session import cut_lineage

SLICE_BYTES = 64 << 20


def as_matrix(column: pa.Array) -> np.ndarray:
    """List column to a (rows, width) array of doubles; every row must have the same width and no NULL element."""
    if len(column) == 0:
        return np.zeros((0, 0))
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or (widths != widths[0]).any():
        raise ValueError("array column with NULL rows or rows of different width")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("array column with NULL elements")
    flat = flat.to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def as_lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def as_targets(column: pa.Array, classes: int) -> np.ndarray:
    """One-hot rows of an integer label column, or the rows of a target array column."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return as_matrix(column)
    labels = column.to_numpy(zero_copy_only=False)
    outside = ~((labels >= 0) & (labels < classes))  # NULL arrives as NaN
    if outside.any():
        raise ValueError(f"label {labels[outside][0]} outside 0..{classes - 1}")
    return np.eye(classes)[labels.astype(np.int64)]


def slices(rows: int, row_bytes: int) -> Iterator[slice]:
    """Row ranges whose largest intermediate stays within ``SLICE_BYTES``."""
    step = max(1, SLICE_BYTES // row_bytes)
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def score(
    df: DataFrame,
    net: Network,
    *keep: str,
    data: str = "data",
    target: str | None = None,
    with_y: bool = True,
    keep_if_wrong: Sequence[str] = (),
) -> DataFrame:
    """Add ``predicted`` and ``y``, and with a target also ``cost`` and ``correct`` (0/1).

    ``target`` is an integer label or a target array column. Only the kept, data and target
    columns are read; columns in ``keep_if_wrong`` come back for misclassified rows only and
    are NULL elsewhere. The network is broadcast once; rows stay in their partitions.
    """
    keep = (*keep, *keep_if_wrong)
    shipped = Network.ship(df.sparkSession, {0: net})
    needed = list(dict.fromkeys([*keep, data, *([target] if target else [])]))
    source = df.select(*needed)
    added = [StructField("predicted", IntegerType())]
    if with_y:
        added.append(StructField("y", ArrayType(DoubleType())))
    if target:
        added += [StructField("cost", DoubleType()), StructField("correct", IntegerType())]
    schema = StructType([source.schema[k] for k in keep] + added)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.load()[0]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = as_matrix(batch.column(data))
            y = np.concatenate([model.forward(x[s])[-1] for s in slices(len(x), model.config.row_bytes())])
            y = y.reshape(len(x), -1)
            best = y.argmax(axis=1)
            added = [pa.array(best.astype(np.int32))]
            if with_y:
                added.append(as_lists(y))
            kept = {k: batch.column(k) for k in keep}
            if target:
                t = as_targets(batch.column(target), y.shape[1])
                correct = t.argmax(axis=1) == best
                added.append(pa.array(model.row_cost(y, t)))
                added.append(pa.array(correct.astype(np.int32)))
                for k in keep_if_wrong:
                    kept[k] = kept[k].take(pa.array(np.arange(len(x)), mask=correct))
            columns = [*kept.values(), *added]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def predict(df: DataFrame, net: Network, *keep: str, data: str = "data") -> DataFrame:
    """Predicted class per row, beside its name."""
    return score(df, net, *keep, data=data, with_y=False)


def evaluate(df: DataFrame, net: Network, data: str = "data", target: str = "label") -> DataFrame:
    """One row: entries, accuracy (0 unless the cost is cross-entropy), mean cost."""
    scored = score(df, net, data=data, target=target, with_y=False)
    return scored.agg(
        F.count(F.lit(1)).alias("num_entries"),
        F.coalesce(reports.accuracy_of("correct", net.config.cost), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(F.sum("cost"), F.count(F.lit(1))), F.lit(0.0)).alias("cost"),
    )


def evaluate_details(
    df: DataFrame, net: Network, set_name: str = "null", id_col: str = "id", data: str = "data", target: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """(ranked probability rows, misclassified images).

    Scores are checkpointed once, as the ranking and the images read them several times;
    images are kept for wrong rows only, so the checkpoint stays far smaller than the data.
    """
    scored = score(df, net, id_col, target, data=data, target=target, keep_if_wrong=[data])
    scored = cut_lineage(scored.drop("cost"))
    detail = reports.evaluation_detail(scored, net.config.network[-1].num_channels, set_name, id_col)
    one_hot = isinstance(scored.schema[target].dataType, ArrayType)
    label = arrays.argmax(F.col(target)) if one_hot else F.col(target)
    channels = (net.config.image() or (1,))[0]
    wrong = reports.misclassified(scored.withColumn("label", label), id_col, data, channels)
    return detail, wrong


def map_windows(
    df: DataFrame,
    f: Callable[[np.ndarray], np.ndarray],
    *keep: str,
    image: tuple[int, int, int],
    kernel: int,
    stride: int = 1,
    padding: int = 0,
    data: str = "data",
) -> DataFrame:
    """Any NumPy function over sliding windows, as a flat array column ``y``.

    ``f`` gets all windows of a slice of rows, ``(rows, channel, i, j, ky, kx)`` with zero
    borders, and returns ``(rows, ...)``; ``windows.max(axis=(4, 5))`` is max-pooling.
    """
    source = df.select(*dict.fromkeys([*keep, data]))
    schema = StructType([*[source.schema[k] for k in keep], StructField("y", ArrayType(DoubleType()))])
    row_bytes = 8 * image[0] * image[1] * image[2] * kernel * kernel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = as_matrix(batch.column(data)).reshape(-1, *image)
            parts = [f(windows(x[s], kernel, stride, padding)) for s in slices(len(x), row_bytes)]
            y = np.concatenate([p.reshape(len(p), -1) for p in parts]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], as_lists(y)], names=[*keep, "y"])

    return source.mapInArrow(run, schema)


def network_target(df: DataFrame, inputs: Sequence[str], structure: Sequence[int], activations: Sequence[str], cost: str = "SQR") -> DataFrame:
    """Synthetic ``ann`` target: outputs ``y0..`` of a net with position-numbered weights."""
    layers = [{"type": a, "num_channels": n} for a, n in zip(activations, structure[1:])]
    config = NetConfig.from_dict({"obj_name": "ann", "network": layers, "input_num_channels": structure[0], "cost": cost})
    net = Network.closed_form(config, ann_weights, ann_bias)
    carried = df.withColumn("_x", F.array(*[F.col(c).cast("double") for c in inputs]))
    scored = score(carried, net, *df.columns, data="_x")
    return scored.select(*df.columns, *arrays.spread(F.col("y"), "y", structure[-1]))


def weight_rows(net: Network, layer: int, spark) -> tuple[DataFrame, DataFrame]:
    """Weights and bias of one layer as long tables."""
    w, b = net.weights[layer], net.biases[layer]
    index = np.indices(w.shape).reshape(w.ndim, -1)
    axes = ("k", "j") if w.ndim == 2 else ("c", "e", "ky", "kx")
    columns = {a: pa.array(i.astype(np.int32)) for a, i in zip(axes, index)}
    weights = spark.createDataFrame(pa.table({**columns, "w": pa.array(w.reshape(-1))}))
    return weights, spark.createDataFrame(pa.table({axes[1]: pa.array(np.arange(len(b), dtype=np.int32)), "b": pa.array(b)}))
