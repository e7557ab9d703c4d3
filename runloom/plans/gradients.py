"""Gradient sums over a distributed batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from runloom.plans.network import Network, Shipped
from runloom.plans.score import as_lists, as_matrix, as_targets, slices

# Flat vectors travel in blocks, so that a large model spreads over many reducers.
BLOCK = 4096
# Vectors of a network's block that one reducer adds at most on the first level.
FAN_IN = 256
_SCHEMA = "config_id int, block int, source int, part array<double>"


def flatten(grads) -> np.ndarray:
    return np.concatenate([np.ravel(g) for pair in grads for g in pair if g is not None] or [np.zeros(0)])


def unflatten(net: Network, flat: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray | None]]:
    """Back to (dW, db) per layer; layers that learn nothing stay (None, None)."""
    out, at = [], 0
    for w, b, conf in zip(net.weights, net.biases, net.config.network):
        if conf.type == "MAXPOOL":
            out.append((None, None))
            continue
        dw = flat[at : at + w.size].reshape(w.shape)
        db = flat[at + w.size : at + w.size + b.size]
        at += w.size + b.size
        out.append((dw, db))
    return out


def batch_vectors(
    models: dict[int, Network], batch: pa.RecordBatch, batch_rows: int, data: str, target: str, learn: bool = True
) -> Iterator[np.ndarray]:
    """Per network, over the rows of an Arrow batch: rows, cost, correct, then all gradients."""
    x, labels = as_matrix(batch.column(data)), batch.column(target)
    for net in models.values():
        t = as_targets(labels, net.config.network[-1].num_channels)
        vector = None
        for s in slices(len(x), net.config.row_bytes()):
            ys = net.forward(x[s])
            y = ys[-1].reshape(len(t[s]), -1)
            hits = (t[s].argmax(axis=1) == y.argmax(axis=1)).sum() if net.config.cost == "CE" else 0.0
            head = np.array([len(y), net.row_cost(y, t[s]).sum(), hits], dtype=float)
            grads = flatten(net.gradients(ys, t[s], batch_rows)) if learn else np.zeros(0)
            part = np.concatenate([head, grads])
            vector = part if vector is None else vector + part
        yield vector


def partial_sums(
    df: DataFrame, shipped: Shipped, batch_rows: int, data: str = "data", target: str = "label", learn: bool = True
) -> DataFrame:
    """One flat vector per partition and network: rows, cost, correct, then all gradients.

    Every network runs over the same Arrow batches, so a whole sweep costs one scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shipped.load()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for key, vector in zip(models, batch_vectors(models, batch, batch_rows, data, target, learn), strict=True):
                sums[key] = sums[key] + vector if key in sums else vector
        source = TaskContext.get().partitionId()
        for key, vector in sums.items():
            starts = range(0, len(vector), BLOCK)
            parts = [vector[i : i + BLOCK] for i in starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * len(parts), pa.int32()),
                    pa.array(range(len(parts)), pa.int32()),
                    pa.array([source] * len(parts), pa.int32()),
                    pa.array(parts, pa.list_(pa.float64())),
                ],
                names=["config_id", "block", "source", "part"],
            )

    return df.select(data, target).mapInArrow(run, _SCHEMA)


def _add_up(table: pa.Table) -> pa.Table:
    """Sum a group's vectors in source order, so that a retry adds in the same order; named by the group's number."""
    ordered = table.sort_by("source").combine_chunks()
    column = ordered.column("part").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    first = ordered.slice(0, 1).set_column(2, "source", pa.array([ordered.column("source")[0].as_py() // FAN_IN], pa.int32()))
    return first.set_column(3, "part", as_lists(as_matrix(column).sum(axis=0, keepdims=True)))


def sum_partials(partials: DataFrame) -> DataFrame:
    """Add the partition vectors block by block, ``FAN_IN`` sources to a reducer and then the rest.

    A group holds one block per source task, never data rows; a network's block ends as one
    vector, however many tasks there were: the same path at every size.
    """
    part = F.floor(F.col("source") / FAN_IN).cast("int")
    first = partials.groupBy("config_id", "block", part.alias("part_no")).applyInArrow(_add_up, _SCHEMA)
    return first.groupBy("config_id", "block").applyInArrow(_add_up, _SCHEMA)


def batch_sums(
    df: DataFrame,
    nets: dict[int, Network],
    batch_rows: int,
    data: str = "data",
    target: str = "label",
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per network: [rows, cost, correct] and the flat gradient. Only model-sized arrays arrive here."""
    shipped = Network.ship(df.sparkSession, nets)
    partials = sum_partials(partial_sums(df, shipped, batch_rows, data, target))
    got = partials.toArrow().sort_by([("config_id", "ascending"), ("block", "ascending")])
    shipped.destroy()
    parts: dict[int, list[np.ndarray]] = {}
    for key, part in zip(got.column("config_id").to_pylist(), got.column("part")):
        parts.setdefault(key, []).append(part.values.to_numpy(zero_copy_only=False))
    whole = {k: np.concatenate(v) for k, v in parts.items()}
    return {k: (v[:3], v[3:]) for k, v in whole.items()}


def cost_sums(
    df: DataFrame, nets: dict[int, Network], data: str = "data", target: str = "label"
) -> dict[int, tuple[float, float, float]]:
    """(rows, cost, correct) of each network in one scan."""
    shipped = Network.ship(df.sparkSession, nets)
    partials = partial_sums(df, shipped, 1, data, target, learn=False)
    sums = partials.groupBy("config_id").agg(*[F.sum(F.get("part", F.lit(i))).alias(n) for i, n in enumerate("nch")])
    rows = sums.collect()
    shipped.destroy()
    return {r["config_id"]: (r["n"], r["c"], r["h"]) for r in rows}


def gradient_rows(df: DataFrame, net: Network, batch_rows: int, data: str = "data", target: str = "label") -> DataFrame:
    """The summed gradient as rows ``(layer, part, pos, g)``, without a driver step."""
    summed = sum_partials(partial_sums(df, Network.ship(df.sparkSession, {0: net}), batch_rows, data, target))
    flat = summed.select("block", F.posexplode("part").alias("at", "g")).select(
        (F.col("block") * BLOCK + F.col("at") - 3).alias("at"), "g"
    )
    layer, part, start, at = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(0), 0
    for n, (w, b, conf) in enumerate(zip(net.weights, net.biases, net.config.network)):
        if conf.type == "MAXPOOL":
            continue
        for kind, size in (("w", w.size), ("b", b.size)):
            here = F.col("at") >= at
            layer = F.when(here, n).otherwise(layer)
            part = F.when(here, F.lit(kind)).otherwise(part)
            start = F.when(here, at).otherwise(start)
            at += size
    return flat.where("at >= 0").select(
        layer.alias("layer"), part.alias("part"), (F.col("at") - start).cast("int").alias("pos"), "g"
    )
