"""Saved models: one Parquet row per layer, a folder per run."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

from runloom.plans.network import NetConfig, Network

MODEL_COLUMNS = ("run_id", "epoch", "batch", "layer", "type", "w_shape", "w", "b", "config")


def save_model(spark: SparkSession, net: Network, path: str, run_id: str) -> None:
    """Write weights, configuration and counters; an earlier save of the run is replaced."""
    n = len(net.weights)
    table = pa.table(
        {
            "run_id": [run_id] * n,
            "epoch": pa.array([net.epoch] * n, pa.int64()),
            "batch": pa.array([net.batch] * n, pa.int64()),
            "layer": pa.array(range(n), pa.int32()),
            "type": [l.type for l in net.config.network],
            "w_shape": pa.array([list(w.shape) for w in net.weights], pa.list_(pa.int32())),
            "w": pa.array([w.reshape(-1) for w in net.weights], pa.list_(pa.float64())),
            "b": pa.array(net.biases, pa.list_(pa.float64())),
            "config": [json.dumps(net.config.to_dict())] * n,
        }
    )
    writer = spark.createDataFrame(table).coalesce(1).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def load_model(spark: SparkSession, path: str, run_id: str, expected: NetConfig | None = None) -> Network:
    """Rebuild a network; weight and bias shapes must fit the (stored or expected) configuration.

    Momentum is not stored, a resumed run starts it at zero.
    """
    saved = spark.read.parquet(path).where(F.col("run_id") == run_id).orderBy("layer")
    rows = saved.drop("run_id").toArrow().to_pylist()
    if not rows:
        raise ValueError(f"no saved model of run {run_id!r} in {path}")
    config = expected or NetConfig.from_dict(json.loads(rows[0]["config"]))
    shapes = config.weight_shapes()
    if [tuple(r["w_shape"]) for r in rows] != shapes or [len(r["b"]) for r in rows] != [s[1] for s in shapes]:
        raise ValueError("saved weights do not fit the configuration")
    weights = [np.array(r["w"], dtype=float).reshape(s) for r, s in zip(rows, shapes)]
    biases = [np.array(r["b"], dtype=float) for r in rows]
    return Network(config, weights, biases, epoch=rows[0]["epoch"], batch=rows[0]["batch"])
