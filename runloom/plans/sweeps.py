"""Sweep tables: from lists of values to network configurations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from runloom.functions.text import parse_structure
from runloom.operators.control import config_grid
from runloom.plans.network import Layer, NetConfig

# Layer types by their short names in structure strings.
SHORT_TYPES = {"sig": "FC_SIG", "lin": "FC_LIN", "softmax": "FC_SOFTMAX"}


def sweep_table(
    datasets: DataFrame, rates: Sequence[float], momenta: Sequence[float], batches: Sequence[int], structures: Sequence[str]
) -> DataFrame:
    """Every combination for every data set, with the layers of each structure string parsed."""
    values = {"learn_rate": rates, "momentum": momenta, "batch_size": batches, "struct": structures}
    return config_grid(datasets, values).withColumn("network", parse_structure(F.col("struct")))


def configurations(table: DataFrame, base: NetConfig) -> list[tuple[dict, NetConfig]]:
    """The rows of a sweep table as configurations; they are few, and training holds them anyway.

    A layer starts with the ``init_wt`` of the base's layer at its place, or of the base's last one.
    """
    out = []
    for row in table.orderBy("learn_rate", "momentum", "batch_size", "struct").collect():
        inits = [l.init_wt for l in base.network]
        inits += inits[-1:] * (len(row["network"]) - len(inits))
        layers = tuple(Layer(SHORT_TYPES.get(l["type"], l["type"]), l["num_channels"], init_wt=i) for l, i in zip(row["network"], inits))
        conf = replace(base, network=layers, alpha=row["learn_rate"], momentum=row["momentum"], batch=row["batch_size"])
        out.append((row.asDict(), conf))
    return out
