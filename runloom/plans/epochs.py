"""An epoch as one job: barrier tasks step together and exchange gradients among themselves."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.functions.permutation import permuted, round_keys
from runloom.operators.scans import row_index
from runloom.plans.gradients import batch_vectors, unflatten
from runloom.plans.network import Network
from runloom.session import cut_lineage

# Rows of a batch that a task takes at least.
ROWS_PER_TASK = 32
# What all tasks together hand to each of them at a step at most.
GATHER_BYTES = 16 << 20


def step_tasks(spark: SparkSession, nets: dict[int, Network], batch_rows: int) -> int:
    """Tasks that can step together, 0 if steps are better made as jobs of their own.

    A barrier stage needs all its tasks at once and a fixed set of executors; every task receives
    the gradients of all, so a large model leaves room for few.
    """
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    wanted = max(1, min(spark.sparkContext.defaultParallelism, -(-batch_rows // ROWS_PER_TASK)))
    message = sum(net.nbytes + 24 for net in nets.values()) * 4 // 3
    possible = GATHER_BYTES // max(message, 1)
    return min(wanted, possible) if 4 * possible >= wanted else 0


class NumberedRows:
    """Training rows with their number in stored order; every epoch gives them places anew, without a sort."""

    def __init__(self, train: DataFrame, size: int, id_col: str, seed: int):
        self.frame = cut_lineage(row_index(train, [id_col], "_at").drop(id_col))
        self.size, self.seed = size, seed
        self.rows = self.frame.count()
        self.batches = -(-self.rows // size)

    def placed(self, epoch: int | None) -> DataFrame:
        """The rows with their place ``_place`` in the epoch; None keeps the stored order."""
        at = F.col("_at").cast("long")
        place = at if epoch is None else permuted(at, self.rows, round_keys(self.seed, epoch))
        return self.frame.withColumn("_place", place).drop("_at")


def _shares(batches: Iterator[pa.RecordBatch], size: int, count: int) -> Iterator[pa.Table | None]:
    """The task's rows of batch 0, 1, ..., from rows sorted by place; None where it has none."""
    held: list[pa.RecordBatch] = []
    source = iter(batches)
    rest: pa.RecordBatch | None = None
    for number in range(count):
        end = (number + 1) * size
        while True:
            if rest is None or rest.num_rows == 0:
                rest = next(source, None)
                if rest is None:
                    break
            n = int(np.searchsorted(rest.column("_place").to_numpy(), end))
            if n:
                held.append(rest.slice(0, n))
            rest = rest.slice(n)
            if rest.num_rows:
                break
        yield pa.Table.from_batches(held) if held else None
        held = []
    while next(source, None) is not None:  # nothing should be left, but the stream must be read to its end
        pass


def run_epoch(
    table: NumberedRows, epoch: int | None, nets: dict[int, Network], velocity: dict[int, list], tasks: int, data: str, target: str, step
) -> dict[int, tuple[Network, list, np.ndarray]]:
    """One pass over the rows in batches: (network, velocity, [cost, correct] summed over batch means) of each.

    Every task holds its share of each batch by place modulo ``tasks``, steps in the rhythm of the
    others and adds all tasks' vectors in task order, so all networks stay equal bit by bit and
    a repeated stage gives them again. The driver sees the networks after the last step only, from one task.
    """
    spark = table.frame.sparkSession
    Network.check_broadcast(nets)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps((nets, velocity)))
    size, rows, count = table.size, table.rows, table.batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        own, speed = cloudpickle.loads(shared.value)
        means = {key: np.zeros(2) for key in own}
        for number, share in enumerate(_shares(batches, size, count)):
            batch_rows = min(size, rows - number * size)
            vectors = [np.zeros(3 + sum(w.size + b.size for w, b in _learning(net))) for net in own.values()]
            if share is not None:
                merged = share.combine_chunks()
                for part in merged.to_batches():
                    for vector, found in zip(vectors, batch_vectors(own, part, batch_rows, data, target), strict=True):
                        vector += found
            message = base64.b64encode(np.concatenate(vectors).tobytes()).decode()
            summed = sum(np.frombuffer(base64.b64decode(m)) for m in context.allGather(message))
            at = 0
            for (key, net), vector in zip(own.items(), vectors, strict=True):
                total = summed[at : at + len(vector)]
                at += len(vector)
                means[key] += total[1:3] / total[0]
                step(net, speed[key], unflatten(net, total[3:]))
                net.batch += 1
        if context.partitionId() == 0:
            result = [cloudpickle.dumps((own[key], speed[key], means[key])) for key in own]
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array(result, pa.binary())], names=["config_id", "state"])

    shared_rows = table.placed(epoch).repartitionById(tasks, F.pmod(F.col("_place"), F.lit(tasks)).cast("int"))
    stepped = shared_rows.sortWithinPartitions("_place").mapInArrow(run, "config_id int, state binary", barrier=True)
    out = {r["config_id"]: cloudpickle.loads(r["state"]) for r in stepped.collect()}
    shared.destroy()
    return out


def _learning(net: Network) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases of the layers that learn."""
    return [(w, b) for w, b, conf in zip(net.weights, net.biases, net.config.network, strict=True) if conf.type != "MAXPOOL"]
