"""Data-parallel momentum SGD: an epoch is one barrier job, and a whole sweep shares its scans.

Where the model is too large to be exchanged among the tasks, a step is a job of its own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from runloom.operators import dataset
from runloom.operators.records import new_stamp
from runloom.plans.checkpoints import save_model
from runloom.plans.epochs import NumberedRows, run_epoch, step_tasks
from runloom.plans.gradients import batch_sums, cost_sums, unflatten
from runloom.plans.network import NetConfig, Network
from runloom.plans.score import evaluate_details
from runloom.session import shared_path

# Batches are stored under at most this many folders, sorted inside each.
BATCH_FOLDERS = 1024


@dataclass
class Trained:
    """A finished run: last weights, best weights, and the per-epoch cost rows."""

    run_id: str
    network: Network
    best: Network | None = None
    cost_rows: list[dict] = field(default_factory=list)
    test: tuple[float, float] | None = None


def sgd_step(net: Network, velocity: list, grads: Iterable) -> None:
    """v = momentum * v + gradient; weights -= alpha * v. Layers without gradients are skipped."""
    m, alpha = net.config.momentum, net.config.alpha
    for n, pair in enumerate(grads):
        if pair[0] is None:
            continue
        velocity[n] = tuple(m * v + g for v, g in zip(velocity[n], pair))
        net.weights[n] = net.weights[n] - alpha * velocity[n][0]
        net.biases[n] = net.biases[n] - alpha * velocity[n][1]


def zero_velocity(net: Network) -> list:
    return [(np.zeros_like(w), np.zeros_like(b)) for w, b in zip(net.weights, net.biases)]


class EpochTable(NumberedRows):
    """The rows of one epoch, written so that a step that is a job of its own reads its own batch only.

    The folder prunes partitions, the order inside it lets row groups be skipped. The table
    lies in the shared folder and each epoch overwrites the one before.
    """

    def __init__(self, train: DataFrame, size: int, id_col: str, seed: int):
        super().__init__(train, size, id_col, seed)
        self.path = shared_path(train.sparkSession, "epoch")
        self.written: DataFrame | None = None

    @property
    def per_folder(self) -> int:
        return -(-self.batches // BATCH_FOLDERS)

    def fill(self, epoch: int | None) -> None:
        number = dataset.batch_number(F.col("_place"), self.size)
        folder = F.floor(number / self.per_folder).cast("int")
        numbered = self.placed(epoch).select("*", number.alias("batch_no"), folder.alias("batch_folder"))
        by_batch = numbered.repartition("batch_folder").sortWithinPartitions("batch_folder", "batch_no", "_place")
        by_batch.write.mode("overwrite").partitionBy("batch_folder").parquet(self.path)
        self.written = self.frame.sparkSession.read.parquet(self.path)

    def batch(self, number: int) -> tuple[DataFrame, int]:
        """The rows of one batch, and how many they are."""
        rows = min(self.size, self.rows - number * self.size)
        wanted = (F.col("batch_folder") == number // self.per_folder) & (F.col("batch_no") == number)
        return self.written.where(wanted), rows

    def steps(self, epoch: int | None, nets: dict[int, Network], velocity: dict[int, list], data: str, target: str) -> dict[int, np.ndarray]:
        """One pass over the batches, which moves the networks: the sum of each one's batch means of (cost, correct)."""
        tasks = step_tasks(self.frame.sparkSession, nets, self.size)
        if tasks:
            own = {k: velocity[k] for k in nets}
            found = run_epoch(self, epoch, nets, own, tasks, data, target, sgd_step)
            for key, (net, speed, _) in found.items():
                nets[key].weights, nets[key].biases, nets[key].batch = net.weights, net.biases, net.batch
                velocity[key] = speed
            return {key: means for key, (_, _, means) in found.items()}
        means = {k: np.zeros(2) for k in nets}
        if epoch is not None or self.written is None:
            self.fill(epoch)
        for number in range(self.batches):
            rows_of_batch, count = self.batch(number)
            for key, (head, flat) in batch_sums(rows_of_batch, nets, count, data, target).items():
                means[key] += head[1:] / head[0]  # measured before the update
                sgd_step(nets[key], velocity[key], unflatten(nets[key], flat))
                nets[key].batch += 1
        return means


def evaluate_many(df: DataFrame | None, nets: dict[int, Network], data: str, target: str) -> dict[int, tuple[float, float]]:
    """(cost, accuracy) of each network in one scan; zeros without data."""
    sums = cost_sums(df, nets, data, target) if df is not None else {}
    out = dict.fromkeys(nets, (0.0, 0.0))
    out.update({k: (cost / rows, correct / rows) for k, (rows, cost, correct) in sums.items()})
    return out


def fit_many(
    train: DataFrame,
    valid: DataFrame | None,
    test: DataFrame | None,
    configs: dict[int, NetConfig],
    *,
    start: dict[int, Network] | None = None,
    run_ids: dict[int, str] | None = None,
    model_path: str | None = None,
    store=None,
    data: str = "data",
    target: str = "label",
    id_col: str = "id",
    seed: int = 0,
) -> dict[int, Trained]:
    """Train every configuration on the same data.

    Configurations with the same batch size and shuffling step together: each step reads its
    batch once for all of them. Shuffled, an epoch takes the rows in the order of a keyed
    permutation of their numbers. ``start`` resumes from loaded
    networks. ``store`` (a profile store) gets a row per run and per epoch and the details of
    the final test, ``model_path`` a checkpoint whenever validation accuracy beats every
    earlier epoch.
    """
    spark = train.sparkSession
    stamp = new_stamp()
    out: dict[int, Trained] = {}
    groups: dict[tuple, list[int]] = {}
    for key, conf in configs.items():
        groups.setdefault((conf.batch, conf.shuffle), []).append(key)
        net = (start or {}).get(key)
        net = net.copy(config=conf) if net is not None else Network.initial(conf, seed)
        run_id = (run_ids or {}).get(key) or (stamp if len(configs) == 1 else f"{stamp}-{key}")
        out[key] = Trained(run_id, net)

    slim = train.select(id_col, data, target)
    for (size, shuffled), keys in groups.items():
        table = EpochTable(slim, size, id_col, seed)
        if store is not None:
            for key in keys:
                store.add_run(configs[key], out[key].run_id, table.rows, test.count() if test is not None else 0)
        velocity = {k: zero_velocity(out[k].network) for k in keys}
        best = dict.fromkeys(keys, 0.0)
        for epoch in range(max(configs[k].epoch for k in keys)):
            live = [k for k in keys if epoch < configs[k].epoch]
            nets = {k: out[k].network for k in live}
            for net in nets.values():
                net.epoch += 1
            means = table.steps(epoch if shuffled else None, nets, velocity, data, target)
            checked = evaluate_many(valid, nets, data, target)
            epoch_rows: dict[str, list[dict]] = {}
            for key in live:
                cost, correct = checked[key]
                cost_batch, correct_batch = means[key] / table.batches
                row = {
                    "epoch_num": nets[key].epoch,
                    "batch_num": nets[key].batch,
                    "cost_batch": float(cost_batch),
                    "correct_batch": float(correct_batch),
                    "cost_val": float(cost),
                    "correct_val": float(correct),
                }
                out[key].cost_rows.append(row)
                epoch_rows[out[key].run_id] = [row]
                if correct > best[key]:
                    best[key] = correct
                    out[key].best = nets[key].copy()
                    if model_path is not None:
                        save_model(spark, nets[key], model_path, out[key].run_id)
            if store is not None:
                store.add_costs_of(epoch_rows)
        if test is not None:
            for key, result in evaluate_many(test, {k: out[k].network for k in keys}, data, target).items():
                out[key].test = result
                if store is not None and configs[key].cost == "CE":
                    details = evaluate_details(test, out[key].network, "null", id_col, data, target)
                    store.add_details(*details, out[key].run_id)
    return out


def fit(train: DataFrame, valid: DataFrame | None, test: DataFrame | None, config: NetConfig, **options) -> Trained:
    """Train one configuration; see ``fit_many``. ``start`` and ``run_id`` are single values."""
    single = {"start": options.pop("start", None), "run_ids": options.pop("run_id", None)}
    wrapped = {k: {0: v} for k, v in single.items() if v is not None}
    return fit_many(train, valid, test, {0: config}, **wrapped, **options)[0]
