"""Model configuration and model state."""

from __future__ import annotations

import math
import sys
import types
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession

from runloom.functions.normal import normals
from runloom.operators.sliding import output_size
from runloom.plans.kernels import ACTIVATIONS, COSTS, IMAGE_LAYERS

# Networks are updated on the driver and broadcast whole, all of a sweep at once; beyond this size
# in all they are refused there, and the tiled form (tiles.score_tiles) scores a model piece by piece.
MODEL_BYTES_LIMIT = 2 << 30


@dataclass(frozen=True)
class Layer:
    type: str
    num_channels: int
    name: str = ""
    kernel_size: int = 0
    stride: int = 1
    padding: int = 0
    init_wt: float = 0.0


@dataclass(frozen=True)
class NetConfig:
    """The keys of a model file; ``network`` lists the layers without the input."""

    obj_name: str
    network: tuple[Layer, ...]
    input_num_channels: int
    input_image_size_y: int = 1
    input_image_size_x: int = 1
    epoch: int = 10
    batch: int = 100
    momentum: float = 0.9
    alpha: float = 0.02
    cost: str = "CE"
    shuffle: bool = True
    data_format: str = "parquet"
    data_dir: str = ""
    checkpoint: str = ""

    def __post_init__(self):
        unknown = [l.type for l in self.network if l.type not in ACTIVATIONS]
        if unknown or self.cost not in COSTS:
            raise ValueError(f"unknown layer type(s) {unknown} or cost {self.cost!r}")
        if self.cost == "CE" and self.network[-1].type != "FC_SOFTMAX":
            raise ValueError("CE needs FC_SOFTMAX as the last layer")
        self.weight_shapes()

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> NetConfig:
        """From a parsed model file; keys that are not configuration are ignored."""
        known = {f.name for f in fields(Layer)}
        layers = tuple(Layer(**{k: v for k, v in l.items() if k in known}) for l in raw["network"])
        own = {f.name for f in fields(cls)}
        return cls(**{**{k: v for k, v in raw.items() if k in own}, "network": layers})

    def to_dict(self) -> dict[str, Any]:
        return {**asdict(self), "network": [asdict(l) for l in self.network]}

    def structure(self) -> str:
        return "-".join([f"{self.input_num_channels}FC_LIN", *[f"{l.num_channels}{l.type}" for l in self.network]])

    def image(self) -> tuple[int, int, int] | None:
        """(channels, height, width) when the first layer works on images."""
        if self.network[0].type not in IMAGE_LAYERS:
            return None
        return self.input_num_channels, self.input_image_size_y, self.input_image_size_x

    def walk(self) -> list[tuple[Layer, tuple[int, ...], tuple[int, int] | None]]:
        """Each layer with its weight shape and output image size (None when dense)."""
        out, channels, size = [], self.input_num_channels, None
        if self.image() is not None:
            size = (self.input_image_size_y, self.input_image_size_x)
        for l in self.network:
            if l.type in IMAGE_LAYERS:
                if size is None:
                    raise ValueError(f"{l.type} cannot follow a dense layer")
                shape = (channels, l.num_channels, l.kernel_size, l.kernel_size)
                size = tuple(output_size(s, l.kernel_size, l.stride, l.padding) for s in size)
            else:
                shape = (channels * size[0] * size[1] if size else channels, l.num_channels)
                size = None
            out.append((l, shape, size))
            channels = l.num_channels
        return out

    def weight_shapes(self) -> list[tuple[int, ...]]:
        return [shape for _, shape, _ in self.walk()]

    def row_bytes(self) -> int:
        """Largest intermediate of one row, for sizing the slices a task works on."""
        sizes = [1]
        for _, shape, size in self.walk():
            area = size[0] * size[1] if size else 1
            sizes += [shape[0] * area * (shape[2] * shape[3] if len(shape) == 4 else 1), shape[1] * area]
        return 8 * max(sizes)


@dataclass
class Network:
    """Weights of a configuration with the layer arithmetic they need.

    The layer objects travel with the weights, so types added on the driver work in tasks.
    """

    config: NetConfig
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    epoch: int = 0
    batch: int = 0
    layers: list[Any] = field(default_factory=list)

    def __post_init__(self):
        self.layers = [ACTIVATIONS[l.type] for l in self.config.network]
        self.row_cost = COSTS[self.config.cost]

    @classmethod
    def initial(cls, config: NetConfig, seed: int = 0) -> Network:
        """Normal weights times each layer's ``init_wt``, zero biases; a weight depends on seed, layer and place only."""
        pairs = list(zip(config.network, config.weight_shapes()))
        weights = [l.init_wt * normals(math.prod(s), seed, n).reshape(s) for n, (l, s) in enumerate(pairs)]
        return cls(config, weights, [np.zeros(l.num_channels) for l, _ in pairs])

    @classmethod
    def closed_form(cls, config: NetConfig, weight: Callable, bias: Callable) -> Network:
        """Weights stated by formulas ``weight(layer, *index grids)`` and ``bias(layer, j)``."""
        shapes = config.weight_shapes()
        ws = [np.asarray(weight(n, *np.indices(s)), dtype=float) for n, s in enumerate(shapes)]
        bs = [np.asarray(bias(n, np.arange(s[1])), dtype=float) for n, s in enumerate(shapes)]
        return cls(config, ws, bs)

    def copy(self, **changes) -> Network:
        return replace(self, **{"weights": list(self.weights), "biases": list(self.biases), **changes})

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes for w in self.weights) + sum(b.nbytes for b in self.biases)

    @staticmethod
    def check_broadcast(nets: dict[int, Network]) -> None:
        size = sum(net.nbytes for net in nets.values())
        if size > MODEL_BYTES_LIMIT:
            raise ValueError(f"{len(nets)} networks of {size} bytes are above the broadcast limit; use fewer at once, or score_tiles")

    @staticmethod
    def ship(spark: SparkSession, nets: dict[int, Network]) -> Shipped:
        """Broadcast networks after a check of their size in all.

        cloudpickle carries layer objects defined in a notebook or script as well.
        """
        Network.check_broadcast(nets)
        return Shipped(spark.sparkContext.broadcast(cloudpickle.dumps(nets)))

    def shape_input(self, rows: np.ndarray) -> np.ndarray:
        image = self.config.image()
        return rows if image is None else rows.reshape(len(rows), *image)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Outputs of every layer, the shaped input first."""
        ys = [self.shape_input(x)]
        for layer, conf, w, b in zip(self.layers, self.config.network, self.weights, self.biases):
            ys.append(layer.forward(ys[-1], w, b, conf))
        return ys

    def gradients(self, ys: list[np.ndarray], target: np.ndarray, batch_rows: int):
        """(dW, db) sums per layer; the derivative is divided by the rows of the whole batch."""
        slope = (ys[-1] - target) / batch_rows
        out: list[tuple[np.ndarray | None, np.ndarray | None]] = [(None, None)] * len(self.layers)
        for n in range(len(self.layers) - 1, -1, -1):
            dw, db, slope = self.layers[n].backward(
                slope, ys[n + 1], ys[n], self.weights[n], self.config.network[n], need_input=n > 0
            )
            out[n] = (dw, db)
        return out


@dataclass(frozen=True)
class Shipped:
    """Broadcast networks: ``load`` on a worker, ``destroy`` when no job needs them again."""

    shared: Broadcast
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def load(self) -> dict[int, Network]:
        """Unpickled once per Python worker, not once per task, until other networks are shipped."""
        held = sys.modules.setdefault("_runloom_networks", types.ModuleType("_runloom_networks")).__dict__
        if held.get("token") != self.token:
            held.update(token=self.token, networks=cloudpickle.loads(self.shared.value))
        return held["networks"]

    def destroy(self) -> None:
        self.shared.destroy()


def ann_weights(layer, k, j):
    """Position-numbered weights of the synthetic target net."""
    return (k * (j.max() + 1) + j + layer) / 100.0


def ann_bias(layer, j):
    return (j - layer) / 100.0
