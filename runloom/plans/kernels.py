"""Per-batch layer arithmetic, run inside Arrow tasks.

Images are ``(rows, channel, y, x)``, dense inputs ``(rows, k)``; dense weights
``(k, j)``, kernels ``(c_in, c_out, ky, kx)`` in cross-correlation order. A layer maps
its input to its output and, given the cost derivative by its output, returns the sums of
its weight and bias gradients and the derivative by its input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np

from runloom.functions.neural import EXP_CLAMP, LOG_OFFSET


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.maximum(z, -EXP_CLAMP)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(np.minimum(z, EXP_CLAMP))
    with np.errstate(invalid="ignore"):
        return e / e.sum(axis=1, keepdims=True)


def windows(x: np.ndarray, kernel: int, stride: int, padding: int) -> np.ndarray:
    """View of all windows, ``(rows, channel, i, j, ky, kx)``, over zero borders."""
    if padding:
        x = np.pad(x, ((0, 0), (0, 0), (padding, padding), (padding, padding)))
    view = np.lib.stride_tricks.sliding_window_view(x, (kernel, kernel), axis=(2, 3))
    return view[:, :, ::stride, ::stride]


def _add_windows(parts: Callable[[int, int], np.ndarray], shape, out_hw, kernel: int, stride: int, padding: int):
    """Sum window contributions, given per kernel cell, back onto the input cells."""
    n, c, h, w = shape
    grid = np.zeros((n, c, h + 2 * padding, w + 2 * padding))
    for ky in range(kernel):
        for kx in range(kernel):
            rows = slice(ky, ky + stride * (out_hw[0] - 1) + 1, stride)
            cols = slice(kx, kx + stride * (out_hw[1] - 1) + 1, stride)
            grid[:, :, rows, cols] += parts(ky, kx)
    return grid[:, :, padding : padding + h, padding : padding + w]


@dataclass(frozen=True)
class Dense:
    activate: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray], Any]

    def forward(self, x, w, b, layer):
        return self.activate(x.reshape(len(x), -1) @ w + b)

    def backward(self, dy, y, x, w, layer, need_input):
        delta = dy.reshape(y.shape) * self.slope(y)
        flat = x.reshape(len(x), -1)
        back = (delta @ w.T).reshape(x.shape) if need_input else None
        return flat.T @ delta, delta.sum(axis=0), back


@dataclass(frozen=True)
class Convolution:
    def forward(self, x, w, b, layer):
        seen = windows(x, layer.kernel_size, layer.stride, layer.padding)
        z = np.tensordot(seen, w, axes=((1, 4, 5), (0, 2, 3))) + b
        return np.maximum(np.moveaxis(z, -1, 1), 0.0)

    def backward(self, dy, y, x, w, layer, need_input):
        delta = dy.reshape(y.shape) * (y > 0)
        seen = windows(x, layer.kernel_size, layer.stride, layer.padding)
        dw = np.tensordot(seen, delta, axes=((0, 2, 3), (0, 2, 3))).transpose(0, 3, 1, 2)
        back = None
        if need_input:
            part = lambda ky, kx: np.einsum("neij,ce->ncij", delta, w[:, :, ky, kx])
            back = _add_windows(part, x.shape, y.shape[2:], layer.kernel_size, layer.stride, layer.padding)
        return dw, delta.sum(axis=(0, 2, 3)), back


@dataclass(frozen=True)
class MaxPool:
    def forward(self, x, w, b, layer):
        return windows(x, layer.kernel_size, layer.stride, layer.padding).max(axis=(4, 5))

    def backward(self, dy, y, x, w, layer, need_input):
        if not need_input:
            return None, None, None
        delta = dy.reshape(y.shape)
        seen = windows(x, layer.kernel_size, layer.stride, layer.padding)
        part = lambda ky, kx: (seen[..., ky, kx] == y) * delta
        return None, None, _add_windows(part, x.shape, y.shape[2:], layer.kernel_size, layer.stride, layer.padding)


def _one(y):
    return 1.0


# Layer types by name; more can be added with the same two methods.
ACTIVATIONS: dict[str, Any] = {
    "FC_SIG": Dense(sigmoid, lambda y: y * (1.0 - y)),
    "FC_LIN": Dense(lambda z: z, _one),
    "FC_SOFTMAX": Dense(softmax, _one),  # its slope is part of the cross-entropy derivative
    "CONVOLUTION": Convolution(),
    "MAXPOOL": MaxPool(),
}

IMAGE_LAYERS = ("CONVOLUTION", "MAXPOOL")


def squared(y, t):
    return 0.5 * np.sum((y - t) ** 2, axis=-1)


def cross_entropy(y, t):
    return -np.sum(t * np.log(y + LOG_OFFSET), axis=-1)


# Row costs by name; the derivative of both is (y - t) / rows of the batch.
COSTS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"SQR": squared, "CE": cross_entropy}
