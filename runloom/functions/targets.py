"""Synthetic regression targets over input columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SINGLE_OUTPUT = ("sigmoid", "lin", "sin")


def _mean(xs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs) / float(len(xs))


def sigmoid_target(xs: Sequence[Column], low: float, high: float) -> list[Column]:
    """The 0.5 is subtracted inside the denominator, as the data sets were made."""
    avg = _mean(xs)
    y = F.lit(high - low) * (F.lit(1.0) / (F.lit(1.0) + F.exp(-avg) - 0.5)) + (low + high) / 2
    return [y.alias("y0"), avg.alias("xAvg")]


def linear_target(xs: Sequence[Column]) -> list[Column]:
    """Position-weighted sum; a single input is passed through."""
    lin = xs[0] if len(xs) == 1 else reduce(lambda a, b: a + b, [x * float(i) for i, x in enumerate(xs) if i])
    return [(lin * 4.0).alias("y0"), lin.alias("xLin")]


def sine_target(xs: Sequence[Column], low: float, high: float) -> list[Column]:
    avg = _mean(xs)
    return [(F.lit(high - low) * F.sin(avg) + (low + high) / 2).alias("y0"), avg.alias("xAvg")]


def random_target(low: float, high: float, seed: int) -> list[Column]:
    return [(F.rand(seed) * (high - low) + low).alias("y0")]


def with_target(
    df: DataFrame, kind: str, inputs: Sequence[str], low: float = -5.0, high: float = 5.0, outputs: int = 1, seed: int = 0
) -> DataFrame:
    """Append the named target to a frame of inputs.

    ``ann`` targets come from scoring a closed-form network, see
    ``runloom.plans.score.network_target``.
    """
    if kind in SINGLE_OUTPUT and outputs > 1:
        raise ValueError(f"{kind} has one output only")
    xs = [F.col(c) for c in inputs]
    made = {
        "sigmoid": lambda: sigmoid_target(xs, low, high),
        "lin": lambda: linear_target(xs),
        "sin": lambda: sine_target(xs, low, high),
        "random": lambda: random_target(low, high, seed),
    }
    if kind not in made:
        raise ValueError(f"unknown target {kind!r}; one of {sorted(made)}")
    return df.select("*", *made[kind]())
