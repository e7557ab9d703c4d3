"""Activations, their derivatives, costs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runloom.functions.arrays import let, total

# Clamps that keep exp() finite, and the offset inside the logarithm.
EXP_CLAMP = 400.0
LOG_OFFSET = 1e-30


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(z, F.lit(-EXP_CLAMP))))


def relu(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0))


def softmax(z: Column) -> Column:
    """Over an array, with no shift by the maximum; NULLs when every term underflows."""
    powers = F.transform(z, lambda v: F.exp(F.least(v, F.lit(EXP_CLAMP))))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda v: F.try_divide(v, s))))


def sigmoid_slope(y: Column) -> Column:
    """Derivative expressed in the output."""
    return y * (F.lit(1.0) - y)


def relu_slope(y: Column) -> Column:
    return F.when(y > 0, 1.0).otherwise(0.0)


def unit_slope(y: Column) -> Column:
    """Linear, and softmax whose own factor is folded into the cost derivative."""
    return F.when(y.isNotNull(), 1.0)


def squared_cost(y: Column, t: Column) -> Column:
    return F.lit(0.5) * total(F.zip_with(y, t, lambda a, b: (a - b) * (a - b)))


def cross_entropy(y: Column, t: Column) -> Column:
    return -total(F.zip_with(t, y, lambda a, b: a * F.ln(b + LOG_OFFSET)))


def cost_slope(y: Column, t: Column, batch_rows: int | Column) -> Column:
    """(y - t) / rows of the whole batch, never those of one partition."""
    rows = batch_rows if isinstance(batch_rows, Column) else F.lit(float(batch_rows))
    return F.zip_with(y, t, lambda a, b: (a - b) / rows)
