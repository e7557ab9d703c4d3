"""Normal numbers by counter: from (seed, stream, index) without state, alike as column, NumPy array and SQL.

An index is sent through a keyed permutation of SIDE * SIDE places, whose middle is a probability, and that
through a rational approximation of the normal quantile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from runloom.functions.permutation import permuted, permuted_numbers, round_keys

SIDE = 46341
PLACES = SIDE * SIDE
# Coefficients of Acklam's approximation of the normal quantile, and where its tails begin.
CENTRE_ABOVE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_ABOVE = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def _polynomial(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def quantile(p: Column) -> Column:
    q = p - F.lit(0.5)
    r = q * q
    centre = _polynomial([F.lit(c) for c in CENTRE_ABOVE], r) * q / _polynomial([F.lit(c) for c in CENTRE_BELOW], r)
    t = F.sqrt(F.lit(-2.0) * F.ln(F.least(p, F.lit(1.0) - p)))
    tail = _polynomial([F.lit(c) for c in TAIL_ABOVE], t) / _polynomial([F.lit(c) for c in TAIL_BELOW], t)
    return F.when(p < TAIL, tail).when(p > 1.0 - TAIL, -tail).otherwise(centre)


def quantiles(p: np.ndarray) -> np.ndarray:
    q = p - 0.5
    r = q * q
    centre = _polynomial(CENTRE_ABOVE, r) * q / _polynomial(CENTRE_BELOW, r)
    t = np.sqrt(-2.0 * np.log(np.minimum(p, 1.0 - p)))
    tail = _polynomial(TAIL_ABOVE, t) / _polynomial(TAIL_BELOW, t)
    return np.where(p < TAIL, tail, np.where(p > 1.0 - TAIL, -tail, centre))


def normal(index: Column, seed: int, stream: int) -> Column:
    """A normal number for each index; a stream repeats after PLACES of them."""
    place = permuted(F.pmod(index.cast("long"), F.lit(PLACES).cast("long")), PLACES, round_keys(seed, stream))
    return quantile((place.cast("double") + F.lit(0.5)) / F.lit(float(PLACES)))


def normals(count: int, seed: int, stream: int) -> np.ndarray:
    """The numbers of the indexes from 0 on."""
    place = permuted_numbers(np.arange(count, dtype=np.int64) % PLACES, PLACES, round_keys(seed, stream))
    return quantiles((place + 0.5) / float(PLACES))
