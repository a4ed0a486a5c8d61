"""Exact binomial tails at any count: the regularised incomplete beta function by its continued fraction.

The factor before the fraction is the probability of the count itself, by the deviance form of the binomial, which stays
accurate where the logarithms of factorials cancel. Arrays in, arrays out; a count takes the same memory however large it is,
and steps in proportion to its square root.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative change at which the continued fraction has converged, and a value below which its terms count as zero.
EXACT, TINY = 1e-15, 1e-300


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula."""
    small = np.array([0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)])
    x = np.maximum(n, 1.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / x**2) / x**2) / x**2) / x**2) / x
    return np.where(n < 16, small[np.minimum(n, 15).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without cancellation where the two are close."""
    v = (x - mean) / (x + mean)
    total, term = (x - mean) * v, 2 * x * v
    for j in range(1, 60):  # |v| < 0.1: sixty terms are more than enough
        term = term * v * v
        total = total + term / (2 * j + 1)
    far = np.abs(v) >= 0.1
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    return np.where(far, plain, total)


def half_mass(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The probability of k heads in n fair throws; n at least 1."""
    rest, mean = n - k, n / 2
    edge = (k == 0) | (rest == 0)
    log = _stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - _deviance(k, mean) - _deviance(rest, mean)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.exp(log) * np.sqrt(n / (2 * math.pi * k * rest))
    return np.where(edge, np.exp(-n * math.log(2)), inner)


def _fraction(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method, row by row until it holds still."""
    safe = lambda y: np.where(np.abs(y) < TINY, TINY, y)
    out = np.ones(len(a))
    left = np.arange(len(a))
    c, d = np.ones(len(a)), 1 / safe(1 - (a + b) * x / (a + 1))
    h, m = d.copy(), 0
    while len(left):
        m += 1
        before = h
        for even in (True, False):
            if even:
                t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 / safe(1 + t * d), safe(1 + t / c)
            h = h * d * c
        done = np.abs(h - before) <= EXACT * np.abs(h)
        if m > 5_000_000:
            raise ArithmeticError("the continued fraction does not converge")
        if done.any():
            out[left[done]] = h[done]
            left, a, b, c, d, h = (y[~done] for y in (left, a, b, c, d, h))
    return out


def two_sided(minus: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """Twice the probability that of minus + plus fair throws no more than the smaller count fall on one side, 1 at most."""
    minus, plus = np.asarray(minus, dtype=float), np.asarray(plus, dtype=float)
    k, n = np.minimum(minus, plus), minus + plus
    out = np.where(np.isnan(n), np.nan, 1.0)
    far = np.flatnonzero(2 * k < n - 1)
    if len(far):
        k, n = k[far], n[far]
        out[far] = np.minimum(1.0, half_mass(k, n) * _fraction(n - k, k + 1, 0.5))
    return out


def exact_two_sided(minus: Column, plus: Column) -> Column:
    """two_sided of two columns of counts; null where one is null."""

    @F.pandas_udf("double")
    def tail(minus: pd.Series, plus: pd.Series) -> pd.Series:
        found = two_sided(minus.to_numpy(dtype=float, na_value=np.nan), plus.to_numpy(dtype=float, na_value=np.nan))
        return pd.Series(found).where(~np.isnan(found), None)

    return tail(minus.cast("double"), plus.cast("double"))
