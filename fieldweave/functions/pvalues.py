"""Tail probabilities as Arrow-batched functions (Spark has no distribution built-ins).

Student's tail becomes a normal one by u^2 = v log(1 + t^2 / v), which turns its density into the normal
density times g(u^2 / v) with g(y) = sqrt(y / (1 - exp(-y))): smooth, close to 1 where v is large, and the same
formula for every number v of degrees of freedom. What is left is an integral over a bounded stretch
that Gauss-Legendre quadrature takes to machine accuracy, for whole arrays at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

NODES, WEIGHTS = np.polynomial.legendre.leggauss(64)
NEAR = 1.0  # below it the tail is one less the middle, which is the exact way round there
FOLDS = 45.0  # powers of e after which the rest of a tail is nothing


def _tail(u: np.ndarray, g: Callable[[np.ndarray, np.ndarray], np.ndarray], scale: np.ndarray | float = 1.0) -> np.ndarray:
    """Two-sided tail beyond u >= 0 of the normal density times scale * g(u, rows), for arrays."""
    out = np.full(u.shape, np.nan)
    scale = np.broadcast_to(np.asarray(scale, float), u.shape)
    for rows, inner in ((np.flatnonzero(u < NEAR), True), (np.flatnonzero((u >= NEAR) & np.isfinite(u)), False)):
        for at in (rows[i:i + 4096] for i in range(0, len(rows), 4096)):
            low = u[at][:, None]
            width = low if inner else np.sqrt(low * low + 2 * FOLDS) - low
            step = (NODES + 1) / 2 * width
            x = step if inner else low + step
            fall = np.exp(-0.5 * x * x) if inner else np.exp(-step * (low + 0.5 * step))
            part = (fall * g(x, at)) @ WEIGHTS * width[:, 0] * scale[at] / math.sqrt(2 * math.pi)  # both sides: twice half the width
            out[at] = 1.0 - part if inner else part * np.exp(-0.5 * u[at] ** 2)
    return np.where(np.isinf(u), 0.0, out)


def normal_two_sided(z) -> np.ndarray:
    z = np.asarray(z, dtype=float)
    return _tail(np.abs(z).ravel(), lambda x, at: np.ones_like(x)).reshape(z.shape)


def chi2_1_upper(x) -> np.ndarray:
    return normal_two_sided(np.sqrt(np.maximum(np.asarray(x, dtype=float), 0.0)))


def half_step_ratio(a: np.ndarray) -> np.ndarray:
    """gamma(a + 1/2) / (gamma(a) sqrt(a)), by the series of its logarithm after steps up to a >= 16."""
    a = np.asarray(a, dtype=float)
    up, product = a.copy(), np.ones_like(a)
    for _ in range(16):
        low = up < 16
        product = np.where(low, product * up / (up + 0.5), product)
        up = np.where(low, up + 1, up)
    i = 1.0 / up
    log = i * (-1 / 8 + i**2 * (1 / 192 + i**2 * (-1 / 640 + i**2 * (17 / 14336 - i**2 * 31 / 18432))))
    return np.exp(log) * product * np.sqrt(up / a)


def t_two_sided(t, df) -> np.ndarray:
    """Two-sided tail of Student's t for any number of degrees of freedom above 0."""
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, dtype=float)), np.asarray(df, dtype=float))
    flat_t, flat_df = t.ravel(), np.where(df > 0, df, np.nan).ravel()
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        ratio = flat_t * flat_t / flat_df
        u = np.sqrt(flat_df * np.where(np.isinf(ratio), 2 * np.log(flat_t) - np.log(flat_df), np.log1p(ratio)))

    def g(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        y = x * x / flat_df[at][:, None]
        return np.sqrt(np.where(y < 1e-8, 1 + y / 2, y / -np.expm1(-np.maximum(y, 1e-8))))

    return np.where(np.isnan(flat_df), np.nan, _tail(u, g, half_step_ratio(np.where(np.isnan(flat_df), 1.0, flat_df) / 2))).reshape(t.shape)


# ---------------------------------------------------------------- exact rank sums
@lru_cache(maxsize=256)
def rank_sum_counts(m: int, n: int) -> tuple[float, ...]:
    """In how many orders of m and n distinct values does U take 0, 1, ... m n, as shares of all orders.

    The generating function is a product of (1 - x^(n + i)) / (1 - x^i); each factor is one pass of
    differences and one of running sums with that stride.
    """
    share = np.zeros(m * n + 1)
    share[0] = 1.0
    for i in range(1, m + 1):
        share[n + i:] -= share[:-(n + i)].copy() if n + i <= m * n else 0.0
        for at in range(i):
            share[at::i] = np.cumsum(share[at::i])
    return tuple(share / share.sum())


def rank_sum_exact(u: float, m: int, n: int) -> float:
    """Two-sided p of U without ties: twice the smaller tail, at most 1."""
    share = np.array(rank_sum_counts(min(m, n), max(m, n)))
    u = int(round(u))
    return float(min(1.0, 2 * min(share[: u + 1].sum(), share[u:].sum())))


@F.pandas_udf(DoubleType())
def _rank_sum_p(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else rank_sum_exact(x, int(a), int(b)) for x, a, b in zip(u, m, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def _corr_p(r: pd.Series, n: pd.Series) -> pd.Series:
    r, n = r.to_numpy(float), n.to_numpy(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = r * np.sqrt((n - 2) / np.maximum(1.0 - r * r, 0.0))
        p = np.where(np.abs(r) >= 1.0, 0.0, t_two_sided(t, n - 2))
    return pd.Series(np.where(n < 3, np.nan, p)).where(lambda s: ~s.isna(), None)


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df)).where(lambda s: ~s.isna(), None)


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series) -> pd.Series:
    return pd.Series(chi2_1_upper(x)).where(lambda s: ~s.isna(), None)


@F.pandas_udf(DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z)).where(lambda s: ~s.isna(), None)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n pairs (Student t, n - 2 degrees of freedom)."""
    return _corr_p(r.cast("double"), n.cast("double"))


def student_t_p(t: Column, df: Column) -> Column:
    return _t_p(t.cast("double"), df.cast("double"))


def chi2_p(x: Column) -> Column:
    return _chi2_p(x.cast("double"))


def normal_p(z: Column) -> Column:
    return _normal_p(z.cast("double"))


def rank_sum_p(u: Column, m: Column, n: Column) -> Column:
    """Exact two-sided p of a rank sum without ties; null u gives null. One row is one whole test."""
    return _rank_sum_p(u.cast("double"), m.cast("long"), n.cast("long"))
