"""Tail probabilities for aggregated rows: one row per test, never per observation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EXACT_MAX_N = 50  # default: above it the signed-rank null is taken as normal


def signed_rank_p(n: int, w: float, tie_sum: float, exact: bool) -> float:
    """Two-sided p of the smaller signed-rank sum ``w`` over ``n`` non-zero differences."""
    if n == 0:
        return 1.0
    if exact:
        ways = np.ones(1)
        for r in range(1, n + 1):
            ways = np.concatenate([ways, np.zeros(r)]) + np.concatenate([np.zeros(r), ways])
        ways = ways / ways.sum()
        return float(min(1.0, 2.0 * ways[: int(math.floor(w)) + 1].sum()))
    var = n * (n + 1.0) * (2.0 * n + 1.0) / 24.0 - tie_sum / 48.0
    if var <= 0:
        return 1.0
    z = (w - n * (n + 1.0) / 4.0) / math.sqrt(var)
    return float(min(1.0, math.erfc(abs(z) / math.sqrt(2.0))))


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny, m, h = 1e-300, 0, 1.0
    cc, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            cc = 1.0 + num / cc
            cc = cc if abs(cc) > tiny else tiny
            h *= d * cc
        if abs(d * cc - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def rank_correlation_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom."""
    if n < 3 or rho != rho:
        return float("nan")
    df = n - 2.0
    t2 = rho * rho * df / max(1e-12, 1.0 - rho * rho)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t2))


@F.pandas_udf(DoubleType())
def signed_rank_p_udf(n: pd.Series, w: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), b, t, bool(e))
                      for a, b, t, e in zip(n, w.fillna(0), ties.fillna(0), exact)], dtype=float)


@F.pandas_udf(DoubleType())
def rank_correlation_p_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([rank_correlation_p(float(r) if r == r else float("nan"), int(k))
                      for r, k in zip(rho, n)], dtype=float)
