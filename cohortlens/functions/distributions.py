"""Normal and Student distributions as vectorised functions of NumPy arrays and as Arrow-batched UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_ppf(p: np.ndarray) -> np.ndarray:
    inverse = NormalDist().inv_cdf
    return np.array([inverse(x) if x is not None and 0 < x < 1 else np.nan for x in p])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    if t is None or df is None or not math.isfinite(t) or df <= 0:
        return math.nan
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's distribution by bisection."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        cdf = 1 - t_two_sided(mid, df) / 2 if mid > 0 else t_two_sided(mid, df) / 2
        low, high = (mid, high) if cdf < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(normal_ppf(p.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def normal_p_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if pd.notna(x) else math.nan)


@F.pandas_udf(DoubleType())
def t_p_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else math.nan for a, b in zip(t, df)])
