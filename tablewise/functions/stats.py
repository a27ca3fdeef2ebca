"""Significance figures for small reduced frames, and column expressions for their labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction, for arrays."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    value = d.copy()
    for m in range(1, steps):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            value *= c * d
    out = np.where(z <= 0, 0.0, front * value)
    return np.clip(np.where(flip, 1 - out, out), 0, 1)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t; 0 for an infinite t, NaN where df is not positive."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = (df > 0) & ~np.isnan(t)
    n = np.where(ok, df, 1.0)
    x = np.where(np.isinf(t), 0.0, n / (n + np.where(np.isinf(t), 0.0, t) ** 2))
    return np.where(ok, incomplete_beta(n / 2, 0.5, x), np.nan)


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    p = t_two_sided(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(p).where(~np.isnan(p), None)


@pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def confidence_of_z(z: Column) -> Column:
    out = F.lit("low")
    for at, label in ((1.645, "90%"), (1.96, "95%"), (2.576, "99%"), (3.29, "99.9%")):
        out = F.when(F.abs(z) >= at, F.lit(label)).otherwise(out)
    return out


def confidence_of_p(p: Column) -> Column:
    out = F.lit("low")
    for at, label in ((0.1, "90%"), (0.05, "95%"), (0.01, "99%"), (0.001, "99.9%")):
        out = F.when(p < at, F.lit(label)).otherwise(out)
    return out
