"""Distribution functions Spark SQL lacks, on numpy arrays, and their Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

STIRLING_FROM = 8
FRACTION_FROM = 2.0
FRACTION_STEPS = 120


def log_gamma(x):
    """Stirling's series from 8 upwards, smaller positive numbers by the recurrence."""
    x = np.asarray(x, dtype=float)
    shift = np.where(x < STIRLING_FROM, np.ceil(STIRLING_FROM - x), 0.0)
    product = np.ones_like(x)
    for k in range(STIRLING_FROM):
        product = np.where(k < shift, product * (x + k), product)
    z = x + shift
    w = 1 / (z * z)
    series = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * (691 / 360360 - w / 156)))))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _upper_error(x):
    """The complementary error function: a series of positive terms below 2, a continued fraction above."""
    size = np.abs(np.asarray(x, dtype=float))
    low = np.minimum(size, FRACTION_FROM)
    term = low * 2 / math.sqrt(math.pi) * np.exp(-low * low)
    total = term.copy()
    for n in range(1, 60):
        term = term * 2 * low * low / (2 * n + 1)
        total = total + term
    high = np.maximum(size, FRACTION_FROM)
    tail = np.zeros_like(high)
    for n in range(FRACTION_STEPS, 0, -1):
        tail = 0.5 * n / (high + tail)
    fraction = np.exp(-high * high) / math.sqrt(math.pi) / (high + tail)
    upper = np.where(size < FRACTION_FROM, 1 - total, fraction)
    return np.where(np.asarray(x, dtype=float) < 0, 2 - upper, upper)


def normal_two_sided(z):
    return _upper_error(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0))


def normal_upper(z):
    return 0.5 * _upper_error(np.asarray(z, dtype=float) / math.sqrt(2.0))


def normal_quantile(p):
    """A rational start in the tail, brought to full precision by Halley steps on the tail probability."""
    p = np.asarray(p, dtype=float)
    tail = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(tail))
    # The published rational approximation, good to 4.5e-4.
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    for _ in range(3):
        off = (normal_upper(z) - tail) * math.sqrt(2 * math.pi) * np.exp(0.5 * z * z)
        z = z + off / (1 - 0.5 * z * off)
    return np.where(p < 0.5, -z, z)


def _beta_fraction(a, b, x, steps=400):
    """Continued fraction of the incomplete beta function (modified Lentz), on arrays."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def _log_beta(a, b):
    """log B(a, b); for a large argument the gamma ratio is expanded, as the plain difference cancels."""
    big, small = np.maximum(a, b), np.minimum(a, b)
    correction = lambda z: 1 / (12 * z) - 1 / (360 * z**3)
    far = np.maximum(big, 1e3)
    ratio = np.where(
        big > 1e3,
        (far + small - 0.5) * np.log1p(small / far) + small * (np.log(far) - 1) + correction(far + small) - correction(far),
        log_gamma(big + small) - log_gamma(big),
    )
    return log_gamma(small) - ratio


def beta_cdf(x, a, b, rest=None):
    """Regularised incomplete beta function; `rest` is 1 − x where the caller knows it more exactly."""
    x = np.asarray(x, dtype=float)
    x, rest, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, 1.0 - x if rest is None else rest, a, b)))
    if not x.size:
        return x.copy()
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    inside = np.clip(np.where(swap, rest, x), 1e-300, 1.0)
    outside = np.clip(np.where(swap, x, rest), 1e-300, 1.0)
    log_of = lambda value, other: np.where(value > 0.5, np.log1p(-np.minimum(other, 0.5)), np.log(value))
    front = np.exp(-_log_beta(p, q) + p * log_of(inside, outside) + q * log_of(outside, inside))
    part = np.where(inside <= 1e-300, 0.0, front * _beta_fraction(p, q, inside) / p)
    return np.where(swap, 1.0 - part, part)


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5, t * t / (df + t * t))


def f_upper(f, df1, df2):
    f = np.asarray(f, dtype=float)
    whole = df2 + df1 * f
    return beta_cdf(df2 / whole, np.asarray(df2) / 2.0, np.asarray(df1) / 2.0, df1 * f / whole)


def f_quantile(p, df1, df2):
    """The value with lower tail `p`, by bisection on the upper tail."""
    df1, df2, p = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (df1, df2, p)))
    low, high = np.zeros(df1.shape), np.full(df1.shape, 1e6)
    for _ in range(200):
        middle = 0.5 * (low + high)
        above = f_upper(middle, df1, df2) > 1.0 - p
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return 0.5 * (low + high)


def t_quantile(p, df):
    """Upper half only: `p` of at least one half."""
    return np.sqrt(f_quantile(2.0 * np.asarray(p, dtype=float) - 1.0, 1.0, df))


def digamma(x):
    """Recurrence up to 8, then the asymptotic series."""
    x = np.array(x, dtype=float)
    total = np.zeros_like(x)
    for _ in range(8):
        low = x < 8.0
        total = np.where(low, total - 1.0 / x, total)
        x = np.where(low, x + 1.0, x)
    s = 1.0 / (x * x)
    series = s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (1 / 132)))))
    return total + np.log(x) - 0.5 / x - series


def trigamma(x):
    x = np.array(x, dtype=float)
    total = np.zeros_like(x)
    for _ in range(8):
        low = x < 8.0
        total = np.where(low, total + 1.0 / (x * x), total)
        x = np.where(low, x + 1.0, x)
    s = 1.0 / (x * x)
    series = (1.0 / x) * (1 + 0.5 / x + s * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30)))))
    return total + series


def _nullable(function):
    """An Arrow UDF over doubles that leaves rows with a missing argument null."""

    def one(a: pd.Series) -> pd.Series:
        return _apply(function, a)

    return F.pandas_udf(one, DoubleType())


def _apply(function, *columns):
    stacked = pd.concat(columns, axis=1).astype(float)
    known = stacked.notna().all(axis=1).to_numpy()
    out = np.full(len(stacked), np.nan)
    if known.any():
        out[known] = function(*(stacked.iloc[:, i].to_numpy()[known] for i in range(stacked.shape[1])))
    return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("Float64")


log_gamma_udf = _nullable(log_gamma)
digamma_udf = _nullable(digamma)
trigamma_udf = _nullable(trigamma)
normal_two_sided_udf = _nullable(normal_two_sided)
normal_upper_udf = _nullable(normal_upper)
normal_quantile_udf = _nullable(normal_quantile)


@F.pandas_udf(DoubleType())
def t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def f_upper_udf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _apply(f_upper, f, df1, df2)


@F.pandas_udf(DoubleType())
def f_quantile_udf(p: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _apply(f_quantile, p, df1, df2)
