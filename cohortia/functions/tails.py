"""Tail probabilities and related functions, vectorised over Arrow batches.

Small numeric helpers only; every argument is a column of already reduced statistics.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def _lgamma(x):
    """Log of the gamma function of positive numbers: shifted up, then Stirling's series."""
    x = np.asarray(x, float)
    low, shift = x < 16, np.zeros_like(x)
    if low.any():
        for i in range(16):
            shift = shift + np.where(low, np.log(np.where(low, x + i, 1.0)), 0.0)
        x = np.where(low, x + 16, x)
    i = 1 / (x * x)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift



def _ratio(a, b, x, rounds=400):
    """Continued fraction of the incomplete beta integral, by the modified Lentz rule."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 4e-15):
            break
    return h


def beta_share(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, float) for v in (a, b, x)])
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x)
    out[ok & (x <= 0)], out[ok & (x >= 1)] = 0.0, 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        aa, bb, xx = a[mid], b[mid], x[mid]
        swap = xx > (aa + 1) / (aa + bb + 2)
        p, q, y = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y))
        part = front * _ratio(p, q, y) / p
        out[mid] = np.where(swap, 1 - part, part)
    return out


def gamma_upper(a, x):
    """Regularised upper incomplete gamma function Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(x) & (a > 0)
    out[ok & (x <= 0)] = 1.0
    low = ok & (x > 0) & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1 / aa
        total, k = term.copy(), aa.copy()
        for _ in range(2000):
            k = k + 1
            term = term * xx / k
            total = total + term
            if np.all(np.abs(term) < np.abs(total) * 1e-17):
                break
        out[low] = 1 - total * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
    high = ok & (x >= a + 1)
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c, d = np.full_like(b, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 2000):
            num = -i * (i - aa)
            b = b + 2
            d = 1 / (num * d + b)
            c = b + num / c
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-16):
                break
        out[high] = np.exp(-xx + aa * np.log(xx) - _lgamma(aa)) * h
    return out


def t_two_sided(t, df):
    """Two-sided tail of Student's t; infinite df is the normal limit."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    finite = np.where(np.isinf(df), 1.0, df)
    p = beta_share(finite / 2, 0.5, finite / (finite + t * t))
    return np.where(np.isinf(df), gamma_upper(0.5, t * t / 2), p)


def f_upper(f, df1, df2):
    f, df1, df2 = [np.asarray(v, float) for v in (f, df1, df2)]
    return beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_upper(x, df):
    return gamma_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def t_quantile(upper, df):
    """t with the given upper tail, by bisection over the distinct arguments (df >= 1)."""
    upper, df = np.broadcast_arrays(np.asarray(upper, float), np.asarray(df, float))
    pairs, back = np.unique(np.column_stack([upper.ravel(), df.ravel()]), axis=0, return_inverse=True)
    lo, hi = np.full(len(pairs), -10.0), np.full(len(pairs), 14.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        big = t_two_sided(np.exp(mid), pairs[:, 1]) / 2 > pairs[:, 0]
        lo, hi = np.where(big, mid, lo), np.where(big, hi, mid)
    found = np.where(np.isnan(pairs).any(axis=1), np.nan, np.exp((lo + hi) / 2))
    return found[back.ravel()].reshape(df.shape)


def digamma(x):
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        shift = shift - np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    i = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x):
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        shift = shift + np.where(small, 1 / (x * x), 0)
        x = np.where(small, x + 1, x)
    i = 1 / (x * x)
    return shift + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * 5 / 66))))


def trigamma_inverse(y):
    """x with trigamma(x) = y, by bisection on log x."""
    y = np.asarray(y, float)
    lo, hi = np.full(y.shape, -20.0), np.full(y.shape, 20.0)
    for _ in range(90):
        mid = (lo + hi) / 2
        big = trigamma(np.exp(mid)) > y
        lo, hi = np.where(big, mid, lo), np.where(big, hi, mid)
    return np.exp((lo + hi) / 2)


def _column(fn, *args: Column) -> Column:
    """Column whose Arrow batches go through ``fn``; a result that is not a number is NULL."""
    @F.pandas_udf("double")
    def batch(*cols: pd.Series) -> pd.Series:
        out = np.asarray(fn(*[c.to_numpy(dtype=float, na_value=np.nan) for c in cols]), float)
        return pd.Series(out).where(~np.isnan(out), None).astype("Float64")
    return batch(*[a.cast("double") for a in args])


def t_tail(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    return _column(f_upper, f, df1, df2)


def chi2_tail(x: Column, df: Column) -> Column:
    return _column(chi2_upper, x, df)


def t_upper_point(upper: Column, df: Column) -> Column:
    return _column(t_quantile, upper, df)


def log_variance_shift(df: Column) -> Column:
    """Expected log of a scaled chi-square mean over its scale: digamma(df/2) - log(df/2)."""
    return _column(lambda d: digamma(d / 2) - np.log(d / 2), df)


def trigamma_half(df: Column) -> Column:
    return _column(lambda d: trigamma(d / 2), df)
