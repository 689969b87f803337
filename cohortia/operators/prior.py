"""Prior variance distribution from summary moments of one row per contrast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.functions.tails import digamma, f_upper, trigamma_inverse


def _plain(z_mean: np.ndarray, z_var: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    extra = z_var - tri
    d0 = np.full(z_mean.shape, np.inf)
    fit = extra > 0
    d0[fit] = 2 * trigamma_inverse(extra[fit])
    s2 = np.exp(z_mean)
    s2[fit] = np.exp(z_mean[fit] + digamma(d0[fit] / 2) - np.log(d0[fit] / 2))
    return d0, s2


def _log_f_moments(df1: float, df2: float, tail: tuple[float, float]) -> tuple[float, float]:
    """Mean and variance of log F with both tails pulled in to their quantiles."""
    x = np.linspace(-10, 10, 1001)
    upper = f_upper(np.exp(x), df1, np.full(x.shape, min(df2, 1e7)))
    lo, hi = np.interp(tail[0], 1 - upper, x), np.interp(1 - tail[1], 1 - upper, x)
    grid = np.clip((x[1:] + x[:-1]) / 2, lo, hi)
    mass = -np.diff(upper)
    mean = (grid * mass).sum() / mass.sum()
    return mean, ((grid - mean) ** 2 * mass).sum() / mass.sum()


def _robust(w_mean: float, w_var: float, df: float, tail: tuple[float, float]) -> tuple[float, float]:
    lo, hi = np.log(0.1), np.log(1e6)
    mean, var = _log_f_moments(df, np.exp(hi), tail)
    if w_var <= var:
        return np.inf, float(np.exp(w_mean - mean))
    for _ in range(34):
        mid = (lo + hi) / 2
        if _log_f_moments(df, np.exp(mid), tail)[1] > w_var:
            lo = mid
        else:
            hi = mid
    mean, _ = _log_f_moments(df, np.exp(lo), tail)
    return float(np.exp(lo)), float(np.exp(w_mean - mean))


def plain_prior(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("prior_df double, prior_s2 double")
    def solve(m: pd.Series, v: pd.Series, t: pd.Series) -> pd.DataFrame:
        d0, s2 = _plain(*[s.to_numpy(float) for s in (m, v, t)])
        return pd.DataFrame({"prior_df": d0, "prior_s2": s2})
    return rows.withColumn("__p", solve("z_mean", "z_var", "tri")).select("*", "__p.*").drop("__p")


def robust_prior(rows: DataFrame, tail: tuple[float, float]) -> DataFrame:
    @F.pandas_udf("prior_df double, prior_s2 double")
    def solve(m: pd.Series, v: pd.Series, df: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_robust(a, b, c, tail) for a, b, c in zip(m, v, df)], columns=["prior_df", "prior_s2"])
    return rows.withColumn("__p", solve("w_mean", "w_var", "df_mean")).select("*", "__p.*").drop("__p")

