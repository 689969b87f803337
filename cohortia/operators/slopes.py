"""Random-slope models per assay, fitted by restricted likelihood in passes over the data.

A pass evaluates, for all assays at once, a few candidate variance parameters per assay:
subjects are held as moment matrices in chunks of bounded size, each chunk returns partial
sums, and Spark adds them up. The next candidates are chosen from the summed results, so
neither a whole assay nor its subjects are ever in one task.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.operators.mixed import (SINGULAR, chi_square_rows, design_rows, fit_statistics, intercept_statistics)
from cohortia.session import cut

NAMES = ["one", "age", "sex", "age_sex"]
M = len(NAMES) + 1
CHUNK = 2000
STATE = "assay string, n long, phase string, center array<double>, width double, best double, gain double, cands array<array<double>>"


def subject_chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(assay, chunk, moments): one moment matrix per subject, packed in bounded chunks."""
    cols = [*NAMES, "y"]
    flat = ", ".join(f"sum({a} * {b})" for a, b in combinations_with_replacement(cols, 2))
    per = rows.groupBy("assay", "subject").agg(F.expr(f"array({flat})").alias("g"))
    most = per.groupBy("assay").count().agg(F.max("count")).first()[0] or 1
    tag = F.pmod(F.xxhash64("subject"), F.lit(-(-most // chunk)))
    return per.withColumn("chunk", tag).groupBy("assay", "chunk").agg(F.collect_list("g").alias("moments"))


def _matrices(flat: np.ndarray) -> np.ndarray:
    out = np.zeros((len(flat), M, M))
    i, j = np.triu_indices(M)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def _lower(theta: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((q, q))
    out[np.tril_indices(q)] = theta
    return out


def _partial(moments, cands, q: int) -> list[list[float]]:
    g = _matrices(np.array([np.asarray(m) for m in moments]))
    out = []
    for theta in cands:
        low = _lower(np.asarray(theta), q)
        w = g[:, :, :q] @ low
        inner = np.eye(q) + low.T @ g[:, :q, :q] @ low
        c = g - w @ np.linalg.solve(inner, w.transpose(0, 2, 1))
        out.append([*c.sum(axis=0)[np.triu_indices(M)], float(np.linalg.slogdet(inner)[1].sum())])
    return out


def evaluate(chunks: DataFrame, state: DataFrame, q: int) -> DataFrame:
    """(assay, cand, sums) of every candidate, summed over all chunks of an assay."""
    @F.pandas_udf("array<array<double>>")
    def partial(moments: pd.Series, cands: pd.Series) -> pd.Series:
        return pd.Series([_partial(m, c, q) for m, c in zip(moments, cands)])

    size = M * (M + 1) // 2 + 1
    parts = (chunks.join(state.select("assay", "cands"), "assay")
             .select("assay", F.posexplode(partial("moments", "cands")).alias("cand", "s")))
    total = ", ".join(f"sum(s[{i}])" for i in range(size))
    return parts.groupBy("assay", "cand").agg(F.expr(f"array({total})").alias("sums"))


def _criterion(sums: np.ndarray, n: float) -> float:
    c = _matrices(sums[None, :-1])[0]
    a, b = c[:-1, :-1], c[:-1, -1]
    rss = max(c[-1, -1] - b @ np.linalg.solve(a, b), 1e-300)
    d = n - len(b)
    return sums[-1] + np.linalg.slogdet(a)[1] + d * (1 + np.log(2 * np.pi * rss / d))


def _design(center: np.ndarray, width: float) -> list[list[float]]:
    """Centre, axial points and pairwise points of a quadratic model."""
    d, e = len(center), np.eye(len(center)) * width
    pts = [center, *[center + e[i] for i in range(d)], *[center - e[i] for i in range(d)]]
    pts += [center + e[i] + e[j] for i in range(d) for j in range(i)]
    return [list(map(float, p)) for p in pts]


def _newton(vals: np.ndarray, d: int, width: float) -> np.ndarray:
    f0, up, dn = vals[0], vals[1:1 + d], vals[1 + d:1 + 2 * d]
    grad = (up - dn) / (2 * width)
    hess = np.diag((up - 2 * f0 + dn) / width ** 2)
    k = 1 + 2 * d
    for i in range(d):
        for j in range(i):
            hess[i, j] = hess[j, i] = (vals[k] - up[i] - up[j] + f0) / width ** 2
            k += 1
    val, vec = np.linalg.eigh(hess)
    val = np.maximum(np.abs(val), 1e-6 * max(np.abs(val).max(), 1.0))
    step = -vec @ ((vec.T @ grad) / val)
    long = np.linalg.norm(step)
    return step if long <= 2 else step * 2 / long


def _advance(row: pd.Series, vals: np.ndarray) -> tuple:
    cands = [np.asarray(c) for c in row["cands"]]
    at = int(np.nanargmin(vals))
    if row["phase"] == "design":
        center = np.asarray(row["center"])
        step = _newton(vals, len(center), row["width"])
        line = [center + t * step for t in (0.05, 0.15, 0.3, 0.6, 1.0, 1.5, 2.5)] + [cands[at], center]
        return row["assay"], row["n"], "line", list(center), row["width"], float(vals[0]), row["gain"], [list(map(float, c)) for c in line]
    gain = float(row["best"] - vals[at])
    width = row["width"] * (0.5 if gain > 1e-3 else 0.3)
    width = max(width, 2e-3)
    best = cands[at]
    return row["assay"], row["n"], "design", list(map(float, best)), width, float(vals[at]), gain, _design(best, width)


def fit_slopes(chunks: DataFrame, start: DataFrame, q: int, max_rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """Best variance parameters and criterion per assay; ``start`` holds (assay, n, ratio).

    An assay leaves the rounds when a round gains less than ``tolerance``; ``converged`` tells those that
    were still gaining after ``max_rounds``.
    """

    def begin(batches):
        for pdf in batches:
            out = []
            for assay, n, ratio in zip(pdf["assay"], pdf["n"], pdf["ratio"]):
                low = np.diag([max(np.sqrt(ratio), 0.1), *[0.2] * (q - 1)])
                center = low[np.tril_indices(q)]
                out.append((assay, n, "design", list(center), 0.1, np.inf, np.inf, _design(center, 0.1)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cand")
        vals = np.array([_criterion(np.asarray(s, float), float(n)) for s, n in zip(pdf["sums"], pdf["n"])])
        return pd.DataFrame([_advance(pdf.iloc[0], vals)], columns=[c.split()[0] for c in STATE.split(", ")])

    state = cut(start.select("assay", "n", "ratio").mapInPandas(begin, STATE))
    done = state.limit(0)
    for i in range(2 * max_rounds):
        scored = evaluate(chunks, state, q).join(state, "assay")
        state = cut(scored.groupBy("assay").applyInPandas(step, STATE))
        if i % 2 == 1:
            done = done.unionByName(state.filter(F.col("gain") < tolerance))
            state = state.filter(F.col("gain") >= tolerance)
            if state.isEmpty():
                break
    return done.unionByName(state).select("assay", F.col("center").alias("theta"), F.col("best").alias("criterion"),
                                          (F.col("gain") < tolerance).alias("converged"))


def _raw_singular(theta, mean: float, sd: float, q: int) -> bool:
    """Whether a diagonal entry of the factor is nearly zero on the unscaled age."""
    t = np.eye(q)
    t[0, 1], t[1, 1] = -mean / sd, 1 / sd
    r = np.linalg.qr((t @ _lower(np.asarray(theta), q)).T, mode="r")
    return bool((np.abs(np.diag(r)) < SINGULAR).any())


def _singular_column(q: int):
    @F.pandas_udf("boolean")
    def flag(theta: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
        return pd.Series([_raw_singular(t, a, b, q) for t, a, b in zip(theta, mean, sd)])
    return flag("theta", "m", "s")


def compare_slopes(long: DataFrame, cohort: Cohort = DEFAULT, max_rounds: int = 40, chunk: int = CHUNK) -> DataFrame:
    """Random intercept against random age slope against random age and sex slopes.

    All share the fixed effects ``age * sex``. Age is centred and scaled inside the fit and
    the criterion is given on the unscaled age.
    """
    rows, names = design_rows(long, True, cohort)
    scale = cut(rows.groupBy("assay").agg(F.avg("age").alias("m"), F.stddev_samp("age").alias("s"), F.count(F.lit(1)).alias("n")))
    z = (rows.join(scale.select("assay", "m", "s"), "assay").withColumn("age", (F.col("age") - F.col("m")) / F.col("s"))
         .withColumn("age_sex", F.col("age") * F.col("sex")).drop("m", "s"))
    z = cut(z)
    chunks = cut(subject_chunks(z, chunk))
    first = cut(fit_statistics(intercept_statistics(z, names), names).filter("term = '(Intercept)'"))
    start = first.select("assay", "n", (F.col("var_subject") / F.col("var_residual")).alias("ratio"))
    shift = 4 * F.log("s")
    parts = first.join(scale.select("assay", "s"), "assay").select("assay", F.struct(
        F.lit("intercept").alias("term"), F.lit(6).alias("npar"), (F.col("criterion") + shift).alias("criterion"), "singular").alias("m"))
    for term, q, npar in (("age slope", 2, 8), ("age and sex slopes", 3, 11)):
        fit = fit_slopes(chunks, start, q, max_rounds)
        parts = parts.unionByName(fit.join(scale, "assay").select("assay", F.struct(
            F.lit(term).alias("term"), F.lit(npar).alias("npar"), (F.col("criterion") + shift).alias("criterion"),
            _singular_column(q).alias("singular")).alias("m")))
    return chi_square_rows(parts.groupBy("assay").agg(F.collect_list("m").alias("models")))
