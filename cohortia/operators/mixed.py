"""Random-intercept models per assay, fitted by restricted likelihood.

With one random intercept a subject enters the likelihood only through its number of rows
and its sums. Subjects with equally many rows are therefore merged: Spark reduces the facts
to one row per (assay, rows per subject), and the one-dimensional search sees only those.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.functions.tails import chi2_upper, t_two_sided
from cohortia.operators.linear import numeric_sex

SINGULAR = 1e-4


def design_rows(long: DataFrame, interaction: bool = False, cohort: Cohort = DEFAULT) -> tuple[DataFrame, list[str]]:
    """Complete rows with the fixed-effect columns of ``age + sex`` or ``age * sex``."""
    c = cohort
    rows = long.select(
        F.col(c.assay).alias("assay"), F.col(c.subject).alias("subject"), F.lit(1.0).alias("one"),
        F.col(c.age).cast("double").alias("age"), numeric_sex(F.col(c.sex)).alias("sex"), F.col(c.value).alias("y")
    ).filter("age IS NOT NULL AND sex IS NOT NULL AND y IS NOT NULL AND subject IS NOT NULL")
    names = ["one", "age", "sex"]
    if interaction:
        rows, names = rows.withColumn("age_sex", F.col("age") * F.col("sex")), [*names, "age_sex"]
    return rows, names


def intercept_statistics(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (assay, rows per subject): merged sums and cross-products."""
    cols = [*names, "y"]
    pairs = list(combinations_with_replacement(cols, 2))
    per_subject = rows.groupBy("assay", "subject").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s_{v}") for v in cols],
        *[F.expr(f"sum({a} * {b})").alias(f"q_{a}_{b}") for a, b in pairs])
    total = ", ".join(f"sum(q_{a}_{b})" for a, b in pairs)
    between = ", ".join(f"sum(s_{a} * s_{b})" for a, b in pairs)
    return per_subject.groupBy("assay", "n").agg(
        F.count(F.lit(1)).alias("subjects"), F.expr(f"array({total})").alias("total"), F.expr(f"array({between})").alias("between"))


def _square(flat: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((m, m))
    out[np.triu_indices(m)] = flat
    return out + np.triu(out, 1).T


class _Profile:
    """Restricted likelihood of one assay as a function of the variance ratio."""

    def __init__(self, pdf: pd.DataFrame, p: int):
        self.n = pdf["n"].to_numpy(float)
        self.subjects = pdf["subjects"].to_numpy(float)
        self.total = _square(np.sum([np.asarray(v) for v in pdf["total"]], axis=0), p + 1)
        self.between = [_square(np.asarray(v), p + 1) for v in pdf["between"]]
        self.p, self.rows = p, float((self.n * self.subjects).sum())

        self.kept = list(range(p))

    def independent(self) -> _Profile:
        """The same without columns that earlier ones determine (as sex where only one occurs)."""
        x, kept = self.total[:-1, :-1], []
        scale = np.sqrt(np.maximum(np.diag(x), 1e-300))
        unit = x / np.outer(scale, scale)
        for j in range(self.p):
            if np.linalg.matrix_rank(unit[np.ix_([*kept, j], [*kept, j])], tol=1e-10) > len(kept):
                kept.append(j)
        at = np.ix_([*kept, self.p], [*kept, self.p])
        self.total, self.between = self.total[at], [b[at] for b in self.between]
        self.p, self.kept = len(kept), kept
        return self

    def parts(self, ratio: float):
        g = ratio / (1 + self.n * ratio)
        m = self.total - sum(w * b for w, b in zip(g, self.between))
        a, b, q = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        beta = np.linalg.solve(a, b)
        rss = max(q - b @ beta, 1e-300)
        logs = float((self.subjects * np.log1p(self.n * ratio)).sum()) + np.linalg.slogdet(a)[1]
        return a, beta, rss, logs

    def criterion(self, ratio: float) -> float:
        _, _, rss, logs = self.parts(ratio)
        d = self.rows - self.p
        return logs + d * (1 + np.log(2 * np.pi * rss / d))

    def best(self) -> float:
        grid = np.linspace(-18, 14, 65)
        vals = np.array([self.criterion(np.exp(v)) for v in grid])
        i = int(vals.argmin())
        lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
        gold = (np.sqrt(5) - 1) / 2
        for _ in range(70):
            a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
            if self.criterion(np.exp(a)) < self.criterion(np.exp(b)):
                hi = b
            else:
                lo = a
        ratio = float(np.exp((lo + hi) / 2))
        return 0.0 if self.criterion(0.0) <= self.criterion(ratio) else ratio

    def deviance(self, su: float, se: float) -> float:
        _, _, rss, logs = self.parts(su / se)
        return (self.rows - self.p) * np.log(se) + logs + rss / se

    def degrees(self, su: float, se: float) -> np.ndarray:
        """Satterthwaite degrees of freedom of each coefficient."""
        if su <= 0:
            return np.full(self.p, self.rows - self.p)
        at = np.array([su, se])
        h = 1e-3 * at
        f = lambda d0, d1: self.deviance(at[0] + d0 * h[0], at[1] + d1 * h[1])
        mid = f(0, 0)
        hess = np.array([[(f(1, 0) - 2 * mid + f(-1, 0)) / h[0] ** 2, (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / (4 * h[0] * h[1])], [0, 0]])
        hess[1] = [hess[0, 1], (f(0, 1) - 2 * mid + f(0, -1)) / h[1] ** 2]
        var = lambda s: np.diag(np.linalg.inv(self.parts(s[0] / s[1])[0])) * s[1]
        grad = np.array([(var(at + h * e) - var(at - h * e)) / (2 * h @ e) for e in np.eye(2)])
        spread = np.einsum("ik,ij,jk->k", grad, 2 * np.linalg.pinv(hess), grad)
        return 2 * var(at) ** 2 / spread

    def moments(self, beta: np.ndarray) -> float:
        """Sample variance of the fixed-effect prediction."""
        x = self.total[:-1, :-1]
        mean = x[0] / self.rows
        return float(beta @ (x - self.rows * np.outer(mean, mean)) @ beta / (self.rows - 1))


FIT_SCHEMA = ("assay string, term string, estimate double, std_error double, statistic double, df double, p_value double, "
              "fixed_share double, random_share double, residual_share double, var_subject double, var_residual double, "
              "criterion double, n long, singular boolean")


def mixed_model(long: DataFrame, interaction: bool = False, cohort: Cohort = DEFAULT) -> DataFrame:
    """Fixed effects of ``value ~ age + sex + (1 | subject)`` per assay, with the variance parts.

    One fit serves both the coefficient and the variance tables.
    """
    rows, names = design_rows(long, interaction, cohort)
    return fit_statistics(intercept_statistics(rows, names), names)


def fit_statistics(stats: DataFrame, names: Sequence[str]) -> DataFrame:
    terms = ["(Intercept)", *names[1:]]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        prof = _Profile(pdf, len(names)).independent()
        if prof.rows <= prof.p:
            return pd.DataFrame({c.split()[0]: [] for c in FIT_SCHEMA.split(", ")})
        ratio = prof.best()
        singular = np.sqrt(ratio) < SINGULAR
        a, beta, rss, _ = prof.parts(ratio)
        se = rss / (prof.rows - prof.p)
        su = ratio * se
        err = np.sqrt(np.diag(np.linalg.inv(a)) * se)
        df = prof.degrees(0.0 if singular else su, se)
        fixed = prof.moments(beta)
        whole = fixed + su + se
        marginal, random = fixed / whole, 0.0 if singular else su / whole
        return pd.DataFrame({
            "assay": pdf["assay"].iloc[0], "term": [terms[i] for i in prof.kept], "estimate": beta, "std_error": err, "statistic": beta / err, "df": df,
            "p_value": t_two_sided(beta / err, df), "fixed_share": marginal, "random_share": random,
            "residual_share": 1 - marginal - random, "var_subject": su, "var_residual": se,
            "criterion": prof.criterion(ratio), "n": int(prof.rows), "singular": bool(singular)})

    return stats.groupBy("assay").applyInPandas(fit, FIT_SCHEMA)


def fixed_effects(fit: DataFrame) -> DataFrame:
    return fit.select("assay", "term", "estimate", "std_error", "statistic", "df", "p_value")


def variance_explained(fit: DataFrame) -> DataFrame:
    """Shares of variance per assay: fixed effects, subject, residual."""
    parts = F.array(*[F.struct(F.lit(n).alias("component"), F.col(c).alias("variance")) for n, c in (
        ("Fixed effects (age & sex)", "fixed_share"), ("Random effects (subject)", "random_share"), ("Residual", "residual_share"))])
    return fit.filter("term = '(Intercept)'").select("assay", F.explode(parts).alias("e")).select("assay", "e.*")


COMPARISON = ("assay string, term string, npar int, criterion double, statistic double, df int, p_value double, singular boolean")


def chi_square_rows(steps: DataFrame) -> DataFrame:
    """Likelihood-ratio table from (assay, models array of (term, npar, criterion, singular))."""
    def table(batches):
        for pdf in batches:
            out = []
            for assay, models in zip(pdf["assay"], pdf["models"]):
                models = sorted(models, key=lambda m: m["npar"])
                for i, m in enumerate(models):
                    stat = None if i == 0 else max(models[i - 1]["criterion"] - m["criterion"], 0.0)
                    df = None if i == 0 else int(m["npar"] - models[i - 1]["npar"])
                    p = None if i == 0 else float(chi2_upper([stat], [df])[0])
                    out.append((assay, m["term"], int(m["npar"]), m["criterion"], stat, df, p, bool(m["singular"])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in COMPARISON.split(", ")])
    return steps.mapInPandas(table, COMPARISON)


def compare_interaction(long: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Main effects against interaction, both with a random intercept, without refitting."""
    rows, names = design_rows(long, True, cohort)
    parts = None
    for term, cols in (("main", names[:-1]), ("interaction", names)):
        fit = fit_statistics(intercept_statistics(rows, cols), cols).filter("term = '(Intercept)'").select(
            "assay", F.struct(F.lit(term).alias("term"), F.lit(len(cols) + 2).alias("npar"), "criterion", "singular").alias("m"))
        parts = fit if parts is None else parts.unionByName(fit)
    return chi_square_rows(parts.groupBy("assay").agg(F.collect_list("m").alias("models")))


def singular_counts(results: DataFrame, test: str, dataset: str) -> DataFrame:
    return (results.filter("singular").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(test).alias("test"), F.lit(dataset).alias("dataset"), "term", "n"))
