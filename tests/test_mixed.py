"""Grouped variance-component fits against dense matrices."""

import numpy as np

from cohortia.operators import mixed


def dense(y, x, subject, ratio):
    z = (subject[:, None] == np.unique(subject)[None, :]).astype(float)
    v = np.eye(len(y)) + ratio * z @ z.T
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ beta
    d = len(y) - x.shape[1]
    rss = r @ vi @ r
    crit = np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + d * (1 + np.log(2 * np.pi * rss / d))
    return crit, beta, rss / d, np.sqrt(np.diag(np.linalg.inv(a)) * rss / d)


def make(seed, effect):
    rng = np.random.default_rng(seed)
    subject = np.repeat(np.arange(30), rng.integers(1, 6, 30))
    n = len(subject)
    age = 20 + 3.0 * subject % 40 + rng.uniform(0, 5, n)
    sex = (subject % 2).astype(float)
    y = 1 + 0.02 * age + 0.3 * sex + effect * rng.normal(size=30)[subject] + rng.normal(size=n)
    return subject, age, sex, y


def test_fit_matches_dense(spark):
    rows, sets = [], {}
    for assay, (seed, effect) in {"strong": (1, 1.5), "weak": (2, 0.6), "none": (7, 0.0)}.items():
        subject, age, sex, y = make(seed, effect)
        sets[assay] = (subject, age, sex, y)
        rows += [(assay, int(s), float(a), "M" if g else "F", float(v)) for s, a, g, v in zip(subject, age, sex, y)]
    df = spark.createDataFrame(rows, "assay string, subject long, age double, sex string, value double")
    fit = mixed.mixed_model(df).toPandas()
    for assay, (subject, age, sex, y) in sets.items():
        got = fit[fit.assay == assay].set_index("term").loc[["(Intercept)", "age", "sex"]]
        x = np.column_stack([np.ones_like(age), age, sex])
        ratio = got.var_subject.iloc[0] / got.var_residual.iloc[0]
        crit, beta, s2, err = dense(y, x, subject, ratio)
        assert np.allclose(got.estimate, beta, atol=1e-8)
        assert np.allclose(got.std_error, err, atol=1e-8)
        assert abs(got.criterion.iloc[0] - crit) < 1e-7
        for other in np.exp(np.linspace(-8, 4, 60)):
            assert dense(y, x, subject, other)[0] >= crit - 1e-6
        shares = got[["fixed_share", "random_share", "residual_share"]].iloc[0]
        assert abs(shares.sum() - 1) < 1e-9
        if got.singular.iloc[0]:
            assert shares.random_share == 0


def test_interaction_test_is_a_difference_of_criteria(spark):
    subject, age, sex, y = make(3, 1.0)
    rows = [("A", int(s), float(a), "M" if g else "F", float(v)) for s, a, g, v in zip(subject, age, sex, y)]
    df = spark.createDataFrame(rows, "assay string, subject long, age double, sex string, value double")
    out = mixed.compare_interaction(df).toPandas().set_index("term")
    assert out.loc["interaction", "df"] == 1
    gap = max(out.loc["main", "criterion"] - out.loc["interaction", "criterion"], 0)
    assert abs(out.loc["interaction", "statistic"] - gap) < 1e-9
    assert 0 <= out.loc["interaction", "p_value"] <= 1


def test_slopes_reach_the_dense_optimum(spark):
    from cohortia.operators import slopes

    rng = np.random.default_rng(8)
    subject = np.repeat(np.arange(40), 6)
    n = len(subject)
    age = rng.uniform(20, 60, n)
    sex = (subject % 2).astype(float)
    slope = rng.normal(size=40) * 0.04
    y = 1 + 0.02 * age + 0.3 * sex + rng.normal(size=40)[subject] + slope[subject] * (age - 40) + 0.7 * rng.normal(size=n)
    rows = [("A", int(s), float(a), "M" if g else "F", float(v)) for s, a, g, v in zip(subject, age, sex, y)]
    df = spark.createDataFrame(rows, "assay string, subject long, age double, sex string, value double")
    out = slopes.compare_slopes(df.repartition(2), chunk=15).toPandas().set_index("term")
    x = np.column_stack([np.ones(n), age, sex, age * sex])
    z = (age - age.mean()) / age.std(ddof=1)

    def crit(theta):
        low = np.zeros((2, 2))
        low[np.tril_indices(2)] = theta
        a, b, q, logs = np.zeros((4, 4)), np.zeros(4), 0.0, 0.0
        for s in range(40):
            at = subject == s
            zi = np.column_stack([np.ones(at.sum()), z[at]]) @ low
            v = np.eye(at.sum()) + zi @ zi.T
            vi = np.linalg.inv(v)
            a += x[at].T @ vi @ x[at]
            b += x[at].T @ vi @ y[at]
            q += y[at] @ vi @ y[at]
            logs += np.linalg.slogdet(v)[1]
        d = n - 4
        return logs + np.linalg.slogdet(a)[1] + d * (1 + np.log(2 * np.pi * (q - b @ np.linalg.solve(a, b)) / d))

    best = out.loc["age slope", "criterion"]
    found, width = np.array([1.2, 0.2, 0.6]), 0.5
    value = crit(found)
    for _ in range(200):
        if width < 1e-3:
            break
        tries = [found + width * s * e for e in np.eye(3) for s in (1, -1)]
        vals = [crit(t) for t in tries]
        if min(vals) < value:
            found, value = tries[int(np.argmin(vals))], min(vals)
        else:
            width /= 2
    assert abs(best - value) < 1e-4
    plain = min(crit([t, 0.0, 0.0]) for t in np.linspace(0.5, 3, 400))
    assert abs(out.loc["intercept", "criterion"] - plain) < 1e-3
    assert out.loc["age slope", "df"] == 2
    assert abs(out.loc["age slope", "statistic"] - (plain - value)) < 2e-3
    assert out.loc["age and sex slopes", "df"] == 3
    assert out.loc["age and sex slopes", "criterion"] <= best + 1e-4
