"""Stacked lasso fits against the conditions of the optimum, and what folds may learn from."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortia.operators import stacked as S


def data(n=90, p=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 2, (n, p))
    eta = (x[:, 0] - 3) - (x[:, 1] - 3)
    return rng, x, eta


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_paths_end_at_the_optimum(classes):
    rng, x, eta = data()
    y = eta + rng.normal(0, 0.5, len(x)) if not classes else np.digitize(eta + rng.logistic(0, 1, len(x)), [0] if classes == 2 else [-1, 1]).astype(float)
    w = (rng.random((4, len(x))) < 0.7).astype(float)
    z = np.stack([(x - x[m > 0].mean(axis=0)) / x[m > 0].std(axis=0) for m in w])
    penalties = [0.001, 0.01, 0.1, 10.0]
    b0, b, broken = S.paths(z, w, y, classes, penalties, 500, 0.005)
    assert (broken <= 0.006).all() and (b[3] == 0).all()
    for k, penalty in enumerate(penalties):
        for m in range(4):
            fit = z[m] @ b[k, m].T + b0[k, m]
            fit = S._chances(fit[None])[0] if classes else fit
            target = y[:, None] if classes < 3 else np.stack([y == c for c in range(3)], axis=1)
            slope = ((target - fit) * w[m][:, None]).T @ z[m] / w[m].sum()
            off = np.where(b[k, m] == 0, np.abs(slope) - penalty, np.abs(slope - penalty * np.sign(b[k, m])))
            assert off.max() <= 0.01 * penalty
            assert abs(((target - fit) * w[m][:, None]).sum(axis=0)).max() < 1e-2


def test_area_by_counting_pairs():
    rng = np.random.default_rng(1)
    score, event = rng.integers(0, 9, 60).astype(float), rng.random(60) < 0.4
    won = [(a > b) + 0.5 * (a == b) for a in score[event] for b in score[~event]]
    assert S.area(score, event) == pytest.approx(np.mean(won))
    assert np.isnan(S.area(score, np.ones(60, bool)))


def test_nothing_held_out_reaches_what_is_learnt():
    """Changing held-out rows changes no training row; a held-out gap is filled from training rows only."""
    rng, x, _ = data()
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5] = 1.0
    y = (rng.random(len(x)) < 0.3).astype(float)
    train = rng.random(len(x)) < 0.7
    recipe, order = S.Recipe(balance=True), rng.permutation(len(x))
    z, kept = recipe.bake(x, train, y, order, True)
    other = x.copy()
    other[~train] = rng.normal(50, 9, other[~train].shape)
    z2, kept2 = recipe.bake(other, train, y, order, True)
    assert np.allclose(z[train], z2[train]) and (kept == kept2).all()
    assert not np.isnan(z).any() and (z[:, 5] == 0).all() and not (kept & ~train).any()
    assert (kept & (y == 1)).sum() == (kept & (y == 0)).sum() == min((train & (y == 1)).sum(), (train & (y == 0)).sum())
    held = x.copy()
    i = np.flatnonzero(~train)[0]
    held[i] = x[np.flatnonzero(train)[0]]
    held[i, 2] = np.nan
    one, _ = recipe.bake(held, train, y, order, True)
    near = np.flatnonzero(train & ~np.isnan(x[:, 2]))
    low, high = np.nanmin(x[train], axis=0), np.nanmax(x[train], axis=0)
    s = (held - low) / np.where(high > low, high - low, 1)
    d = np.nanmean(np.abs(s[near] - s[i])[:, [j for j in range(12) if j != 5]], axis=1)
    best = near[np.lexsort((near, d))][:5]
    assert one[i, 2] == pytest.approx(one[best, 2].mean())


def test_tasks_of_all_kinds_in_one_job(spark):
    rng, x, eta = data(80, 8)
    points = spark.createDataFrame([(i, [None if rng.random() < 0.02 else float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    rows = []
    for task, classes, label in [("two", 2, (eta > 0).astype(float)), ("three", 3, np.digitize(eta, [-1, 1]).astype(float)), ("number", 0, eta)]:
        for seed in (1, 2, 11):
            fold = np.random.default_rng(seed).integers(-1, 4, 80)
            rows += [(task, classes, seed, i, float(label[i]), int(fold[i])) for i in range(80)]
    members = spark.createDataFrame(rows, "task string, classes int, seed int, id long, label double, fold int")
    got = S.fit_tasks(points, members, penalties=(0.001, 0.01, 0.1, 1.0))
    table = got.toPandas()
    assert len(table) == 9 and (table.broken <= S.TOLERANCE + 1e-9).all() and (table.n_train + table.n_test == 80).all()
    assert (table[table.task == "two"].merit > 0.9).all() and (table[table.task == "number"].merit > -0.6).all()
    assert S.predictions(got).count() == sum(1 for r in rows if r[5] == -1)
    used = members.withColumn("used", F.array(F.lit(0), F.lit(1))).filter("task = 'number'")
    few = S.fit_tasks(points, used, penalties=(0.01,)).toPandas()
    assert len(few) == 3 and all(len(e[0]) == 2 for e in few.estimates)
    assert pd.Series([r for r in few.merit]).min() > -0.6


def test_large_tasks_keep_their_rows_in_blocks(spark, monkeypatch):
    """Tasks beyond a group: same splits, penalties and models as fitted in a group, and no group holds a task."""
    rng, x, eta = data(700, 8)
    x[:, 5] = rng.random(700) < 0.01  # of near-zero variance
    x[:, 6] = rng.integers(0, 4, 700)  # few values, but varied
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    rows = []
    for task, classes, label in [("two", 2, (eta + rng.logistic(0, 1, 700) > 0).astype(float)), ("three", 3, np.digitize(eta + rng.logistic(0, 1, 700), [-1, 1]).astype(float)),
                                 ("number", 0, 1e3 + eta + rng.normal(0, 1, 700))]:
        for seed in (1, 2):
            fold = np.random.default_rng(seed).integers(-1, 4, 700)
            rows += [(task, classes, seed, i, float(label[i]), int(fold[i])) for i in range(700)]
    members = spark.createDataFrame(rows, "task string, classes int, seed int, id long, label double, fold int")
    penalties = (0.002, 0.02, 0.1, 1.0)
    group = S.fit_tasks(points, members, penalties=penalties).toPandas().sort_values(["task", "seed"], ignore_index=True)
    monkeypatch.setattr(S, "SPREAD_BYTES", 1 << 10)
    monkeypatch.setattr(S, "GROUP_BYTES", 1 << 11)
    got = S.fit_tasks(points, members, penalties=penalties)
    wide = got.toPandas().sort_values(["task", "seed"], ignore_index=True)
    assert (wide[["task", "seed", "n_train", "n_test"]] == group[["task", "seed", "n_train", "n_test"]]).all().all()
    assert (wide.broken <= S.TOLERANCE + 1e-9).all()
    for a, b in zip(wide.itertuples(), group.itertuples(), strict=True):
        assert np.allclose(a.cv, b.cv, atol=2e-3), a.task
        if a.penalty == b.penalty:
            e, f = (np.array([list(r) for r in m.estimates]) for m in (a, b))
            level = [np.array(m.intercept) - (np.mean(m.intercept) if a.task == "three" else 0) for m in (a, b)]  # chances tell intercepts up to a shift
            assert np.allclose(e, f, atol=0.02) and np.allclose(*level, atol=0.02)
            assert (e[:, 5] == 0).all()
            assert np.allclose([list(t["fit"]) for t in a.test], [list(t["fit"]) for t in sorted(b.test, key=lambda t: t["id"])], atol=0.02)
    assert (wide.penalty == group.penalty).sum() >= 5
    assert S.predictions(got).count() == sum(1 for r in rows if r[5] == -1)
    few = S.fit_tasks(points, members.withColumn("used", F.array(F.lit(0), F.lit(5), F.lit(1))).filter("task = 'two'"), penalties=(0.01,)).toPandas()
    assert len(few) == 2 and all(len(e[0]) == 3 and e[0][1] == 0 for e in few.estimates)
