"""Many tuned lasso models as one Spark job: tasks, seeds, folds and penalties are data.

``members`` says which sample takes part in which (task, seed), with its label and its fold (-1: held out for testing);
``points`` has each sample's values once. Samples meet their tasks in groups of (task, some seeds), so a sample's values are
shipped once for `SEEDS` seeds. A group fits all its folds and penalties side by side: coordinate descent by covariance updates
on stacked Gram matrices, along the penalty path from strong to weak with warm starts; for classes inside reweighted steps.

Everything a recipe learns is learnt from the rows a fold trains on: centre and scale, variance filter, the candidates and ranges
of neighbour filling, and the rows that balance classes. Held-out rows only pass through it.

A group holds one task's samples times its assays. A task of more than `SPREAD_BYTES` keeps its rows in blocks over all workers
instead (`spread`). Gaps and balanced classes need a task's rows side by side: such a task is fitted in a group up to
`GROUP_BYTES`, and beyond is one for `learn.fit_lasso`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.operators.learn import PENALTIES
from cohortia.operators.neighbours import _best_holding

SEEDS = 2
GROUP_BYTES = 512 << 20
SPREAD_BYTES = 4 << 20
#: Bytes of Gram matrices that are worked on side by side.
STACK_BYTES = 64 << 20
#: Largest break of the optimum's conditions, as a share of the penalty, at which a fit ends: of the model that is kept, and of
#: those that only rate penalties, which take `STEPS` reweighted steps at most.
TOLERANCE, RATING = 0.005, 0.02
STEPS = 12
#: Sweeps over the coefficients before the weights of a class are worked out anew.
INNER = 6
#: Share of the deviance at which a path ends.
EXPLAINED = 0.99
#: Share of the deviance that a next penalty must explain for the path to go on.
GAIN = 1e-4


@dataclass(frozen=True)
class Recipe:
    """What is learnt from the training rows of a fold."""

    freq_cut: float = 95 / 5
    unique_cut: float = 10.0
    neighbours: int = 5
    balance: bool = False

    def varied(self, x: np.ndarray) -> np.ndarray:
        """Assays that are not of near-zero variance."""
        out = np.zeros(x.shape[1], bool)
        for j in range(x.shape[1]):
            values, n = np.unique(x[~np.isnan(x[:, j]), j], return_counts=True)
            n = np.sort(n)[::-1]
            out[j] = len(n) > 1 and not (n[0] / n[1] > self.freq_cut and 100 * len(n) <= self.unique_cut * n.sum())
        return out

    def bake(self, x: np.ndarray, train: np.ndarray, y: np.ndarray, order: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
        """(values of all rows as the training rows ask for, training rows that stay)."""
        own = x[train]
        keep = self.varied(own)
        centre, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
        centre[keep], scale[keep] = np.nanmean(own[:, keep], axis=0), np.nanstd(own[:, keep], axis=0, ddof=1)
        z = np.where(keep, (x - centre) / np.where(scale > 0, scale, 1), 0.0)
        gaps = np.flatnonzero(np.isnan(z).any(axis=1))
        if len(gaps):
            low, high = np.nanmin(own[:, keep], axis=0), np.nanmax(own[:, keep], axis=0)
            s = (x[:, keep] - low) / np.where(high > low, high - low, 1)
            row, entry, other, _ = _best_holding(s[gaps], gaps, s[train], np.flatnonzero(train), self.neighbours)
            at = np.flatnonzero(keep)[entry]
            near = z[np.flatnonzero(train)[other], at]
            fill = pd.DataFrame({"row": gaps[row], "at": at, "near": near}).groupby(["row", "at"])["near"].mean()
            z[fill.index.get_level_values(0), fill.index.get_level_values(1)] = fill.to_numpy()
            z = np.nan_to_num(z)  # no training row holds it: the training mean
        if classes and self.balance:
            least = min((train & (y == c)).sum() for c in np.unique(y[train]))
            picked = np.zeros(len(y), bool)
            for c in np.unique(y[train]):
                rows = np.flatnonzero(train & (y == c))
                picked[rows[np.argsort(order[rows], kind="stable")[:least]]] = True
            train = picked
        return z, train


def descend(gram: np.ndarray, cross: np.ndarray, b: np.ndarray, penalty: float, sweeps: int = 200) -> np.ndarray:
    """Stacked lasso by coordinate descent: min b'Gb/2 - c'b + penalty |b|, all problems a step at a time."""
    b = b.copy()
    pull = np.einsum("bij,bj->bi", gram, b)
    diagonal = np.einsum("bjj->bj", gram)
    size = np.maximum(diagonal, 1e-12)
    every = np.arange(b.shape[1])
    active, full = every, True
    for _ in range(sweeps):
        most = 0.0
        for j in active:
            want = cross[:, j] - pull[:, j] + diagonal[:, j] * b[:, j]
            new = np.sign(want) * np.maximum(np.abs(want) - penalty, 0) / size[:, j]
            move = np.where(diagonal[:, j] > 1e-12, new - b[:, j], 0.0)
            if move.any():
                pull += move[:, None] * gram[:, j]
                b[:, j] += move
                most = max(most, float((np.abs(move) * np.sqrt(size[:, j])).max()))
        if most < 1e-3 * penalty:
            if full:
                break
            active, full = every, True
        else:
            active, full = np.flatnonzero((b != 0).any(axis=0)), False
    return b


def _chances(eta: np.ndarray) -> np.ndarray:
    if eta.shape[2] == 1:
        return 1 / (1 + np.exp(-np.clip(eta, -40, 40)))
    e = np.exp(eta - eta.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def _breaks(slope: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """How far each coefficient is from the conditions of the optimum, ``slope`` being the mean gradient of the likelihood."""
    return np.where(b == 0, np.maximum(np.abs(slope) - penalty, 0), np.abs(slope - penalty * np.sign(b)))


def paths(z: np.ndarray, w: np.ndarray, y: np.ndarray, classes: int, penalties: Sequence[float], steps: int = STEPS, tolerance: float = RATING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intercepts, coefficients, worst break of the optimum as a share of the penalty) by (penalty, problem, class).

    ``z`` (problem, row, assay), ``w`` 1 for rows a problem trains on, ``classes`` 0 for a number. A path ends where in all
    problems more than `EXPLAINED` of the deviance is explained or the last penalty gained less than `GAIN`; weaker ones then have its last model.
    """
    problems, _, p = z.shape
    n = w.sum(axis=1)
    c = max(1, classes if classes > 2 else 1)
    target = np.stack([y == k for k in range(classes)], axis=1).astype(float) if classes > 2 else y[:, None].astype(float)
    mean = np.einsum("bn,nc->bc", w, target) / n[:, None]
    b0 = mean.copy() if not classes else (np.log(mean / (1 - mean)) if c == 1 else np.log(np.maximum(mean, 1e-12)))
    b = np.zeros((problems, c, p))
    order = np.argsort(penalties)[::-1]
    out0, out, worst = np.zeros((len(penalties), problems, c)), np.zeros((len(penalties), problems, c, p)), np.zeros((len(penalties), problems))

    def at(b0: np.ndarray, b: np.ndarray) -> np.ndarray:
        eta = np.matmul(z, b.transpose(0, 2, 1)) + b0[:, None]
        return _chances(eta) if classes else eta

    def deviance(fit: np.ndarray) -> np.ndarray:
        if not classes:
            return np.einsum("bn,bnc->b", w, (target[None] - fit) ** 2)
        hit = np.where(target[None] > 0, fit, 1 - fit) if c == 1 else np.where(target[None] > 0, fit, 1.0)
        return -2 * np.einsum("bn,bnc->b", w, np.log(np.maximum(hit, 1e-300)))

    none = np.maximum(deviance(at(b0, b)), 1e-300)
    if not classes:
        shift = np.einsum("bn,bnp->bp", w, z) / n[:, None]
        level = z - shift[:, None]
        gram = np.matmul((level * w[:, :, None]).transpose(0, 2, 1), level) / n[:, None, None]
        cross = np.einsum("bnp,bn->bp", level * w[:, :, None], target[None, :, 0] - mean) / n[:, None]
    ended, told = False, np.zeros(problems)
    for k in order:
        penalty = float(penalties[k])
        if not ended and not classes:
            b = descend(gram, cross, b[:, 0], penalty)[:, None]
            b0 = mean - np.einsum("bp,bcp->bc", shift, b)
        for _ in range(0 if ended or not classes else steps):
            fit = at(b0, b)
            for k_class in range(c):
                if k_class:
                    fit = at(b0, b)
                share = fit[:, :, k_class]
                v = np.maximum(share * (1 - share), 1e-5) * w
                sums = v.sum(axis=1)
                shift = np.einsum("bn,bnp->bp", v, z) / sums[:, None]
                level = z - shift[:, None]
                gram = np.matmul((level * v[:, :, None]).transpose(0, 2, 1), level) / n[:, None, None]
                miss = (target[None, :, k_class] - share) * w
                cross = np.einsum("bpq,bq->bp", gram, b[:, k_class]) + np.einsum("bnp,bn->bp", level, miss) / n[:, None]
                new = descend(gram, cross, b[:, k_class], penalty, INNER if tolerance >= RATING else 10 * INNER)
                move = new - b[:, k_class]
                b[:, k_class] = new
                b0[:, k_class] += miss.sum(axis=1) / sums - np.einsum("bp,bp->b", shift, move)
            slope = np.matmul(((target[None] - at(b0, b)) * w[:, :, None]).transpose(0, 2, 1), z) / n[:, None, None]
            if _breaks(slope, b, penalty).max() <= tolerance * penalty:
                break
        fit = at(b0, b)
        slope = np.matmul(((target[None] - fit) * w[:, :, None]).transpose(0, 2, 1), z) / n[:, None, None]
        out0[k], out[k], worst[k] = b0, b, _breaks(slope, b, penalty).max(axis=(1, 2)) / penalty
        told, before = 1 - deviance(fit) / none, told
        ended = ended or bool(((told > EXPLAINED) | ((told - before < GAIN) & (told > 0.01))).all())
    return out0, out, worst


def area(score: np.ndarray, event: np.ndarray) -> float:
    """Area under the curve, ties counting half; NaN without both kinds."""
    if event.all() or not event.any():
        return float("nan")
    _, back, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[back]
    m = event.sum()
    return float((rank[event].sum() - m * (m + 1) / 2) / (m * (len(event) - m)))


def merit(fit: np.ndarray, y: np.ndarray, classes: int) -> float:
    """What a penalty is chosen by, larger is better: area (mean over pairs of classes), or the negative root mean squared error."""
    if not classes:
        return -float(np.sqrt(((fit[:, 0] - y) ** 2).mean())) if len(y) else float("nan")
    if classes == 2:
        return area(fit[:, 0], y == 1)
    pairs = [(area(fit[of, i], y[of] == i) + area(fit[of, j], y[of] == j)) / 2 for i in range(classes) for j in range(i) for of in [(y == i) | (y == j)]]
    return float(np.nanmean(pairs)) if not np.isnan(pairs).all() else float("nan")


RESULT = ("task string, seed int, n_train long, n_test long, penalty double, merit double, cv array<double>, broken double, intercept array<double>, "
          "estimates array<array<double>>, test array<struct<id:long,label:double,fit:array<double>>>")


def fit_tasks(points: DataFrame, members: DataFrame, penalties: Sequence[float] = PENALTIES, recipe: Recipe = Recipe()) -> DataFrame:
    """One tuned model for every (task, seed); columns as in `RESULT`.

    ``points``: id long, x array<double> (NULL entries are gaps). ``members``: task, classes (0: a number, 2, 3, ..), seed, id, label
    (0 .. classes - 1), fold (0 .. v - 1, or -1 for a test row), and ``used`` (places in ``x``) for a task of some assays only. ``cv`` is the mean merit over folds of each penalty; the
    best one is taken, the strongest of equals. ``broken`` is the largest break of the optimum's conditions as a share of the penalty.
    ``fit`` holds the chance of class 1, of each class, or the number.
    """
    from cohortia.operators import spread

    width = points.agg(F.max(F.size("x"))).first()[0] or 0
    sizes = members.groupBy("task", "seed").agg(F.count(F.lit(1)).alias("n"), F.max("classes").alias("c")).groupBy("task").agg(F.max("n").alias("n"), F.max("c").alias("c")).collect()
    large = [r["task"] for r in sizes if r["n"] * width * 8 > SPREAD_BYTES and (max(1, r["c"]) * (width + 1)) ** 2 * 8 <= spread.CURVATURE_BYTES]
    if large and not recipe.balance and not points.filter(F.exists("x", lambda v: v.isNull() | F.isnan(v))).limit(1).count():
        whole = spread.fit(points, members.filter(F.col("task").isin(large)), penalties, recipe)
        if len(large) == len(sizes):
            return whole
        return whole.unionByName(fit_tasks(points, members.filter(~F.col("task").isin(large)), penalties, recipe))
    rows = max((r["n"] for r in sizes), default=0)
    if rows * width * 8 > GROUP_BYTES:
        raise ValueError(f"a task of {rows} samples and {width} assays is beyond a group; fit it with learn.fit_lasso")
    values = list(penalties)
    told = members.withColumn("chunk", F.floor(F.col("seed") / SEEDS).cast("int"))
    held = (told.select(F.col("task").alias("of"), F.col("chunk").alias("part"), F.col("id").alias("own")).distinct()
            .join(points.select(F.col("id").alias("own"), "x"), "own"))

    def run(who: pd.DataFrame, what: pd.DataFrame) -> pd.DataFrame:
        what = what.sort_values("own", ignore_index=True)
        ids = what["own"].to_numpy()
        x = np.array([np.array(v, float) for v in what["x"]])
        if "used" in who:
            x = x[:, np.array(who["used"].iloc[0], int)]
        classes = int(who["classes"].iloc[0])
        jobs, orders = [], {}
        for seed, part in who.groupby("seed"):
            y, fold = np.full(len(ids), np.nan), np.full(len(ids), -2)
            at = np.searchsorted(ids, part["id"].to_numpy())
            y[at], fold[at] = part["label"].to_numpy(float), part["fold"].to_numpy()
            order = np.random.Generator(np.random.PCG64(int(seed))).permutation(len(ids))
            orders[seed] = order
            jobs += [(seed, y, fold, k, order) for k in [*np.unique(fold[fold >= 0]), -1]]
        done: dict[int, dict[int, tuple]] = {}
        step = max(1, STACK_BYTES // (8 * x.shape[1] * max(x.shape)))
        for i in range(0, len(jobs), step):
            some = jobs[i:i + step]
            baked = [recipe.bake(x, (fold >= 0) & (fold != k), y, order, classes > 0) for _, y, fold, k, order in some]
            for same in _alike([job[1] for job in some]):
                y = np.nan_to_num(some[same[0]][1])
                z, w = np.stack([baked[s][0] for s in same]), np.stack([baked[s][1] for s in same]).astype(float)
                b0, b, broken = paths(z, w, y, classes, values)
                for m, s in enumerate(same):
                    seed, _, fold, k, _ = some[s]
                    hold = fold == k
                    eta = np.einsum("np,lcp->lnc", z[m][hold], b[:, m]) + b0[:, m][:, None]
                    fits = _chances(eta) if classes else eta
                    done.setdefault(seed, {})[k] = (fold, y, hold, fits, b0[:, m], b[:, m], broken[:, m])
        out = []
        for seed, folds in done.items():
            fold, y, hold, fits, b0, b, broken = folds[-1]
            cv = np.array([np.nanmean([merit(f[3][q], f[1][f[2]], classes) for k, f in folds.items() if k >= 0] or [np.nan]) for q in range(len(values))])
            rated = np.where(np.isnan(cv), -np.inf, cv)
            best = max(range(len(values)), key=lambda q: (rated[q], values[q]))
            if broken[best] > TOLERANCE:  # the model that is kept is fitted to the end
                z, w = recipe.bake(x, fold >= 0, y, orders[seed], classes > 0)
                upto = [v for v in values if v >= values[best]]
                end0, end, worst = (a[upto.index(values[best])][0] for a in paths(z[None], w[None].astype(float), y, classes, upto, 1000, TOLERANCE))
                b0[best], b[best], broken[best] = end0, end, worst
                eta = z[hold] @ end.T + end0
                fits[best] = _chances(eta[None])[0] if classes else eta
            test = [{"id": int(i), "label": float(v), "fit": f.tolist()} for i, v, f in zip(ids[hold], y[hold], fits[best], strict=True)]
            out.append((str(who["task"].iloc[0]), int(seed), int((fold >= 0).sum()), len(test), values[best], float(cv[best]), cv.tolist(), float(broken[best]),
                        b0[best].tolist(), [r.tolist() for r in b[best]], test))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _names(RESULT)])

    # a group costs far more than its bytes, so its number of partitions is named and not put together by size
    groups = 2 * max(1, told.select("task", "chunk").distinct().count())
    return (told.repartition(groups, "task", "chunk").groupBy("task", "chunk")
            .cogroup(held.repartition(groups, "of", "part").groupBy("of", "part")).applyInPandas(run, RESULT))


def _names(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, s in enumerate(schema + ","):
        depth += (s == "<") - (s == ">")
        if s == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def _alike(labels: list[np.ndarray]) -> list[list[int]]:
    """Places of equal label vectors: seeds of a task share their labels, so their problems are stacked."""
    groups: dict[bytes, list[int]] = {}
    for i, y in enumerate(labels):
        groups.setdefault(np.nan_to_num(y, nan=-9e9).tobytes(), []).append(i)
    return list(groups.values())


def predictions(models: DataFrame) -> DataFrame:
    """(task, seed, id, label, fit) of every test row."""
    return models.select("task", "seed", F.explode("test").alias("t")).select("task", "seed", "t.id", "t.label", "t.fit")


def coefficients(models: DataFrame, assays: DataFrame, task: str | None = None) -> DataFrame:
    """(task, seed, label index, assay, estimate): ``assays`` holds (row, assay), row being the place in ``x``."""
    some = models if task is None else models.filter(F.col("task") == task)
    each = some.select("task", "seed", F.posexplode("estimates").alias("label", "b")).select("task", "seed", "label", F.posexplode("b").alias("row", "estimate"))
    return each.join(assays, "row").drop("row")
