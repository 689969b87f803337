"""Tuned lasso models of large tasks: rows stay in blocks, sums over them meet by (task, seed).

`stacked.fit_tasks` sends tasks here whose rows are too many for one group. Every row is packed once into a block with its
(task, seed, label, fold) entries. A pass over the blocks works out, for all folds of all (task, seed) side by side, the gradient
at the current coefficients, the deviance, and the curvature at the model of all training rows; a step then goes to the minimum of
the quadratic model by `stacked.descend`, or halfway back where the objective rose. Gradients are each fold's own, so a path's
models meet the conditions of the optimum whatever curvature they were found by. Numbers need one pass: cross-products by fold.

What meets the driver are models and sums, whose size depends on tasks, seeds, folds, penalties and assays, never on rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators import stacked as ST
from cohortia.session import cut

#: Bytes of values in a block, and the curvature of one (task, seed).
BLOCK_BYTES = 4 << 20
CURVATURE_BYTES = 64 << 20
#: Most frequent values of an assay that are counted in each fold, to tell assays of near-zero variance.
FREQUENT = 9
#: Passes for one penalty, and sweeps of one step.
PASSES = 40
SWEEPS = 60


def _row(blob: pa.Table, name: str = "blob") -> list:
    return [pickle.loads(b) for b in blob.column(name).to_pylist()]


def pack(points: DataFrame, members: DataFrame, units: DataFrame) -> DataFrame:
    """Blocks of rows: values, ids, and (unit, row, label, fold) entries in order of the unit."""
    told = (members.join(F.broadcast(units), ["task", "seed"]).groupBy("id")
            .agg(F.collect_list(F.struct("unit", F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"))).alias("e")))
    rows = points.select("id", F.col("x").cast("array<double>").alias("x")).join(told, "id")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = max(1, len(batch.column("x")[0])) if len(batch) else 1
            size = max(1, BLOCK_BYTES // (8 * width))
            for i in range(0, len(batch), size):
                part = batch.slice(i, size)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
                e, each = part.column("e").flatten(), np.diff(part.column("e").offsets.to_numpy())
                unit, label, fold = (e.field(c).to_numpy(zero_copy_only=False) for c in ("unit", "label", "fold"))
                order = np.argsort(unit, kind="stable")
                held = (x, part.column("id").to_numpy(), unit[order], np.repeat(np.arange(len(part)), each)[order], label[order], fold[order])
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held, protocol=5)], pa.binary())], names=["blob"])

    parts = 2 * points.sparkSession.sparkContext.defaultParallelism
    return cut(rows.repartition(parts, "id").mapInArrow(block, "blob binary"))


def _entries(held: tuple) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(unit, values, ids, labels, folds) of each unit in a block."""
    x, ids, unit, row, label, fold = held
    edges = np.flatnonzero(np.diff(unit)) + 1
    for i, j in zip([0, *edges], [*edges, len(unit)], strict=True):
        if j > i:
            yield int(unit[i]), x[row[i:j]], ids[row[i:j]], label[i:j], fold[i:j]


def summed(blocks: DataFrame, known: dict, add: Callable, done: Callable, partitions: int) -> dict:
    """``done(of, sums)`` of every unit in ``known``, sums being the total of ``add(of, x, label, fold)`` over its rows."""
    held = blocks.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for block in _row(batch):
                for unit, x, _, label, fold in _entries(block):
                    if unit in held.value:
                        sums = add(held.value[unit], x, label, fold)
                        total[unit] = sums if unit not in total else [a + b for a, b in zip(total[unit], sums, strict=True)]
        for unit, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([pickle.dumps(sums, protocol=5)], pa.binary())], names=["unit", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        total = None
        for b in table.column("blob"):
            sums = pickle.loads(b.as_py())
            total = sums if total is None else [a + c for a, c in zip(total, sums, strict=True)]
        return pa.table({"unit": pa.array([unit], pa.int32()), "blob": pa.array([pickle.dumps(done(held.value[unit], total), protocol=5)], pa.binary())})

    # a step costs far more than its bytes, so its number of partitions is named
    found = (blocks.mapInArrow(run, "unit int, blob binary").repartition(max(1, min(len(known), partitions)), "unit")
             .groupBy("unit").applyInArrow(meet, "unit int, blob binary").toArrow())
    held.unpersist()
    return dict(zip(found.column("unit").to_pylist(), _row(found), strict=True))


def frequent(points: DataFrame) -> dict[int, tuple[np.ndarray, int, int, int]]:
    """By assay: its `FREQUENT` most frequent values, rows of the first, rows of the next one beyond them, distinct values."""
    each = points.select(F.posexplode("x").alias("pos", "v")).groupBy("pos", "v").agg(F.count(F.lit(1)).alias("n"))
    most = (each.groupBy("pos").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("distinct")))
    top = {r["pos"]: r for r in most.collect()}
    many = [p for p, r in top.items() if r["most"] > ST.Recipe.freq_cut]
    out = {p: (np.zeros(0), r["most"], r["most"], r["distinct"]) for p, r in top.items()}
    if many:
        # the best of all are among the best of the values' hash groups, so no window sees a whole assay
        w = Window.partitionBy("pos", F.pmod(F.xxhash64("v"), F.lit(64))).orderBy(F.desc("n"), "v")
        some = each.filter(F.col("pos").isin(many)).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= FREQUENT + 1)
        last = Window.partitionBy("pos").orderBy(F.desc("n"), "v")
        rows = some.withColumn("k", F.row_number().over(last)).filter(F.col("k") <= FREQUENT + 1).select("pos", "v", "n", "k").orderBy("pos", "k").collect()
        for p in many:
            own = [r for r in rows if r["pos"] == p]
            out[p] = (np.array([r["v"] for r in own[:FREQUENT]]), own[0]["n"], own[FREQUENT]["n"] if len(own) > FREQUENT else 0, top[p]["distinct"])
    return out


def varied(recipe: ST.Recipe, counts: np.ndarray, rest: int, distinct: int, rows: int) -> bool | None:
    """Whether an assay is not of near-zero variance in ``rows`` rows, of which ``counts`` hold its most frequent values overall;
    any other value has at most ``rest`` rows. None: the bounds do not tell."""
    if rest <= recipe.freq_cut < rows and not len(counts):
        return True  # no value has more rows than the ratio allows
    first, second = (np.sort(np.append(counts, [0, 0]))[::-1][:2])
    if second and max(first, rest) <= recipe.freq_cut * second:
        return True
    others = max(second, rest)
    if first == rows:
        return False
    if others and first > recipe.freq_cut * others and 100 * distinct <= recipe.unique_cut * rows:
        return False
    return None


def fit(points: DataFrame, members: DataFrame, penalties: Sequence[float], recipe: ST.Recipe) -> DataFrame:
    """As `stacked.fit_tasks`, for tasks of any number of rows, without gaps and balance."""
    spark = points.sparkSession
    keys = ["task", "classes", "seed", *(["used"] if "used" in members.columns else [])]
    listed = members.groupBy("task", "seed").agg(*[F.first(k).alias(k) for k in keys if k not in ("task", "seed")], F.max("fold").alias("last"), F.avg("label").alias("level")).orderBy("task", "seed").collect()
    units = spark.createDataFrame([(r["task"], r["seed"], i) for i, r in enumerate(listed)], "task string, seed int, unit int")
    blocks = pack(points, members, units)
    partitions = 2 * spark.sparkContext.defaultParallelism
    width = points.agg(F.max(F.size("x"))).first()[0]
    shift = np.array([r[1] for r in points.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v")).orderBy("pos").collect()])
    common = frequent(points)

    state = {}
    for i, r in enumerate(listed):
        used = np.array(r["used"], int) if "used" in keys and r["used"] is not None else np.arange(width)
        state[i] = {"used": used, "shift": shift[used], "classes": int(r["classes"]), "folds": int(r["last"]) + 1, "level": r["level"],
                    "common": [common[int(u)] for u in used]}

    def moments(of: dict, x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> list:
        x = x[:, of["used"]]
        train = fold >= 0
        hit = np.arange(of["folds"])[:, None] == fold[None, :]
        dev = x - of["shift"]
        kinds = max(2, of["classes"])
        seen = [hit.astype(float) @ (x[:, j, None] == c[0][None, :]).astype(float) if len(c[0]) else np.zeros((of["folds"], 0)) for j, c in enumerate(of["common"])]
        out = [hit.sum(axis=1), hit.astype(float) @ dev, hit.astype(float) @ dev ** 2, np.array([(~train).sum()]), *seen]
        if of["classes"]:
            return [*out, hit.astype(float) @ (label[:, None] == np.arange(kinds)).astype(float)]
        wide = np.column_stack([np.ones(len(x)), dev, label - of["level"]])
        return [*out, np.stack([wide[h].T @ wide[h] for h in hit])]

    def start(of: dict, sums: list) -> dict:
        n, one, two, tested = sums[0], sums[1], sums[2], int(sums[3][0])
        seen, last = sums[4:-1], sums[-1]
        held_out = [k for k in range(of["folds"]) if n[k]] + [-1]
        less = lambda s: np.stack([s.sum(axis=0) - (s[k] if k >= 0 else 0) for k in held_out])
        rows, centre = less(n).astype(float), less(one)
        centre = centre / rows[:, None]
        scale = np.sqrt(np.maximum(less(two) - rows[:, None] * centre ** 2, 0) / np.maximum(rows - 1, 1)[:, None])
        own = [less(s) for s in seen]
        told = [[varied(recipe, own[j][m], c[2], c[3], int(rows[m])) for j, c in enumerate(of["common"])] for m in range(len(held_out))]
        return {**of, "problems": held_out, "n": rows, "n_test": tested, "centre": centre, "scale": np.where(scale > 0, scale, 1), "told": told, "last": less(last)}

    state = summed(blocks, state, moments, start, partitions)
    open_ = [(u, j) for u, of in state.items() for j in range(len(of["used"])) if any(t[j] is None for t in of["told"])]
    exact = counted(points, members, units, state, open_, recipe) if open_ else {}
    for u, of in state.items():
        of["keep"] = np.array([[exact[u, int(of["used"][j]), k] if t is None else t for j, t in enumerate(row)] for row, k in zip(of["told"], of["problems"], strict=True)], bool)
        del of["told"], of["common"]

    order = [int(k) for k in np.argsort(penalties)[::-1]]
    models: dict[int, list] = {}
    waiting = {}
    for u, of in state.items():
        c, p = (of["classes"] if of["classes"] > 2 else 1), len(of["used"])
        of["beta"] = np.zeros((len(of["problems"]), c, p))
        if not of["classes"]:
            models[u] = numbers(of, [penalties[k] for k in order])
            continue
        share = of["last"] / of["n"][:, None]
        of["b0"] = np.log(np.maximum(share, 1e-12)) if c > 1 else np.log(np.maximum(share[:, 1:], 1e-12) / np.maximum(share[:, :1], 1e-12))
        of["none"] = -2 * (of["last"] * np.log(np.maximum(share, 1e-300))).sum(axis=1)
        of.update(at=0, tried=0, told=np.zeros(len(of["n"])), before=None, path=[float(penalties[k]) for k in order])
        models[u], waiting[u] = [], of
    while waiting:
        waiting = summed(blocks, waiting, slopes, step, partitions)
        for u, of in list(waiting.items()):
            models[u] += of.pop("ended")
            state[u] = of
            if of["at"] >= len(order):
                del waiting[u]

    return told_models(blocks, listed, keys, state, models, [float(penalties[k]) for k in order], list(penalties), partitions, members)


def counted(points: DataFrame, members: DataFrame, units: DataFrame, state: dict, pairs: list, recipe: ST.Recipe) -> dict:
    """Near-zero variance by counting all values, for the (unit, assay) pairs that bounds leave open."""
    spark = points.sparkSession
    asked = spark.createDataFrame([(u, int(state[u]["used"][j]), int(k)) for u, j in pairs for k in state[u]["problems"]], "unit int, pos int, of int")
    rows = members.filter("fold >= 0").join(F.broadcast(units), ["task", "seed"]).select("unit", "id", "fold")
    values = points.select("id", F.posexplode("x").alias("pos", "v"))
    by_fold = cut(rows.join(F.broadcast(asked.select("unit", "pos").distinct()), "unit").join(values, ["id", "pos"])
                  .groupBy("unit", "pos", "v", "fold").agg(F.count(F.lit(1)).alias("n")))
    each = (by_fold.join(F.broadcast(asked), ["unit", "pos"]).filter(F.col("fold") != F.col("of"))
            .groupBy("unit", "pos", "of", "v").agg(F.sum("n").alias("n")))
    w = ["unit", "pos", "of"]
    # the most frequent value and the next: the largest, and the largest of the rest or the same again
    most = each.groupBy(*w).agg(F.max_by("v", F.struct("n", "v")).alias("first"), F.max("n").alias("n0"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"))
    after = each.join(most.select(*w, "first"), w).filter("v <> first").groupBy(*w).agg(F.max("n").alias("n1"))
    return {(r["unit"], r["pos"], r["of"]): r["n1"] is not None and not (r["n0"] / r["n1"] > recipe.freq_cut and 100 * r["distinct"] <= recipe.unique_cut * r["rows"])
            for r in most.join(after, w, "left").collect()}


def _plain(of: dict, b0: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """(problem, class, 1 + assay): intercept and coefficients for values less the shift."""
    b = np.where(of["keep"], 1 / of["scale"], 0)[:, None] * beta
    return np.concatenate([(b0 - (b * of["centre"][:, None]).sum(axis=2))[..., None], b], axis=2)


def _wide(of: dict, x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, of["used"]] - of["shift"]])


def slopes(of: dict, x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> list:
    """Sums of the gradient by problem, curvature by pair of classes at the model of all rows, and deviance by problem."""
    train = fold >= 0
    x, label, fold = _wide(of, x[train]), label[train], fold[train]
    plain = _plain(of, of["b0"], of["beta"])
    problems, c, _ = plain.shape
    fits = ST._chances((x @ plain.reshape(problems * c, -1).T).reshape(len(x), problems, c).transpose(1, 0, 2))
    target = (label[:, None] == (np.arange(c) if c > 1 else np.ones(1))).astype(float)
    mask = np.array(of["problems"])[:, None] != fold[None, :]
    miss = (target[None] - fits) * mask[:, :, None]
    gradient = (x.T @ miss.transpose(1, 0, 2).reshape(len(x), -1)).T.reshape(problems, c, -1)
    hit = np.where(target[None] > 0, fits, 1 - fits) if c == 1 else np.where(target[None] > 0, fits, 1.0)
    deviance = -2 * (np.log(np.maximum(hit, 1e-300)).sum(axis=2) * mask).sum(axis=1)
    whole = fits[-1]
    curve = np.zeros((c, c, x.shape[1], x.shape[1]))
    for i in range(c):
        for j in range(i + 1):
            v = whole[:, i] * ((i == j) - whole[:, j])
            curve[i, j] = x.T @ (x * (np.maximum(v, 1e-5) if i == j else v)[:, None])
            curve[j, i] = curve[i, j]
    return [gradient, curve, deviance]


def step(of: dict, sums: list) -> dict:
    """The unit after one pass: models whose penalty is done under ``ended``, and the next coefficients."""
    gradient, curve, deviance = sums
    n, keep, centre, scale = of["n"], of["keep"], of["centre"], of["scale"]
    problems, c, p = of["beta"].shape
    free = gradient[:, :, 0] / n[:, None]
    slope = np.where(keep[:, None], (gradient[:, :, 1:] - centre[:, None] * gradient[:, :, :1]) / scale[:, None], 0) / n[:, None, None]
    size = np.abs(of["beta"]).sum(axis=(1, 2))
    ended = []
    while of["at"] < len(of["path"]):
        penalty = of["path"][of["at"]]
        off = np.maximum(ST._breaks(slope, of["beta"], penalty).max(axis=(1, 2)), np.abs(free).max(axis=1)) / penalty
        if off.max() > ST.TOLERANCE and of["tried"] < PASSES:
            break
        told = 1 - deviance / np.maximum(of["none"], 1e-300)
        gain = told - of["told"]
        ended.append((of["b0"].copy(), of["beta"].copy(), off))
        last = bool(((told > ST.EXPLAINED) | ((gain < ST.GAIN) & (told > 0.01))).all())
        of = {**of, "at": len(of["path"]) if last else of["at"] + 1, "tried": 0, "told": told, "before": None}
    if of["at"] >= len(of["path"]):
        return {**of, "ended": ended}
    objective = deviance / (2 * n) + penalty * size
    b0, beta = of["b0"].copy(), of["beta"].copy()
    before = of["before"]
    back = np.zeros(problems, bool)
    if before is not None:
        back = objective > before[2] + 1e-10 * np.abs(before[2])
    new0, new = _newton(of, curve, free, slope, penalty)
    go = (off > ST.TOLERANCE / 2) & ~back
    b0[go], beta[go] = new0[go], new[go]
    if back.any():
        b0[back], beta[back] = (b0[back] + before[0][back]) / 2, (beta[back] + before[1][back]) / 2
    was = (of["b0"], of["beta"], objective) if before is None else tuple(np.where(back.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in zip(before, (of["b0"], of["beta"], objective), strict=True))
    return {**of, "b0": b0, "beta": beta, "before": was, "tried": of["tried"] + 1, "ended": ended}


def _newton(of: dict, curve: np.ndarray, free: np.ndarray, slope: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of the penalised quadratic model; intercepts are eliminated, the curvature is that of all training rows."""
    problems, c, p = of["beta"].shape
    turn = np.zeros((problems, p + 1, p + 1))
    turn[:, 0, 0] = 1
    inverse = np.where(of["keep"], 1 / of["scale"], 0)
    turn[:, 0, 1:], turn[:, np.arange(1, p + 1), np.arange(1, p + 1)] = -of["centre"] * inverse, inverse
    gram, mixed, base = np.zeros((problems, c * p, c * p)), np.zeros((problems, c, c * p)), np.zeros((problems, c, c))
    for i in range(c):
        for j in range(c):
            m = np.matmul(turn.transpose(0, 2, 1), np.matmul(curve[i, j] / of["n"][-1], turn))
            gram[:, i * p:(i + 1) * p, j * p:(j + 1) * p] = m[:, 1:, 1:]
            mixed[:, i, j * p:(j + 1) * p], base[:, i, j] = m[:, 0, 1:], m[:, 0, 0]
    undo = np.linalg.pinv(base, hermitian=True)
    gram -= np.matmul(mixed.transpose(0, 2, 1), np.matmul(undo, mixed))
    flat = of["beta"].reshape(problems, c * p)
    cross = np.einsum("bij,bj->bi", gram, flat) + slope.reshape(problems, c * p) - np.einsum("bcp,bc->bp", mixed, np.einsum("bij,bj->bi", undo, free))
    new = ST.descend(gram, cross, flat, penalty, SWEEPS)
    move = np.einsum("bij,bj->bi", undo, free - np.einsum("bcp,bp->bc", mixed, new - flat))
    return of["b0"] + move, new.reshape(problems, c, p)


def numbers(of: dict, path: Sequence[float]) -> list:
    """All models of a number by its cross-products; ends as `stacked.paths` does."""
    inverse = np.where(of["keep"], 1 / of["scale"], 0)
    n, cross = of["n"], of["last"]
    mean = cross[:, 0, -1] / n
    around = of["centre"][:, :, None] * of["centre"][:, None, :]
    gram = (cross[:, 1:-1, 1:-1] / n[:, None, None] - around) * inverse[:, :, None] * inverse[:, None, :]
    pull = (cross[:, 1:-1, -1] / n[:, None] - of["centre"] * mean[:, None]) * inverse
    spread = np.maximum(cross[:, -1, -1] / n - mean ** 2, 1e-300)
    b, out, before = np.zeros_like(pull), [], np.zeros(len(n))
    for penalty in path:
        for _ in range(20):
            b = ST.descend(gram, pull, b, penalty)
            slope = pull - np.einsum("bij,bj->bi", gram, b)
            off = ST._breaks(slope, b, penalty).max(axis=1) / penalty
            if off.max() <= ST.TOLERANCE:
                break
        out.append((mean[:, None] + of["level"], b[:, None].copy(), off))
        told = (np.einsum("bi,bi->b", b, 2 * pull) - np.einsum("bi,bij,bj->b", b, gram, b)) / spread
        gain, before = told - before, told
        if ((told > ST.EXPLAINED) | ((gain < ST.GAIN) & (told > 0.01))).all():
            break
    return out


def told_models(blocks: DataFrame, listed: list, keys: list, state: dict, models: dict, path: list, penalties: list, partitions: int, members: DataFrame) -> DataFrame:
    """Merits of held-out folds, the best penalty of each unit, and its model with the test rows."""
    spark = blocks.sparkSession
    slim = {u: {**{k: of[k] for k in ("used", "shift", "classes", "problems")}, "plain": np.stack([_plain(of, b0, b) for b0, b, _ in models[u]])} for u, of in state.items()}
    held = spark.sparkContext.broadcast(slim)

    def fits(of: dict, x: np.ndarray, plain: np.ndarray) -> np.ndarray:
        eta = (_wide(of, x) @ plain.reshape(-1, plain.shape[-1]).T).reshape(len(x), *plain.shape[:2]).transpose(1, 0, 2)
        return ST._chances(eta) if of["classes"] else eta

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _row(batch):
                for unit, x, _, label, fold in _entries(block):
                    of = held.value[unit]
                    got: list[tuple] = []
                    for m, k in enumerate(of["problems"][:-1]):
                        rows = fold == k
                        if rows.any():
                            fit = fits(of, x[rows], of["plain"][:, m])
                            if of["classes"]:
                                got += [(unit, k, q, pickle.dumps((f, label[rows].astype(np.int16)), protocol=5)) for q, f in enumerate(fit)]
                            else:
                                got += [(unit, k, q, pickle.dumps((((f[:, 0] - label[rows]) ** 2).sum(), len(f)), protocol=5)) for q, f in enumerate(fit)]
                    if got:
                        unit_, k_, q_, blob = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(unit_, pa.int32()), pa.array(k_, pa.int32()), pa.array(q_, pa.int32()), pa.array(blob, pa.binary())], names=["unit", "fold", "q", "blob"])

    def rate(table: pa.Table) -> pa.Table:
        unit, classes = table.column("unit")[0].as_py(), held.value[table.column("unit")[0].as_py()]["classes"]
        parts = _row(table)
        if classes:
            merit = ST.merit(np.concatenate([f for f, _ in parts]), np.concatenate([y for _, y in parts]).astype(float), classes)
        else:
            merit = -float(np.sqrt(sum(s for s, _ in parts) / sum(n for _, n in parts)))
        return pa.table({"unit": pa.array([unit], pa.int32()), "fold": table.column("fold").slice(0, 1), "q": table.column("q").slice(0, 1), "merit": pa.array([merit])})

    rated = (blocks.mapInArrow(score, "unit int, fold int, q int, blob binary").repartition(4 * partitions, "unit", "fold", "q")
             .groupBy("unit", "fold", "q").applyInArrow(rate, "unit int, fold int, q int, merit double").toPandas())
    chosen, rows = {}, []
    merits = {u: part.pivot(index="fold", columns="q", values="merit") for u, part in rated.groupby("unit")}
    for u, of in state.items():
        last = len(models[u]) - 1
        mean = merits[u].mean(axis=0) if u in merits else {}
        by_path = [float(mean.get(min(i, last), np.nan)) for i in range(len(path))]
        best = max(range(len(path)), key=lambda i: (-np.inf if np.isnan(by_path[i]) else by_path[i], path[i]))
        b0, beta, off = models[u][min(best, last)]
        chosen[u] = min(best, last)  # weaker penalties share the last model and its merit, so the strongest of equals is one of the path
        cv = dict(zip(path, by_path, strict=True))
        rows.append((u, listed[u]["task"], int(listed[u]["seed"]), int(of["n"][-1]), of["n_test"], path[best], by_path[best], [cv[float(v)] for v in penalties],
                     float(off[-1]), b0[-1].tolist(), [r.tolist() for r in np.where(of["keep"][-1], beta[-1], 0)]))
    slim = {u: {**of, "plain": of["plain"][chosen[u]][None, -1]} for u, of in slim.items()}
    kept = spark.sparkContext.broadcast(slim)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _row(batch):
                for unit, x, ids, label, fold in _entries(block):
                    out = fold < 0
                    if out.any():
                        of = kept.value[unit]
                        fit = fits(of, x[out], of["plain"])[0]
                        lists = pa.FixedSizeListArray.from_arrays(pa.array(fit.ravel()), fit.shape[1]).cast(pa.list_(pa.float64()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fit), unit, np.int32)), pa.array(ids[out].astype(np.int64)), pa.array(label[out]), lists], names=["unit", "id", "label", "fit"])

    tested = (blocks.mapInArrow(test, "unit int, id long, label double, fit array<double>")
              .groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("id", "label", "fit"))).alias("test")))
    schema = "unit int, task string, seed int, n_train long, n_test long, penalty double, merit double, cv array<double>, broken double, intercept array<double>, estimates array<array<double>>"
    none = F.array().cast("array<struct<id:long,label:double,fit:array<double>>>")
    return (spark.createDataFrame(rows, schema).join(tested, "unit", "left").withColumn("test", F.coalesce("test", none)).drop("unit"))
