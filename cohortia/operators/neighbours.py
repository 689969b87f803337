"""Exact nearest neighbours between samples by metric pivots.

About sqrt(n) vectors serve as pivots. Every vector belongs to the cell of its nearest pivot, and cells are dealt to
blocks along the distance from their pivot, so a block lies in a shell of known radii. A vector's k-th best
in its own block (and in the nearest cells by their radii) bounds how far its neighbours can be; by the triangle
inequality that rules out most cells, and of the others most shells. Consecutive blocks make up a hall; a vector is shipped
once to each hall with a block that is left, and meets all of that hall's blocks that its bound there does not rule out. So a vector
is shipped at most twice as often as there are halls, also where the bounds rule out nothing, and pairs are never written out.

Rows with gaps are compared over what both hold, which no metric bounds: two halls of them meet once for both, screened by products of
columns that bound summed differences (`_features`).

What is broadcast are the pivots with three numbers for each cell and block. Many equal vectors are no special case: they fill
several blocks. A pair of halls is held by one task: `HALL_BYTES` of values on either side, for rows with gaps about four times that in single-precision columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.operators.reshape import vectors
from cohortia.session import cut, join_on

PIVOT_BYTES = 16 << 20
#: Halls of a table of some size, and the values that a hall may hold; larger tables have more halls.
HALLS = 10
HALL_BYTES = 32 << 20
#: Survivors of a screen that are held before the k best of them are kept.
HELD = 1 << 15
#: Share of a distance's scale that rounding may cost a bound.
SLACK = 1e-6
#: Pairs of vectors whose differences are held at once.
PAIRS = 1 << 15
#: Rows of a table that place the knots of `_features`.
KNOT_ROWS = 2048
#: Blocks of `nearest_observed`; their shells (36 numbers each) meet on the driver.
MAX_BLOCKS = 2048
REFERENCES = 16
#: Rows that bound how far neighbours can be before any halls meet, their bytes, and how many of the nearest tell the bound.
SAMPLE, SAMPLE_BYTES, NEAR = 2048, 16 << 20, 32


def blocks_for(n: int, block: int) -> int:
    return max(1, -(-n // block))


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix; NULL entries are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by way of products; close distances bear rounding, see `SLACK`."""
    square = (a ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _best(a: np.ndarray, ids: np.ndarray, b: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, exact distance) of each row's k nearest others, ties by id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    scale = math.sqrt((a ** 2).sum(axis=1).max() + (b ** 2).sum(axis=1).max())
    step = max(1, PAIRS // max(len(b), 1))
    for i in range(0, len(a), step):
        near = _between(a[i:i + step], b)
        near[ids[i:i + step, None] == others[None, :]] = np.inf
        limit = np.partition(near, k - 1, axis=1)[:, k - 1] if len(b) > k else np.full(len(near), np.inf)
        row, col = np.nonzero((near <= limit[:, None] + SLACK * scale) & np.isfinite(near))
        exact = np.sqrt(((b[col] - a[i + row]) ** 2).sum(axis=1))
        order = np.lexsort((others[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out.append((i + row[keep], col[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Consecutive rows of one cell, at most ``size`` of them (columns end with cell)."""
    held: list[pa.RecordBatch] = []

    def run_out() -> Iterator[pa.Table]:
        whole = pa.Table.from_batches(held)
        for i in range(0, len(whole), size):
            yield whole.slice(i, size)

    for batch in batches:
        cells = batch.column("cell").to_numpy()
        edges = np.flatnonzero(np.diff(cells)) + 1
        for i, j in zip([0, *edges], [*edges, len(cells)], strict=True):
            if held and held[0].column("cell")[0].as_py() != int(cells[i]):
                yield from run_out()
                held = []
            held.append(batch.slice(i, j - i))
            while sum(len(x) for x in held) >= 2 * size:
                whole = pa.Table.from_batches(held)
                yield whole.slice(0, size)
                held = whole.slice(size).to_batches()
    if held:
        yield from run_out()


def _pivots(points: DataFrame, n: int) -> np.ndarray:
    width = points.select(F.max(F.size("v"))).first()[0] or 1
    few = min(max(1, math.isqrt(n)), max(1, PIVOT_BYTES // (8 * width + 24)))
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(few).select("v").toArrow()
    return _rows(drawn["v"])


def placed(points: DataFrame, pivots: np.ndarray, k: int, block: int) -> DataFrame:
    """(id, v, cell, away, part, reach): nearest pivot and distance from it, block, and k-th best distance inside the block."""
    held = points.sparkSession.sparkContext.broadcast(pivots)
    kind = points.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _rows(batch.column("v"))
            far = np.concatenate([_between(v[i:i + 2048], held.value) for i in range(0, len(v), 2048)]) if len(v) else np.zeros((0, 1))
            cell = far.argmin(axis=1)
            away = np.sqrt(((v - held.value[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(cell.astype(np.int32))], names=["id", "v", "away", "cell"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for table in _blocks(batches, block):
            v, ids = _rows(table["v"]), np.arange(len(table))
            row, _, d = _best(v, ids, v, ids, k)
            reach = np.full(len(table), np.inf)
            full = np.flatnonzero(np.bincount(row, minlength=len(table)) >= k)
            reach[full] = d[np.searchsorted(row, full, "right") - 1]
            yield from table.append_column("part", pa.array(np.full(len(table), part))).append_column("reach", pa.array(reach)).combine_chunks().to_batches()
            part += 1

    by = ["cell", "away", "id"]
    dealt = points.mapInArrow(assign, f"id {kind}, v array<double>, away double, cell int").repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(dealt.mapInArrow(deal, f"id {kind}, v array<double>, away double, cell int, part long, reach double"))


def _limits(batch: pa.RecordBatch, cells: tuple, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, distances to the pivots, bound of the k-th best, cells within the bound) for stretches of placed vectors."""
    centre, name, size, near, far = cells
    v = _rows(batch.column("v"))
    own, away, reach = (batch.column(c).to_numpy() for c in ("cell", "away", "reach"))
    for i in range(0, len(v), 1024):
        part = slice(i, i + 1024)
        d = _between(v[part], centre)
        slack = SLACK * (np.sqrt((v[part] ** 2).sum(axis=1)) + np.sqrt((centre ** 2).sum(axis=1)).max())
        # the cells within this radius hold k others for sure
        outer = d + far
        order = outer.argsort(axis=1)
        held_by = np.cumsum(size[order], axis=1)
        enough = (held_by > k).argmax(axis=1)
        rows = np.arange(len(d))
        bound = np.where(held_by[:, -1] > k, outer[rows, order[rows, enough]], np.inf)
        limit = np.minimum(reach[part], bound) + slack
        # rings of the cell, and the plane between its pivot and the own one
        least = np.maximum(np.maximum(d - far, near - d), np.where(name[None, :] == own[part, None], 0, (d - away[part, None]) / 2))
        yield i, d, limit, least <= limit[:, None]


def _cells(points: DataFrame, pivots: np.ndarray) -> tuple:
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).toArrow()
    at = cells["cell"].to_numpy()
    return (pivots[at], at, *(cells[c].to_numpy() for c in ("n", "near", "far")))


def halls_for(n: int, width: int) -> int:
    return max(1, -(-n * width * 8 // HALL_BYTES), min(HALLS, -(-n // 2048)))


def _halls(sizes: np.ndarray, halls: int) -> np.ndarray:
    """Hall of each block: consecutive blocks of about as many rows in all."""
    return np.minimum(((np.cumsum(sizes) - sizes) * halls) // max(1, sizes.sum()), halls - 1).astype(np.int32)


def asked(rows: DataFrame, pivots: np.ndarray, k: int, rings: pa.Table, hall: np.ndarray) -> DataFrame:
    """(id, v, reach, part, own, hall): each placed vector with its bound, for every hall in which it may have one of its k nearest."""
    cells = _cells(rows, pivots)
    at = np.argsort(cells[1])
    of = at[np.searchsorted(cells[1][at], rings["cell"].to_numpy())]
    starts = np.searchsorted(hall, np.unique(hall))
    held = rows.sparkSession.sparkContext.broadcast((cells, of, rings["near"].to_numpy(), rings["far"].to_numpy(), rings["part"].to_numpy()))
    kind = rows.schema["id"].dataType.simpleString()
    names = np.unique(hall)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, of, near, far, part = held.value
        for batch in batches:
            own = hall[np.searchsorted(part, batch.column("part").to_numpy())]
            for i, d, limit, within in _limits(batch, cells, k):
                there = d[:, of]
                met = within[:, of] & (near[None, :] <= there + limit[:, None]) & (far[None, :] >= there - limit[:, None])
                row, col = np.nonzero(np.logical_or.reduceat(met, starts, axis=1))
                if len(row):
                    take = pa.array(i + row)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "v")), pa.array(limit[row]), batch.column("part").take(take),
                                                      pa.array(own[i + row]), pa.array(names[col])], names=["id", "v", "reach", "part", "own", "hall"])

    return rows.mapInArrow(look, f"id {kind}, v array<double>, reach double, part long, own int, hall int")


def _met(a: np.ndarray, ids: np.ndarray, reach: np.ndarray, b: np.ndarray, others: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_best` for rows of ``b`` in blocks (``part``, ascending): blocks are met from near to far as far as a row's bound reaches.

    Distances are screened in single precision with its error added to the bound; those that stay are worked out exactly.
    """
    size = float((a ** 2).sum(axis=1).max() + (b ** 2).sum(axis=1).max())
    slack = SLACK * math.sqrt(size)
    middle = b.mean(axis=0)
    a32, b32 = (a - middle).astype(np.float32), (b - middle).astype(np.float32)
    square_a, square_b = (a32 ** 2).sum(axis=1), (b32 ** 2).sum(axis=1)
    error = 2 * (a.shape[1] + 8) * 6e-8 * max(size, float(square_a.max() + square_b.max()))
    edges = np.flatnonzero(np.diff(part)) + 1
    blocks = list(zip([0, *edges], [*edges, len(b)], strict=True))
    centre = np.stack([b[i:j].mean(axis=0) for i, j in blocks])
    radius = np.array([_between(b[i:j], c[None])[:, 0].max() for (i, j), c in zip(blocks, centre, strict=True)])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for first in range(0, len(a), 512):
        t, own = slice(first, first + 512), ids[first:first + 512]
        limit = reach[t].copy()
        least = _between(a[t], centre) - radius - slack
        row, col, far = out[0]
        wait: list[tuple[np.ndarray, np.ndarray]] = []

        def keep() -> None:
            nonlocal row, col, far, wait
            r, c = (np.concatenate(x) for x in zip(*wait, strict=True))
            wait = []
            d = np.sqrt(((b[c] - a[first + r]) ** 2).sum(axis=1))
            row, col, far = np.append(row, r), np.append(col, c), np.append(far, d)
            order = np.lexsort((others[col], far, row))
            row, col, far = row[order], col[order], far[order]
            stays = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, far = row[stays], col[stays], far[stays]
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            limit[row[last]] = np.minimum(limit[row[last]], far[last])

        for at in np.argsort(least.min(axis=0)):
            need = np.flatnonzero(least[:, at] <= limit)
            if not len(need):
                continue
            i, j = blocks[at]
            near = square_b[i:j] - 2 * (a32[first + need] @ b32[i:j].T)
            r, c = np.nonzero(near <= (((limit[need] + slack) ** 2 + error) - square_a[first + need])[:, None].astype(np.float32))
            r, c = need[r], c + i
            other = own[r] != others[c]
            wait.append((r[other], c[other]))
            if sum(len(x) for x, _ in wait) >= HELD:
                keep()
        if wait:
            keep()
        out.append((first + row, col, far))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def visits(points: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(id, part): the blocks in which a placed vector may have one of its k nearest."""
    held = points.sparkSession.sparkContext.broadcast(_cells(points, pivots))
    kind = points.schema["id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, d, limit, within in _limits(batch, held.value, k):
                row, col = np.nonzero(within)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(i + row)), pa.array(held.value[1][col]), pa.array((d[row, col] - limit[row])), pa.array(d[row, col] + limit[row])],
                                                 names=["id", "cell", "low", "high"])

    rings = points.groupBy("part", "cell").agg(F.min("away").alias("near"), F.max("away").alias("far"))
    found = points.mapInArrow(look, f"id {kind}, cell int, low double, high double")
    return found.join(rings, "cell").filter((F.col("near") <= F.col("high")) & (F.col("far") >= F.col("low"))).select("id", "part")


def nearest(points: DataFrame, key: str, vector: str, k: int, block: int = 512) -> DataFrame:
    """(key, neighbour, distance, rank) of the k nearest other points by Euclidean distance.

    Points without a vector, or with missing or infinite entries in it, have no neighbours and are none.
    """
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = cut(points.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & sound))
    n = slim.count()
    kind = slim.schema["id"].dataType.simpleString()
    if not n:
        return slim.select(F.col("id").alias(key), F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    pivots = _pivots(slim, n)
    rows = placed(slim, pivots, k, block)
    rings = rows.groupBy("part", "cell").agg(F.min("away").alias("near"), F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).orderBy("part").toArrow()
    halls = halls_for(n, pivots.shape[1])
    hall = _halls(rings["n"].to_numpy(), halls)
    places = rows.sparkSession.createDataFrame(pd.DataFrame({"part": rings["part"].to_numpy(), "of": hall}), "part long, of int")
    blocks = (rows.join(F.broadcast(places), "part").select(F.col("id").alias("oid"), F.col("v").alias("ov"), F.col("part").alias("opart"), "of",
                                                            F.explode(F.sequence(F.lit(0), F.lit(halls - 1))).alias("group")))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return pa.table({"id": q["id"].slice(0, 0), "neighbour": c["oid"].slice(0, 0), "distance": pa.array([], pa.float64())})
        q, c = q.take(pa.array(np.argsort(q["part"].to_numpy(), kind="stable"))), c.take(pa.array(np.argsort(c["opart"].to_numpy(), kind="stable")))
        row, col, d = _met(_rows(q["v"]), q["id"].to_numpy(), q["reach"].to_numpy(), _rows(c["ov"]), c["oid"].to_numpy(), c["opart"].to_numpy(), k)
        return pa.table({"id": q["id"].take(pa.array(row)), "neighbour": c["oid"].take(pa.array(col)), "distance": pa.array(d)})

    # a pair of halls costs far more than its bytes, so its number of partitions is named
    tasks = 2 * halls * halls
    found = (asked(rows, pivots, k, rings, hall).repartition(tasks, "own", "hall").groupBy("own", "hall")
             .cogroup(blocks.repartition(tasks, "group", "of").groupBy("group", "of"))
             .applyInArrow(search, f"id {kind}, neighbour {kind}, distance double"))
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumnRenamed("id", key))


def neighbour_graph(edges: DataFrame, key: str, k: int) -> DataFrame:
    """Edge weights on each point's own scale: the nearest neighbour weighs one and the weights
    of a point add up to log2(k)."""
    packed = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "distance"))).alias("e"))

    @F.pandas_udf("array<double>")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for col in batches:
            out = []
            for d in col:
                d = np.asarray(d, float) - min(d)
                lo, hi = -20.0, 20.0
                for _ in range(64):
                    mid = (lo + hi) / 2
                    if np.exp(-d / np.exp(mid)).sum() > np.log2(k):
                        hi = mid
                    else:
                        lo = mid
                out.append(np.exp(-d / np.exp((lo + hi) / 2)))
            yield pd.Series(out)

    weighed = packed.withColumn("w", weigh(F.col("e.distance")))
    return (weighed.select(key, F.explode(F.arrays_zip("e", "w")).alias("z"))
            .select(key, "z.e.neighbour", "z.e.distance", F.col("z.w").alias("weight")))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean absolute difference over the entries both rows hold; infinite where they share none."""
    held_a, held_b = (~np.isnan(x) for x in (a, b))
    zero_a, zero_b = np.nan_to_num(a), np.nan_to_num(b)
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += np.abs(zero_a[:, j, None] - zero_b[None, :, j]) * (held_a[:, j, None] & held_b[None, :, j])
    shared = held_a.astype(float) @ held_b.T.astype(float)
    return np.where(shared > 0, total / np.maximum(shared, 1), np.inf)


def _best_holding(a: np.ndarray, ids: np.ndarray, b: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row of ``a``, entry, row of ``b``, distance): for every missing entry the k nearest others that hold it, ties by id."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    step = max(1, 4 * PAIRS // max(len(b), 1))
    held = ~np.isnan(b)
    for i in range(0, len(a), step):
        part = a[i:i + step]
        d = _apart(part, b)
        d[ids[i:i + step, None] == others[None, :]] = np.inf
        order = np.lexsort((np.broadcast_to(others, d.shape), d), axis=1)
        sorted_d = np.take_along_axis(d, order, axis=1)
        row, pos = np.nonzero(np.isnan(part))
        for s in range(0, len(row), step):
            r, j = row[s:s + step], pos[s:s + step]
            fits = held[order[r], j[:, None]] & np.isfinite(sorted_d[r])
            fits &= np.cumsum(fits, axis=1) <= k
            gap, place = np.nonzero(fits)
            out.append((i + r[gap], j[gap], order[r[gap], place], sorted_d[r[gap], place]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _between_blocks(rings: pd.DataFrame) -> np.ndarray:
    """Least distance that rows of two blocks can have, by the entries both hold.

    Rows x, y differ over what both hold by at least D(x) - missing(y) - D(y), D being the summed difference from a
    reference over what the row holds: no entry's difference exceeds one. That sum is over at most as many entries as either holds.
    """
    low, high = (np.array([list(v) for v in rings[c]]) for c in ("low", "high"))
    gaps, held = rings["gaps"].to_numpy(float), rings["held"].to_numpy(float)
    gap = np.zeros((len(rings), len(rings)))
    for r in range(low.shape[1]):
        np.maximum(gap, low[:, r, None] - high[None, :, r] - gaps[None, :], out=gap)
        np.maximum(gap, low[None, :, r] - high[:, r, None] - gaps[:, None], out=gap)
    return gap / np.maximum(np.minimum(held[:, None], held[None, :]), 1)


def _knots(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle of each entry's values; width of a first step from there to either side). Any numbers give right bounds, these close ones."""
    s = s[:: max(1, len(s) // KNOT_ROWS)]
    held = ~np.isnan(s)
    centre = np.array([np.median(s[h, j]) if h.any() else 0.0 for j, h in enumerate(held.T)])
    steps = np.full((2, s.shape[1]), 1e-9)
    for i, u in enumerate((s - centre, centre - s)):
        for j in range(s.shape[1]):
            there = u[u[:, j] > 0, j]
            if len(there):
                steps[i, j] = max(np.quantile(there, 0.7), 1e-9)
    return centre, steps


def _features(s: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Single-precision columns (six for each entry, deviations, gaps, sum of deviations, one) whose products bound summed differences.

    Differences of u and v from a middle differ by |u| + |v| - 2 min(|u|, |v|) on one side of it, by |u| + |v| on two. The smaller of
    two numbers is at most f(u) f(v) + b(u) b(v) + t(u) t(v) with f = sqrt(w) min(u / w, 1), b = sqrt(f (sqrt(w) - f)), t = sqrt(max(u - w, 0)):
    f f is the part below w by steps, m (w - M) / w <= b b what it lacks if both are below, min(u - w, v - w) <= t t what is above.
    """
    centre, steps = knots
    n, width = s.shape
    out = np.empty((n, 8 * width + 2), np.float32)
    for i in range(0, n, 2048):
        part = slice(i, i + 2048)
        gap = np.isnan(s[part])
        u = np.where(gap, 0.0, s[part] - centre)
        for side, w in enumerate(steps):
            v = np.maximum(-u if side else u, 0.0)
            f = np.minimum(v / w, 1.0)
            at = 3 * width * side
            out[part, at:at + width] = np.sqrt(w) * f
            out[part, at + width:at + 2 * width] = np.sqrt(w * f * (1 - f))
            out[part, at + 2 * width:at + 3 * width] = np.sqrt(np.maximum(v - w, 0.0))
        off = np.abs(u)
        out[part, 6 * width:7 * width], out[part, 7 * width:8 * width] = off, gap
        out[part, -2], out[part, -1] = off.sum(axis=1), 1.0
    return out


def _against(features: np.ndarray, level: float) -> np.ndarray:
    """Columns whose products with `_features` are at most (summed difference - level x entries both hold) of two rows."""
    width = (features.shape[1] - 2) // 8
    out = np.empty_like(features)
    np.multiply(features[:, :6 * width], -2, out=out[:, :6 * width])
    off, gap = features[:, 6 * width:7 * width], features[:, 7 * width:8 * width]
    out[:, 6 * width:7 * width] = -gap
    out[:, 7 * width:8 * width] = np.float32(level) * (1 - gap) - off
    out[:, -2], out[:, -1] = 1, features[:, -2] - np.float32(level) * (1 - gap).sum(axis=1)
    return out


class _Found:
    """The k nearest so far that hold an entry, for every gap of some rows, and the bound of each row (negative: it asks for nothing)."""

    def __init__(self, s: np.ndarray, ids: np.ndarray, reach: np.ndarray, k: int):
        self.s, self.ids, self.k, self.width = s, ids, k, s.shape[1]
        self.gap = np.isnan(s)
        self.limit = np.where(self.gap.any(axis=1), reach, -1.0).astype(float)
        self.kth = np.where(self.gap, self.limit[:, None], -1.0)
        # gap (row x width + entry), the other row, distance; by gap, distance and id of the other
        self.best: tuple[np.ndarray, ...] = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.wait: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0
        self.enough = max(HELD, 4 * len(s))

    def offer(self, row: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        near = d <= self.limit[row]
        row, other, d = row[near], other[near], d[near]
        at, j = np.nonzero(~self.gap[other] & (d[:, None] <= self.kth[row]))
        if len(at):
            self.wait.append((row[at] * self.width + j, other[at], d[at]))
            self.waiting += len(at)
        if self.waiting >= self.enough:
            self.keep()

    def keep(self) -> None:
        gap, other, d = (np.concatenate(x) for x in zip(self.best, *self.wait, strict=True))
        self.wait, self.waiting = [], 0
        order = np.lexsort((self.ids[other], d, gap))
        gap, other, d = gap[order], other[order], d[order]
        place = np.arange(len(gap)) - np.searchsorted(gap, gap)
        last = np.flatnonzero(place == self.k - 1)
        self.kth.flat[gap[last]] = np.minimum(self.kth.flat[gap[last]], d[last])
        rows = np.unique(gap[last] // self.width)
        self.limit[rows] = self.kth[rows].max(axis=1)
        self.best = tuple(x[place < self.k] for x in (gap, other, d))


def _exactly(s: np.ndarray, row: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, worked out in the order of `_apart`."""
    out = np.empty(len(row))
    for i in range(0, len(row), 2048):
        apart = np.abs(s[row[i:i + 2048]] - s[other[i:i + 2048]]).T.copy()
        one = np.isnan(apart)
        apart[one] = 0
        shared = len(apart) - one.sum(axis=0)
        out[i:i + 2048] = np.where(shared > 0, np.add.reduce(apart, axis=0) / np.maximum(shared, 1), np.inf)
    return out


def _meet(found: _Found, first: np.ndarray, second: np.ndarray | None, blocks: np.ndarray, met: np.ndarray) -> None:
    """Rows ``first`` meet rows ``second`` (or each other, each pair once) if their blocks do; either may be the other's neighbour.

    A product of `_features` screens pairs in single precision, with its error added to the bound; those that stay are worked out exactly.
    """
    s, limit = found.s, found.limit
    within = second is None
    second = first if within else second
    if not len(first) or not len(second):
        return
    knots = _knots(s)
    asks = limit[limit >= 0]
    # near what limits come to, so that a pair's entries in common hardly matter
    level = 0.8 * min(1.0, float(np.median(asks))) if len(asks) else 0.0
    held = (~found.gap).sum(axis=1)
    right = _features(s[second], knots)
    edges = np.flatnonzero(np.diff(blocks[second])) + 1
    parts = np.array([0, *edges, len(second)])
    names = blocks[second[parts[:-1]]]
    # relative error of a sum of so many products; no entry's difference exceeds one
    error = 2 * (right.shape[1] + 8) * 6e-8
    most = float(right[:, -2].max())

    def bounds(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        own = np.minimum(limit[rows], 1.0) + SLACK - level
        common = np.where(own >= 0, held[rows], np.maximum(held[rows] - (s.shape[1] - held[others].min()), 0))
        return np.where(limit[rows] < 0, -np.inf, own * common)

    cuts = np.flatnonzero(np.diff(blocks[first])) + 1
    for low, high in zip([0, *cuts], [*cuts, len(first)], strict=True):
        mine = blocks[first[low]]
        need = np.flatnonzero(met[mine, names] | met[names, mine])
        if within:
            need = need[parts[need + 1] > low]
        if not len(need):
            continue
        runs = np.split(need, np.flatnonzero(np.diff(need) > 1) + 1)
        for i in range(low, high, 512):
            t = first[i:min(i + 512, high)]
            features = right[i:i + len(t)] if within else _features(s[t], knots)
            left = _against(features, level)
            slack = error * (4 * (float(features[:, -2].max()) + most) + s.shape[1])
            for run in runs:
                for j in range(max(parts[run[0]], i if within else 0), parts[run[-1] + 1], 2048):
                    z = min(j + 2048, parts[run[-1] + 1])
                    o = second[j:z]
                    near = left @ right[j:z].T
                    mine_bound, other_bound = bounds(t, o) + slack, bounds(o, t) + slack
                    hit = near <= np.maximum(mine_bound[:, None], other_bound[None, :]).astype(np.float32)
                    if within:
                        hit &= np.arange(j, z)[None, :] > np.arange(i, i + len(t))[:, None]
                    r, c = np.divmod(np.flatnonzero(hit), z - j)
                    r, c = t[r], o[c]
                    apart = found.ids[r] != found.ids[c]
                    r, c = r[apart], c[apart]
                    d = _exactly(s, r, c)
                    sound = np.isfinite(d)
                    r, c, d = r[sound], c[sound], d[sound]
                    found.offer(r, c, d)
                    found.offer(c, r, d)


def _met_holding(a: np.ndarray, ids: np.ndarray, reach: np.ndarray, mine: np.ndarray, b: np.ndarray, others: np.ndarray, blocks: np.ndarray, met: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """As `_best_holding` for rows of blocks ``mine`` and ``blocks`` (both ascending), of which ``met`` tells those that may hold neighbours."""
    n = len(a)
    found = _Found(np.concatenate([a, b]), np.concatenate([ids, others]), np.concatenate([reach, np.full(len(b), -1.0)]), k)
    _meet(found, np.arange(n), n + np.arange(len(b)), np.concatenate([mine, blocks]), met)
    found.keep()
    gap, other, d = found.best
    return gap // a.shape[1], gap % a.shape[1], other - n, d


def _reach(s: np.ndarray, others: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """For every entry of rows with gaps, a bound of the k-th least distance to ``others`` that hold it, their ``same`` row left out.

    Only the nearest `NEAR` are looked at, in single precision with its error added; infinite where they do not tell.
    """
    width = s.shape[1]
    za, zb = (np.nan_to_num(x).astype(np.float32) for x in (s, others))
    ga, gb = (np.isnan(x).astype(np.float32) for x in (s, others))
    columns, held = np.ascontiguousarray(zb.T), ~np.isnan(others)
    out = np.full(s.shape, np.inf)
    step = max(1, PAIRS // max(len(others), 1))
    for i in range(0, len(s) if len(others) > k else 0, step):
        t = slice(i, i + step)
        d, gap = np.zeros((len(za[t]), len(others)), np.float32), np.empty((len(za[t]), len(others)), np.float32)
        for p in range(width):
            np.subtract(za[t, p, None], columns[None, p], out=gap)
            np.abs(gap, out=gap)
            d += gap
        d -= za[t] @ gb.T + ga[t] @ zb.T
        shared = (1 - ga[t]) @ (1 - gb).T
        d = np.where(shared > 0, d / np.maximum(shared, 1), np.inf)
        row, col = np.nonzero(same[t, None] == np.arange(len(others))[None, :])
        d[row, col] = np.inf
        near = np.argpartition(d, NEAR - 1, axis=1)[:, :NEAR] if d.shape[1] > NEAR else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1), axis=1)
        row, pos = np.nonzero(ga[t])
        counts = np.cumsum(held[near[row], pos[:, None]], axis=1)
        full = counts[:, -1] >= k
        row, pos, place = row[full], pos[full], (counts[full] >= k).argmax(axis=1)
        out[i + row, pos] = d[row, near[row, place]] + 4 * (width + 8) * 6e-8
    return out


def observed_blocks(packed: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, s, x, part) in blocks of alike rows, and the pairs of blocks (part, of) in which gaps may find their k nearest."""
    rows, parts, _, met = _observed(packed, k, block)
    mine, other = np.nonzero(met)
    return rows, packed.sparkSession.createDataFrame(pd.DataFrame({"part": parts[mine], "of": parts[other]}), "part long, of long")


def _observed(packed: DataFrame, k: int, block: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in blocks of alike rows, the blocks with their rows, and which of them (column) may hold neighbours of which (row).

    ``s`` is scaled to the range 0 to 1 of each assay, ``x`` the values; both have NULL where nothing was measured.
    """
    width = packed.select(F.max(F.size("s"))).first()[0] or 1
    # rows that the first bounds are worked out with; every row is met later, whatever they are
    few = packed.orderBy(F.xxhash64("id"), "id").limit(max(REFERENCES, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).select("id", "s").toArrow()
    sample = _rows(few["s"])
    drawn = sample[:REFERENCES]
    held = packed.sparkSession.sparkContext.broadcast(np.where(np.isnan(drawn), 0.5, drawn))
    drawn_rows = packed.sparkSession.sparkContext.broadcast((few["id"].to_pylist(), sample))
    kind = packed.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _rows(batch.column("s"))
            far = np.stack([np.nansum(np.abs(s - p), axis=1) for p in held.value], axis=1)
            cell = far.argmin(axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), far.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(far[np.arange(len(s)), cell]), pa.array(cell.astype(np.int32))],
                                             names=["id", "s", "x", "far", "away", "cell"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        names, sample = drawn_rows.value
        at = {name: i for i, name in enumerate(names)}
        for table in _blocks(batches, block):
            s = _rows(table["s"])
            missing, ids = np.isnan(s).sum(axis=1), table["id"].to_pylist()
            same = np.array([at.get(i, -1) for i in ids])
            bound = np.minimum(_reach(s, s, np.arange(len(s)), k), _reach(s, sample, same, k))
            reach = np.where(missing > 0, np.where(np.isnan(s), bound, 0).max(axis=1, initial=0), -1.0)
            columns = {"missing": pa.array(missing.astype(np.int32)), "part": pa.array(np.full(len(table), part)), "reach": pa.array(reach)}
            for name, column in columns.items():
                table = table.append_column(name, column)
            yield from table.combine_chunks().to_batches()
            part += 1

    by = ["cell", "away", "id"]
    kinds = f"id {kind}, s array<double>, x array<double>, far array<double>, away double, cell int"
    dealt = packed.select("id", "s", "x").mapInArrow(assign, kinds).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = cut(dealt.mapInArrow(deal, f"{kinds}, missing int, part long, reach double"))
    size = len(held.value)
    ends = lambda fn, name: F.array(*[fn(F.col("far")[r]) for r in range(size)]).alias(name)
    rings = rows.groupBy("part").agg(ends(F.min, "low"), ends(F.max, "high"), F.max("missing").alias("gaps"),
                                     F.max(F.size("s") - F.col("missing")).alias("held"), F.max("reach").alias("reach"), F.count(F.lit(1)).alias("n")).orderBy("part").toPandas()
    least = _between_blocks(rings)
    return rows, rings["part"].to_numpy(), rings["n"].to_numpy(), least <= rings["reach"].to_numpy()[:, None] + SLACK


def nearest_observed(long: DataFrame, k: int, block: int = 512, cohort: Cohort = DEFAULT) -> DataFrame:
    """For every missing (sample, assay), the k nearest samples holding it, with their values.

    Two halls meet in one task for both, so a row is shipped to at most one task more than there are halls, and only if one of its hall's blocks is
    left by the bound of `_between_blocks`. Values of neighbours are looked up once the nearest are known.
    """
    c = cohort
    ranges = long.groupBy(c.assay).agg(F.min(c.value).alias("__min"), (F.max(c.value) - F.min(c.value)).alias("__range"))
    scaled = (long.join(ranges, c.assay)
              .withColumn("__s", F.when(F.col("__range") > 0, (F.col(c.value) - F.col("__min")) / F.col("__range"))
                          .otherwise(F.when(F.col(c.value).isNotNull(), 0.0)))
              .select(c.sample, c.assay, F.struct(F.col("__s").alias("s"), F.col(c.value).alias("x")).alias("__p")))
    packed = cut(vectors(scaled, c.sample, c.assay, "__p")
                 .select(F.col(c.sample).alias("id"), F.col("vector.s").alias("s"), F.col("vector.x").cast("array<double>").alias("x")))
    kind = packed.schema["id"].dataType.simpleString()
    n = packed.count()
    rows, parts, sizes, met = _observed(packed, k, max(block, blocks_for(n, MAX_BLOCKS)))
    hall = _halls(sizes, halls_for(n, packed.select(F.max(F.size("s"))).first()[0] or 1))
    there = [int(h) for h in np.unique(hall)]
    starts = np.searchsorted(hall, there)
    wanted = np.logical_or.reduceat(np.logical_or.reduceat(met | met.T, starts, axis=0), starts, axis=1) if len(there) else np.zeros((0, 0), bool)
    # a hall is the first of its pairs with itself and later ones, the second of those with earlier ones
    pairs = {h: [(min(h, o), max(h, o)) for j, o in enumerate(there) if wanted[i, j]] for i, h in enumerate(there)}
    places = packed.sparkSession.createDataFrame([(int(p), i, int(hall[i]), pairs[int(hall[i])]) for i, p in enumerate(parts)],
                                                 "part long, block int, own int, pairs array<struct<low: int, high: int>>")
    held = packed.sparkSession.sparkContext.broadcast(met)
    dealt = (rows.join(F.broadcast(places), "part").select("id", "s", "reach", "block", "own", F.explode("pairs").alias("pair"))
             .select("id", "s", "reach", "block", "own", "pair.low", "pair.high"))

    def search(q: pa.Table, p: pa.Table) -> pa.Table:
        both = pa.concat_tables([t.take(pa.array(np.argsort(t["block"].to_numpy(), kind="stable"))) for t in (q, p.rename_columns(q.column_names))])
        found = _Found(_rows(both["s"]), both["id"].to_numpy(), both["reach"].to_numpy(), k)
        at = np.arange(len(both))
        own = len(p) == 0 and len(q) > 0 and q["low"][0] == q["high"][0]
        _meet(found, at[:len(q)], None if own else at[len(q):], both["block"].to_numpy(), held.value)
        found.keep()
        gap, other, d = found.best
        return pa.table({"id": both["id"].take(pa.array(gap // found.width)), "pos": pa.array((gap % found.width).astype(np.int32)),
                         "neighbour": both["id"].take(pa.array(other)), "distance": pa.array(d)})

    # a pair of halls costs far more than its bytes, so its number of partitions is named, with few pairs in one by chance
    tasks = 4 * len(there) ** 2
    first = dealt.filter(F.col("own") == F.col("low")).repartition(tasks, "low", "high").groupBy("low", "high")
    second = (dealt.filter(F.col("own") > F.col("low")).select(*[F.col(x).alias(f"o_{x}") for x in dealt.columns])
              .repartition(tasks, "o_low", "o_high").groupBy("o_low", "o_high"))
    found = first.cogroup(second).applyInArrow(search, f"id {kind}, pos int, neighbour {kind}, distance double")
    w = Window.partitionBy("id", "pos").orderBy("distance", "neighbour")
    best = found.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
    valued = join_on(best, packed.select(F.col("id").alias("neighbour"), "x"), ["neighbour"]).withColumn("neighbour_value", F.get("x", F.col("pos"))).drop("x")
    names = (long.select(c.assay).distinct().filter(F.col(c.assay).isNotNull())
             .withColumn("pos", (F.row_number().over(Window.orderBy(c.assay)) - 1).cast("int")))
    return valued.join(names, "pos").select(F.col("id").alias(c.sample), c.assay, "neighbour", "distance", "neighbour_value")
