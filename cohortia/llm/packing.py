"""Best-fit packing of token sequences by bin completion with branch and bound.

Bins are planned over the histogram of piece lengths, which has at most ``capacity`` entries however
large the corpus is. The plan goes bin by bin: around the largest length left, a branch and bound
enumerates fillings of the rest, larger pieces first (a filling of larger pieces dominates one of
smaller pieces), prunes by the waste a branch can still reach, and keeps the fullest; the filling is
used as often as the counts allow. Best-fit decreasing gives the first incumbent; the search restarts
with the second-best filling at one of the early bins while the bound (total length over capacity)
is not met, and the plan of fewest bins is taken.

A plan entry says which ranks among the pieces of a length go into which sequences, so pieces are
placed by rank alone. Ranks are counted in buckets of each length by digest, so a length that a
third of all rows share is counted by many tasks.

Defined results: NULL or empty texts give one piece (the end token); ties in length are broken by
digest and id; repeated rows are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.llm import tokens as K
from cohortia.llm import words as W
from cohortia.session import cut

#: Branches looked at for one filling, and restarts of the plan.
NODES = 3000
RESTARTS = 8
#: Pieces of a bucket in which ranks are counted.
BUCKET = 50_000

Plan = list[tuple[list[tuple[int, int]], int]]  # ([(length, pieces in a bin)], bins)


def _reachable(counts: np.ndarray, capacity: int) -> int:
    """Bit set of sums that pieces of the given lengths may reach (at most; counts up to 2**k - 1)."""
    bits, full = 1, (1 << (capacity + 1)) - 1
    for length in np.flatnonzero(counts):
        n, length = min(int(counts[length]), capacity // int(length)), int(length)
        k = 1
        while n > 0:
            bits |= bits << (length * k) & full
            n, k = n - k, k * 2
    return bits


def filling(counts: np.ndarray, present: list[int], room: int, sums: int, rank: int = 0) -> list[tuple[int, int]]:
    """The fullest way found to fill ``room`` (or the next best of another kind, by ``rank``)."""
    best: list[tuple[int, list[tuple[int, int]]]] = []
    nodes = 0
    reach = sums & ((1 << (room + 1)) - 1)
    goal = reach.bit_length() - 1

    def go(i: int, left: int, taken: list[tuple[int, int]]) -> bool:
        nonlocal nodes
        nodes += 1
        used = room - left
        if len(best) <= rank or used > best[-1][0]:
            best.append((used, list(taken)))
            best.sort(key=lambda x: -x[0])
            del best[rank + 1:]
        if len(best) > rank and best[-1][0] >= goal or nodes > NODES:
            return True
        lo, hi = i, len(present)
        while lo < hi:  # largest length that fits
            mid = (lo + hi) // 2
            if present[mid] > left:
                lo = mid + 1
            else:
                hi = mid
        for j in range(lo, len(present)):
            length = present[j]
            most = min(int(counts[length]), left // length)
            for n in range(most, 0, -1):
                rest = left - n * length
                can = (sums & ((1 << (rest + 1)) - 1)).bit_length() - 1
                if len(best) > rank and room - rest + can <= best[-1][0]:
                    continue  # cannot waste less than the incumbent
                taken.append((length, n))
                if go(j + 1, rest, taken):
                    return True
                taken.pop()
        return False

    go(0, room, [])
    return best[min(rank, len(best) - 1)][1]


def complete(histogram: dict[int, int], capacity: int, swerve: int = -1) -> Plan:
    """Plan by bin completion; at bin ``swerve`` the second-best filling is taken."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan: Plan = []
    present = [int(x) for x in np.flatnonzero(counts)[::-1]]
    sums, stale = _reachable(counts, capacity), 0
    while present:
        top = present[0]
        counts[top] -= 1
        room = capacity - top
        if stale >= 64:
            sums, stale = _reachable(counts, capacity), 0
        stale += 1
        taken = filling(counts, present, room, sums, int(len(plan) == swerve)) if room else []
        counts[top] += 1
        use: dict[int, int] = {top: 1}
        for length, n in taken:
            use[length] = use.get(length, 0) + n
        times = min(int(counts[length]) // n for length, n in use.items())
        for length, n in use.items():
            counts[length] -= n * times
        plan.append((sorted(use.items(), reverse=True), times))
        present = [x for x in present if counts[x]] if any(not counts[x] for x in use) else present
    return plan


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over the histogram: the incumbent to begin with."""
    room: dict[int, list[list]] = {}  # free space -> [contents, bins]
    free = np.zeros(capacity + 1, np.int64)

    def put(space: int, content: tuple, bins: int) -> None:
        room.setdefault(space, []).append([content, bins])
        free[space] += bins

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            fit = np.flatnonzero(free[length:])
            if len(fit):
                space = int(fit[0]) + length
                content, bins = room[space].pop()
                take = min(n, bins)
                free[space] -= bins
                if bins > take:
                    put(space, content, bins - take)
                put(space - length, (*content, length), take)
                n -= take
            else:
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - n % each * length, (length,) * (n % each), 1)
                n = 0
    out: Plan = []
    for lists in room.values():
        for content, bins in lists:
            lengths, k = np.unique(content, return_counts=True)
            out.append(([(int(a), int(b)) for a, b in zip(lengths[::-1], k[::-1], strict=True)], bins))
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan of fewest bins that was found."""
    bound = -(-sum(a * b for a, b in histogram.items()) // capacity)
    best = best_fit(histogram, capacity)
    for swerve in range(-1, RESTARTS):
        if sum(n for _, n in best) <= bound:
            break
        now = complete(histogram, capacity, swerve)
        if sum(n for _, n in now) < sum(n for _, n in best):
            best = now
    return best


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids): token ids (little-endian unsigned 32-bit) with ``end``, cut to ``capacity``."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = K.WordEncoder.of(vocabulary)
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                ids, at = K.with_end(*encoder.encode(texts), end)
                size = np.diff(at)
                n = -(-size // capacity)
                row = np.repeat(np.arange(texts.n), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                offs = np.zeros(len(row) + 1, np.int32)
                np.cumsum(length * 4, out=offs[1:])
                data = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offs), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, texts.n).take(pa.array(row)), pa.array(piece.astype(np.int32)),
                                                  pa.array(start), pa.array(length), data], schema.names)

    return df.select(df[id_col], df[text]).mapInArrow(run, schema)


def pack(df: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``df`` (with a ``length`` from 1 to ``capacity``) and each row's sequence_id and offset.

    ``order`` breaks ties among rows of one length.
    """
    df = cut(df.drop("sequence_id", "offset"))
    histogram = {int(r["length"]): int(r["n"]) for r in df.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = plan_bins(histogram, capacity)
    # for each length, in order of rank: first rank, bins' first number, pieces a bin, offset in the bin
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    bin_id = 0
    for content, bins in plan:
        offset = 0
        for length, k in content:
            spans.setdefault(length, []).append((given.get(length, 0), bin_id, k, offset))
            given[length] = given.get(length, 0) + k * bins
            offset += k * length
        bin_id += bins
    table = {length: np.array(x, np.int64) for length, x in spans.items()}
    buckets = {length: -(-n // BUCKET) for length, n in histogram.items()}
    several = F.create_map(*[F.lit(x) for kv in buckets.items() if kv[1] > 1 for x in kv]) if max(buckets.values(), default=1) > 1 else None
    n_buckets = F.coalesce(several[F.col("length")], F.lit(1)) if several is not None else F.lit(1)
    seated = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), n_buckets))
    counts = (seated.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
              .withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n"))
              .drop("__n"))
    ranked = (seated.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*order)) - 1)
              .join(counts, ["length", "__bucket"]).withColumn("__rank", (F.col("__rank") + F.col("__before")).cast("long")))
    keep = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                size = int(length[rows[0]])
                t = table[size]
                hit = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - hit[:, 0]
                seq[rows], off[rows] = hit[:, 1] + nth // hit[:, 2], hit[:, 3] + nth % hit[:, 2] * size
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    return ranked.select(*keep, "__rank").mapInArrow(place, schema)
