"""Exact top-k by inner product: columnar branch and bound over blocks of candidates.

Candidates and queries are dealt into blocks by digest and each block of queries meets each block of
candidates once. Inside, candidates lie in vertical layout: one matrix for each group of dimensions.
For a query the groups are added one by one; after each, a candidate can gain at most the product of
what is left of the two norms (Cauchy-Schwarz), and candidates that cannot reach the k-th best score
known so far are taken out by compaction. The first threshold comes from scoring a few candidates of large norm
in full. Each pair of blocks passes on k rows a query at most.

Components are floor(256 * x) as whole numbers; sums are exact in doubles up to 2**53, and beyond that
Python integers are used (scores are held to the range of a long before they are ranked).

Defined results: vectors that are NULL or hold NULL or non-finite components, and rows without an id, take
no part; shorter vectors count as filled up with zeros; rows with the query's own id are no
candidates; ties go to the smaller id, and repeated rows of an id take a place each; several query
rows of one id are one query, with the smallest vector; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 512
GROUP = 16
SEED_ROWS = 64
EXACT = float(1 << 53)


def whole(vectors: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) of a list column as rows of doubles, filled up with zeros."""
    lists = vectors.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


class Columns:
    """Candidates in vertical layout with the norms that remain after each group of dimensions."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.lexsort((ids, -np.einsum("ij,ij->i", rows, rows)))
        self.ids, rows = ids[order], rows[order]
        self.rows = rows
        self.cuts = list(range(0, rows.shape[1], GROUP)) + [rows.shape[1]]
        self.groups = [np.ascontiguousarray(rows[:, a:z].T) for a, z in zip(self.cuts, self.cuts[1:], strict=False)]
        left = np.zeros((len(self.groups) + 1, len(rows)))
        for g in range(len(self.groups) - 1, -1, -1):
            left[g] = left[g + 1] + (self.groups[g] ** 2).sum(axis=0)
        self.left = np.sqrt(left)
        self.largest = float(np.abs(rows).max(initial=0.0))

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, in order."""
        q = q[:self.rows.shape[1]] if len(q) >= self.rows.shape[1] else np.pad(q, (0, self.rows.shape[1] - len(q)))
        if self.largest * float(np.abs(q).max(initial=0.0)) * max(len(q), 1) >= EXACT:
            return self._long(query_id, q, k)
        rest = [float(np.sqrt((q[a:] ** 2).sum())) for a in self.cuts]
        head = np.flatnonzero(self.ids[:SEED_ROWS] != query_id)
        seeds = self.rows[head] @ q
        low = np.sort(seeds)[-k] if len(seeds) >= k else -np.inf
        alive = np.flatnonzero(self.ids != query_id)
        score = np.zeros(len(alive))
        for g, part in enumerate(self.groups):
            a, z = self.cuts[g], self.cuts[g + 1]
            score += q[a:z] @ (part if len(alive) == part.shape[1] else part[:, alive])
            bound = score + self.left[g + 1][alive] * (rest[g + 1] * (1 + 1e-9)) + 1e-6 * bool(rest[g + 1])
            if len(score) > k:  # the k-th best of the sure lower bounds
                sure = 2 * score - bound
                low = max(low, float(np.partition(sure, len(sure) - k)[len(sure) - k]))
            keep = bound >= low
            if not keep.all():
                alive, score = alive[keep], score[keep]
        return self._best(self.ids[alive], score, k)

    def _long(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ints = [int(x) for x in q]
        alive = np.flatnonzero(self.ids != query_id)
        score = [sum(a * int(b) for a, b in zip(ints, self.rows[i], strict=True)) for i in alive]
        held = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score]
        order = sorted(range(len(alive)), key=lambda i: (-held[i], self.ids[alive[i]]))[:k]
        return self.ids[alive[order]] if order else self.ids[:0], np.array([held[i] for i in order], np.int64)

    @staticmethod
    def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) > k:
            low = np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[score >= low], score[score >= low]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order].astype(np.int64)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
          scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query."""
    def sound(df: DataFrame) -> DataFrame:
        big = F.lit(float("inf"))
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big)
        x = F.col("v")
        return (df.select(df[id_col].cast("long").alias("id"), df[vector].alias("v"))
                .filter(F.col("id").isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(False))))

    asked = sound(queries).groupBy("id").agg(F.min("v").alias("v"))
    given = sound(candidates)
    n, n_asked = given.count(), asked.count()
    blocks, parts = max(-(-n // CANDIDATES), 1), max(-(-n_asked // QUERIES), 1)
    left = (given.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    right = (asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).toDF("q_id", "q", "q_part", "q_block"))

    def meet(key, rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if rows.num_rows and asks.num_rows:
            held = Columns(rows.column("id").to_numpy(), whole(rows.column("v"), scale))
            for qid, q in zip(asks.column("q_id").to_numpy(), whole(asks.column("q"), scale), strict=True):
                ids, score = held.top(int(qid), q, k)
                out[0].append(np.full(len(ids), qid))
                out[1].append(ids)
                out[2].append(score)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))

    met = (left.groupBy("block", "part").cogroup(right.groupBy("q_block", "q_part"))
           .applyInArrow(meet, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
