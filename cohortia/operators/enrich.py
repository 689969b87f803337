"""Gene-set enrichment on ranked lists, term reduction, and overlap of marker lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.joins import presence_matrix
from cohortia.operators.ordered import running
from cohortia.operators.summaries import pair_overlaps, set_sizes
from cohortia.operators.windows import attach_totals, bh_adjust, first_rows, top_with_ties
from cohortia.session import cut, join_on


def rank_list(scores: DataFrame, group: str, gene: str, score: str) -> DataFrame:
    """Genes of each group placed by falling score (name order on ties)."""
    live = scores.filter(F.col(score).isNotNull()).select(group, gene, F.col(score).alias("score"))
    ranked = running(live, [group], "score", {"position": ("row_number", None)}, tie_break=[gene], descending=True)
    return attach_totals(ranked, [group], n_genes=F.count(F.lit(1)))


def eligible_sets(ranked: DataFrame, sets: DataFrame, group: str, gene: str, term: str,
                  sizes: tuple[int, int] = (10, 500)) -> DataFrame:
    """Set members found in each group's list, for sets of fitting size."""
    hits = ranked.select(group, gene).join(sets.select(term, gene).distinct(), gene)
    fitting = (hits.groupBy(group, term).agg(F.count(F.lit(1)).alias("set_size"))
               .filter(F.col("set_size").between(*sizes)))
    return hits.join(fitting, [group, term])


def running_scores(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Enrichment score from the hits alone: the running sum peaks at a hit and bottoms before one.

    A set whose scores are all zero scores zero. A set has at most the allowed number of members, so a
    window holds no more than that.
    """
    w = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*keys)
    steps = hits.withColumns({"__w": F.abs("score")}).withColumns({
        "__run": F.sum("__w").over(w), "__h": F.count(F.lit(1)).over(w), "__all": F.sum("__w").over(full)})
    others = F.col("n_genes") - F.col("set_size")
    miss = F.when(others > 0, (F.col("position") - F.col("__h")) / F.nullif(others, F.lit(0))).otherwise(0.0)
    share = lambda e: e / F.nullif(F.col("__all"), F.lit(0))
    ends = steps.groupBy(*keys).agg(
        F.max("set_size").alias("set_size"), F.max(share(F.col("__run")) - miss).alias("__top"),
        F.min(share(F.col("__run") - F.col("__w")) - miss).alias("__low"))
    top, low = F.greatest(F.col("__top"), F.lit(0.0)), F.least(F.col("__low"), F.lit(0.0))
    return ends.withColumn("es", F.when(top > -low, top).when(top < -low, low).otherwise(0.0)).drop("__top", "__low")


ROUNDS = 64  # of the keyed permutation


def _mix(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^32, scrambled one to one."""
    low = np.int64(0xFFFFFFFF)
    x = x & low
    for _ in range(2):
        x = ((x ^ (x >> 16)) * np.int64(73244475)) & low
    return x ^ (x >> 16)


def deal_places(n: int, deals: np.ndarray, many: int, seed: int) -> np.ndarray:
    """Places 1..n that the first ``many`` numbers take under each deal (a row a deal), by arithmetic alone.

    A swap-or-not permutation: in every round a number and its mirror about a keyed centre change
    places or stay, as a keyed bit of the pair says. It permutes 1..n for any n, so no place has to be
    sorted, stored or drawn again.
    """
    first = (seed * 1000003 + np.asarray(deals, dtype=np.int64) * ROUNDS)[:, None]
    x = np.tile(np.arange(min(many, n), dtype=np.int64), (len(first), 1))
    for j in range(ROUNDS):
        key = _mix(first + j)
        mirror = key % n - x
        mirror += n * (mirror < 0)
        x = np.where(_mix(np.maximum(x, mirror) + key) & 1, mirror, x)
    return x + 1


def null_scores(ranked: DataFrame, sizes: DataFrame, group: str, permutations: int, seed: int) -> DataFrame:
    """Enrichment scores of random sets of every wanted size in every group, one for each deal.

    Which genes a set holds does not matter under the null, so sets of one size share their scores, and a
    deal of the largest size holds those of all smaller ones (its first genes). Lists of equal length
    share the deals. A row of the last step holds the hits of one group and deal: as many as the largest
    set has members. ``sizes`` holds (group, set_size).
    """
    wanted = sizes.groupBy(group).agg(F.array_sort(F.collect_set("set_size")).alias("sizes"))
    lists = attach_lengths(ranked, wanted, group)
    lengths = lists.groupBy("n_genes").agg(F.max(F.element_at("sizes", -1)).alias("many"))
    tasks = lengths.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).repartition("n_genes", "perm")

    def deals(batches):
        for b in batches:
            for (n, many), part in b.groupby(["n_genes", "many"]):
                for perms in np.array_split(part["perm"].to_numpy(), len(part) // 500 + 1):
                    places = deal_places(int(n), perms, int(many), seed)
                    yield pd.DataFrame({"n_genes": n, "perm": np.repeat(perms, places.shape[1]),
                                        "nth": np.tile(np.arange(1, places.shape[1] + 1), len(perms)), "position": places.ravel()})

    dealt = tasks.mapInPandas(deals, "n_genes long, perm int, nth int, position long")
    strength = ranked.select(group, "n_genes", "position", F.abs("score").cast("double").alias("__w"))
    most = lists.select(group, F.element_at("sizes", -1).alias("__most"))
    hits = join_on(dealt.join(strength, ["n_genes", "position"]), most, [group], "inner").filter(F.col("nth") <= F.col("__most"))
    rows = (hits.groupBy(group, "perm").agg(F.array_sort(F.collect_list(F.struct("position", "nth", "__w"))).alias("h")))
    rows = join_on(rows, lists, [group], "inner").select(
        group, "perm", "n_genes", "sizes", *[F.col(f"h.{c}").alias(c) for c in ("position", "nth", "__w")])

    @F.pandas_udf("array<double>")
    def by_size(n: pd.Series, sizes: pd.Series, place: pd.Series, nth: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([_scores_by_size(*row) for row in zip(n, sizes, place, nth, w)])

    each = F.arrays_zip("sizes", by_size("n_genes", "sizes", "position", "nth", "__w").alias("es"))
    return (rows.select(group, "perm", F.explode(each).alias("__e"))
            .select(group, "perm", F.col("__e.sizes").alias("set_size"), F.col("__e.es").alias("null_es")))


def attach_lengths(ranked: DataFrame, wanted: DataFrame, group: str) -> DataFrame:
    lengths = ranked.groupBy(group).agg(F.max("n_genes").alias("n_genes"))
    return join_on(lengths, wanted, [group], "inner")


def _scores_by_size(n: int, sizes: np.ndarray, place: np.ndarray, nth: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of the sets made of the first members of one deal, whose hits come in order of place: a row a size."""
    m = np.asarray(sizes)[:, None]
    of = nth <= m
    weight = np.where(of, w, 0.0)
    run, total = np.cumsum(weight, axis=1), weight.sum(axis=1, keepdims=True)
    miss = (place - np.cumsum(of, axis=1)) / np.maximum(n - m, 1) * (n > m)
    share = 1 / np.where(total > 0, total, np.inf)
    top = np.where(of, run * share - miss, 0.0).max(axis=1)
    low = np.where(of, (run - weight) * share - miss, 0.0).min(axis=1)
    top, low = np.maximum(top, 0.0), np.minimum(low, 0.0)
    return np.where(total[:, 0] > 0, np.where(top > -low, top, np.where(top < -low, low, 0.0)), 0.0)


def enrichment(scores: DataFrame, sets: DataFrame, group: str = "disease", gene: str = "gene", score: str = "score",
               term: str = "term", sizes: tuple[int, int] = (10, 500), permutations: int = 1000, seed: int = 213) -> DataFrame:
    """Enrichment of every set in every group's ranked list.

    The null deals sets of the same size over the list, once per permutation (`null_scores`); p-values
    compare with null scores of the same sign and are adjusted per group. A set without null scores of
    its sign has a NULL normalised score and p-value 1.
    """
    ranked = cut(rank_list(scores, group, gene, score))
    members = cut(eligible_sets(ranked, sets, group, gene, term, sizes))
    observed = cut(running_scores(join_on(members, ranked, [group, gene], "inner"), [group, term]))
    null = null_scores(ranked, observed.select(group, "set_size").distinct(), group, permutations, seed)
    same = F.signum("null_es") == F.signum("es")
    # counted once per (group, size, score): sets of one size share the null, equal scores share the count
    asked = observed.select(group, "set_size", "es").distinct()
    counted = (join_on(asked, null, [group, "set_size"], "inner").groupBy(group, "set_size", "es").agg(
        F.count_if(same).alias("__n"), F.count_if(same & (F.abs("null_es") >= F.abs("es"))).alias("__k"),
        F.avg(F.when(same, F.abs("null_es"))).alias("__mean")))
    tested = (join_on(observed, counted, [group, "set_size", "es"], "left")
              .withColumns({"nes": F.col("es") / F.col("__mean"),
                            "p_value": (F.coalesce("__k", F.lit(0)) + 1) / (F.coalesce("__n", F.lit(0)) + 1)})
              .drop("__n", "__k", "__mean"))
    return bh_adjust(cut(tested), [group])


def reduce_terms(sets: DataFrame, scored_terms: DataFrame, threshold: float = 0.7, term: str = "term",
                 gene: str = "gene", score: str = "score") -> DataFrame:
    """Parent of each term: the best-scored term whose members overlap it (Jaccard) enough."""
    members = sets.join(scored_terms.select(term), term, "left_semi").select(term, gene).distinct()
    size = members.groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    pairs = (pair_overlaps(members, gene, term, zeros=False)
             .join(size.select(F.col(term).alias("src"), F.col("n").alias("n1")), "src")
             .join(size.select(F.col(term).alias("dst"), F.col("n").alias("n2")), "dst"))
    near = (pairs.withColumn("similarity", F.col("overlap") / (F.col("n1") + F.col("n2") - F.col("overlap")))
            .filter(F.col("similarity") >= threshold).select("src", "dst"))
    own = scored_terms.select(F.col(term).alias("src"), F.col(term).alias("dst"))
    best = near.unionByName(own).join(scored_terms.select(F.col(term).alias("dst"), F.col(score).alias("__s")), "dst")
    return (best.groupBy(F.col("src").alias(term))
            .agg(F.min_by("dst", F.struct(-F.col("__s"), F.col("dst"))).alias("parent_term")))


def assign_theme(text: F.Column, rules: Sequence[tuple[str, str]], other: str = "Other") -> F.Column:
    """Theme of the first pattern the text matches."""
    out = None
    for pattern, theme in rules:
        test = text.rlike(pattern)
        out = F.when(test, theme) if out is None else out.when(test, theme)
    return out.otherwise(other) if out is not None else F.lit(other)


def pleiotropy(hits: DataFrame, external: DataFrame, item: str, group: str, klass: str, studies: Sequence[str],
               n: int = 35) -> tuple[DataFrame, DataFrame]:
    """Items hit in most groups: counts by class with totals, and their evidence in other studies.

    ``external`` holds (item, study).
    """
    per = hits.select(item, group, klass).distinct()
    top = first_rows(per.groupBy(item).agg(F.count(F.lit(1)).alias("total")), n, F.col("total").desc(), item)
    bars = (per.join(top, item).groupBy(item, klass)
            .agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total")))
    return bars, presence_matrix(top, external, item, "study", studies)


def marker_overlap(own: DataFrame, published: Mapping[str, DataFrame], item: str, order: str, n: int = 150,
                   own_name: str = "own", universe: DataFrame | None = None) -> DataFrame:
    """Sizes of every combination of marker lists: own top n (ties kept) against published ones."""
    lists = top_with_ties(own, [], order, n).select(item, F.lit(own_name).alias("study"))
    for name, df in published.items():
        lists = lists.unionByName(df.select(item, F.lit(name).alias("study")))
    if universe is not None:
        lists = lists.join(universe.select(item), item, "left_semi")
    return set_sizes(lists, item, "study")
