"""The numbers behind charts: bins, box statistics, densities, ellipses, trends, trajectories."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.functions.scalar import recode
from cohortia.operators.ordered import quantiles
from cohortia.operators.summaries import pair_overlaps
from cohortia.operators.windows import top_with_ties
from cohortia.session import join_on


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Equal bins from the smallest to the largest value over all facets; empty bins count zero.

    Bins are numbered 1..bins; the largest value falls into the last one.
    """
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = edges.select(F.struct("lo", "hi").alias("e")).scalar()
    live = df.filter(F.col(value).isNotNull()).withColumn("__e", span)
    lo, hi = F.col("__e.lo"), F.col("__e.hi")
    width = (hi - lo) / bins
    number = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.floor((F.col(value) - lo) / width) + 1, F.lit(bins))).cast("int")
    counts = live.groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    on = [*keys, "bin"]
    facets = live.select(*keys).distinct() if keys else edges
    grid = facets.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return join_on(grid, counts, on, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles and whiskers ending at the furthest point within 1.5 times the box height."""
    q = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, mean="mean", count="n")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - fence) & (F.col(value) <= F.col("q3") + fence)
    ends = (join_on(df.select(*keys, value), q.select(*keys, "q1", "q3"), keys, "inner")
            .groupBy(*keys).agg(F.min(F.when(inside, F.col(value))).alias("low"),
                                F.max(F.when(inside, F.col(value))).alias("high"),
                                F.count_if(~inside).alias("n_outliers")))
    return join_on(q, ends, keys, "left")


def mean_marker(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"))


def density(df: DataFrame, keys: Sequence[str], value: str, bins: int = 128, points: int = 32) -> DataFrame:
    """Gaussian kernel density per group on an even grid, from binned counts, with the median.

    Values are first counted in ``bins`` equal cells per group, so the kernel runs over cells
    and not over rows. The bandwidth is the usual rule 0.9 min(sd, IQR / 1.34) n^(-1/5).
    """
    q = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75},
                  extra=[F.count(value).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"),
                         F.stddev_samp(value).alias("__sd")])
    spread = F.least(F.col("__sd"), (F.col("q3") - F.col("q1")) / 1.34)
    shape = (q.withColumn("bandwidth", 0.9 * F.when(spread > 0, spread).otherwise(F.col("__sd"))
                          * F.pow(F.col("__n"), F.lit(-0.2)))
             .filter("bandwidth > 0").drop("q1", "q3", "__sd"))
    rows = join_on(df.filter(F.col(value).isNotNull()).select(*keys, value),
                   shape.select(*keys, "__lo", "__hi"), keys, "inner")
    step = (F.col("__hi") - F.col("__lo")) / bins
    cell = F.least(F.floor((F.col(value) - F.col("__lo")) / step), F.lit(bins - 1))
    cells = rows.groupBy(*keys, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__w"))
    spread_out = (join_on(cells, shape, keys, "inner")
                  .withColumn("__mid", F.col("__lo") + (F.col("__cell") + 0.5) * step)
                  .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
                  .withColumn("x", F.col("__lo") + F.col("point") * (F.col("__hi") - F.col("__lo")) / (points - 1)))
    z = (F.col("x") - F.col("__mid")) / F.col("bandwidth")
    kernel = F.col("__w") * F.exp(-0.5 * z * z)
    norm = F.col("__n") * F.col("bandwidth") * math.sqrt(2 * math.pi)
    return spread_out.groupBy(*keys, "point").agg(
        F.min("x").alias("x"), F.sum(kernel / norm).alias("density"), F.min("median").alias("median"))


def ellipse(df: DataFrame, keys: Sequence[str], axes: tuple[str, str], level_scale: float = 5.991464547107979) -> DataFrame:
    """Centre, covariance and half axes of the normal ellipse (default 95 %, two dimensions)."""
    x, y = axes
    m = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
        F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vxy"))
    half = (F.col("vx") + F.col("vy")) / 2
    root = F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow("vxy", 2))
    return m.withColumns({
        "major": F.sqrt((half + root) * level_scale),
        "minor": F.sqrt(F.greatest(half - root, F.lit(0.0)) * level_scale),
        "angle": F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2})


def trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group; pairs with a NULL are left out."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                    F.count(F.lit(1)).alias("n"))


def binned_trend(df: DataFrame, keys: Sequence[str], x: str, y: str, width: float) -> DataFrame:
    """Mean and standard error of y in bands of x."""
    band = (F.floor(F.col(x) / width) * width).cast("double").alias("band")
    return df.groupBy(*keys, band).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"),
        (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("se"))


def trajectory(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Values of one subject in visit order with the change since the visit before.

    ``keys`` name one subject (and assay), so a window holds one subject's visits.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"step": F.row_number().over(w),
                           "change": F.col(value) - F.lag(value).over(w)})


def overlap_graph(members: DataFrame, nodes: DataFrame, item: str, group: str, neighbours: int = 3,
                  above: int = 150) -> tuple[DataFrame, DataFrame]:
    """Undirected edges to each group's best neighbours (ties kept), and the node table."""
    best = top_with_ties(pair_overlaps(members, item, group, zeros=False), ["src"], "overlap", neighbours)
    edges = (best.filter(F.col("overlap") > above)
             .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "overlap").distinct())
    names = edges.select(F.col("src").alias(group)).union(edges.select("dst")).distinct()
    return edges, names.join(nodes.dropDuplicates(), group, "left")


def box_source(long: DataFrame, meta: DataFrame, assays: Sequence[str], label: str, qualifier: Sequence[str],
               qualify: str, drop_pattern: str = "back-up", cohort: Cohort = DEFAULT) -> DataFrame:
    """Rows for a box plot: chosen assays, a qualified group label, back-up samples dropped."""
    c = cohort
    name = F.concat_ws("_", *qualifier)
    shown = F.when(F.col(label) == qualify, F.concat_ws("_", F.col(label), name)).otherwise(F.col(label))
    return (long.filter(F.col(c.assay).isin(list(assays))).select(c.sample, c.assay, c.value)
            .join(meta.select(c.sample, label, *qualifier), c.sample, "left")
            .withColumn("cohort_label", name).withColumn(label, shown)
            .filter(F.col(label).isNotNull() & ~F.col(label).rlike(drop_pattern)))


def batch_profile(raw: DataFrame, donors: Mapping[str, str], keys: Sequence[str], donor: str = "donor",
                  plate: str = "plate", cohort: Cohort = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Replicate donors over batches: group means and box statistics in natural plate order.

    ``donors`` maps the donor names to keep to the name shown (several may merge into one).
    """
    live = (raw.filter(F.col(donor).isin(list(donors)))
            .withColumn(donor, recode(F.col(donor), donors))
            .withColumn("plate_number", F.regexp_extract(F.col(plate).cast("string"), r"(\d+)", 1).try_cast("long")))
    means = live.groupBy(donor, *keys).agg(F.avg(cohort.value).alias("mean_value"))
    return means, box_stats(live, [donor, "plate_number"], cohort.value)
