"""Grouped summaries of long tables. Every one starts with a partial aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.functions.scalar import above, detect_class
from cohortia.operators.joins import complete, level_pairs
from cohortia.operators.ordered import quantiles


def _skip(value: Column, na_rm: bool, agg) -> Column:
    """Aggregate that skips NULL, or is NULL as soon as one value is NULL."""
    out = agg(value)
    return out if na_rm else F.when(F.count_if(value.isNull()) == 0, out)


def detection_counts(long: DataFrame, keys: Sequence[str], na_rm: bool = True,
                     cohort: Cohort = DEFAULT) -> DataFrame:
    """How many measurements lie above the detection limit."""
    over = F.col(cohort.value) > F.col(cohort.lod)
    hit = F.when(over, 1).when(~over, 0)
    return long.groupBy(*keys).agg(F.coalesce(_skip(hit, na_rm, F.sum), F.lit(0) if na_rm else F.lit(None))
                                   .alias("above_count"))


def visit_counts(meta: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    return meta.groupBy(cohort.subject).agg(F.countDistinct(cohort.visit).alias("visits"))


def detectability_classes(long: DataFrame, meta: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Assays of each subject per detectability class."""
    c = cohort
    share = (detection_counts(long, [c.subject, c.assay], cohort=c)
             .join(visit_counts(meta, c), c.subject, "left")
             .withColumn("detectability", detect_class(F.col("above_count") / F.col("visits"))))
    return share.groupBy(c.subject, "detectability").agg(F.count(F.lit(1)).alias("n"))


def class_means(classes: DataFrame, n_assays: DataFrame) -> DataFrame:
    """Mean class count over subjects and the same as percent of all assays."""
    return (classes.groupBy("detectability").agg(F.avg("n").alias("mean_n"))
            .withColumn("percent", F.col("mean_n") / n_assays.scalar() * 100))


def detected_share(long: DataFrame, n_samples: DataFrame, flag: str = "Yes", cutoff: float = 80.0,
                   cohort: Cohort = DEFAULT) -> DataFrame:
    """Assays whose share of samples with the given flag exceeds the cutoff."""
    c = cohort
    flagged = long.filter(above(F.col(c.value), F.col(c.lod)) == flag)
    return (flagged.groupBy(c.assay).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("percent", F.col("n") / n_samples.scalar() * 100)
            .filter(F.col("percent") > cutoff))


def detectability_table(long: DataFrame, n_samples: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Samples above the limit per assay, zero where there is none."""
    c = cohort
    counts = (long.withColumn("above", above(F.col(c.value), F.col(c.lod)))
              .groupBy(c.assay, "above").agg(F.count(F.lit(1)).alias("n_above")))
    return (complete(counts, c.assay, "above", ["Yes", "No"], "n_above").filter("above = 'Yes'")
            .withColumn("percent", F.col("n_above") / n_samples.scalar() * 100).drop("above"))


def visit_ranges(meta: DataFrame, date: str = "date", cohort: Cohort = DEFAULT) -> DataFrame:
    return meta.groupBy(cohort.visit).agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"))


def five_figures(long: DataFrame, keys: Sequence[str], digits: int = 2,
                 cohort: Cohort = DEFAULT) -> DataFrame:
    """Rounded mean, median and quartiles per group."""
    out = quantiles(long, keys, cohort.value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, mean="mean")
    return out.withColumns({n: F.bround(F.col(n), digits) for n in ("mean", "median", "q1", "q3")})


def mean_range(value: str, digits: int = 1) -> Column:
    """Text "mean (min - max)" of a group."""
    f = f"%.{digits}f"
    return F.format_string(f"{f} ({f} - {f})", F.bround(F.avg(value), digits),
                           F.bround(F.min(value), digits), F.bround(F.max(value), digits))


def cohort_table(meta: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Class, size by sex and age range of each disease."""
    c = cohort
    return meta.groupBy(c.disease).agg(
        F.min(c.klass).alias(c.klass), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(c.sex) == "F").alias("n_female"), F.count_if(F.col(c.sex) == "M").alias("n_male"),
        mean_range(c.age).alias("age_range"))


def group_means(long: DataFrame, keys: Sequence[str], na_rm: bool = True,
                cohort: Cohort = DEFAULT) -> DataFrame:
    return long.groupBy(*keys).agg(_skip(F.col(cohort.value), na_rm, F.avg).alias("mean_value"))


def group_centres(points: DataFrame, group: str, axes: tuple[str, str]) -> DataFrame:
    """Median point of each group."""
    first = quantiles(points, [group], axes[0], {f"{axes[0]}_centre": 0.5})
    return first.join(quantiles(points, [group], axes[1], {f"{axes[1]}_centre": 0.5}), group)


def count_of_counts(hits: DataFrame, group: str, item: str) -> DataFrame:
    """How many items occur k times, per group."""
    once = hits.groupBy(group, item).agg(F.count(F.lit(1)).alias("times"))
    return once.groupBy(group, "times").agg(F.count(F.lit(1)).alias("n_items"))


def member_sets(members: DataFrame, item: str, group: str) -> DataFrame:
    """Sorted set of groups of each item."""
    return (members.select(item, group).distinct().groupBy(item)
            .agg(F.array_sort(F.collect_set(group)).alias("groups")))


def set_sizes(members: DataFrame, item: str, group: str) -> DataFrame:
    """Items per exact combination of groups."""
    return member_sets(members, item, group).groupBy("groups").agg(F.count(F.lit(1)).alias("n"))


def pair_overlaps(members: DataFrame, item: str, group: str, zeros: bool = True) -> DataFrame:
    """Shared items of every ordered pair of groups.

    Items with the same set of groups are counted first, so pairs are spelled out once per
    distinct set and not once per item.
    """
    sized = set_sizes(members, item, group)
    pairs = (sized.withColumn("src", F.explode("groups")).withColumn("dst", F.explode("groups"))
             .filter("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("overlap")))
    if not zeros:
        return pairs
    grid = level_pairs(members, group, ("src", "dst"))
    return (grid.join(pairs, ["src", "dst"], "left")
            .withColumn("overlap", F.coalesce("overlap", F.lit(0)).cast("long")))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count, percent of total and label of each value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.withColumns({
        "percent": F.col("n") / total.scalar() * 100,
        "label": F.concat(F.col(column), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))})


def missing_counts(long: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    c = cohort
    return long.groupBy(c.assay).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(c.value).isNull()).alias("n_missing"),
        (F.count_if(F.col(c.value).isNull()) / F.count(F.lit(1)) * 100).alias("percent"))


def auc_summary(aucs: DataFrame, keys: Sequence[str], value: str = "auc") -> DataFrame:
    return aucs.groupBy(*keys).agg(F.avg(value).alias("mean_auc"), F.stddev_samp(value).alias("sd_auc"))


def importance_summary(importances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute importance over the runs that selected a feature, and their number."""
    return (importances.filter("importance <> 0").groupBy(*keys)
            .agg(F.avg(F.abs("importance")).alias("mean_importance"),
                 F.countDistinct("seed").alias("n_seeds")))
