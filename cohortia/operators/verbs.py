"""Row and column verbs on long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.operators.ordered import running
from cohortia.session import join_on

def select_as(df: DataFrame, **columns: str) -> DataFrame:
    """Select and rename in one step: ``select_as(df, new="old")``."""
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()])


def level_table(df: DataFrame, column: str, order: Sequence[str] = ()) -> DataFrame:
    """Levels with their ordinal: the declared ones first, then the rest by name."""
    distinct = df.select(F.col(column).alias("level")).filter(F.col(column).isNotNull()).distinct()
    place = F.array_position(F.array(*[F.lit(v) for v in order]).cast("array<string>"),
                             F.col("level").cast("string")) if order else F.lit(0)
    keyed = distinct.withColumn("__unlisted", (place == 0).cast("int")).withColumn("__place", place)
    listed = keyed.filter("__unlisted = 0").select("level", F.col("__place").cast("long").alias("ordinal"))
    rest = running(keyed.filter("__unlisted = 1").select("level"), [], "level",
                   {"ordinal": ("row_number", None)})
    return listed.unionByName(rest.withColumn("ordinal", F.col("ordinal") + F.lit(len(order))))


def order_by_levels(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """Sort rows by a declared level order, then by further columns."""
    lv = level_table(df, column, order).withColumnRenamed("level", column)
    return join_on(df, lv, [column], "left").orderBy(F.col("ordinal").asc_nulls_last(), *then)


def order_by_statistic(df: DataFrame, group: str, value: str, then: Sequence[str] = ()) -> DataFrame:
    """Group levels placed by descending mean of ``value``."""
    means = df.groupBy(group).agg(F.avg(value).alias("statistic"))
    return running(means.filter("statistic is not null"), [], "statistic",
                   {"ordinal": ("row_number", None)}, tie_break=[group, *then], descending=True)


def level_code(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Rank of the value among its distinct values (a factor's integer code)."""
    lv = level_table(df, column).select(F.col("level").alias(column), F.col("ordinal").alias(out))
    return join_on(df, lv, [column], "left")


def split_two(df: DataFrame, column: str, names: tuple[str, str],
              delimiter: str = "[^A-Za-z0-9]+") -> DataFrame:
    """First two pieces of a text column; further pieces are dropped, absent ones are NULL."""
    parts = F.split(column, delimiter)
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def split_rows(df: DataFrame, column: str, delimiter: str = ", ") -> DataFrame:
    return df.withColumn(column, F.explode_outer(F.split(column, delimiter)))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first full row per key in a declared order; only one row per key is shuffled per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def add_absent_features(df: DataFrame, features: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Give every sample a NULL row for each model feature its cohort does not measure."""
    c = cohort
    absent = (features.select(c.assay).distinct()
              .join(df.select(c.assay).distinct(), c.assay, "left_anti"))
    pad = (df.select(c.sample).distinct()
           .join(absent)  # every sample gets every absent feature: the result is of that size
           .withColumn(c.value, F.lit(None).cast("double")))
    return df.select(c.sample, c.assay, c.value).unionByName(pad)


def allowed_sexes(meta: DataFrame, fixed: Mapping[str, str] | None = None,
                  cohort: Cohort = DEFAULT) -> DataFrame:
    """(disease, sex) pairs a disease's cohort may hold.

    A disease seen in one sex only is kept to it; ``fixed`` overrides that by name.
    """
    c = cohort
    seen = (meta.filter(F.col(c.sex).isNotNull()).groupBy(c.disease)
            .agg(F.array_sort(F.collect_set(c.sex)).alias("__sexes")))
    if fixed:
        chosen = None
        for name, sex in fixed.items():
            test = F.col(c.disease) == name
            chosen = F.when(test, F.array(F.lit(sex))) if chosen is None else chosen.when(
                test, F.array(F.lit(sex)))
        seen = seen.withColumn("__sexes", chosen.otherwise(F.col("__sexes")))
    return seen.select(c.disease, F.explode("__sexes").alias(c.sex))
