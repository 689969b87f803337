"""Join shapes. No side carries a broadcast hint: Spark broadcasts a side when its size is
below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges, where adaptive
execution splits skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def with_metadata(long: DataFrame, meta: DataFrame, key: str, columns: Sequence[str],
                  meta_key: str | None = None) -> DataFrame:
    """Left join of chosen metadata columns, under one or two key names."""
    right = meta.select(F.col(meta_key or key).alias(key), *columns)
    return long.join(right, key, "left")


def keep_in(df: DataFrame, other: DataFrame, column: str, other_column: str | None = None) -> DataFrame:
    right = other.select(F.col(other_column or column).alias(column))
    return df.join(right, column, "left_semi")


def keep_not_in(df: DataFrame, other: DataFrame, column: str, other_column: str | None = None) -> DataFrame:
    right = other.select(F.col(other_column or column).alias(column))
    return df.join(right, column, "left_anti")


def natural(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on the columns both sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no common columns")
    return left.join(right, shared, how)


def level_pairs(df: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    """All ordered pairs of different levels of a dimension; the result is of that size."""
    one = df.select(F.col(column).alias(names[0])).distinct().filter(F.col(names[0]).isNotNull())
    two = one.withColumnRenamed(names[0], names[1])
    return one.join(two, F.col(names[0]) != F.col(names[1]))


def complete(counts: DataFrame, key: str, column: str, values: Sequence[str], fill: str) -> DataFrame:
    """One row per key and declared value, absent counts set to zero."""
    grid = counts.select(key).distinct().withColumn(
        column, F.explode(F.array(*[F.lit(v) for v in values])))
    return (grid.join(counts, [key, column], "left")
            .withColumn(fill, F.coalesce(F.col(fill), F.lit(0))))


def lookup(df: DataFrame, annotation: DataFrame, key: str, column: str, default: str,
           annotation_key: str | None = None) -> DataFrame:
    """Annotation value per row with a default where the annotation has none."""
    right = annotation.select(F.col(annotation_key or key).alias(key), column)
    return df.join(right, key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def paired_results(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str,
                   names: tuple[str, str]) -> DataFrame:
    """The same statistic of two cohorts side by side."""
    a = first.select(*keys, F.col(value).alias(names[0]))
    b = second.select(*keys, F.col(value).alias(names[1]))
    return a.join(b, list(keys), "inner")


def presence_matrix(markers: DataFrame, members: DataFrame, key: str, study: str,
                    studies: Sequence[str]) -> DataFrame:
    """Yes/No per marker and declared study."""
    grid = markers.select(key).distinct().withColumn(
        study, F.explode(F.array(*[F.lit(s) for s in studies])))
    hits = members.select(key, study).distinct().withColumn("__hit", F.lit(True))
    present: Column = F.when(F.col("__hit"), "Yes").otherwise("No")
    return grid.join(hits, [key, study], "left").withColumn("present", present).drop("__hit")
