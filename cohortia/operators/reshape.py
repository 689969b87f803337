"""Reshaping and set verbs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.ordered import running


def wide(df: DataFrame, rows: str, names: str, value: Column, values: Sequence, fill=None) -> DataFrame:
    """Long to wide over declared names, for output tables. ``value`` is an aggregate."""
    out = df.groupBy(rows).pivot(names, list(values)).agg(value)
    return out if fill is None else out.fillna(fill, subset=[str(v) for v in values])


def first_value(value: str, order: str) -> Column:
    """Value of the row that comes first in ``order``."""
    return F.min_by(value, order)


def long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def one_hot(df: DataFrame, key: str, label: str, values: Sequence) -> DataFrame:
    """A 0/1 column per declared label."""
    return df.select(key, *[F.when(F.col(label) == v, 1).otherwise(0).alias(str(v)) for v in values])


def transpose(df: DataFrame, row: str, columns: Sequence[str], values: Sequence, column: str = "column",
              value: str = "value") -> DataFrame:
    """Swap rows and columns of a small labelled table."""
    return wide(long(df, [row], columns, column, value), column, row, F.max(value), values)


def vectors(df: DataFrame, sample: str, assay: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample with its values as an array in assay order (no wide columns).

    A value's place follows from its assay among all assays of ``df``, so samples that lack rows of some
    assays have NULL there.
    """
    places = running(df.select(assay).distinct().filter(F.col(assay).isNotNull()), [], assay, {"__place": ("row_number", None)})
    held = df.join(places, assay).select(sample, *keep, F.struct("__place", F.col(value).alias("v")).alias("__s"))
    packed = held.groupBy(sample, *keep).agg(F.collect_list("__s").alias("__p"))
    packed = packed.withColumn("__every", F.sequence(F.lit(1).cast("long"), places.agg(F.count(F.lit(1))).scalar()))
    packed = packed.withColumn("__absent", F.array_except("__every", F.col("__p")["__place"]))
    nothing = F.lit(None).cast(df.schema[value].dataType)
    whole = F.array_sort(F.concat("__p", F.transform("__absent", lambda i: F.struct(i.alias("__place"), nothing.alias("v")))))
    return packed.select(sample, *keep, F.transform(whole, lambda s: s["v"]).alias("vector"))


def stack(*parts: DataFrame) -> DataFrame:
    """Row union; columns absent from a part become NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
