"""Window verbs: shares, ranks, rescaling and adjusted p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.operators.ordered import running
from cohortia.session import join_on, lookup_side


def rank_first(df: DataFrame, order: str, tie_break: Sequence[str], keys: Sequence[str] = (),
               descending: bool = True, out: str = "rank") -> DataFrame:
    """Rank with ties in declared order."""
    return running(df, keys, order, {out: ("row_number", None)}, tie_break=tie_break,
                   descending=descending)


def attach_totals(df: DataFrame, keys: Sequence[str], rows: int = 0, **aggs) -> DataFrame:
    """Group aggregates joined back to the rows; the aggregate side is one row per group, so a
    hot group is combined map-side and never gathered in one task. ``rows`` tells about how many rows
    there are if their groups are many (`lookup_side`)."""
    totals = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return join_on(df, lookup_side(totals, rows), keys, "left")


def share_within(df: DataFrame, keys: Sequence[str], value: str, out: str = "percent") -> DataFrame:
    return (attach_totals(df, keys, __sum=F.sum(value))
            .withColumn(out, F.col(value) / F.col("__sum") * 100).drop("__sum"))


def sign_agreement(importances: DataFrame, feature: str = "variable") -> DataFrame:
    """Largest share of runs that agree on a feature's sign."""
    signs = (importances.filter("importance <> 0").filter(F.col("sign").isin("POS", "NEG"))
             .select(feature, "sign", "seed").distinct()
             .groupBy(feature, "sign").agg(F.count(F.lit(1)).alias("n")))
    return (signs.groupBy(feature)
            .agg((F.max("n") / F.sum("n") * 100).alias("max_share")))


def confusion_shares(matrix: DataFrame, truth: str = "truth", predicted: str = "predicted",
                     blank_below: float = 10) -> DataFrame:
    """Whole percent within each true label, blank text for small cells."""
    out = share_within(matrix, [truth], "n").withColumn("percent", F.bround("percent", 0).cast("long"))
    return out.withColumn("label", F.when(F.col("percent") > blank_below, F.col("percent").cast("string"))
                          .otherwise(""))


def arcs(counts: DataFrame, order: str, value: str = "n", tie_break: Sequence[str] = ()) -> DataFrame:
    """Cumulative share of each level and where it starts."""
    total = counts.agg(F.sum(value).alias("total"))
    run = running(counts, [], order, {"__run": ("sum", value)}, tie_break=tie_break)
    whole = total.scalar()
    return run.withColumns({"arc_end": F.col("__run") / whole,
                            "arc_start": (F.col("__run") - F.col(value)) / whole}).drop("__run")


def rescale(df: DataFrame, keys: Sequence[str], value: str, top: float = 100.0,
            from_zero: bool = False, out: str = "scaled", rows: int = 0) -> DataFrame:
    """Min-max rescale to 0..top inside each group; a group without range gets the middle.

    ``from_zero`` counts a zero into the range, as if the group had one more row of zero.
    """
    lo, hi = F.min(value), F.max(value)
    if from_zero:
        lo, hi = F.least(lo, F.lit(0.0)), F.greatest(hi, F.lit(0.0))
    held = attach_totals(df, keys, rows, __lo=lo, __hi=hi)
    scaled = (F.when(F.col(value).isNull(), None)
              .when(F.col("__hi") == F.col("__lo"), F.lit(top / 2))
              .otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * top))
    return held.withColumn(out, scaled).drop("__lo", "__hi")


def bh_adjust(df: DataFrame, family: Sequence[str], p: str = "p_value", out: str = "adj_p") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values inside each family; a p that is NULL or NaN gets NULL.

    The rows of a family are counted to distinct p-values, both passes run over these, and the result is
    joined back once.
    """
    one = "__family"
    keys = list(family) or [one]
    base = df.withColumn(one, F.lit(1))
    levels = (base.filter(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__n")))
    ranked = running(levels, keys, p, {"__k": ("sum", "__n")})
    raw = (attach_totals(ranked, keys, __m=F.sum("__n"))
           .withColumn("__raw", F.col(p) * F.col("__m") / F.col("__k")))
    done = running(raw, keys, p, {out: ("min", "__raw")}, descending=True)
    return join_on(base, done.select(*keys, p, F.least(F.lit(1.0), F.col(out)).alias(out)), [*keys, p], "left").drop(one)


def top_with_ties(df: DataFrame, keys: Sequence[str], order: str, n: int, descending: bool = True) -> DataFrame:
    """The n best rows per group and all their ties.

    Rows are counted to (group, value) first; the values that reach into the n best are at most n for a
    group, and the rows that have them are kept by a join, so ties are never gathered in one task.
    """
    keys = list(keys)
    by = F.col(order).desc() if descending else F.col(order).asc()
    counts = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(by)
    few = counts.withColumn("__place", F.row_number().over(w)).filter(F.col("__place") <= n)
    best = few.withColumn("__before", F.sum("__n").over(w) - F.col("__n")).filter(F.col("__before") < n)
    return join_on(df, best.select(*keys, order), [*keys, order], "left_semi")


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of a declared order, without ties."""
    return df.orderBy(*order).limit(n)


def balanced_top(df: DataFrame, direction: str, values: Sequence[str], order: str, n: int) -> DataFrame:
    """The n best rows (with ties) of each listed direction."""
    return top_with_ties(df.filter(F.col(direction).isin(list(values))), [direction], order, n)
