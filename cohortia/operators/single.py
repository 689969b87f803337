"""Logistic regression on one predictor for many groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.roc import auc, score_levels
from cohortia.session import cut, join_on


def logit_fit(df: DataFrame, keys: Sequence[str], x: str, case: Column, steps: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """Intercept and slope per group by Newton steps, each one grouped aggregate over the rows.

    Steps go on until no group moves by ``tolerance``; groups that are separated perfectly have no end,
    and are told by ``converged`` after ``steps``.
    """
    rows = df.select(*keys, F.col(x).alias("x"), case.cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    rows = cut(rows)
    shape = rows.groupBy(*keys).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.avg("y").alias("rate"))
    beta = cut(shape.filter("s > 0 AND rate > 0 AND rate < 1").select(
        *keys, "m", "s", F.log(F.col("rate") / (1 - F.col("rate"))).alias("b0"), F.lit(0.0).alias("b1"), F.lit(1.0).alias("move")))
    for _ in range(steps):
        at = (join_on(rows, beta, keys, "inner").withColumn("z", (F.col("x") - F.col("m")) / F.col("s"))
              .withColumn("p", 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("z")))))
              .withColumn("w", F.col("p") * (1 - F.col("p"))))
        sums = at.groupBy(*keys).agg(*[F.expr(e) for e in (
            "sum(w) AS h00", "sum(w * z) AS h01", "sum(w * z * z) AS h11", "sum(y - p) AS g0", "sum((y - p) * z) AS g1")])
        det = "(h00 * h11 - h01 * h01)"
        move = lambda e: F.expr(f"greatest(least(coalesce(({e}) / nullif({det}, 0D), 0D), 5D), -5D)")
        beta = cut(join_on(beta, sums, keys, "inner").withColumn("d0", move("h11 * g0 - h01 * g1"))
                   .withColumn("d1", move("h00 * g1 - h01 * g0"))
                   .select(*keys, "m", "s", (F.col("b0") + F.col("d0")).alias("b0"), (F.col("b1") + F.col("d1")).alias("b1"),
                           F.greatest(F.abs("d0"), F.abs("d1")).alias("move")))
        if (beta.agg(F.max("move")).first()[0] or 0) < tolerance:
            break
    return beta.select(*keys, (F.col("b0") - F.col("b1") * F.col("m") / F.col("s")).alias("intercept"),
                       (F.col("b1") / F.col("s")).alias("slope"), (F.col("move") < tolerance).alias("converged"))


def predict(df: DataFrame, fit: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    eta = F.col("intercept") + F.col("slope") * F.col(x)
    return join_on(df, fit, keys, "inner").withColumn("probability", 1 / (1 + F.exp(-eta))).drop("intercept", "slope", "converged")


def single_assay_auc(train: DataFrame, test: DataFrame, keys: Sequence[str], x: str, case: Column) -> DataFrame:
    """Held-out area of the one-predictor model per group.

    The model is monotone in its predictor and its slope has the sign of the difference of
    class means, so the area needs no fit: scores keep or flip their order by that sign.
    """
    means = (train.withColumn("__case", case).filter(F.col(x).isNotNull()).groupBy(*keys)
             .agg(F.avg(F.when(F.col("__case"), F.col(x))).alias("m1"), F.avg(F.when(~F.col("__case"), F.col(x))).alias("m0"))
             .select(*keys, F.when(F.col("m1") >= F.col("m0"), 1.0).otherwise(-1.0).alias("direction")))
    levels = score_levels(test, keys, x, case)
    return auc(join_on(levels, means, keys, "inner").withColumn("score", F.col("score") * F.col("direction")), keys)
