"""ROC curves and areas for any number of groups at once.

Rows are first counted per (group, score); every curve, area and interval is arithmetic on
running counts over those score levels. A case is always the event and higher scores point
to it, so an area below one half is reported as such.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.scalar import correlation
from cohortia.operators.ordered import running
from cohortia.operators.windows import attach_totals

Z95 = 1.959963984540054


def score_levels(df: DataFrame, keys: Sequence[str], score: str, case: Column) -> DataFrame:
    """Cases and controls per distinct score; rows without score or class are left out."""
    live = df.withColumn("__case", case).filter(F.col(score).isNotNull() & F.col("__case").isNotNull())
    return live.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col("__case")).alias("cases"), F.count_if(~F.col("__case")).alias("controls"))


def cumulate(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds counts below each score and the group totals."""
    run = running(levels, keys, "score", {"__c": ("sum", "cases"), "__n": ("sum", "controls")})
    below = run.withColumns({"cases_below": F.col("__c") - F.col("cases"),
                             "controls_below": F.col("__n") - F.col("controls")}).drop("__c", "__n")
    if keys:
        return attach_totals(below, keys, n_cases=F.sum("cases"), n_controls=F.sum("controls"))
    whole = levels.agg(F.sum("cases").alias("c"), F.sum("controls").alias("n")).select(F.struct("c", "n").alias("t"))
    return (below.withColumn("__t", whole.scalar())
            .withColumns({"n_cases": F.col("__t.c"), "n_controls": F.col("__t.n")}).drop("__t"))


def roc_curve(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sensitivity and specificity of calling scores at or above each threshold, with the two ends."""
    c = cumulate(levels, keys).filter("n_cases > 0 AND n_controls > 0")
    inner = c.select(*keys, F.col("score").alias("threshold"),
                     (1 - F.col("cases_below") / F.col("n_cases")).alias("sensitivity"),
                     (F.col("controls_below") / F.col("n_controls")).alias("specificity"))
    ends = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(a).alias("sensitivity"), F.lit(b).alias("specificity"))
                     for t, a, b in ((float("-inf"), 1.0, 0.0), (float("inf"), 0.0, 1.0))])
    whole = c.groupBy(*keys).agg(F.first(F.lit(1))) if keys else c.limit(1)
    return inner.unionByName(whole.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*"))


def auc(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the curve with its 95 % interval from the placements of both classes.

    Groups without both classes have a NULL area, with fewer than two of either no interval.
    """
    c = cumulate(levels, keys)
    p, n = F.col("n_cases"), F.col("n_controls")
    v1 = (F.col("controls_below") + F.col("controls") / 2) / F.nullif(n, F.lit(0))
    v0 = 1 - (F.col("cases_below") + F.col("cases") / 2) / F.nullif(p, F.lit(0))
    w = c.withColumns({"v1": v1, "v0": v0})
    agg = w.groupBy(*keys).agg(
        F.max("n_cases").alias("n_cases"), F.max("n_controls").alias("n_controls"),
        F.sum(F.col("cases") * F.col("v1")).alias("s1"), F.sum(F.col("cases") * F.col("v1") * F.col("v1")).alias("q1"),
        F.sum(F.col("controls") * F.col("v0")).alias("s0"), F.sum(F.col("controls") * F.col("v0") * F.col("v0")).alias("q0"))
    both = (p > 0) & (n > 0)
    spread = lambda s, q, m: F.greatest((F.col(q) - F.col(s) * F.col(s) / m) / (m - 1), F.lit(0.0)) / m
    out = agg.withColumn("auc", F.when(both, F.col("s1") / p))
    out = out.withColumn("se", F.when((p > 1) & (n > 1), F.sqrt(spread("s1", "q1", p) + spread("s0", "q0", n))))
    return out.withColumns({"ci_low": F.when(F.col("se").isNotNull(), F.greatest(F.col("auc") - Z95 * F.col("se"), F.lit(0.0))),
                            "ci_high": F.when(F.col("se").isNotNull(), F.least(F.col("auc") + Z95 * F.col("se"), F.lit(1.0)))}
                           ).drop("s1", "q1", "s0", "q0")


def subgroup_levels(df: DataFrame, keys: Sequence[str], score: str, case: Column, group: str,
                    groups: Sequence[str]) -> DataFrame:
    """Score levels of each case subgroup against all controls. Controls are counted per score
    before they are repeated for every subgroup."""
    live = df.withColumn("__case", case)
    cases = score_levels(live.filter("__case").filter(F.col(group).isin(list(groups))), [*keys, group], score, F.col("__case"))
    controls = (score_levels(live.filter("NOT __case"), keys, score, F.col("__case"))
                .withColumn(group, F.explode(F.array(*[F.lit(g) for g in groups]))))
    return (cases.unionByName(controls).groupBy(*keys, group, "score")
            .agg(F.sum("cases").alias("cases"), F.sum("controls").alias("controls")))


def label_scores(wide: DataFrame, ids: Sequence[str], labels: Sequence[str], prefix: str = "p_") -> DataFrame:
    """One row per (row, label) from one probability column per label."""
    named = wide.withColumnsRenamed({f"{prefix}{v}": v for v in labels})
    return named.unpivot(list(ids), list(labels), "label", "score")


def one_vs_rest(long: DataFrame, keys: Sequence[str], truth: str = "truth") -> DataFrame:
    return score_levels(long, [*keys, "label"], "score", F.col("label") == F.col(truth))


def pairwise_auc(long: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), truth: str = "truth") -> DataFrame:
    """Area of separating label i from label j by the score of i, for every ordered pair.

    Counts per (label, truth, score) are taken first; only those are repeated over partners.
    """
    counts = long.groupBy(*keys, "label", truth, "score").agg(F.count(F.lit(1)).alias("n"))
    own = (counts.filter(F.col("label") == F.col(truth))
           .withColumn("partner", F.explode(F.array(*[F.lit(v) for v in labels]))).filter("partner <> label")
           .select(*keys, "label", "partner", "score", F.col("n").alias("cases"), F.lit(0).cast("long").alias("controls")))
    other = counts.filter(F.col("label") != F.col(truth)).select(
        *keys, "label", F.col(truth).alias("partner"), "score", F.lit(0).cast("long").alias("cases"), F.col("n").alias("controls"))
    levels = (own.unionByName(other).groupBy(*keys, "label", "partner", "score")
              .agg(F.sum("cases").alias("cases"), F.sum("controls").alias("controls")))
    return auc(levels, [*keys, "label", "partner"])


def hand_till(long: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), truth: str = "truth") -> DataFrame:
    """Mean pairwise area over all label pairs present."""
    pairs = pairwise_auc(long, labels, keys, truth)
    return pairs.groupBy(*keys).agg(F.avg("auc").alias("auc"), (F.count("auc") / 2).cast("long").alias("n_pairs"))


def regression_metrics(df: DataFrame, keys: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Root mean squared error, squared correlation (NULL where truth or prediction is constant) and rows."""
    gap = F.col(truth) - F.col(predicted)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"),
                                 F.pow(correlation(F.col(truth), F.col(predicted)), 2).alias("r2"), F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, keys: Sequence[str], truth: str, probability: str, cutoff: float = 0.5) -> DataFrame:
    """Accuracy and Brier score of a 0/1 truth."""
    hit = (F.col(probability) > cutoff) == (F.col(truth) == 1)
    gap = F.col(truth) - F.col(probability)
    return df.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("accuracy"), F.avg(gap * gap).alias("brier"))


def most_likely(long: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Label with the highest score per row; the first label by name on a tie."""
    best = F.min_by("label", F.struct(-F.col("score"), F.col("label")))
    return long.groupBy(*ids).agg(best.alias("predicted"))


def confusion(df: DataFrame, truth: str, predicted: str, labels: Sequence) -> DataFrame:
    """Counts over the full grid of labels."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    every = F.array(*[F.lit(v) for v in labels])
    grid = (df.sparkSession.range(1).select(F.explode(every).alias("truth")).withColumn("predicted", F.explode(every)))
    return grid.join(counts, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
