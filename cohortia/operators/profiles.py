"""Sample and group profiles: principal components and rank correlation of group means."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.functions.scalar import correlation
from cohortia.operators.ordered import running
from cohortia.operators.prepare import knn_impute, normalize
from cohortia.operators.reshape import vectors
from cohortia.operators.summaries import group_means
from cohortia.operators.windows import top_with_ties
from cohortia.session import cut


def pca(long: DataFrame, k: int = 5, impute: bool = False, cohort: Cohort = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, loadings and explained variance of standardised measurements.

    Each component's sign is set so that its largest loading is positive.
    """
    c = cohort
    scaled = normalize(long, c)
    scaled = knn_impute(scaled, cohort=c) if impute else scaled
    rows = cut(vectors(scaled, c.sample, c.assay, c.value)).withColumn("x", array_to_vector("vector"))
    model = PCA(k=k, inputCol="x", outputCol="pc").fit(rows)
    mat = model.pc.toArray()
    sign = [1.0 if mat[abs(mat[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    signs = F.array(*[F.lit(s) for s in sign])
    scores = model.transform(rows).select(c.sample, F.posexplode(F.zip_with(vector_to_array("pc"), signs, lambda a, b: a * b))
                                          .alias("j", "score"))
    assays = running(scaled.select(c.assay).distinct(), [], c.assay, {"row": ("row_number", None)})
    spark = long.sparkSession
    load = spark.createDataFrame([(i + 1, [float(v * s) for v, s in zip(mat[i], sign)]) for i in range(len(mat))], "row long, v array<double>")
    loadings = (assays.join(load, "row").select(c.assay, F.posexplode("v").alias("j", "loading")))
    name = F.concat(F.lit("PC"), (F.col("j") + 1).cast("string")).alias("component")
    var = spark.createDataFrame([(f"PC{j + 1}", float(v)) for j, v in enumerate(model.explainedVariance)], "component string, share double")
    return scores.select(c.sample, name, "score"), loadings.select(c.assay, name, "loading"), var


def top_loadings(loadings: DataFrame, n: int = 8, components: int = 4) -> DataFrame:
    wanted = loadings.filter(F.col("component").isin([f"PC{i + 1}" for i in range(components)])).withColumn("size", F.abs("loading"))
    return top_with_ties(wanted, ["component"], "size", n).drop("size")


def group_correlation(long: DataFrame, cohort: Cohort = DEFAULT, lower_only: bool = False) -> DataFrame:
    """Spearman correlation between group-mean profiles, scaled per assay over groups.

    Assays missing in some group are left out of all comparisons.
    """
    c = cohort
    means = cut(group_means(long, [c.disease, c.assay], cohort=c).filter("mean_value IS NOT NULL"))
    n_groups = means.agg(F.countDistinct(c.disease).alias("n"))
    full = means.groupBy(c.assay).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("mean_value").alias("__sd"),
                                      F.avg("mean_value").alias("__m")).filter(F.col("__n") == n_groups.scalar())
    z = (means.join(full, c.assay).filter(F.col("__sd") > 0)
         .select(c.disease, c.assay, ((F.col("mean_value") - F.col("__m")) / F.col("__sd")).alias("z")))
    ranked = running(z, [c.disease], "z", {"__lo": ("rank", None), "__hi": ("count", None)}, peers=True)
    ranks = cut(ranked.select(c.disease, c.assay, ((F.col("__lo") + F.col("__hi")) / 2).alias("r")))
    a = ranks.select(F.col(c.disease).alias("a"), c.assay, F.col("r").alias("ra"))
    b = ranks.select(F.col(c.disease).alias("b"), c.assay, F.col("r").alias("rb"))
    pairs = a.join(b, c.assay)
    if lower_only:
        pairs = pairs.filter("a > b")
    return pairs.groupBy("a", "b").agg(correlation(F.col("ra"), F.col("rb")).alias("rho"))
