"""Lasso models on long measurements with Spark ML.

Facts become one feature vector per sample (never one column per assay). Folds are assigned
by hash, so a rerun fits the same models. Many small fits run from a bounded thread pool.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, RegressionEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.operators.ordered import running
from cohortia.operators.prepare import folds, near_zero_variance
from cohortia.operators.roc import hand_till
from cohortia.session import cut, scratch_path
from cohortia.sources.sinks import load_table, save_table

# 20 penalties evenly spaced on the log10 scale from 1e-10 to 1.
PENALTIES = tuple(10.0 ** (-10 + 10 * i / 19) for i in range(20))


def feature_table(train: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Assays a model uses, with the mean and standard deviation of the training samples.

    Assays of near-zero variance are left out.
    """
    c = cohort
    flat = near_zero_variance(train, cohort=c).filter("nzv").select(c.assay)
    stats = (train.join(flat, c.assay, "left_anti").groupBy(c.assay)
             .agg(F.avg(c.value).alias("mean"), F.stddev_samp(c.value).alias("sd")).filter("sd > 0"))
    return running(stats, [], c.assay, {"row": ("row_number", None)}).withColumn("row", (F.col("row") - 1).cast("int"))


def feature_vectors(long: DataFrame, features: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Scaled feature vector of every sample in the model's feature order.

    Values are scaled by the training statistics; an assay the sample or its whole cohort
    lacks enters at the training mean. Every sample of ``long`` has a row, even without any value.
    """
    c = cohort
    width = features.agg((F.max("row") + 1).alias("w")).first()["w"] or 0

    scaled = (long.filter(F.col(c.value).isNotNull()).join(features, c.assay)
              .select(c.sample, F.struct("row", ((F.col(c.value) - F.col("mean")) / F.col("sd")).alias("z")).alias("s")))
    packed = (long.select(c.sample).distinct().join(scaled.groupBy(c.sample).agg(F.collect_list("s").alias("p")), c.sample, "left")
              .withColumn("p", F.coalesce("p", F.array().cast("array<struct<row:int,z:double>>"))))
    every = F.array(*[F.lit(i) for i in range(0)]).cast("array<int>") if not width else F.sequence(F.lit(0), F.lit(width - 1))
    absent = F.transform(F.array_except(every, F.col("p")["row"]), lambda i: F.struct(i.alias("row"), F.lit(0.0).alias("z")))
    whole = F.transform(F.array_sort(F.concat("p", absent)), lambda s: s["z"])
    return packed.select(c.sample, array_to_vector(whole).alias("features"))


class HandTillEvaluator(Evaluator):
    """Mean pairwise area under the curve of class probabilities."""

    def __init__(self, n_labels: int):
        super().__init__()
        self.n_labels = n_labels

    def _evaluate(self, dataset: DataFrame) -> float:
        long = dataset.select(F.col("label").cast("int").alias("truth"),
                              F.posexplode(vector_to_array("probability")).alias("label", "score"))
        return hand_till(long, list(range(self.n_labels))).first()["auc"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


@dataclass
class Lasso:
    """A tuned model with what is needed to read and reuse it."""

    kind: str
    model: PipelineModel
    penalty: float
    cv: list[tuple[float, float]]
    features: DataFrame
    labels: list

    @property
    def inner(self) -> Model:
        return self.model.stages[-1]

    def predict(self, vectors: DataFrame) -> DataFrame:
        return self.model.transform(vectors)

    def importance(self) -> DataFrame:
        """Coefficient of every assay by label, with absolute size and sign (zero where not chosen)."""
        m = self.inner
        mat = m.coefficientMatrix.toArray() if self.kind != "linear" else np.array([m.coefficients.toArray()])
        names = self.labels if self.kind == "multinomial" else [self.labels[-1] if self.labels else "value"]
        rows = [(str(n), int(j), float(mat[i, j])) for i, n in enumerate(names) for j in range(mat.shape[1])]
        table = self.features.sparkSession.createDataFrame(rows, "label string, row int, estimate double")
        return (table.join(self.features.select("row", self.features.columns[0]), "row").drop("row")
                .withColumns({"importance": F.abs("estimate"), "sign": F.when(F.col("estimate") > 0, "POS").when(F.col("estimate") < 0, "NEG")}))


def _estimator(kind: str, max_iter: int):
    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol="label", elasticNetParam=1.0, standardization=False, maxIter=max_iter)
    family = "binomial" if kind == "binary" else "multinomial"
    return LogisticRegression(featuresCol="features", labelCol="label", family=family, elasticNetParam=1.0,
                              standardization=False, maxIter=max_iter)


def _evaluator(kind: str, n_labels: int) -> Evaluator:
    if kind == "linear":
        return RegressionEvaluator(metricName="rmse")
    if kind == "binary":
        return BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)
    return HandTillEvaluator(n_labels)


def fit_lasso(rows: DataFrame, features: DataFrame, kind: str, labels: Sequence = (), id_column: str = "sample_id",
              stratum: str | None = None, penalties: Iterable[float] = PENALTIES, v: int = 10, seed: int = 213,
              parallelism: int = 4, max_iter: int = 100) -> Lasso:
    """Tune the penalty by stratified folds and refit on all rows.

    ``rows`` holds id, ``features`` and a numeric ``label`` (0 to k-1 for classes). Binary
    models are chosen by area under the curve, multinomial ones by the mean pairwise area,
    linear ones by root mean squared error.
    """
    by = stratum or "label"
    fold = folds(rows, id_column, by, v=v, seed=seed).select(id_column, "fold")
    data = cut(rows.join(fold, id_column))
    est = _estimator(kind, max_iter)
    grid = ParamGridBuilder().addGrid(est.regParam, list(penalties)).build()
    evaluator = _evaluator(kind, len(labels))
    cv = CrossValidator(estimator=Pipeline(stages=[est]), estimatorParamMaps=grid, evaluator=evaluator, numFolds=v,
                        foldCol="fold", parallelism=parallelism)
    fitted = cv.fit(data)
    scores = list(zip([g[est.regParam] for g in grid], fitted.avgMetrics))
    pick = max if evaluator.isLargerBetter() else min
    return Lasso(kind, fitted.bestModel, pick(scores, key=lambda s: s[1])[0], scores, features, list(labels))


def label_codes(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Numeric ``label`` by position in the declared list; other rows drop out."""
    place = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(column))
    return df.withColumn("label", (place - 1).cast("double")).filter("label >= 0")


def probabilities(predicted: DataFrame, labels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    p = vector_to_array("probability")
    return predicted.select(*keep, *[p[i].alias(f"p_{v}") for i, v in enumerate(labels)],
                            F.element_at(F.array(*[F.lit(v) for v in labels]), (F.col("prediction") + 1).cast("int")).alias("predicted"))


def feature_sweep(train: DataFrame, test: DataFrame, ranked: DataFrame, kind: str, sizes: Sequence[int] = tuple(range(5, 201, 5)),
                  penalty: float = 0.01, workers: int = 4, max_iter: int = 100) -> DataFrame:
    """Held-out metric of models refitted on the n best features, for every n.

    ``ranked`` (row, place) orders the feature positions, best first. A size above the number of
    features uses all of them (``n_used``).
    """
    order = [r["row"] for r in ranked.orderBy("place").select("row").collect()]
    evaluator = _evaluator(kind, 2)
    train, test = train.persist(), test.persist()

    def one(n: int) -> tuple[int, int, float]:
        slicer = VectorSlicer(inputCol="features", outputCol="best", indices=order[:n])
        est = _estimator(kind, max_iter).setFeaturesCol("best").setRegParam(penalty)
        model = Pipeline(stages=[slicer, est]).fit(train)
        return n, min(n, len(order)), float(evaluator.evaluate(model.transform(test)))

    try:
        with ThreadPoolExecutor(workers) as pool:
            made = {u: m for _, u, m in pool.map(one, sorted({min(n, len(order)) for n in sizes}))}
            out = [(n, min(n, len(order)), made[min(n, len(order))]) for n in sizes]
    finally:
        train.unpersist()
        test.unpersist()
    return train.sparkSession.createDataFrame(out, "n int, n_used int, metric double")


def task_sweep(spark: SparkSession, tasks: Sequence[tuple[str, int]], run, workers: int = 4, path: str | None = None) -> DataFrame:
    """Run ``run(task, seed) -> DataFrame`` for every task from a bounded pool.

    Each result is written as its own partition of one table, so a restarted sweep with the
    same ``path`` goes on with the tasks that have no finished partition yet.
    """
    path = path or scratch_path(spark, "tasks")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def one(item: tuple[str, int]) -> None:
        task, seed = item
        part = f"{path}/task={task}/seed={seed}"
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS")):
            save_table(run(task, seed), part, mode="overwrite")

    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(one, tasks))
    return load_table(spark, path)
