"""Lasso models over the test tables: the library's 20 penalties and 10 folds, all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortia import sources
from cohortia.functions import scalar as S
from cohortia.operators import prepare as P
from cohortia.operators import roc as R
from cohortia.operators import stacked as ST
from cohortia.operators.ordered import running
from cohortia.operators.reshape import vectors
from cohortia.plans.bindings import emb_meta, emb_values, sql
from cohortia.plans.ml_catalog import LABELS, eligible
from cohortia.plans.registry import query
from cohortia.session import cut, scratch_path


def points(spark, d, gaps=False):
    """(id, x): each sample's values in assay order."""
    return vectors(emb_values(spark, d, gaps), "sample_id", "assay", "value").select(F.col("sample_id").alias("id"), F.col("vector").alias("x"))


def assays(spark, d):
    names = running(emb_values(spark, d).select("assay").distinct(), [], "assay", {"row": ("row_number", None)})
    return names.select((F.col("row") - 1).cast("int").alias("row"), "assay")


def members(rows, seeds, prop=0.7, v=10):
    """Test rows and folds for (task, classes, id, label, stratum) rows, split for each seed by hash order within each stratum."""
    keys = ["task", "classes", "label", *(["used"] if "used" in rows.columns else [])]
    each = rows.withColumn("__s", F.concat_ws("|", "task", "stratum"))
    split = each.join(P.split(each, "id", "__s", seeds, prop).select("seed", "id", "__s", "role"), ["id", "__s"])
    train = split.filter("role = 'train'")
    folds = P.folds(train, "id", "__s", v=v, keys=["task", "seed"]).select("task", "seed", "id", "fold")
    return (split.join(folds, ["task", "seed", "id"], "left")
            .select("seed", "id", *keys, F.coalesce("fold", F.lit(-1)).alias("fold")))


def disease_rows(spark, d, case, controls=None, task=None):
    role = S.case_control(F.col("disease"), case, controls, "1", "0").cast("double")
    meta = emb_meta(spark, d).withColumn("label", role).filter("label IS NOT NULL")
    return meta.select(F.lit(task or case).alias("task"), F.lit(2).alias("classes"), F.col("sample_id").alias("id"), "label", F.col("disease").alias("stratum"))


def trait_rows(spark, d, trait):
    rows = P.quartile_strata(emb_meta(spark, d).withColumn("label", F.col(trait)), "label")
    return rows.select(F.lit(trait).alias("task"), F.lit(0).alias("classes"), F.col("sample_id").alias("id"), "label", F.col("stratum").cast("string").alias("stratum"))


def binary(spark, d, case="D1", controls=None, seed=213, balance=False):
    who = members(disease_rows(spark, d, case, controls), [seed])
    return cut(ST.fit_tasks(points(spark, d), cut(who), recipe=ST.Recipe(balance=balance))), who


def shown(models, spark, d, names):
    """Class probabilities of the test rows by name, and the likeliest class."""
    p = ST.predictions(models).join(emb_meta(spark, d).select(F.col("sample_id").alias("id"), "disease"), "id")
    chance = F.when(F.size("fit") == 1, F.array(1 - F.col("fit")[0], F.col("fit")[0])).otherwise(F.col("fit"))
    p = p.withColumn("c", chance)
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("c", F.array_max("c")).cast("int"))
    return p.select(F.col("id").alias("sample_id"), "disease", "label", *[F.col("c")[i].alias(f"p_{x}") for i, x in enumerate(names)], best.alias("predicted"))


@query("K5_lasso_binary")
def lasso_binary(spark, d):
    return shown(binary(spark, d)[0], spark, d, ["control", "case"])


def optimality(spark, d, models, who):
    """How many assays there are and how many break the conditions of a lasso optimum by over 2 % of the penalty: the mean gradient is within the
    penalty where a coefficient is zero, and equals it against the sign elsewhere. Worked out from all training rows, scaled anew."""
    values = emb_values(spark, d).join(who.filter("fold >= 0").select(F.col("id").alias("sample_id"), "label"), "sample_id")
    stats = values.groupBy("assay").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    z = cut(values.join(stats, "assay").select("sample_id", "label", "assay", ((F.col("value") - F.col("m")) / F.col("sd")).alias("z")))
    b = cut(ST.coefficients(models, assays(spark, d)).select("assay", "estimate"))
    model = models.select(F.col("intercept")[0].alias("b0"), "penalty", F.size("test.fit").alias("n")).first()
    kind = who.select("classes").first()[0]
    eta = z.join(b, "assay").groupBy("sample_id").agg((F.sum(F.col("z") * F.col("estimate")) + model["b0"]).alias("eta"))
    fit = F.col("eta") if not kind else 1 / (1 + F.exp(-F.col("eta")))
    grad = z.join(eta, "sample_id").groupBy("assay").agg(F.avg((fit - F.col("label")) * F.col("z")).alias("g")).join(b, "assay")
    off = F.when(F.col("estimate") == 0, F.abs("g") - model["penalty"]).otherwise(F.abs(F.col("g") + F.signum("estimate") * model["penalty"]))
    return grad.agg(F.count(F.lit(1)).alias("assays"), F.count_if(off > 0.02 * model["penalty"]).alias("violations"))


@query("K5_lasso_binary_optimality", "SELECT CAST(max(len(embedding)) AS BIGINT) AS assays, 0::BIGINT AS violations FROM embeddings")
def lasso_binary_optimality(spark, d):
    return optimality(spark, d, *binary(spark, d))


def linear(spark, d, trait="age"):
    who = members(trait_rows(spark, d, trait), [213])
    return cut(ST.fit_tasks(points(spark, d), cut(who))), who


@query("K6_lasso_linear_optimality", "SELECT CAST(max(len(embedding)) AS BIGINT) AS assays, 0::BIGINT AS violations FROM embeddings")
def lasso_linear_optimality(spark, d):
    return optimality(spark, d, *linear(spark, d))


@query("K5_lasso_binary_balanced_auc")
def lasso_balanced(spark, d):
    models, _ = binary(spark, d, controls=["D0"], balance=True)
    p = ST.predictions(models).withColumn("p_case", F.col("fit")[0])
    return R.auc(R.score_levels(p, [], "p_case", F.col("label") == 1), []).join(models.select("penalty"))


@query("K6_lasso_linear")
def lasso_linear(spark, d):
    models, _ = linear(spark, d)
    p = ST.predictions(models).withColumn("prediction", F.col("fit")[0])
    return R.regression_metrics(p, [], "label", "prediction").join(models.select("penalty"))


def multinomial(spark, d):
    place = (F.array_position(F.array(*[F.lit(v) for v in LABELS]), F.col("disease")) - 1).cast("double")
    rows = emb_meta(spark, d).select(F.lit("all").alias("task"), F.lit(len(LABELS)).alias("classes"), F.col("sample_id").alias("id"), place.alias("label"),
                                     F.col("disease").alias("stratum")).filter("label >= 0")
    who = members(rows, [213])
    return cut(ST.fit_tasks(points(spark, d), cut(who))), who


@query("K7_lasso_multinomial")
def lasso_multinomial(spark, d):
    return shown(multinomial(spark, d)[0], spark, d, LABELS).drop("label")


@query("K9_transfer_predictions")
def transfer(spark, d):
    """Predictions for a second platform that lacks ten assays and has gaps, by a saved model; gaps enter at the training mean."""
    models, who = binary(spark, d, controls=["D0"])
    path = sources.save_table(models, scratch_path(spark, "model"))
    saved = sources.load_table(spark, path)
    trained = emb_values(spark, d).join(who.filter("fold >= 0").select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    stats = trained.groupBy("assay").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    b = ST.coefficients(saved, assays(spark, d)).join(stats, "assay")
    other = emb_values(spark, d, gaps=True).filter("assay >= 'A10'").join(b, "assay")
    eta = other.groupBy("sample_id").agg(F.coalesce(F.sum((F.col("value") - F.col("m")) / F.col("sd") * F.col("estimate")), F.lit(0.0)).alias("eta"))
    case = 1 / (1 + F.exp(-(F.col("eta") + F.col("b0"))))
    out = eta.join(saved.select(F.col("intercept")[0].alias("b0"))).join(emb_meta(spark, d).select("sample_id", "disease"), "sample_id")
    return out.select("sample_id", "disease", (1 - case).alias("p_control"), case.alias("p_case"), F.when(case > 0.5, "case").otherwise("control").alias("predicted"))


@query("K17_feature_importance")
def feature_importance(spark, d):
    b = ST.coefficients(binary(spark, d)[0], assays(spark, d))
    return b.select(F.lit("1_D1").alias("label"), "estimate", "assay", F.abs("estimate").alias("importance"),
                    F.when(F.col("estimate") > 0, "POS").when(F.col("estimate") < 0, "NEG").alias("sign")).orderBy(F.col("importance").desc(), "assay")


SIZES = range(5, 201, 5)


@query("K20_feature_sweep")
def feature_sweep(spark, d):
    """Three traits refitted with their 5, 10, .. best assays: each (trait, size) is a task."""
    sex = emb_meta(spark, d).select(F.lit("sex").alias("task"), F.lit(2).alias("classes"), F.col("sample_id").alias("id"),
                                    (F.col("sex") == "M").cast("double").alias("label"), F.col("sex").alias("stratum"))
    rows = cut(sex.unionByName(trait_rows(spark, d, "age")).unionByName(trait_rows(spark, d, "bmi")))
    x = cut(points(spark, d))
    whole = cut(ST.fit_tasks(x, cut(members(rows, [213]))))
    strength = whole.select("task", F.posexplode(F.col("estimates")[0]).alias("row", "b"))
    order = strength.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.abs("b")).alias("s"), "row"))), lambda s: s["row"]).alias("order"))
    sized = (order.withColumn("n", F.explode(F.array(*[F.lit(n) for n in SIZES]))).withColumn("n_used", F.least("n", F.size("order")))
             .withColumn("used", F.slice("order", F.lit(1), F.col("n_used"))))
    each = sized.groupBy("task", "n_used").agg(F.first("used").alias("used"))  # sizes beyond the assays are one task
    tasks = rows.join(each, "task").withColumn("task", F.concat_ws(":", "task", "n_used"))
    fits = cut(ST.fit_tasks(x, cut(members(tasks, [213]))))
    return sized.select("task", "n", "n_used").join(metrics(fits).select(F.split("task", ":")[0].alias("task"), F.split("task", ":")[1].cast("int").alias("n_used"), "metric"),
                                                    ["task", "n_used"]).select("task", "n", "n_used", "metric")


def metrics(models):
    """Held-out metric of every (task, seed): area under the curve (mean over pairs of classes), or the root mean squared error."""
    p = ST.predictions(models)
    events = p.filter(F.size("fit") == 1).join(models.select("task", "seed", F.size(F.col("estimates")).alias("c")), ["task", "seed"])
    numbers = events.groupBy("task", "seed").agg(F.sqrt(F.avg(F.pow(F.col("fit")[0] - F.col("label"), 2))).alias("rmse"), F.max((F.col("label") > 1) | ((F.col("label") % 1) != 0)).alias("number"))
    two = events.join(numbers.filter("NOT number").select("task", "seed"), ["task", "seed"]).withColumn("score", F.col("fit")[0])
    auc = R.auc(R.score_levels(two, ["task", "seed"], "score", F.col("label") == 1), ["task", "seed"]).select("task", "seed", F.col("auc").alias("metric"))
    many = p.filter(F.size("fit") > 1).select("task", "seed", "label", F.posexplode("fit").alias("of", "score"))
    # area of class a against b, by a's score, for each ordered pair
    pairs = (many.join(many.select("task", "seed", F.col("of").alias("other")).distinct(), ["task", "seed"]).filter("of != other")
             .filter((F.col("label") == F.col("of")) | (F.col("label") == F.col("other"))))
    hand = (R.auc(R.score_levels(pairs, ["task", "seed", "of", "other"], "score", F.col("label") == F.col("of")), ["task", "seed", "of", "other"])
            .groupBy("task", "seed").agg(F.avg("auc").alias("metric")))
    return auc.unionByName(hand).unionByName(numbers.filter("number").select("task", "seed", F.col("rmse").alias("metric")))


def sweep(spark, d, seeds):
    """Every eligible disease against Healthy, every class's diseases among themselves, and two traits, for every seed."""
    meta = emb_meta(spark, d)
    # one master split of all diseases for each seed, by disease; a task takes its diseases' rows of it
    cases = eligible(spark, d).select(F.col("disease").alias("task"))
    binary_rows = (meta.join(cases, (F.col("disease") == F.col("task")) | (F.col("disease") == "D0"))
                   .select("task", F.lit(2).alias("classes"), F.col("sample_id").alias("id"), (F.col("disease") == F.col("task")).cast("double").alias("label"), F.col("disease").alias("stratum")))
    labels = (meta.filter("class <> 'Healthy'").select("class", "disease").distinct()
              .withColumn("label", (F.row_number().over(Window.partitionBy("class").orderBy("disease")) - 1).cast("double"))
              .withColumn("classes", F.count(F.lit(1)).over(Window.partitionBy("class")).cast("int")))
    class_rows = (meta.join(labels, ["class", "disease"]).filter("classes > 1")
                  .select(F.col("class").alias("task"), "classes", F.col("sample_id").alias("id"), "label", F.col("disease").alias("stratum")))
    diseases = members(cut(binary_rows.unionByName(class_rows)), seeds)
    traits = members(cut(trait_rows(spark, d, "age").unionByName(trait_rows(spark, d, "bmi"))), seeds, prop=0.8)
    return cut(ST.fit_tasks(cut(points(spark, d)), cut(diseases.unionByName(traits))))


@query("K21_task_sweep")
def task_sweep(spark, d):
    """Ten seeds; metric, penalty and split sizes of every (task, seed)."""
    models = sweep(spark, d, range(1, 11))
    return models.select("task", "seed", "n_train", "n_test", "penalty", "broken").join(metrics(models), ["task", "seed"])


_STRATA = """q AS (SELECT quantile_cont(age, 0.25) AS a1, quantile_cont(age, 0.5) AS a2, quantile_cont(age, 0.75) AS a3,
    quantile_cont(bmi, 0.25) AS b1, quantile_cont(bmi, 0.5) AS b2, quantile_cont(bmi, 0.75) AS b3 FROM emb_meta)"""


@query("K21_task_splits", sql("emb_meta", _STRATA, "e AS (SELECT disease FROM emb_meta WHERE disease <> 'D0' GROUP BY 1 HAVING count(*) >= 48)",
    "c AS (SELECT class FROM emb_meta WHERE class <> 'Healthy' GROUP BY 1 HAVING count(DISTINCT disease) > 1)",
    """r AS (SELECT e.disease AS task, m.disease AS stratum, count(*) AS n, 0.7 AS prop FROM e JOIN emb_meta m ON m.disease IN (e.disease, 'D0') GROUP BY 1, 2
    UNION ALL SELECT class, disease, count(*), 0.7 FROM emb_meta WHERE class IN (SELECT class FROM c) GROUP BY 1, 2
    UNION ALL SELECT 'age', CAST(CASE WHEN age <= a1 THEN 1 WHEN age <= a2 THEN 2 WHEN age <= a3 THEN 3 ELSE 4 END AS VARCHAR), count(*), 0.8 FROM emb_meta, q GROUP BY 1, 2
    UNION ALL SELECT 'bmi', CAST(CASE WHEN bmi <= b1 THEN 1 WHEN bmi <= b2 THEN 2 WHEN bmi <= b3 THEN 3 ELSE 4 END AS VARCHAR), count(*), 0.8 FROM emb_meta, q GROUP BY 1, 2)""",
    body="""SELECT task, CAST(s AS INTEGER) AS seed, CAST(sum(floor(prop * n)) AS BIGINT) AS n_train, CAST(sum(n - floor(prop * n)) AS BIGINT) AS n_test,
    TRUE AS optimal FROM r, range(1, 3) t(s) GROUP BY 1, 2"""))
def task_splits(spark, d):
    """Split sizes of every (task, seed) for two seeds, and whether its model is an optimum within 2 % of the penalty."""
    return sweep(spark, d, range(1, 3)).select("task", "seed", "n_train", "n_test", (F.col("broken") <= 0.02).alias("optimal"))
