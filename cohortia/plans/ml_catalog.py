"""Model evaluation and model fitting over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.operators import prepare as P
from cohortia.operators import roc as R
from cohortia.operators import single as SG
from cohortia.operators import summaries as D
from cohortia.operators import windows as W
from cohortia.plans.bindings import emb_meta, emb_values, line_meta, scored, sql, table
from cohortia.plans.registry import query
from cohortia.plans.summaries_catalog import _BOX, _IMP_SQL, BOX_COLS, importances, rounded
from cohortia.session import lookup_side, sorted_by
from cohortia.operators import layers as L

LABELS = [f"D{i}" for i in range(10)]


def r6(col):
    return F.round(col, 6)


# --- K1-K3, K22: splits and cohorts ---------------------------------------------------------

def _split_sql(rows: str, seeds: str, stratum: str) -> str:
    return f"""s AS (SELECT CAST(seed AS INTEGER) AS seed, sample_id, {stratum}, row_number() OVER (PARTITION BY seed, {stratum}
        ORDER BY md5(sample_id || '|' || seed), sample_id) AS k, count(*) OVER (PARTITION BY seed, {stratum}) AS n
        FROM {rows} CROSS JOIN (SELECT unnest({seeds}) AS seed))"""


@query("K1_stratified_split", sql("line_meta", _split_sql("line_meta", "[213]", "disease"),
    body="SELECT seed, sample_id, disease, CASE WHEN k <= floor(0.7 * n) THEN 'train' ELSE 'test' END AS role FROM s"))
def stratified_split(spark, d):
    return P.split(line_meta(spark, d), "sample_id", "disease")


@query("K1_numeric_strata_split", sql("line_meta", "q AS (SELECT quantile_cont(age, 0.25) AS a, quantile_cont(age, 0.5) AS b, quantile_cont(age, 0.75) AS c FROM line_meta)",
    "m AS (SELECT sample_id, CASE WHEN age <= a THEN 1 WHEN age <= b THEN 2 WHEN age <= c THEN 3 ELSE 4 END AS stratum FROM line_meta, q)",
    _split_sql("m", "[213]", "stratum"), body="SELECT seed, sample_id, stratum, CASE WHEN k <= floor(0.7 * n) THEN 'train' ELSE 'test' END AS role FROM s"))
def numeric_split(spark, d):
    return P.split(P.quartile_strata(line_meta(spark, d), "age"), "sample_id", "stratum")


@query("K2_many_splits", sql("emb_meta", _split_sql("emb_meta", "range(1, 101)", "disease"),
    body="SELECT seed, sample_id, disease, CASE WHEN k <= floor(0.7 * n) THEN 'train' ELSE 'test' END AS role FROM s"))
def many_splits(spark, d):
    return P.split(emb_meta(spark, d), "sample_id", "disease", seeds=range(1, 101))


@query("K3_stratified_folds", sql("line_meta", body="""SELECT sample_id, disease, CAST((row_number() OVER (PARTITION BY disease
    ORDER BY md5(sample_id || '|213-fold'), sample_id) - 1) % 10 AS INTEGER) AS fold FROM line_meta"""))
def stratified_folds(spark, d):
    return P.folds(line_meta(spark, d), "sample_id", "disease")


@query("K22_eligible_diseases", sql("emb_meta", body="""SELECT disease, count(*) AS n FROM emb_meta WHERE disease <> 'D0'
    GROUP BY 1 HAVING count(*) >= 48"""))
def eligible(spark, d):
    return (emb_meta(spark, d).filter("disease <> 'D0'").groupBy("disease").agg(F.count(F.lit(1)).alias("n")).filter("n >= 48"))


# --- K8, K10-K16, K23: evaluation -----------------------------------------------------------

def _levels(keys: str, source: str, score: str, case: str) -> list[str]:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return [f"lv AS (SELECT {k}{score} AS score, count(*) FILTER ({case}) AS p, count(*) FILTER (NOT ({case})) AS q FROM {source} GROUP BY {k}score)",
            f"""cu AS (SELECT *, sum(p) OVER (w ORDER BY score) - p AS pb, sum(q) OVER (w ORDER BY score) - q AS qb,
            sum(p) OVER w AS np, sum(q) OVER w AS nq FROM lv WINDOW w AS ({part}))"""]


def _pair_auc(keys: str, source: str, score: str, case: str) -> list[str]:
    """Area and interval from midranks of single rows (not from score levels)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return [f"r0 AS (SELECT {k}CAST({score} AS DOUBLE) AS sc, ({case}) AS c FROM {source})",
            f"""r1 AS (SELECT *, rank() OVER ({part} ORDER BY sc) + (count(*) OVER ({k and 'PARTITION BY ' + k}{'' if k else 'PARTITION BY '}sc) - 1) / 2.0::DOUBLE AS ra,
            rank() OVER (PARTITION BY {k}c ORDER BY sc) + (count(*) OVER (PARTITION BY {k}c, sc) - 1) / 2.0::DOUBLE AS rw,
            count(*) FILTER (c) OVER ({part}) AS np, count(*) FILTER (NOT c) OVER ({part}) AS nq FROM r0)""",
            "r2 AS (SELECT *, CASE WHEN c THEN (ra - rw) / nq ELSE 1 - (ra - rw) / np END AS v FROM r1)",
            f"""a0 AS (SELECT {k}max(np) AS n_cases, max(nq) AS n_controls, avg(v) FILTER (c) AS auc,
            sqrt(var_samp(v) FILTER (c) / max(np) + var_samp(v) FILTER (NOT c) / max(nq)) AS se FROM r2 {'GROUP BY ' + keys if keys else ''})""",
            f"""ar AS (SELECT {k}n_cases, n_controls, round(auc, 6) AS auc, round(se, 6) AS se, round(greatest(auc - 1.959963984540054 * se, 0), 6) AS ci_low,
            round(least(auc + 1.959963984540054 * se, 1), 6) AS ci_high FROM a0)"""]


AUC_COLS = ["auc", "se", "ci_low", "ci_high"]


@query("K10_roc_curve", sql("scored", *_levels("lang", "scored", "score", "quality = 1"), body="""SELECT lang, score AS threshold,
    round(1 - pb / np, 6) AS sensitivity, round(qb / nq, 6) AS specificity FROM cu WHERE np > 0 AND nq > 0
    UNION ALL SELECT DISTINCT lang, NULL, 1.0, 0.0 FROM cu WHERE np > 0 AND nq > 0
    UNION ALL SELECT DISTINCT lang, NULL, 0.0, 1.0 FROM cu WHERE np > 0 AND nq > 0"""))
def roc_curve(spark, d):
    curve = R.roc_curve(R.score_levels(scored(spark, d), ["lang"], "score", F.col("quality") == 1), ["lang"])
    finite = F.abs("threshold") < F.lit(float("inf"))
    return rounded(curve.withColumn("threshold", F.when(finite, F.col("threshold"))), "sensitivity", "specificity")


@query("K11_auc_interval", sql("scored", *_pair_auc("", "scored", "score", "quality = 1"), body="SELECT * FROM ar"))
def auc_interval(spark, d):
    return rounded(R.auc(R.score_levels(scored(spark, d), [], "score", F.col("quality") == 1), []), *AUC_COLS)


@query("K12_subgroup_auc", sql("scored", "g AS (SELECT unnest(['en', 'fr', 'de', 'es']) AS grp)",
    "x AS (SELECT grp, score, quality FROM scored CROSS JOIN g WHERE quality = 0 OR lang = grp)",
    *_pair_auc("grp", "x", "score", "quality = 1"), body="SELECT * FROM ar"))
def subgroup_auc(spark, d):
    levels = R.subgroup_levels(scored(spark, d).withColumnRenamed("lang", "grp"), [], "score", F.col("quality") == 1, "grp", ["en", "fr", "de", "es"])
    return rounded(R.auc(levels, ["grp"]), *AUC_COLS)


_PROB = """pr AS (SELECT vec_id AS sample_id, 'D' || label AS truth, """ + ", ".join(
    f"round(exp({' + '.join(f'embedding[{j + 1}]::DOUBLE' for j in range(i, 64, 10))}), 4) AS p_D{i}" for i in range(10)) + """ FROM embeddings),
    pl AS (SELECT sample_id, truth, replace(label, 'p_', '') AS label, score FROM pr UNPIVOT (score FOR label IN (""" + ", ".join(
    f"p_D{i}" for i in range(10)) + ")))"


def probabilities(spark, d):
    """One score per label from all vector entries: label i takes the entries whose place ends in i."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("D"), F.col("label").cast("string")).alias("truth"), *[
        F.round(F.exp(sum((F.col("embedding")[j].cast("double") for j in range(i + 10, 64, 10)), F.col("embedding")[i].cast("double"))), 4)
        .alias(f"p_D{i}") for i in range(10)])


def long_probabilities(spark, d):
    return R.label_scores(probabilities(spark, d), ["sample_id", "truth"], LABELS)


@query("K13_one_vs_rest_auc", sql("", _PROB, *_pair_auc("label", "pl", "score", "label = truth"), body="SELECT * FROM ar"))
def one_vs_rest(spark, d):
    return rounded(R.auc(R.one_vs_rest(long_probabilities(spark, d), []), ["label"]), *AUC_COLS)


@query("K14_hand_till", sql("", _PROB, "x AS (SELECT a.label, b.truth AS partner, a.score AS s1, b.score AS s0 FROM pl a JOIN pl b ON a.label = b.label AND a.truth = a.label AND b.truth <> b.label)",
    "y AS (SELECT label, partner, avg(CASE WHEN s1 > s0 THEN 1.0 WHEN s1 = s0 THEN 0.5 ELSE 0.0 END) AS auc FROM x GROUP BY 1, 2)",
    body="SELECT round(avg(auc), 6) AS auc, CAST(count(*) / 2 AS BIGINT) AS n_pairs FROM y"))
def hand_till(spark, d):
    return rounded(R.hand_till(long_probabilities(spark, d), LABELS), "auc")


@query("K15_regression_metrics", sql("line_meta", "t AS (SELECT l_returnflag AS flag, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)",
    body="SELECT flag, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(pow(corr(y, p), 2), 6) AS r2, count(*) AS n FROM t GROUP BY 1"))
def regression_metrics(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return R.regression_metrics(t, ["flag"], "y", "p").withColumns({"rmse": F.round("rmse", 4), "r2": r6("r2")})


@query("K15_class_metrics", sql("scored", body="""SELECT lang, round(avg(CAST((score / (score + 2000) > 0.5) = (quality = 1) AS INTEGER)), 6) AS accuracy,
    round(avg(pow(quality - score / (score + 2000), 2)), 6) AS brier FROM scored GROUP BY 1"""))
def class_metrics(spark, d):
    s = scored(spark, d).withColumn("p", F.col("score") / (F.col("score") + 2000))
    return rounded(R.class_metrics(s, ["lang"], "quality", "p"), "accuracy", "brier")


@query("K16_confusion_matrix", sql("", _PROB, "best AS (SELECT sample_id, truth, arg_min(label, (-score, label)) AS predicted FROM pl GROUP BY 1, 2)",
    body="""SELECT t.l AS truth, p.l AS predicted, count(sample_id) AS n FROM (SELECT unnest(list_transform(range(10), lambda i: 'D' || i)) AS l) t
    CROSS JOIN (SELECT unnest(list_transform(range(10), lambda i: 'D' || i)) AS l) p LEFT JOIN best ON truth = t.l AND predicted = p.l GROUP BY 1, 2"""))
def confusion_matrix(spark, d):
    best = R.most_likely(long_probabilities(spark, d), ["sample_id", "truth"])
    return R.confusion(best, "truth", "predicted", LABELS)


@query("K16_threshold_confusion", sql("scored", "x AS (SELECT quality AS truth, CAST(score / (score + 2000) > 0.5 AS INTEGER) AS predicted FROM scored)",
    body="""SELECT t.l AS truth, p.l AS predicted, count(x.truth) AS n FROM (SELECT unnest([0, 1]) AS l) t CROSS JOIN (SELECT unnest([0, 1]) AS l) p
    LEFT JOIN x ON truth = t.l AND predicted = p.l GROUP BY 1, 2"""))
def threshold_confusion(spark, d):
    p = F.col("score") / (F.col("score") + 2000)
    return R.confusion(scored(spark, d).withColumn("predicted", (p > 0.5).cast("int")), "quality", "predicted", [0, 1])


@query("K23_fold_auc", sql("scored", "f AS (SELECT *, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(sample_id || '|213-fold'), sample_id) - 1) % 5 AS INTEGER) AS fold FROM scored)",
    *_pair_auc("fold", "f", "score", "quality = 1"), body="SELECT fold, auc, round(avg(auc) OVER (), 5) AS mean_auc FROM a0").replace("SELECT fold, auc,", "SELECT fold, round(auc, 6) AS auc,"))
def fold_auc(spark, d):
    s = scored(spark, d)
    folded = s.join(P.folds(s, "sample_id", "quality", v=5).select("sample_id", "fold"), "sample_id")
    a = R.auc(R.score_levels(folded, ["fold"], "score", F.col("quality") == 1), ["fold"])
    return a.select("fold", r6("auc").alias("auc"), F.round(a.agg(F.avg("auc").alias("m")).scalar(), 5).alias("mean_auc"))


_K8_ROWS = ["""pairs AS (SELECT sample_id, disease AS contrast, 'case' AS role FROM emb_meta WHERE disease <> 'D0' UNION ALL
    SELECT sample_id, c.disease, 'control' FROM emb_meta m JOIN (SELECT DISTINCT disease FROM emb_meta WHERE disease <> 'D0') c ON m.disease = 'D0')""",
    """spl AS (SELECT sample_id, CASE WHEN row_number() OVER w <= floor(0.7 * count(*) OVER (PARTITION BY disease)) THEN 'train' ELSE 'test' END AS part
    FROM emb_meta WINDOW w AS (PARTITION BY disease ORDER BY md5(sample_id || '|213'), sample_id))""",
    "rows8 AS (SELECT contrast, assay, role, part, value FROM pairs JOIN spl USING (sample_id) JOIN emb_values USING (sample_id))",
    "dir8 AS (SELECT contrast, assay, CASE WHEN avg(value) FILTER (role = 'case') >= avg(value) FILTER (role = 'control') THEN 1 ELSE -1 END AS dir FROM rows8 WHERE part = 'train' GROUP BY 1, 2)",
    "t8 AS (SELECT contrast, assay, role, value * dir AS s FROM rows8 JOIN dir8 USING (contrast, assay) WHERE part = 'test')"]


def single_rows(spark, d):
    meta = emb_meta(spark, d)
    cases = meta.filter("disease <> 'D0'").select("sample_id", F.col("disease").alias("contrast"), F.lit("case").alias("role"))
    controls = meta.filter("disease = 'D0'").select("sample_id", F.explode(F.array(*[F.lit(x) for x in LABELS[1:]])).alias("contrast"), F.lit("control").alias("role"))
    parts = P.split(meta, "sample_id", "disease").select("sample_id", F.col("role").alias("part"))
    return cases.unionByName(controls).join(parts, "sample_id").join(emb_values(spark, d), "sample_id")


@query("K8_single_assay_auc", sql("emb_meta emb_values", *_K8_ROWS, *_pair_auc("contrast, assay", "t8", "s", "role = 'case'"), body="SELECT * FROM ar"))
def single_assay_auc(spark, d):
    rows = single_rows(spark, d)
    out = SG.single_assay_auc(rows.filter("part = 'train'"), rows.filter("part = 'test'"), ["contrast", "assay"], "value", F.col("role") == "case")
    return rounded(out, *AUC_COLS)


@query("K8_single_assay_predictions")
def single_assay_predictions(spark, d):
    rows = single_rows(spark, d)
    fit = SG.logit_fit(rows.filter("part = 'train'"), ["contrast", "assay"], "value", F.col("role") == "case")
    return SG.predict(rows.filter("part = 'test'"), fit, ["contrast", "assay"], "value")


# --- K18, K19, K24: importances over runs ---------------------------------------------------

@query("K18_selection_stability", sql("line_long", _IMP_SQL, "a AS (SELECT variable, avg(abs(importance)) AS m, count(*) FILTER (importance > 0) AS n FROM imp WHERE importance <> 0 GROUP BY 1)",
    "s AS (SELECT variable, sign, count(DISTINCT seed) AS n FROM imp WHERE importance <> 0 GROUP BY 1, 2)",
    "t AS (SELECT variable, max(n) / sum(n) * 100 AS share FROM s GROUP BY 1)",
    body="SELECT variable, round(m, 6) AS mean_importance, a.n AS n_selected, round(100 - share, 6) AS disagreement FROM a JOIN t USING (variable)"))
def selection_stability(spark, d):
    imp = importances(spark, d)
    mean = (imp.filter("importance <> 0").groupBy("variable")
            .agg(F.avg(F.abs("importance")).alias("mean_importance"), F.count_if(F.col("importance") > 0).alias("n_selected")))
    out = mean.join(W.sign_agreement(imp), "variable").withColumn("disagreement", 100 - F.col("max_share")).drop("max_share")
    return rounded(out, "mean_importance", "disagreement")


_TOP = """topf AS (SELECT variable FROM imp WHERE importance <> 0 GROUP BY 1 ORDER BY round(avg(abs(importance)), 9) DESC, variable LIMIT 25),
    x AS (SELECT variable, abs(importance) AS importance FROM imp WHERE variable IN (SELECT variable FROM topf))"""


@query("K19_top_features", sql("line_long", _IMP_SQL, _TOP, _BOX.format(k="variable", v="importance", t="x"), body="SELECT * FROM box"))
def top_features(spark, d):
    imp = importances(spark, d)
    ranked = D.importance_summary(imp, ["variable"]).withColumn("m", F.round("mean_importance", 9))
    top = W.first_rows(ranked, 25, F.col("m").desc(), "variable")
    rows = imp.join(top.select("variable"), "variable", "left_semi").withColumn("importance", F.abs("importance"))
    return rounded(L.box_stats(rows, ["variable"], "importance"), *BOX_COLS)


@query("K24_publication_table", sql("line_long", _IMP_SQL, "b AS (SELECT assay AS disease, seed, variable, abs(importance) AS i, 'Healthy' AS control FROM imp WHERE sign = 'POS' UNION ALL SELECT assay, seed, variable, abs(importance), 'Class' FROM imp WHERE sign = 'NEG')",
    "s AS (SELECT *, min(i) OVER w AS lo, max(i) OVER w AS hi FROM b WINDOW w AS (PARTITION BY control, disease, seed))",
    body="""SELECT control, disease, seed, variable, p_name AS name, round(CASE WHEN control = 'Class' THEN i / hi * 100 WHEN hi = lo THEN 50
    ELSE (i - lo) / (hi - lo) * 100 END, 6) AS scaled FROM s JOIN part ON variable = p_partkey"""))
def publication_table(spark, d):
    rows = table(spark, d, "lineitem").count()
    imp = importances(spark, d, rows).withColumn("importance", F.abs("importance")).withColumnRenamed("assay", "disease")
    keys = ["control", "disease", "seed"]
    healthy = W.rescale(imp.filter("sign = 'POS'").withColumn("control", F.lit("Healthy")), keys, "importance", rows=rows)
    klass = W.rescale(imp.filter("sign = 'NEG'").withColumn("control", F.lit("Class")), keys, "importance", from_zero=True, rows=rows)
    names = table(spark, d, "part").select(F.col("p_partkey").alias("variable"), F.col("p_name").alias("name"))
    both = healthy.unionByName(klass).join(lookup_side(names, rows), "variable").select(*keys, "variable", "name", r6("scaled").alias("scaled"))
    return sorted_by(both, rows, *keys, F.col("scaled").desc())


_AREAS = """x AS (SELECT control, label AS disease, seed, score, truth FROM s JOIN pl USING (sample_id) JOIN (SELECT DISTINCT disease AS label, class AS own FROM emb_meta) USING (label)
    JOIN (SELECT sample_id, class FROM emb_meta) USING (sample_id) CROSS JOIN (VALUES ('Healthy'), ('Class'), ('All other diseases')) c(control)
    WHERE k > floor(0.7 * n) AND label <> 'D0' AND (truth = label OR (control = 'Healthy' AND truth = 'D0') OR (control = 'Class' AND class = own)
    OR (control = 'All other diseases' AND truth <> 'D0')))"""


@query("K24_publication_auc", sql("emb_meta", _split_sql("emb_meta", "range(1, 6)", "disease"), _PROB, _AREAS, *_pair_auc("control, disease, seed", "x", "score", "truth = disease"),
    body="SELECT control, disease, class, count(*) AS n_seeds, round(avg(auc), 6) AS mean_auc, round(stddev_samp(auc), 6) AS sd_auc FROM a0 "
         "JOIN (SELECT DISTINCT disease, class FROM emb_meta) USING (disease) GROUP BY 1, 2, 3"))
def publication_auc(spark, d):
    """Mean and spread over seeds of each disease's area on test rows, against Healthy, its class, and all other diseases."""
    meta = emb_meta(spark, d).select("sample_id", "disease", "class")
    test = P.split(meta, "sample_id", "disease", seeds=range(1, 6)).filter("role = 'test'").select("seed", "sample_id")
    own = meta.select(F.col("disease").alias("label"), F.col("class").alias("own")).distinct().filter("label <> 'D0'")
    rows = long_probabilities(spark, d).join(meta.select("sample_id", "class"), "sample_id").join(own, "label").join(test, "sample_id")
    case = F.col("truth") == F.col("label")
    against = F.array(F.when(case | (F.col("truth") == "D0"), "Healthy"), F.when(case | (F.col("class") == F.col("own")), "Class"),
                      F.when(F.col("truth") != "D0", "All other diseases"))
    each = rows.withColumn("control", F.explode(F.array_compact(against)))
    keys = ["control", "label", "own", "seed"]
    areas = R.auc(R.score_levels(each, keys, "score", case), keys)
    return (areas.groupBy("control", F.col("label").alias("disease"), F.col("own").alias("class"))
            .agg(F.count("auc").alias("n_seeds"), r6(F.avg("auc")).alias("mean_auc"), r6(F.stddev_samp("auc")).alias("sd_auc")))
