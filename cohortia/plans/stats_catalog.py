"""Statistical operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.functions import scalar as S
from cohortia.functions import tails as TL
from cohortia.operators import linear as LM
from cohortia.operators import matching as M
from cohortia.operators import neighbours as N
from cohortia.operators import prepare as P
from cohortia.operators import windows as W
from cohortia.operators.reshape import vectors
from cohortia.plans.bindings import emb_long, emb_meta, emb_values, line_long, line_meta, sql, table
from cohortia.plans.fwl import centred, residual_steps
from cohortia.plans.registry import query
from cohortia.plans.summaries_catalog import rounded
from cohortia.session import cut

HEALTHY = "D0"


def r6(col):
    return F.round(col, 6)


@query("J1_normalize", sql("emb_values", body="""SELECT sample_id, assay, round((gappy - avg(gappy) OVER w) / stddev_samp(gappy) OVER w, 6) AS value
    FROM emb_values WINDOW w AS (PARTITION BY assay)"""))
def normalize(spark, d):
    return rounded(P.normalize(emb_values(spark, d, gaps=True)), "value").select("sample_id", "assay", "value")


_NZV = """coded AS (SELECT l_returnflag AS assay, l_discount AS value FROM lineitem UNION ALL SELECT 'rare', CASE WHEN l_quantity = 50 AND l_linenumber = 1
    THEN 1.0 ELSE 0.0 END FROM lineitem UNION ALL SELECT 'flat', 1.0 FROM lineitem)"""


@query("J2_near_zero_variance", sql("", _NZV, "c AS (SELECT assay, value, count(*) AS n FROM coded GROUP BY 1, 2)",
    "r AS (SELECT *, row_number() OVER (PARTITION BY assay ORDER BY n DESC) AS k FROM c)",
    body="""SELECT assay, count(*) AS n_unique, round(max(n) FILTER (k = 1) / max(n) FILTER (k = 2), 6) AS freq_ratio,
    round(count(*) / sum(n) * 100, 6) AS unique_percent, CAST(count(*) <= 1 OR (max(n) FILTER (k = 1) / max(n) FILTER (k = 2) > 19
    AND count(*) / sum(n) * 100 <= 10) AS INTEGER) AS nzv FROM r GROUP BY 1"""))
def near_zero_variance(spark, d):
    li = table(spark, d, "lineitem")
    rare = F.when((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 1), 1.0).otherwise(0.0)
    coded = (li.select(F.col("l_returnflag").alias("assay"), F.col("l_discount").alias("value"))
             .unionByName(li.select(F.lit("rare").alias("assay"), rare.alias("value")))
             .unionByName(li.select(F.lit("flat").alias("assay"), F.lit(1.0).alias("value"))))
    return rounded(P.near_zero_variance(coded), "freq_ratio", "unique_percent").withColumn("nzv", F.col("nzv").cast("int"))


_KNN = [
    "rng AS (SELECT assay, max(gappy) - min(gappy) AS w FROM emb_values GROUP BY 1)",
    "g AS (SELECT sample_id, assay, gappy, gappy / w AS s FROM emb_values JOIN rng USING (assay))",
    "pk AS (SELECT sample_id, list(s ORDER BY assay) AS s FROM g GROUP BY 1)",
    """dist AS (SELECT a.sample_id, b.sample_id AS other, list_sum(list_transform(list_zip(a.s, b.s), lambda z: abs(z[1] - z[2])))
    / len(list_filter(list_transform(list_zip(a.s, b.s), lambda z: abs(z[1] - z[2])), lambda z: z IS NOT NULL)) AS d
    FROM pk a JOIN pk b ON a.sample_id <> b.sample_id)""",
    """best AS (SELECT m.sample_id, m.assay, o.gappy AS v, row_number() OVER (PARTITION BY m.sample_id, m.assay ORDER BY d, other) AS k
    FROM g m JOIN dist USING (sample_id) JOIN g o ON o.sample_id = other AND o.assay = m.assay WHERE m.gappy IS NULL AND o.gappy IS NOT NULL)""",
    "fill AS (SELECT sample_id, assay, avg(v) AS f FROM best WHERE k <= 5 GROUP BY 1, 2)"]


@query("J3_knn_impute", sql("emb_values", *_KNN, body="""SELECT sample_id, assay, round(coalesce(gappy, f), 6) AS value
    FROM emb_values LEFT JOIN fill USING (sample_id, assay)"""))
def knn_impute(spark, d):
    return rounded(P.knn_impute(emb_values(spark, d, gaps=True)), "value")


@query("J4_imputation_report", sql("emb_values", body="""SELECT count(DISTINCT sample_id) AS n_samples, count(DISTINCT assay) AS n_assays,
    count(*) FILTER (gappy IS NULL) AS n_imputed, round(count(*) FILTER (gappy IS NULL) /
    (count(DISTINCT sample_id) * (count(DISTINCT assay) + 1)) * 100, 6) AS percent FROM emb_values"""))
def imputation_report(spark, d):
    before = emb_values(spark, d, gaps=True)
    return rounded(P.imputation_report(before, P.knn_impute(before)), "percent")


@query("J5_downsample", sql("line_meta", """r AS (SELECT sample_id, status, row_number() OVER (PARTITION BY status
    ORDER BY md5(sample_id || '|213'), sample_id) AS k FROM line_meta)""",
    body="SELECT sample_id, status FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM line_meta GROUP BY status))"))
def downsample(spark, d):
    return P.downsample(line_meta(spark, d).select("sample_id", "status"), "status", "sample_id")


@query("J7_neighbour_edges", sql("emb_values", "z AS (SELECT sample_id, assay, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS v FROM emb_values WINDOW w AS (PARTITION BY assay))",
    "p AS (SELECT sample_id, list(v ORDER BY assay) AS v FROM z GROUP BY 1)",
    "n AS (SELECT a.sample_id, b.sample_id AS neighbour, list_distance(a.v, b.v) AS distance FROM p a JOIN p b ON a.sample_id <> b.sample_id)",
    body="""SELECT sample_id, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
    (PARTITION BY sample_id ORDER BY distance, neighbour) AS rank FROM n) WHERE rank <= 15"""))
def neighbour_edges(spark, d):
    z = vectors(P.normalize(emb_values(spark, d)), "sample_id", "assay", "value")
    return rounded(N.nearest(z, "sample_id", "vector", 15), "distance")


@query("J7_neighbour_weights", sql("emb_values", "z AS (SELECT sample_id, assay, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS v FROM emb_values WINDOW w AS (PARTITION BY assay))",
    "p AS (SELECT sample_id, list(v ORDER BY assay) AS v FROM z GROUP BY 1)",
    "n AS (SELECT a.sample_id, b.sample_id AS neighbour, list_distance(a.v, b.v) AS distance FROM p a JOIN p b ON a.sample_id <> b.sample_id)",
    """e AS (SELECT sample_id, neighbour, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER
    (PARTITION BY sample_id ORDER BY distance, neighbour) AS rank FROM n) WHERE rank <= 15)""",
    "m AS (SELECT sample_id, min(distance) AS near FROM e GROUP BY 1)",
    "g AS (SELECT sample_id, near, list(distance - near) AS ds FROM e JOIN m USING (sample_id) GROUP BY 1, 2)",
    """b(sample_id, near, ds, i, lo, hi) AS (SELECT sample_id, near, ds, 0, CAST(-20 AS DOUBLE), CAST(20 AS DOUBLE) FROM g UNION ALL
    SELECT sample_id, near, ds, i + 1, CASE WHEN s > log2(15) THEN lo ELSE (lo + hi) / 2 END, CASE WHEN s > log2(15) THEN (lo + hi) / 2 ELSE hi END
    FROM (SELECT *, list_sum([exp(-x / exp((lo + hi) / 2)) FOR x IN ds]) AS s FROM b WHERE i < 64))""",
    body="""SELECT e.sample_id, neighbour, distance, round(exp(-(distance - near) / exp((lo + hi) / 2)), 6) AS weight
    FROM e JOIN b ON b.sample_id = e.sample_id AND i = 64""").replace("WITH ", "WITH RECURSIVE ", 1))
def neighbour_weights(spark, d):
    return rounded(N.neighbour_graph(neighbour_edges(spark, d), "sample_id", 15), "weight")


# --- linear models --------------------------------------------------------------------------

_ROWS = """y0 AS (SELECT sample_id, assay, disease, gappy AS y, age, CAST(sex <> 'F' AS DOUBLE) AS sex, bmi, 1.0 AS one,
    CAST(disease = 'D0' AS DOUBLE) AS ref FROM emb_long WHERE gappy IS NOT NULL)"""


def _anova_sql() -> str:
    xs, ctes, parts = ["age", "sex", "bmi"], [_ROWS], []
    for x in xs:
        others = [z for z in xs if z != x]
        c, last = residual_steps(f"s_{x}", "y0", "assay", ["assay"], others, [x, "y"], centred([*others, x, "y"], "assay, disease"))
        ctes += c
        parts.append(f"SELECT assay, '{x}' AS term, pow(sum({x} * y), 2) / sum({x} * {x}) AS ss, 1 AS df FROM {last} GROUP BY 1")
    for tag, part in (("full", "assay, disease"), ("none", "assay")):
        c, last = residual_steps(f"s_{tag}", "y0", "assay", ["assay"], xs, ["y"], centred([*xs, "y"], part))
        ctes += [*c, f"rss_{tag} AS (SELECT assay, sum(y * y) AS rss, count(*) AS n FROM {last} GROUP BY 1)"]
    start = {v: f"CASE WHEN ref = 1 THEN {v} ELSE {v} - avg({v}) OVER (PARTITION BY assay, disease) END" for v in [*xs, "y"]}
    c, last = residual_steps("s_int", "y0", "assay", ["assay"], xs, ["ref", "y"], {**start, "ref": "ref"})
    ctes += c
    parts.append(f"SELECT assay, '(Intercept)', pow(sum(ref * y), 2) / sum(ref * ref), 1 FROM {last} GROUP BY 1")
    parts.append("SELECT f.assay, 'disease', n0.rss - f.rss, 9 FROM rss_full f JOIN rss_none n0 USING (assay)")
    parts.append("SELECT assay, 'Residuals', rss, n - 13 FROM rss_full")
    body = f"""SELECT t.assay, term, round(ss, 6) AS ss, CAST(df AS BIGINT) AS df,
        CASE WHEN term <> 'Residuals' THEN round(ss / df / (rss / (n - 13)), 6) END AS f,
        CASE WHEN term NOT IN ('Residuals', '(Intercept)') THEN round(ss / (ss + rss) * 100, 6) END AS eta2_percent
        FROM ({' UNION ALL '.join(parts)}) t JOIN rss_full USING (assay)"""
    return sql("emb_long", *ctes, body=body)


@query("J12_anova", _anova_sql())
def anova(spark, d):
    return rounded(LM.anova(emb_long(spark, d, gaps=True), p_values=False), "ss", "f", "eta2_percent")


@query("J12_anova_p_values")
def anova_p(spark, d):
    return W.bh_adjust(cut(LM.anova(emb_long(spark, d, gaps=True)).filter("term NOT IN ('(Intercept)', 'Residuals')")), [])


def _effects_sql(source: str, others: list[str], n_par: int, extra: str = "") -> tuple[list[str], str]:
    """CTEs ending in (control, contrast, assay) effects of x, with intercept, adjusted for others."""
    part = "control, contrast, assay"
    cols = [*others, "x", "y"]
    c, last = residual_steps("e", source, part, ["control", "contrast", "assay", "role", "raw"], others, ["x", "y"], centred(cols, part))
    body = f"""fit AS (SELECT control, contrast, assay, count(*) FILTER (role = 'case') AS n_case,
        count(*) FILTER (role = 'control') AS n_control, sum(x * y) / sum(x * x) AS log_fc, avg(raw) AS average,
        sqrt(1 / sum(x * x)) AS stdev_unscaled, (sum(y * y) - pow(sum(x * y), 2) / sum(x * x)) / (count(*) - {n_par}) AS s2
        FROM {last} GROUP BY 1, 2, 3)"""
    return [*c, body], """SELECT control, contrast, assay, n_case, n_control, round(log_fc, 6) AS log_fc, round(average, 6) AS average,
        round(s2, 6) AS s2, round(sqrt(s2) * stdev_unscaled, 6) AS se, round(log_fc / (sqrt(s2) * stdev_unscaled), 6) AS t FROM fit"""


_PLAN_ALL = [
    "dis AS (SELECT DISTINCT disease, class FROM emb_meta)",
    """plan AS (SELECT 'Healthy' AS control, disease AS case_disease, 'D0' AS control_disease FROM dis WHERE disease <> 'D0'
    UNION ALL SELECT 'Class', a.disease, b.disease FROM dis a JOIN dis b ON a.class = b.class AND a.disease <> b.disease WHERE a.disease <> 'D0'
    UNION ALL SELECT 'All other diseases', a.disease, b.disease FROM dis a JOIN dis b ON a.disease <> b.disease
    WHERE a.disease <> 'D0' AND b.disease <> 'D0')""",
    """mem AS (SELECT DISTINCT control, case_disease AS contrast, sample_id, 'case' AS role FROM plan JOIN emb_meta ON disease = case_disease
    UNION ALL SELECT control, case_disease, sample_id, 'control' FROM plan JOIN emb_meta ON disease = control_disease)"""]


def all_plans(meta):
    out = None
    for control in ("Healthy", "Class", "All other diseases"):
        p = LM.contrast_plan(meta, control, HEALTHY)
        out = p if out is None else out.unionByName(p)
    return out


@query("J16_contrast_plan", sql("emb_meta", *_PLAN_ALL, body="SELECT control, case_disease, control_disease FROM plan"))
def contrast_plan(spark, d):
    return all_plans(emb_meta(spark, d)).select("control", "case_disease", "control_disease")


@query("J16_contrast_members", sql("emb_meta", *_PLAN_ALL, body="SELECT control, contrast, sample_id, role FROM mem"))
def contrast_members(spark, d):
    meta = emb_meta(spark, d)
    return LM.contrast_members(all_plans(meta), meta)


_JOINED = """rowz AS (SELECT m.control, m.contrast, l.assay, m.role, CAST(m.role = 'case' AS DOUBLE) AS x, l.gappy AS y, l.gappy AS raw,
    CAST(l.sex <> 'F' AS DOUBLE) AS sex, l.age FROM mem m JOIN emb_long l USING (sample_id) WHERE l.gappy IS NOT NULL)"""
FIT_COLS = ["control", "contrast", "assay", "n_case", "n_control", "log_fc", "average", "s2", "se", "t"]


def long_xy(spark, d):
    return emb_long(spark, d, gaps=True).select(
        "sample_id", "assay", "disease", F.col("value").alias("y"), LM.numeric_sex(F.col("sex")).alias("sex"), "age")


def adjusted_fit(spark, d, matched=None):
    meta = emb_meta(spark, d)
    plan = all_plans(meta)
    names = ["sex", "age", "y"]
    if matched is None:  # contrasts of whole diseases
        mom = LM.group_contrast_moments(long_xy(spark, d), plan, names)
    else:
        strict = matched.filter(F.col("control_disease") == HEALTHY).select(
            F.lit("Healthy").alias("control"), "case_disease", F.col("case_sample").alias("sample_id"))
        members = LM.contrast_members(plan, meta, matched, strict)
        mom = LM.contrast_moments(long_xy(spark, d), members, names, ["control", "contrast"])
    return LM.contrast_fit(mom, ["control", "contrast"], ["sex", "age"], LM.pick_design(meta, plan, healthy=HEALTHY))


_EFF, _EFF_BODY = _effects_sql("rowz", ["sex", "age"], 4)


@query("J13_differential_effects", sql("emb_long", *_PLAN_ALL, _JOINED, *_EFF, body=_EFF_BODY))
def differential_effects(spark, d):
    return rounded(adjusted_fit(spark, d).select(*FIT_COLS), *FIT_COLS[5:])


@query("U6_tail_probabilities", """SELECT o_orderkey, round(1 - 2 / pi() * atan(x), 9) AS t1, round(1 - x / sqrt(2 + x * x), 9) AS t2,
    round(1 - x * (x * x + 6) / pow(x * x + 4, 1.5), 9) AS t4, round(pow(1 + 2 * x / df, -df / 2), 9) AS f2, round(exp(-x / 2), 9) AS c2,
    round(exp(-x / 2) * (1 + x / 2 + x * x / 8), 9) AS c6
    FROM (SELECT o_orderkey, o_totalprice / 20000 AS x, CAST(1 + o_custkey % 60 AS DOUBLE) AS df FROM orders)""")
def tail_probabilities(spark, d):
    x, df = F.col("o_totalprice") / 20000, (F.col("o_custkey") % 60 + 1).cast("double")
    tails = {"t1": TL.t_tail(x, F.lit(1.0)), "t2": TL.t_tail(x, F.lit(2.0)), "t4": TL.t_tail(x, F.lit(4.0)), "f2": TL.f_tail(x, F.lit(2.0), df),
             "c2": TL.chi2_tail(x, F.lit(2.0)), "c6": TL.chi2_tail(x, F.lit(6.0))}
    return table(spark, d, "orders").select("o_orderkey", *[F.round(c, 9).alias(n) for n, c in tails.items()])


_PRIOR = 4.0


@query("J14_moderated_given_prior", sql("emb_long", *_PLAN_ALL, _JOINED, *_EFF, body="""SELECT control, contrast, assay,
    round((4 * 0.01 + (n_case + n_control - 4) * s2) / (n_case + n_control), 6) AS s2_post,
    round(log_fc / (sqrt((4 * 0.01 + (n_case + n_control - 4) * s2) / (n_case + n_control)) * stdev_unscaled), 6) AS t_mod,
    round(CAST(least(n_case + n_control, sum(n_case + n_control - 4) OVER (PARTITION BY control, contrast)) AS DOUBLE), 6) AS df_total FROM fit"""))
def moderated_given(spark, d):
    fit = adjusted_fit(spark, d)
    prior = fit.select("control", "contrast").distinct().withColumns({"prior_df": F.lit(4.0), "prior_s2": F.lit(0.01)})
    out = LM.moderate(fit, prior, ["control", "contrast"], tails=False)
    return rounded(out.select("control", "contrast", "assay", "s2_post", "t_mod", "df_total"), "s2_post", "t_mod", "df_total")


def _f_upper_sql(f: str, df1: str, df2: str) -> str:
    """Upper tail of F in SQL, by the series of the incomplete beta integral (all its terms are positive)."""
    a, b, x = f"({df2} / 2)", f"({df1} / 2)", f"({df2} / ({df2} + {df1} * {f}))"
    terms = f"exp(lgamma({a} + {b} + i + 1) - lgamma({a} + {b}) - lgamma({a} + i + 2) + lgamma({a} + 1) + (i + 1) * ln({x}))"
    return (f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) "
            f"* (1 + list_sum([{terms} for i in range(4000)]))")


_GIVEN_DF, _GIVEN_S2 = 40.0, 0.0124


@query("J14_assay_priors", sql("emb_long", *_PLAN_ALL, _JOINED, *_EFF,
    f"va AS (SELECT control, contrast, assay, s2 / {_GIVEN_S2} AS f, CAST(n_case + n_control - 4 AS DOUBLE) AS df FROM fit WHERE s2 > 0)",
    f"ta AS MATERIALIZED (SELECT *, least({_GIVEN_DF}, sum(df) OVER (PARTITION BY control, contrast)) AS d0, {_f_upper_sql('f', 'df', f'{_GIVEN_DF}')} AS tail FROM va)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY control, contrast ORDER BY tail, assay) AS k, count(*) OVER (PARTITION BY control, contrast) AS n FROM ta)",
    "w1 AS (SELECT control, contrast, f, df, ln(0.5) / ln(tail) * d0 AS small FROM rk WHERE k = 1)",
    f"w2 AS (SELECT control, contrast, ln(0.5) / ln({_f_upper_sql('f', 'df', 'small')}) * small AS least_df FROM w1)",
    "ch AS (SELECT *, least(1.0, tail / ((k - 0.5) / n)) AS chance FROM rk JOIN w2 USING (control, contrast))",
    "mx AS (SELECT control, contrast, assay, k, chance * d0 + (1 - chance) * least_df AS own FROM ch)",
    "rn AS (SELECT *, avg(own) OVER (PARTITION BY control, contrast ORDER BY k ROWS UNBOUNDED PRECEDING) AS m FROM mx)",
    "lo AS (SELECT control, contrast, min(m) AS lm, arg_min(k, m) AS lk FROM rn GROUP BY 1, 2)",
    body="""SELECT control, contrast, assay, round(max(CASE WHEN k <= lk THEN lm ELSE own END) OVER (PARTITION BY control, contrast ORDER BY k
    ROWS UNBOUNDED PRECEDING), 6) AS prior_df FROM rn JOIN lo USING (control, contrast)"""))
def assay_priors(spark, d):
    """Prior df of each assay under a given prior that many variances exceed."""
    fit = cut(adjusted_fit(spark, d))
    prior = fit.select("control", "contrast").distinct().withColumns({"prior_df": F.lit(_GIVEN_DF), "prior_s2": F.lit(_GIVEN_S2)})
    out = LM.assay_priors(fit, prior, ["control", "contrast"], "assay")
    return rounded(out.select("control", "contrast", "assay", "prior_df"), "prior_df")


@query("J14_differential")
def differential(spark, d):
    return LM.differential(adjusted_fit(spark, d), ["control", "contrast"], robust=True, effect_cut=0.02)


@query("J15_matched_samples")
def matched_samples(spark, d):
    meta = emb_meta(spark, d)
    return M.match_samples(meta, all_plans(meta))


@query("J15_match_counts", sql("emb_meta", *_PLAN_ALL, "pp AS (SELECT DISTINCT case_disease, control_disease FROM plan)",
    "mm AS (SELECT * FROM emb_meta WHERE age IS NOT NULL AND sex IS NOT NULL)",
    "ca AS (SELECT disease AS case_disease, count(*) AS n, list(DISTINCT sex) AS sexes FROM mm GROUP BY 1)",
    """both_n AS (SELECT case_disease, control_disease, any_value(ca.n) AS nc, count(*) AS nk FROM pp JOIN ca USING (case_disease)
    JOIN mm ON mm.disease = control_disease AND list_contains(sexes, mm.sex) GROUP BY 1, 2)""",
    body="""SELECT case_disease, control_disease, least(nc, nk) AS n_pairs, least(nc, nk) AS n_cases, least(nc, nk) AS n_controls, TRUE AS one_sex_kept
    FROM both_n"""))
def match_counts(spark, d):
    """Every pair is as large as the smaller side, no sample is used twice, and no control has a sex the cases lack."""
    meta = emb_meta(spark, d)
    pairs = M.match_samples(meta, all_plans(meta))
    sexes = meta.groupBy(F.col("disease").alias("case_disease")).agg(F.collect_set("sex").alias("sexes"))
    return (pairs.join(sexes, "case_disease").groupBy("case_disease", "control_disease").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("case_sample").alias("n_cases"), F.countDistinct("control_sample").alias("n_controls"),
        F.every(F.array_contains("sexes", F.col("control_sex"))).alias("one_sex_kept")))


@query("J15_matched_differential")
def matched_differential(spark, d):
    meta = emb_meta(spark, d)
    pairs = M.match_samples(meta, all_plans(meta))
    matched = cut(pairs.select("case_disease", "control_disease", F.col("control_sample").alias("sample_id"), "case_sample"))
    return LM.differential(adjusted_fit(spark, d, matched), ["control", "contrast"], robust=True, effect_cut=0.02)


_E2, _E2_BODY = _effects_sql("rowz", [], 2)


@query("J17_uncorrected_contrasts", sql("emb_long", *_PLAN_ALL, _JOINED.replace("WHERE", "WHERE m.control <> 'Healthy' AND"), *_E2, body=_E2_BODY))
def uncorrected(spark, d):
    meta = emb_meta(spark, d)
    plan = LM.contrast_plan(meta, "Class", HEALTHY).unionByName(LM.contrast_plan(meta, "All other diseases", HEALTHY))
    mom = LM.group_contrast_moments(long_xy(spark, d), plan, ["y"])
    return rounded(LM.contrast_fit(mom, ["control", "contrast"], []).select(*FIT_COLS), *FIT_COLS[5:])


_CALLS = """(VALUES ('original', 0.05, 0.02), ('FC1_pval05', 0.05, 0.04), ('FC05_pval005', 0.005, 0.02), ('FC1_pval005', 0.005, 0.04),
    ('FC1_pval0005', 0.0005, 0.04)) k(threshold, p, fc)"""


@query("J18_threshold_counts", sql("line_long line_meta", "res AS (SELECT class AS control, disease, assay, avg(value) - 10.2 AS log_fc, min(quantity) / 1000 AS adj_p FROM line_long JOIN line_meta USING (sample_id) GROUP BY 1, 2, 3)",
    body=f"""SELECT control, disease, threshold, sig, count(*) AS n FROM (SELECT control, disease, threshold, CASE WHEN adj_p < p AND log_fc < -fc
    THEN 'significant down' WHEN adj_p < p AND log_fc > fc THEN 'significant up' ELSE 'not significant' END AS sig
    FROM res CROSS JOIN {_CALLS}) WHERE sig <> 'not significant' GROUP BY 1, 2, 3, 4"""))
def threshold_counts(spark, d):
    res = (line_long(spark, d).join(line_meta(spark, d), "sample_id").groupBy(F.col("class").alias("control"), "disease", "assay")
           .agg((F.avg("value") - 10.2).alias("log_fc"), (F.min("quantity") / 1000).alias("adj_p")))
    scale = {0.5: 0.02, 1.0: 0.04}
    calls = LM.threshold_calls(res, [(n, p, scale[c]) for n, p, c in S.THRESHOLDS])
    return (calls.filter(F.col("sig") != S.NOT_SIGNIFICANT).groupBy("control", "disease", "threshold", "sig")
            .agg(F.count(F.lit(1)).alias("n")))
