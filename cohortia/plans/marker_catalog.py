"""Profiles, mixed models, enrichment and marker lists over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.operators import enrich as E
from cohortia.operators import mixed as MX
from cohortia.operators import profiles as PR
from cohortia.operators import slopes as SL
from cohortia.operators import summaries as D
from cohortia.operators import windows as W
from cohortia.plans.bindings import emb_long, emb_values, evt_long, line_long, line_meta, sql, table
from cohortia.plans.registry import query
from cohortia.plans.summaries_catalog import _HITS_SQL, _IMP_SQL, importances, line_hits, rounded


def r6(col):
    return F.round(col, 6)


@query("J6_pca_scores")
def pca_scores(spark, d):
    return PR.pca(emb_values(spark, d))[0]


@query("J6_pca_identities", """SELECT 'PC' || i AS a, 'PC' || j AS b, CAST(i = j AS INTEGER) * 1.0::DOUBLE AS loading_product, CAST(i = j AS INTEGER) * 1.0::DOUBLE AS score_product
    FROM range(1, 6) x(i), range(1, 6) y(j) WHERE i <= j""")
def pca_identities(spark, d):
    """Loadings are orthonormal; scores are uncorrelated, with the variances that the shares of the total (one for each assay) say."""
    scores, loadings, shares = PR.pca(emb_values(spark, d))
    total = loadings.agg(F.countDistinct("assay").alias("n"))

    def products(df, key, value, scale):
        left, right = df.select(key, F.col("component").alias("a"), F.col(value).alias("x")), df.select(key, F.col("component").alias("b"), F.col(value).alias("y"))
        return left.join(right, key).filter("a <= b").groupBy("a", "b").agg(scale)

    load = products(loadings, "assay", "loading", F.sum(F.col("x") * F.col("y")).alias("l"))
    cov = products(scores, "sample_id", "score", F.covar_samp("x", "y").alias("c"))
    whole = shares.withColumn("v", F.col("share") * total.scalar())
    both = (load.join(cov, ["a", "b"]).join(whole.select(F.col("component").alias("a"), F.col("v").alias("va")), "a")
            .join(whole.select(F.col("component").alias("b"), F.col("v").alias("vb")), "b"))
    return both.select("a", "b", F.abs(F.round("l", 6)).alias("loading_product"), F.abs(F.round(F.col("c") / F.sqrt(F.col("va") * F.col("vb")), 6)).alias("score_product"))


@query("J6_top_loadings")
def pca_loadings(spark, d):
    return PR.top_loadings(PR.pca(emb_values(spark, d))[1])


@query("J8_group_correlation", sql("emb_long", "m AS (SELECT disease, assay, avg(gappy) AS v FROM emb_long GROUP BY 1, 2)",
    "z AS (SELECT disease, assay, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z FROM m WINDOW w AS (PARTITION BY assay))",
    "r AS (SELECT disease, assay, rank() OVER (PARTITION BY disease ORDER BY z) + (count(*) OVER (PARTITION BY disease, z) - 1) / 2.0 AS r FROM z)",
    body="SELECT x.disease AS a, y.disease AS b, round(corr(x.r, y.r), 6) AS rho FROM r x JOIN r y USING (assay) WHERE x.disease > y.disease GROUP BY 1, 2"))
def group_correlation(spark, d):
    return rounded(PR.group_correlation(emb_long(spark, d, gaps=True), lower_only=True), "rho")


def visits(spark, d):
    """Longitudinal measurements with stand-in covariates: age from subject and time, sex from subject."""
    days = F.datediff("date", F.lit("2024-01-01")) / 365.0
    return evt_long(spark, d).select("sample_id", "subject", "assay", "value", "visit",
                                     (20 + (F.col("subject") * 7) % 50 + days).alias("age"),
                                     F.when(F.col("subject") % 2 == 0, "F").otherwise("M").alias("sex"))


@query("J9_mixed_model_fixed_effects")
def mixed_fixed(spark, d):
    return W.bh_adjust(MX.fixed_effects(MX.mixed_model(visits(spark, d))), ["term"])


@query("J10_variance_explained")
def mixed_variance(spark, d):
    return MX.variance_explained(MX.mixed_model(visits(spark, d)))


@query("J11_interaction_comparison")
def mixed_interaction(spark, d):
    return MX.compare_interaction(visits(spark, d))


@query("J11_slope_comparison")
def mixed_slopes(spark, d):
    return SL.compare_slopes(visits(spark, d))


_GENES = """sc AS (SELECT class, gene, round(avg(value), 6) - 10 AS score FROM line_long JOIN line_meta USING (sample_id) GROUP BY 1, 2),
    st AS (SELECT 'brand ' || p_brand AS term, p_partkey AS gene FROM part UNION ALL SELECT 'type ' || p_type, p_partkey FROM part
    UNION ALL SELECT 'name ' || p_name, p_partkey FROM part)"""


def gene_scores(spark, d):
    """Parts as genes, regions as diseases, centred mean log price as score."""
    rows = line_long(spark, d).join(line_meta(spark, d).select("sample_id", "class"), "sample_id")
    return rows.groupBy("class", "gene").agg((r6(F.avg("value")) - 10).alias("score"))


def gene_sets(spark, d):
    part = table(spark, d, "part")
    sets = None
    for kind, col in (("brand", "p_brand"), ("type", "p_type"), ("name", "p_name")):
        s = part.select(F.concat(F.lit(f"{kind} "), col).alias("term"), F.col("p_partkey").alias("gene"))
        sets = s if sets is None else sets.unionByName(s)
    return sets


_SETS_IN_LISTS = [
    "rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, gene) AS pos, count(*) OVER (PARTITION BY class) AS n FROM sc)",
    "sz AS (SELECT class, term, count(*) AS set_size, sum(abs(score)) AS total FROM rk JOIN st USING (gene) GROUP BY 1, 2 HAVING count(*) BETWEEN 10 AND 500)",
    "al AS (SELECT rk.class, sz.term, pos, set_size, CASE WHEN st.gene IS NOT NULL THEN abs(score) / total ELSE -1.0 / (n - set_size) END AS step FROM rk JOIN sz USING (class) LEFT JOIN st ON st.term = sz.term AND st.gene = rk.gene)",
    "ru AS (SELECT *, sum(step) OVER (PARTITION BY class, term ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM al)",
    "ob AS MATERIALIZED (SELECT class, term, max(set_size) AS set_size, CASE WHEN greatest(max(run), 0) > -least(min(run), 0) THEN greatest(max(run), 0) ELSE least(min(run), 0) END AS es FROM ru GROUP BY 1, 2)"]


def _mixed(x: str) -> str:
    """The scrambling of 32 bits that deals use, as SQL."""
    step = lambda v: f"((xor({v}, ({v}) >> 16) * 73244475) & 4294967295)"
    last = step(step(f"(({x}) & 4294967295)"))
    return f"xor({last}, {last} >> 16)"


_MIRROR = "((k % n - x + n) % n)"
_DEALS = [
    "ln AS (SELECT n, max(set_size) AS many FROM (SELECT class, max(n) AS n FROM rk GROUP BY 1) JOIN ob USING (class) GROUP BY 1)",
    f"ky AS (SELECT p, j, {_mixed(f'213 * 1000003 + p * {E.ROUNDS} + j')} AS k FROM range(1, 1001) a(p), range({E.ROUNDS}) b(j))",
    f"wk AS (SELECT n, p, nth, nth - 1 AS x, 0::BIGINT AS j FROM ln, range(1, 1001) a(p), range(1, 501) b(nth) WHERE nth <= least(many, n) "
    f"UNION ALL SELECT n, p, nth, CASE WHEN {_mixed(f'greatest(x, {_MIRROR}) + k')} & 1 = 1 THEN {_MIRROR} ELSE x END, j + 1 FROM wk JOIN ky USING (p, j))",
    f"pl AS MATERIALIZED (SELECT n, p, nth, x + 1 AS pos FROM wk WHERE j = {E.ROUNDS})",
    "hi AS (SELECT class, set_size, p, pos, n, abs(score) AS w FROM (SELECT DISTINCT class, set_size FROM ob) JOIN rk USING (class) JOIN pl USING (n, pos) WHERE nth <= set_size)",
    "hr AS (SELECT *, sum(w) OVER o AS run, count(*) OVER o AS h, sum(w) OVER (PARTITION BY class, set_size, p) AS total FROM hi WINDOW o AS (PARTITION BY class, set_size, p ORDER BY pos ROWS UNBOUNDED PRECEDING))",
    "ht AS (SELECT class, set_size, p, greatest(0, max(run / total - (pos - h) / (n - set_size))) AS top, least(0, min((run - w) / total - (pos - h) / (n - set_size))) AS low FROM hr GROUP BY 1, 2, 3)",
    "nu AS (SELECT class, set_size, CASE WHEN top > -low THEN top ELSE low END AS null_es FROM ht)",
    "pv AS (SELECT ob.class, term, ob.set_size, es, es / avg(abs(null_es)) AS nes, (count(*) FILTER (abs(null_es) >= abs(es)) + 1) / (count(null_es) + 1) AS p_value "
    "FROM ob LEFT JOIN nu ON nu.class = ob.class AND nu.set_size = ob.set_size AND sign(es) = sign(null_es) GROUP BY 1, 2, 3, 4)",
    "pr AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY p_value) + count(*) OVER (PARTITION BY class, p_value) - 1 AS k, count(*) OVER (PARTITION BY class) AS m FROM pv)"]


@query("J19_enrichment_scores", sql("line_long line_meta", _GENES, *_SETS_IN_LISTS, body="SELECT class, term, set_size, round(es, 6) AS es FROM ob"))
def enrichment_scores(spark, d):
    from cohortia.session import join_on
    ranked = E.rank_list(gene_scores(spark, d), "class", "gene", "score")
    members = E.eligible_sets(ranked, gene_sets(spark, d), "class", "gene", "term")
    return rounded(E.running_scores(join_on(members, ranked, ["class", "gene"], "inner"), ["class", "term"]), "es")


@query("J19_enrichment_tests", sql("line_long line_meta", _GENES, *_SETS_IN_LISTS, *_DEALS, body="""SELECT class, term, set_size, round(es, 6) AS es, round(nes, 6) AS nes,
    round(p_value, 6) AS p_value, round(least(1, min(p_value * m / k) OVER (PARTITION BY class ORDER BY p_value DESC)), 6) AS adj_p FROM pr""").replace("WITH ", "WITH RECURSIVE ", 1))
def enrichment_tests(spark, d):
    return rounded(E.enrichment(gene_scores(spark, d), gene_sets(spark, d), group="class"), "es", "nes", "p_value", "adj_p")


_TERMS = """tm AS (SELECT 'N ' || n_name AS term, l_partkey AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), ts AS (SELECT term, count(*) AS score, count(*) AS n FROM tm GROUP BY 1)"""


@query("J20_term_reduction", sql("", _TERMS, "ov AS (SELECT a.term AS t, b.term AS p, count(*) AS o FROM tm a JOIN tm b USING (gene) GROUP BY 1, 2)",
    "ok AS (SELECT t, p, y.score FROM ov JOIN ts x ON x.term = t JOIN ts y ON y.term = p WHERE o / (x.n + y.n - o) >= 0.52)",
    body="SELECT t AS term, arg_min(p, (-score, p)) AS parent_term FROM ok GROUP BY 1"))
def term_reduction(spark, d):
    rows = line_long(spark, d).join(line_meta(spark, d).select("sample_id", "disease"), "sample_id")
    sets = rows.select(F.concat(F.lit("N "), "disease").alias("term"), "gene").distinct()
    scores = sets.groupBy("term").agg(F.count(F.lit(1)).alias("score"))
    return E.reduce_terms(sets, scores, threshold=0.52)


RULES = [("bolt|gear", "Hardware"), ("anvil|rod", "Forging"), ("^(red|blue|green) ", "Coloured")]


@query("J21_theme_assignment", """SELECT p_name, CASE WHEN regexp_matches(p_name, 'bolt|gear') THEN 'Hardware' WHEN regexp_matches(p_name, 'anvil|rod')
    THEN 'Forging' WHEN regexp_matches(p_name, '^(red|blue|green) ') THEN 'Coloured' ELSE 'Other' END AS theme, count(*) AS n FROM part GROUP BY 1, 2""")
def theme_assignment(spark, d):
    return (table(spark, d, "part").groupBy("p_name", E.assign_theme(F.col("p_name"), RULES).alias("theme"))
            .agg(F.count(F.lit(1)).alias("n")))


_TOP35 = """per AS (SELECT DISTINCT gene, disease, class FROM hits), t35 AS (SELECT gene, count(*) AS total FROM per GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 35)"""


@query("J22_pleiotropy_counts", sql("line_long line_meta", _HITS_SQL, _TOP35, body="""SELECT gene, class, count(*) AS n, max(total) AS total
    FROM per JOIN t35 USING (gene) GROUP BY 1, 2"""))
def pleiotropy_counts(spark, d):
    external = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("study"))
    return E.pleiotropy(line_hits(spark, d), external, "gene", "disease", "class", ["SMALL", "PROMO"])[0]


@query("J22_pleiotropy_evidence", sql("line_long line_meta", _HITS_SQL, _TOP35, body="""SELECT gene, study, CASE WHEN p_type = study THEN 'Yes' ELSE 'No' END AS present
    FROM t35 JOIN part ON gene = p_partkey CROSS JOIN (SELECT unnest(['SMALL', 'PROMO']) AS study)"""))
def pleiotropy_evidence(spark, d):
    external = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("study"))
    return E.pleiotropy(line_hits(spark, d), external, "gene", "disease", "class", ["SMALL", "PROMO"])[1]


@query("J23_marker_overlap", sql("line_long", """own AS (SELECT gene, rank() OVER (ORDER BY sum(quantity) DESC) AS r FROM line_long GROUP BY 1)""",
    """ls AS (SELECT gene, 'own' AS study FROM own WHERE r <= 150 UNION ALL SELECT p_partkey, 'large' FROM part WHERE p_size > 40
    UNION ALL SELECT p_partkey, 'dear' FROM part WHERE p_retailprice > 950)""",
    body="SELECT groups, count(*) AS n FROM (SELECT gene, array_to_string(list(DISTINCT study ORDER BY study), '|') AS groups FROM ls GROUP BY 1) GROUP BY 1"))
def marker_overlap(spark, d):
    own = line_long(spark, d).groupBy("gene").agg(F.sum("quantity").alias("strength"))
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "gene")
    out = E.marker_overlap(own, {"large": part.filter("p_size > 40"), "dear": part.filter("p_retailprice > 950")}, "gene", "strength")
    return out.withColumn("groups", F.array_join("groups", "|"))


@query("J25_importance_vs_effect", sql("line_long", _IMP_SQL, body="""SELECT variable, round(mean_importance, 6) AS mean_importance, n_seeds, round(effect, 6) AS effect
    FROM (SELECT variable, avg(abs(importance)) AS mean_importance, count(DISTINCT seed) AS n_seeds FROM imp WHERE importance <> 0 GROUP BY 1)
    JOIN (SELECT gene AS variable, stddev_samp(value) AS effect FROM line_long GROUP BY 1) USING (variable)"""))
def importance_vs_effect(spark, d):
    imp = D.importance_summary(importances(spark, d), ["variable"])
    effect = line_long(spark, d).groupBy(F.col("gene").alias("variable")).agg(F.stddev_samp("value").alias("effect"))
    return rounded(imp.join(effect, "variable"), "mean_importance", "effect")
