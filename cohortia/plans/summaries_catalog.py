"""Summaries, windows and chart layers over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.operators import layers as L
from cohortia.operators import summaries as D
from cohortia.operators import windows as W
from cohortia.plans.bindings import (emb_long, emb_meta, emb_values, evt_long, line_long, line_meta,
                                     scored, sql, table)
from cohortia.plans.registry import query


def r6(col):
    return F.round(col, 6)


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def n_rows(df, column="n"):
    return df.agg(F.count(F.lit(1)).alias(column))


# --- D: aggregations ------------------------------------------------------------------------

@query("D1_count_per_group", sql("line_long line_meta", body="""SELECT class, disease, block, count(*) AS n
    FROM line_long JOIN line_meta USING (sample_id) GROUP BY 1, 2, 3"""))
def count_per_group(spark, d):
    return (line_long(spark, d).join(line_meta(spark, d), "sample_id")
            .groupBy("class", "disease", "block").agg(F.count(F.lit(1)).alias("n")))


@query("D2_distinct_count", sql("line_long", body="""SELECT assay, count(DISTINCT sample_id) AS n_samples
    FROM line_long GROUP BY 1"""))
def distinct_count(spark, d):
    return line_long(spark, d).groupBy("assay").agg(F.countDistinct("sample_id").alias("n_samples"))


_D3 = """det AS (SELECT subject, assay, CAST(coalesce(sum(CASE WHEN value > lod THEN 1 WHEN value <= lod THEN 0 END), 0)
    AS BIGINT) AS above_count FROM evt_long GROUP BY 1, 2)"""
_VIS = "vis AS (SELECT subject, count(DISTINCT visit) AS visits FROM evt_long GROUP BY 1)"
_D4 = """cls AS (SELECT subject, detectability, count(*) AS n FROM (SELECT subject,
    CASE WHEN above_count / visits = 0 THEN 'None' WHEN above_count / visits = 1 THEN 'All'
    WHEN above_count / visits > 0 AND above_count / visits <= 0.5 THEN 'Some: < 50%'
    WHEN above_count / visits < 1 AND above_count / visits > 0.5 THEN 'Some: > 50%' END AS detectability
    FROM det LEFT JOIN vis USING (subject)) GROUP BY 1, 2)"""


@query("D3_detection_counts", sql("evt_long", _D3, body="SELECT * FROM det"))
def detection_counts(spark, d):
    return D.detection_counts(evt_long(spark, d), ["subject", "assay"])


@query("D4_detectability_classes", sql("evt_long", _D3, _VIS, _D4, body="SELECT * FROM cls"))
def detectability_classes(spark, d):
    e = evt_long(spark, d)
    return D.detectability_classes(e, e)


@query("D5_class_means", sql("evt_long", _D3, _VIS, _D4, body="""SELECT detectability, round(avg(n), 6) AS mean_n,
    round(avg(n) / (SELECT count(DISTINCT assay) FROM evt_long) * 100, 6) AS percent FROM cls GROUP BY 1"""))
def class_means(spark, d):
    e = evt_long(spark, d)
    n = e.agg(F.countDistinct("assay").alias("n"))
    return rounded(D.class_means(D.detectability_classes(e, e), n), "mean_n", "percent")


@query("D6_detected_share", sql("evt_long", body="""SELECT flag, assay, n, round(percent, 6) AS percent FROM (SELECT assay,
    CASE WHEN value > lod THEN 'Yes' WHEN value <= lod THEN 'No' END AS flag, count(*) AS n,
    count(*) / (SELECT count(*) FROM evt_long) * 100 AS percent FROM evt_long GROUP BY 1, 2)
    WHERE (flag = 'Yes' AND percent > 8.4) OR (flag = 'No' AND percent > 11)"""))
def detected_share(spark, d):
    e = evt_long(spark, d)
    parts = [D.detected_share(e, n_rows(e), flag, cut).withColumn("flag", F.lit(flag))
             for flag, cut in (("Yes", 8.4), ("No", 11.0))]
    return rounded(parts[0].unionByName(parts[1]), "percent")


@query("D7_detectability_table", sql("evt_long", body="""SELECT assay, count(*) FILTER (value > lod) AS n_above,
    round(count(*) FILTER (value > lod) / (SELECT count(DISTINCT sample_id) FROM evt_long) * 100, 6) AS percent
    FROM evt_long GROUP BY 1"""))
def detectability_table(spark, d):
    e = evt_long(spark, d)
    return rounded(D.detectability_table(e, e.agg(F.countDistinct("sample_id").alias("n"))), "percent")


@query("D8_visit_ranges", sql("evt_long", body="""SELECT visit, CAST(min(date) AS DATE) AS start_date,
    CAST(max(date) AS DATE) AS end_date FROM evt_long GROUP BY 1"""))
def visit_ranges(spark, d):
    e = evt_long(spark, d)
    return D.visit_ranges(e.withColumn("date", F.to_date("date")))


@query("D9_five_figures", sql("line_long line_meta", body="""SELECT disease, assay, round_even(avg(value), 2) AS mean,
    round_even(quantile_cont(value, 0.5), 2) AS median, round_even(quantile_cont(value, 0.25), 2) AS q1,
    round_even(quantile_cont(value, 0.75), 2) AS q3 FROM line_long JOIN line_meta USING (sample_id) GROUP BY 1, 2"""))
def five_figures(spark, d):
    rows = line_long(spark, d).join(line_meta(spark, d).select("sample_id", "disease"), "sample_id")
    return D.five_figures(rows, ["disease", "assay"])


@query("D10_cohort_table", sql("emb_meta", body="""SELECT disease, min(class) AS class, count(*) AS n,
    count(*) FILTER (sex = 'F') AS n_female, count(*) FILTER (sex = 'M') AS n_male,
    printf('%.1f (%.1f - %.1f)', round_even(avg(age), 1), round_even(min(age), 1), round_even(max(age), 1)) AS age_range
    FROM emb_meta GROUP BY 1"""))
def cohort_table(spark, d):
    return D.cohort_table(emb_meta(spark, d))


@query("D11_group_means", sql("line_long", body="""SELECT assay, batch, round(avg(value), 6) AS mean_value
    FROM line_long GROUP BY 1, 2"""))
def group_means(spark, d):
    return rounded(D.group_means(line_long(spark, d), ["assay", "batch"]), "mean_value")


# two fixed scores of a vector: the sums of its even and of its odd entries, added in order
_XY_SQL = ", ".join(" + ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(first, 64, 2)) + f" AS {name}" for first, name in ((0, "x"), (1, "y")))


def points(spark, d):
    def score(first):
        return sum((F.col("embedding")[i].cast("double") for i in range(first + 2, 64, 2)), F.col("embedding")[first].cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), score(0).alias("x"), score(1).alias("y"))


@query("D12_group_centres", sql("emb_meta", "pts AS (SELECT class, " + _XY_SQL + " FROM embeddings e JOIN emb_meta m ON vec_id = sample_id)",
    body="SELECT class, round(median(x), 6) AS x_centre, round(median(y), 6) AS y_centre FROM pts GROUP BY 1"))
def group_centres(spark, d):
    pts = points(spark, d).join(emb_meta(spark, d), "sample_id")
    return rounded(D.group_centres(pts, "class", ("x", "y")), "x_centre", "y_centre")


_HITS_SQL = """hits AS (SELECT DISTINCT class, disease, gene, assay, block FROM line_long JOIN line_meta USING (sample_id)
    WHERE quantity > 40)"""


def line_hits(spark, d):
    """Parts (as assays) ordered in quantity, per nation (as disease): the stand-in hit list."""
    return (line_long(spark, d).filter("quantity > 40").join(line_meta(spark, d), "sample_id")
            .select("class", "disease", "gene", "assay", "block").distinct())


@query("D13_count_of_counts", sql("line_long line_meta", _HITS_SQL, body="""SELECT class, times, count(*) AS n_items FROM
    (SELECT class, gene, count(*) AS times FROM hits GROUP BY 1, 2) GROUP BY 1, 2"""))
def count_of_counts(spark, d):
    return D.count_of_counts(line_hits(spark, d), "class", "gene")


@query("D14_pair_overlaps", sql("line_long line_meta", _HITS_SQL, "h AS (SELECT DISTINCT disease, gene FROM hits)",
    "g AS (SELECT DISTINCT disease FROM h)", body="""SELECT a.disease AS src, b.disease AS dst, (SELECT count(*) FROM h x JOIN h y
    USING (gene) WHERE x.disease = a.disease AND y.disease = b.disease) AS overlap FROM g a JOIN g b ON a.disease <> b.disease"""))
def pair_overlaps(spark, d):
    return D.pair_overlaps(line_hits(spark, d), "gene", "disease")


@query("D15_set_intersections", sql("line_long line_meta", _HITS_SQL, body="""SELECT groups, n FROM (SELECT groups, count(*) AS n,
    rank() OVER (ORDER BY count(*) DESC) AS r FROM (SELECT gene, array_to_string(list(DISTINCT class ORDER BY class), '|') AS groups
    FROM hits GROUP BY 1) GROUP BY 1) WHERE r <= 20"""))
def set_intersections(spark, d):
    sizes = D.set_sizes(line_hits(spark, d), "gene", "class")
    top = W.top_with_ties(sizes, [], "n", 20)
    return top.withColumn("groups", F.array_join("groups", "|"))


@query("D16_shares", """SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent,
    p_type || ' (' || count(*) || ')' AS label FROM part GROUP BY 1""")
def shares(spark, d):
    return rounded(D.shares(table(spark, d, "part"), "p_type"), "percent")


@query("D17_conditional_counts", sql("emb_meta", body="""SELECT disease, count(*) FILTER (sex = 'M') AS n_males,
    count(*) FILTER (sex = 'F') AS n_females FROM emb_meta GROUP BY 1"""))
def conditional_counts(spark, d):
    return emb_meta(spark, d).groupBy("disease").agg(
        F.count_if(F.col("sex") == "M").alias("n_males"), F.count_if(F.col("sex") == "F").alias("n_females"))


@query("D18_missing_counts", sql("emb_values", body="""SELECT assay, count(*) AS n, count(*) FILTER (gappy IS NULL) AS n_missing,
    round(count(*) FILTER (gappy IS NULL) / count(*) * 100, 6) AS percent FROM emb_values GROUP BY 1"""))
def missing_counts(spark, d):
    return rounded(D.missing_counts(emb_values(spark, d, gaps=True)), "percent")


@query("D19_auc_summary", sql("line_long line_meta", body="""SELECT disease, flag, round(avg(a), 6) AS mean_auc,
    round(stddev_samp(a), 6) AS sd_auc FROM (SELECT disease, flag, batch, avg(value / 12) AS a FROM line_long
    JOIN line_meta USING (sample_id) GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def auc_summary(spark, d):
    runs = (line_long(spark, d).join(line_meta(spark, d), "sample_id").groupBy("disease", "flag", "batch")
            .agg(F.avg(F.col("value") / 12).alias("auc")))
    return rounded(D.auc_summary(runs, ["disease", "flag"]), "mean_auc", "sd_auc")


_IMP_SQL = """imp AS (SELECT gene AS variable, batch AS seed, quantity - 25 AS importance,
    CASE WHEN quantity > 25 THEN 'POS' WHEN quantity < 25 THEN 'NEG' END AS sign, assay FROM line_long)"""


def importances(spark, d, rows=0):
    """Parts as features, suppliers as runs, centred quantity as signed importance."""
    q = F.col("quantity") - 25
    return line_long(spark, d, rows).select(
        F.col("gene").alias("variable"), F.col("batch").alias("seed"), q.alias("importance"),
        F.when(q > 0, "POS").when(q < 0, "NEG").alias("sign"), "assay")


@query("D20_importance_summary", sql("line_long", _IMP_SQL, body="""SELECT variable, round(avg(abs(importance)), 6) AS mean_importance,
    count(DISTINCT seed) AS n_seeds FROM imp WHERE importance <> 0 GROUP BY 1"""))
def importance_summary(spark, d):
    return rounded(D.importance_summary(importances(spark, d), ["variable"]), "mean_importance")


@query("D21_hit_counts_by_term", sql("line_long", "p AS (SELECT block AS term, flag AS dataset, pow(quantity / 50, 3) AS p FROM line_long)",
    "r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY p) AS k0, count(*) OVER (PARTITION BY dataset, p) AS ties, count(*) OVER (PARTITION BY dataset) AS m FROM p)",
    "a AS (SELECT *, least(1, min(p * m / (k0 + ties - 1)) OVER (PARTITION BY dataset ORDER BY p DESC)) AS adj FROM r)",
    body="SELECT term, dataset, count(*) AS n FROM a WHERE adj < 0.05 GROUP BY 1, 2"))
def hit_counts(spark, d):
    tests = line_long(spark, d).select(F.col("block").alias("term"), F.col("flag").alias("dataset"),
                                       F.pow(F.col("quantity") / 50, F.lit(3)).alias("p_value"))
    return (W.bh_adjust(tests, ["dataset"]).filter("adj_p < 0.05")
            .groupBy("term", "dataset").agg(F.count(F.lit(1)).alias("n")))


@query("D22_term_counts", sql("line_long line_meta", _HITS_SQL, "c AS (SELECT disease, assay AS parent, count(*) AS n FROM hits GROUP BY 1, 2)",
    "k AS (SELECT assay AS parent, count(*) AS total FROM hits GROUP BY 1 HAVING count(*) > 10)",
    body="SELECT disease, parent, n, total FROM c JOIN k USING (parent)"))
def term_counts(spark, d):
    hits = line_hits(spark, d).withColumnRenamed("assay", "parent")
    keep = hits.groupBy("parent").agg(F.count(F.lit(1)).alias("total")).filter("total > 10")
    return hits.groupBy("disease", "parent").agg(F.count(F.lit(1)).alias("n")).join(keep, "parent")


@query("D23_case_totals", sql("line_long line_meta", _HITS_SQL, "bars AS (SELECT gene, class, count(*) AS n FROM hits GROUP BY 1, 2)",
    body="""SELECT gene, CAST(sum(n) AS BIGINT) AS y_position FROM bars WHERE gene IN (SELECT p_partkey FROM part WHERE p_size > 40)
    GROUP BY 1"""))
def case_totals(spark, d):
    bars = line_hits(spark, d).groupBy("gene", "class").agg(F.count(F.lit(1)).alias("n"))
    listed = table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("gene"))
    return bars.join(listed, "gene", "left_semi").groupBy("gene").agg(F.sum("n").alias("y_position"))


# --- E: windows -----------------------------------------------------------------------------

@query("E1_rank_first", sql("line_meta", body="""SELECT subject, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, subject) AS rank
    FROM line_meta GROUP BY 1"""))
def rank_first(spark, d):
    return W.rank_first(line_meta(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n")), "n", ["subject"])


@query("E2_sign_agreement", sql("line_long", _IMP_SQL, "s AS (SELECT variable, sign, count(DISTINCT seed) AS n FROM imp WHERE importance <> 0 GROUP BY 1, 2)",
    body="SELECT variable, round(max(n) / sum(n) * 100, 6) AS max_share FROM s GROUP BY 1"))
def sign_agreement(spark, d):
    return rounded(W.sign_agreement(importances(spark, d)), "max_share")


_CM = """cm AS (SELECT quality AS truth, CAST(score > 1000 AS INTEGER) AS predicted, count(*) AS n FROM scored GROUP BY 1, 2)"""


@query("E3_confusion_shares", sql("scored", _CM, body="""SELECT truth, predicted, n, CAST(percent AS BIGINT) AS percent,
    CASE WHEN percent > 10 THEN CAST(CAST(percent AS BIGINT) AS VARCHAR) ELSE '' END AS label FROM
    (SELECT *, round_even(n / sum(n) OVER (PARTITION BY truth) * 100, 0) AS percent FROM cm)"""))
def confusion_shares(spark, d):
    cm = (scored(spark, d).groupBy(F.col("quality").alias("truth"), (F.col("score") > 1000).cast("int").alias("predicted"))
          .agg(F.count(F.lit(1)).alias("n")))
    return W.confusion_shares(cm)


@query("E4_arcs", """SELECT p_type, n, round(run / total, 6) AS arc_end, round((run - n) / total, 6) AS arc_start FROM
    (SELECT p_type, n, sum(n) OVER (ORDER BY p_type) AS run, sum(n) OVER () AS total FROM
    (SELECT p_type, count(*) AS n FROM part GROUP BY 1))""")
def arcs(spark, d):
    counts = table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return rounded(W.arcs(counts, "p_type"), "arc_end", "arc_start")


@query("E5_group_total", sql("line_long", body="""SELECT sample_id, line, assay, round(sum(value) OVER (PARTITION BY assay), 4) AS total
    FROM line_long"""))
def group_total(spark, d):
    out = W.attach_totals(line_long(spark, d), ["assay"], total=F.sum("value"))
    return out.select("sample_id", "line", "assay", F.round("total", 4).alias("total"))


@query("E6_rescale", sql("line_long", _IMP_SQL, "g AS (SELECT *, min(abs(importance)) OVER w AS lo, max(abs(importance)) OVER w AS hi FROM imp WINDOW w AS (PARTITION BY assay, seed))",
    body="""SELECT assay, seed, variable, round(CASE WHEN hi = lo THEN 50 ELSE (abs(importance) - lo) / (hi - lo) * 100 END, 6) AS scaled,
    round(CASE WHEN hi = 0 THEN 50 ELSE abs(importance) / hi * 100 END, 6) AS scaled_zero FROM g"""))
def rescale(spark, d):
    imp = importances(spark, d).withColumn("importance", F.abs("importance"))
    once = W.rescale(imp, ["assay", "seed"], "importance").withColumnRenamed("scaled", "first")
    both = W.rescale(once, ["assay", "seed"], "importance", from_zero=True)
    return both.select("assay", "seed", "variable", r6("first").alias("scaled"), r6("scaled").alias("scaled_zero"))


@query("E7_bh_adjust", sql("line_long", "p AS (SELECT sample_id, line, block AS family, (quantity * 977 + line * 13) % 1000 / 1000.0::DOUBLE AS p_value FROM line_long)",
    "r AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY p_value) + count(*) OVER (PARTITION BY family, p_value) - 1 AS k, count(*) OVER (PARTITION BY family) AS m FROM p)",
    body="""SELECT sample_id, line, family, round(least(1, min(p_value * m / k) OVER (PARTITION BY family ORDER BY p_value DESC)), 6) AS adj_p
    FROM r"""))
def bh_adjust(spark, d):
    tests = line_long(spark, d).select("sample_id", "line", F.col("block").alias("family"),
                                       ((F.col("quantity") * 977 + F.col("line") * 13) % 1000 / 1000).alias("p_value"))
    return W.bh_adjust(tests, ["family"]).select("sample_id", "line", "family", r6("adj_p").alias("adj_p"))


@query("E8_top_per_group", sql("line_long line_meta", body="""SELECT disease, sample_id, line, quantity FROM (SELECT *, rank() OVER
    (PARTITION BY disease ORDER BY quantity DESC) AS r FROM line_long JOIN line_meta USING (sample_id)) WHERE r <= 3"""))
def top_per_group(spark, d):
    rows = line_long(spark, d).join(line_meta(spark, d).select("sample_id", "disease"), "sample_id")
    return W.top_with_ties(rows.select("disease", "sample_id", "line", "quantity"), ["disease"], "quantity", 3)


# --- L: chart layers ------------------------------------------------------------------------

@query("L1_histogram", sql("line_meta", "e AS (SELECT min(age) AS lo, max(age) AS hi FROM line_meta)",
    "b AS (SELECT class, CAST(least(floor((age - lo) / ((hi - lo) / 30)) + 1, 30) AS INTEGER) AS bin, count(*) AS n FROM line_meta, e GROUP BY 1, 2)",
    body="""SELECT class, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT class FROM line_meta) CROSS JOIN
    (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS bin) LEFT JOIN b USING (class, bin)"""))
def histogram(spark, d):
    return L.histogram(line_meta(spark, d), ["class"], "age", 30)


_BOX = """q AS (SELECT {k}, count({v}) AS n, avg({v}) AS mean, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
    quantile_cont({v}, 0.75) AS q3 FROM {t} GROUP BY {k}), box AS (SELECT {k}, any_value(q.n) AS n, round(any_value(mean), 6) AS mean,
    round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
    round(min({v}) FILTER ({v} >= q1 - 1.5 * (q3 - q1) AND {v} <= q3 + 1.5 * (q3 - q1)), 6) AS low,
    round(max({v}) FILTER ({v} >= q1 - 1.5 * (q3 - q1) AND {v} <= q3 + 1.5 * (q3 - q1)), 6) AS high,
    count(*) FILTER ({v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM {t} JOIN q USING ({k}) GROUP BY {k})"""
BOX_COLS = ["mean", "q1", "median", "q3", "low", "high"]


@query("L2_box_stats", sql("line_long", _BOX.format(k="assay", v="value", t="line_long"), body="SELECT * FROM box"))
def box_stats(spark, d):
    return rounded(L.box_stats(line_long(spark, d), ["assay"], "value"), *BOX_COLS)


@query("L3_mean_marker", sql("emb_long", body="SELECT disease, assay, round(avg(value), 6) AS mean FROM emb_long GROUP BY 1, 2"))
def mean_marker(spark, d):
    return rounded(L.mean_marker(emb_long(spark, d), ["disease", "assay"], "value"), "mean")


@query("L4_density", sql("line_meta", """q AS (SELECT class, count(age) AS n, min(age) AS lo, max(age) AS hi, stddev_samp(age) AS sd,
    quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.5) AS median, quantile_cont(age, 0.75) AS q3 FROM line_meta GROUP BY 1)""",
    "s AS (SELECT *, 0.9 * least(sd, (q3 - q1) / 1.34) * pow(n, -0.2) AS bw FROM q)",
    "c AS (SELECT class, least(floor((age - lo) / ((hi - lo) / 128)), 127) AS cell, count(*) AS w FROM line_meta JOIN s USING (class) GROUP BY 1, 2)",
    body="""SELECT class, CAST(point AS INTEGER) AS point, round(min(lo + point * (hi - lo) / 31), 6) AS x, round(min(median), 6) AS median,
    round(sum(w * exp(-0.5 * pow((lo + point * (hi - lo) / 31 - (lo + (cell + 0.5) * ((hi - lo) / 128))) / bw, 2)) / (n * bw * sqrt(2 * pi()))), 9) AS density
    FROM c JOIN s USING (class) CROSS JOIN (SELECT unnest(range(32)) AS point) GROUP BY 1, 2"""))
def density(spark, d):
    out = L.density(line_meta(spark, d), ["class"], "age")
    return out.withColumns({"x": r6("x"), "median": r6("median"), "density": F.round("density", 9)})


@query("L5_ellipse", sql("emb_meta", "pts AS (SELECT class, " + _XY_SQL + " FROM embeddings JOIN emb_meta ON vec_id = sample_id)",
    "m AS (SELECT class, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM pts GROUP BY 1)",
    body="""SELECT class, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(vx, 6) AS vx, round(vy, 6) AS vy, round(vxy, 6) AS vxy,
    round(sqrt(((vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + pow(vxy, 2))) * 5.991464547107979), 6) AS major,
    round(sqrt(greatest((vx + vy) / 2 - sqrt(pow((vx - vy) / 2, 2) + pow(vxy, 2)), 0) * 5.991464547107979), 6) AS minor,
    round(atan2(2 * vxy, vx - vy) / 2, 6) AS angle FROM m"""))
def ellipse(spark, d):
    pts = points(spark, d).join(emb_meta(spark, d), "sample_id")
    return rounded(L.ellipse(pts, ["class"], ("x", "y")), "cx", "cy", "vx", "vy", "vxy", "major", "minor", "angle")


@query("L6_trend", sql("emb_long", body="""SELECT assay, sex, round(regr_slope(gappy, age), 6) AS slope,
    round(regr_intercept(gappy, age), 6) AS intercept, count(gappy) AS n FROM emb_long GROUP BY 1, 2"""))
def trend(spark, d):
    return rounded(L.trend(emb_long(spark, d, gaps=True), ["assay", "sex"], "age", "value"), "slope", "intercept")


@query("L6_binned_trend", sql("emb_long", body="""SELECT assay, CAST(floor(age / 10) * 10 AS DOUBLE) AS band, count(gappy) AS n,
    round(avg(gappy), 6) AS mean, round(stddev_samp(gappy) / sqrt(count(gappy)), 6) AS se FROM emb_long GROUP BY 1, 2"""))
def binned_trend(spark, d):
    return rounded(L.binned_trend(emb_long(spark, d, gaps=True), ["assay"], "age", "value", 10), "mean", "se")


@query("L7_trajectory", sql("evt_long", "v AS (SELECT subject, assay, visit, avg(value) AS value FROM evt_long GROUP BY 1, 2, 3)",
    body="""SELECT subject, assay, visit, round(value, 6) AS value, CAST(row_number() OVER w AS INTEGER) AS step,
    round(value - lag(value) OVER w, 6) AS change FROM v WINDOW w AS (PARTITION BY subject, assay ORDER BY visit)"""))
def trajectory(spark, d):
    v = evt_long(spark, d).groupBy("subject", "assay", "visit").agg(F.avg("value").alias("value"))
    return rounded(L.trajectory(v, ["subject", "assay"], ["visit"], "value"), "value", "change")


_OVER = """ov AS (SELECT x.disease AS src, y.disease AS dst, count(*) AS overlap FROM h x JOIN h y USING (gene)
    WHERE x.disease <> y.disease GROUP BY 1, 2)"""
_EDGES = """edges AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, overlap FROM (SELECT *, rank() OVER
    (PARTITION BY src ORDER BY overlap DESC) AS r FROM ov) WHERE r <= 3 AND overlap > 50)"""


@query("L8_overlap_edges", sql("line_long line_meta", _HITS_SQL, "h AS (SELECT DISTINCT disease, gene FROM hits)", _OVER, _EDGES,
                               body="SELECT * FROM edges"))
def overlap_edges(spark, d):
    nodes = line_meta(spark, d).select("disease", "class").distinct()
    return L.overlap_graph(line_hits(spark, d), nodes, "gene", "disease", above=50)[0]


@query("L8_overlap_nodes", sql("line_long line_meta", _HITS_SQL, "h AS (SELECT DISTINCT disease, gene FROM hits)", _OVER, _EDGES,
                               body="""SELECT DISTINCT disease, class FROM line_meta WHERE disease IN (SELECT src FROM edges)
                               OR disease IN (SELECT dst FROM edges)"""))
def overlap_nodes(spark, d):
    nodes = line_meta(spark, d).select("disease", "class").distinct()
    return L.overlap_graph(line_hits(spark, d), nodes, "gene", "disease", above=50)[1]


@query("L9_box_source", sql("line_long line_meta", body="""SELECT l.sample_id, assay, round(value, 6) AS value, status || '_' || segment AS cohort_label,
    CASE WHEN class = 'EUROPE' THEN class || '_' || status || '_' || segment ELSE class END AS class, status, segment
    FROM line_long l JOIN line_meta m USING (sample_id) WHERE assay IN ('Brand#1', 'Brand#2') AND class <> 'ASIA'"""))
def box_source(spark, d):
    out = L.box_source(line_long(spark, d), line_meta(spark, d), ["Brand#1", "Brand#2"], "class",
                       ["status", "segment"], "EUROPE", drop_pattern="ASIA")
    return rounded(out, "value")


@query("J24_batch_profile", sql("line_long line_meta", "raw AS (SELECT CASE WHEN segment = 'FURNITURE' THEN 'HOUSEHOLD' ELSE segment END AS donor, batch % 10 AS plate_number, value FROM line_long JOIN line_meta USING (sample_id) WHERE segment IN ('FURNITURE', 'HOUSEHOLD', 'BUILDING'))",
    _BOX.format(k="donor, plate_number", v="value", t="raw"), body="SELECT * FROM box"))
def batch_profile(spark, d):
    raw = (line_long(spark, d).join(line_meta(spark, d), "sample_id")
           .withColumn("plate", F.concat(F.lit("Plate "), (F.col("batch") % 10).cast("string"))))
    donors = {"FURNITURE": "HOUSEHOLD", "HOUSEHOLD": "HOUSEHOLD", "BUILDING": "BUILDING"}
    return rounded(L.batch_profile(raw, donors, ["plate", "assay"], donor="segment")[1]
                   .withColumnRenamed("segment", "donor"), *BOX_COLS)
