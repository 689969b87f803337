"""Sources, projections, joins, sorts, sets, reshapes and scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia import sources
from cohortia.functions import scalar as S
from cohortia.operators import joins as J
from cohortia.operators import reshape as R
from cohortia.operators import verbs as V
from cohortia.operators import windows as W
from cohortia.plans.bindings import (emb_long, emb_meta, emb_values, evt_long, line_long, line_meta,
                                     scored, sql, table)
from cohortia.plans.registry import query
from cohortia.session import scratch_path

EVT_SCHEMA = "sample_id long, subject long, assay string, value double, lod double, visit int"
EVT_SQL = sql("evt_long", body="SELECT sample_id, subject, assay, value, lod, visit FROM evt_long")
EVT_COLS = ["sample_id", "subject", "assay", "value", "lod", "visit"]


def r6(col):
    return F.round(col, 6)


# --- A: sources and sinks -------------------------------------------------------------------

@query("A1_read_tsv", EVT_SQL)
def read_tsv(spark, d):
    path = sources.write_tsv(evt_long(spark, d).select(*EVT_COLS), scratch_path(spark, "a1"))
    return sources.read_tsv(spark, path, EVT_SCHEMA)


@query("A2_read_csv", "SELECT event_id, event_type, props FROM events")
def read_csv(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", "props")
    path = sources.write_csv(df, scratch_path(spark, "a2"))
    return sources.read_csv(spark, path, "event_id long, event_type string, props string")


@query("A3_read_semicolon_decimal_comma", EVT_SQL)
def read_semicolon(spark, d):
    df = evt_long(spark, d).select(*EVT_COLS).withColumns(
        {c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")) for c in ("value", "lod")})
    path = sources.write_csv(df, scratch_path(spark, "a3"), sep=";")
    return sources.read_semicolon(spark, path, EVT_SCHEMA, decimal_comma=True)


@query("A4_read_blank_delimited", EVT_SQL)
def read_blanks(spark, d):
    df = evt_long(spark, d).select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in EVT_COLS])
    path = scratch_path(spark, "a4")
    turned = df.columns[::-1]  # the header gives the order
    (df.select(F.concat_ws("  ", *turned).alias("value")).unionByName(spark.range(1).select(F.lit("\t".join(turned)).alias("value")))
     .orderBy(~F.col("value").startswith(turned[0])).write.text(path))
    return sources.read_blanks(spark, path, EVT_SCHEMA)


@query("A5_read_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def read_parquet(spark, d):
    return (sources.read_parquet(spark, f"{d}/orders.parquet").filter("o_orderstatus = 'F'")
            .select("o_orderkey", "o_custkey", "o_totalprice"))


@query("A6_read_by_extension", """SELECT source_kind, count(*) AS n, round(sum(value), 2) AS total FROM
    (SELECT unnest(['csv', 'tsv', 'txt', 'parquet']) AS source_kind, value FROM events) GROUP BY source_kind""")
def read_by_extension(spark, d):
    df = evt_long(spark, d).select("sample_id", "value")
    schema, parts = "sample_id long, value double", []
    for kind in ("csv", "tsv", "txt", "parquet"):
        path = f"{scratch_path(spark, 'a6')}.{kind}"
        if kind == "parquet":
            df.write.parquet(path)
        elif kind == "txt":
            text = df.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in df.columns]).alias("value"))
            text.unionByName(spark.range(1).select(F.lit(" ".join(df.columns)).alias("value"))).orderBy(~F.col("value").startswith("s")).write.text(path)
        else:
            sources.write_csv(df, path, sep="," if kind == "csv" else "\t")
        parts.append(sources.read_table(spark, path, schema).withColumn("source_kind", F.lit(kind)))
    return (R.stack(*parts).groupBy("source_kind")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")))


@query("A7_read_seed_results", """SELECT 'importance' AS type, event_type AS class, CAST(user_id % 10 AS INTEGER) AS seed,
    count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 2, 3""")
def read_seed_results(spark, d):
    root = scratch_path(spark, "a7")
    df = table(spark, d, "events").select(
        F.col("event_type").alias("kind"), (F.col("user_id") % 10).cast("int").alias("seed"), "event_id", "value")
    sources.write_tsv(df, f"{root}/importance", partition_by=["kind", "seed"])
    back = sources.read_seed_results(spark, root, "event_id long, value double")
    return (back.withColumn("class", F.regexp_replace("class", "^kind=", ""))
            .groupBy("type", "class", "seed")
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value")))


@query("A8_write_tsv", "SELECT vec_id AS sample_id, label FROM embeddings")
def write_tsv(spark, d):
    df = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    path = sources.write_tsv(df, scratch_path(spark, "a8"))
    return sources.read_tsv(spark, path, "sample_id long, label int")


@query("A9_write_csv_variants", """SELECT sep, count(*) AS n, count(DISTINCT text) AS n_text FROM
    (SELECT unnest(['comma', 'semicolon']) AS sep, text FROM conversations) GROUP BY sep""")
def write_csv(spark, d):
    df = table(spark, d, "conversations").select("conv_id", "turn", "text")
    parts = []
    for name, sep in (("comma", ","), ("semicolon", ";")):
        path = sources.write_csv(df, scratch_path(spark, "a9"), sep=sep)
        back = sources.read_delimited(spark, path, "conv_id long, turn long, text string", sep, missing="\u0000", multi_line=True)
        parts.append(back.withColumn("sep", F.lit(name)))
    return (R.stack(*parts).groupBy("sep")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_text")))


@query("A10_persist_result", """SELECT event_type AS assay, CAST(user_id % 5 AS INTEGER) AS seed, count(*) AS n
    FROM events GROUP BY 1, 2""")
def persist_result(spark, d):
    path = scratch_path(spark, "a10")
    res = (evt_long(spark, d).withColumn("seed", (F.col("subject") % 5).cast("int"))
           .groupBy("assay", "seed").agg(F.count(F.lit(1)).alias("n")))
    sources.save_table(res, path, ["seed"])
    return sources.load_table(spark, path).select("assay", "seed", "n")


# --- B: projections, filters, predicates ----------------------------------------------------

@query("B1_select_rename", "SELECT l_orderkey AS sample_id, l_suppkey AS batch, l_quantity AS value FROM lineitem")
def select_rename(spark, d):
    return V.select_as(table(spark, d, "lineitem"), sample_id="l_orderkey", batch="l_suppkey", value="l_quantity")


@query("B2_filter_conjunction", sql("emb_values", body="""SELECT sample_id, assay, round(gappy, 6) AS value
    FROM emb_values WHERE gappy IS NOT NULL AND gappy > 0 AND assay <> 'A00'"""))
def filter_conjunction(spark, d):
    return (emb_values(spark, d, gaps=True)
            .filter(F.col("value").isNotNull() & (F.col("value") > 0) & (F.col("assay") != "A00"))
            .withColumn("value", r6("value")))


@query("B3_membership", """SELECT p_type, p_brand, count(*) AS n FROM part WHERE p_type IN ('SMALL', 'LARGE')
    AND p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY 1, 2""")
def membership(spark, d):
    return (table(spark, d, "part").filter(F.col("p_type").isin("SMALL", "LARGE"))
            .filter(~F.col("p_brand").isin("Brand#1", "Brand#2"))
            .groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n")))


@query("B4_detection_flag", sql("evt_long", body="""SELECT assay, CASE WHEN value > lod THEN 'Yes'
    WHEN value <= lod THEN 'No' END AS above_lod, count(*) AS n FROM evt_long GROUP BY 1, 2"""))
def detection_flag(spark, d):
    return (evt_long(spark, d).withColumn("above_lod", S.above(F.col("value"), F.col("lod")))
            .groupBy("assay", "above_lod").agg(F.count(F.lit(1)).alias("n")))


_TIME = """time AS (SELECT sample_id, (age - bmi) / 4 AS t FROM emb_meta)"""


@query("B5_time_bands", sql("emb_meta", _TIME, body="""SELECT sample_id,
    CASE WHEN t <= -7 THEN '> 7 years before' WHEN t <= -5 THEN '5-7 years before' WHEN t <= -3 THEN '3-5 years before'
      WHEN t <= -1 THEN '1-3 years before' WHEN t <= 1 THEN '1 year before/after' WHEN t <= 3 THEN '1-3 years after'
      ELSE '> 3 years after' END AS band_7,
    CASE WHEN t <= -5 THEN '> 5 years before' WHEN t <= -3 THEN '3-5 years before' WHEN t <= -1 THEN '1-3 years before'
      WHEN t <= 1 THEN '1 year before/after' ELSE '> 1 year after' END AS band_5,
    CASE WHEN t <= -3 THEN '> 3 years before' WHEN t <= 0 THEN 'Up to 3 years before' ELSE 'After diagnosis' END AS band_3
    FROM time"""))
def time_bands(spark, d):
    t = (F.col("age") - F.col("bmi")) / 4
    return emb_meta(spark, d).select("sample_id", *[S.time_band(t, g).alias(f"band_{g}") for g in (7, 5, 3)])


@query("B6_recode", sql("line_meta", body="""SELECT CASE WHEN class IN ('ASIA', 'MIDDLE EAST') THEN 'EAST'
    ELSE class END AS class, count(*) AS n FROM line_meta GROUP BY 1"""))
def recode(spark, d):
    merged = S.recode(F.col("class"), {"ASIA": "EAST", "MIDDLE EAST": "EAST"})
    return line_meta(spark, d).withColumn("class", merged).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("B7_sentinel_to_null", """SELECT l_suppkey AS batch, count(nullif(l_discount, 0.0)) AS n_known,
    round(avg(nullif(l_discount, 0.0)), 6) AS mean_known FROM lineitem GROUP BY 1""")
def sentinel(spark, d):
    return (table(spark, d, "lineitem").withColumn("v", S.sentinel_null(F.col("l_discount"), 0.0))
            .groupBy(F.col("l_suppkey").alias("batch"))
            .agg(F.count("v").alias("n_known"), r6(F.avg("v")).alias("mean_known")))


@query("B8_case_control", sql("emb_meta", body="""SELECT role, two_controls, count(*) AS n FROM (SELECT
    CASE WHEN disease = 'D1' THEN '1_D1' ELSE '0_Control' END AS role,
    CASE WHEN disease = 'D1' THEN 'Case' WHEN disease IN ('D2', 'D3') THEN 'Control' END AS two_controls
    FROM emb_meta) GROUP BY 1, 2"""))
def case_control(spark, d):
    x = F.col("disease")
    return (emb_meta(spark, d).select(
        S.case_control(x, "D1", case_label="1_D1").alias("role"),
        S.case_control(x, "D1", ["D2", "D3"], "Case", "Control").alias("two_controls"))
        .groupBy("role", "two_controls").agg(F.count(F.lit(1)).alias("n")))


@query("B9_interest_group", sql("line_meta", body="""SELECT CASE WHEN class = 'EUROPE' THEN 'Case'
    WHEN class = 'ASIA' THEN 'Asia' ELSE 'Other' END AS grp, count(*) AS n FROM line_meta GROUP BY 1"""))
def interest_group(spark, d):
    return (line_meta(spark, d).withColumn("grp", S.interest_group(F.col("class"), {"EUROPE": "Case", "ASIA": "Asia"}))
            .groupBy("grp").agg(F.count(F.lit(1)).alias("n")))


@query("B10_level_order", sql("line_meta", body="""SELECT class AS level, CAST(CASE class WHEN 'EUROPE' THEN 1
    WHEN 'ASIA' THEN 2 WHEN 'AFRICA' THEN 3 WHEN 'AMERICA' THEN 4 ELSE 5 END AS BIGINT) AS ordinal
    FROM (SELECT DISTINCT class FROM line_meta)"""))
def level_order(spark, d):
    return V.level_table(line_meta(spark, d), "class", ["EUROPE", "ASIA"])


@query("B10_order_by_statistic", sql("emb_long", body="""SELECT disease, round(avg(age), 6) AS statistic,
    row_number() OVER (ORDER BY avg(age) DESC, disease) AS ordinal FROM emb_meta GROUP BY 1"""))
def order_by_statistic(spark, d):
    return V.order_by_statistic(emb_meta(spark, d), "disease", "age").withColumn("statistic", r6("statistic"))


@query("B11_level_code", sql("emb_meta", body="""SELECT sample_id, age, dense_rank() OVER (ORDER BY age) AS code
    FROM emb_meta"""))
def level_code(spark, d):
    return V.level_code(emb_meta(spark, d), "age").select("sample_id", "age", "code")


@query("B12_text_to_number", """SELECT p_brand, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS num,
    TRY_CAST(p_brand AS DOUBLE) AS failed, TRY_CAST(replace('1,' || replace(p_brand, 'Brand#', ''), ',', '.') AS DOUBLE) AS comma
    FROM part""")
def text_to_number(spark, d):
    b = F.col("p_brand")
    tail = F.replace(b, F.lit("Brand#"), F.lit(""))
    return table(spark, d, "part").select(
        "p_brand", S.to_number(tail).alias("num"), S.to_number(b).alias("failed"),
        S.to_number(F.concat(F.lit("1,"), tail), decimal_comma=True).alias("comma"))


@query("B13_split_two", """SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second
    FROM part""")
def split_two(spark, d):
    return V.split_two(table(spark, d, "part"), "p_name", ("first", "second")).select("p_partkey", "first", "second")


@query("B14_split_rows", """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)
    GROUP BY 1""")
def split_rows(spark, d):
    return (V.split_rows(table(spark, d, "part").select(F.col("p_name").alias("word")), "word", " ")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query("B15_text_labels", """SELECT r_name || '_' || n_name AS label, replace(n_name, 'NATION_', 'N') AS short,
    count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE NOT regexp_matches(c_mktsegment, 'HOUSE') GROUP BY 1, 2""")
def text_labels(spark, d):
    t = lambda n: table(spark, d, n)
    return (t("customer").filter(~F.col("c_mktsegment").rlike("HOUSE"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(F.concat_ws("_", "r_name", "n_name").alias("label"),
                     F.regexp_replace("n_name", "^NATION_", "N").alias("short"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("B16_distinct_keys", sql("line_meta", body="SELECT DISTINCT disease, class FROM line_meta"))
def distinct_keys(spark, d):
    return line_meta(spark, d).select("disease", "class").distinct()


@query("B17_first_row", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def first_row(spark, d):
    return V.first_row(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("B18_absent_features", sql("emb_values", body="""SELECT sample_id, f.assay, round(v.value, 6) AS value
    FROM (SELECT DISTINCT sample_id FROM emb_values) s CROSS JOIN (SELECT DISTINCT assay FROM emb_values
    UNION SELECT DISTINCT p_brand FROM part) f LEFT JOIN emb_values v USING (sample_id, assay)"""))
def absent_features(spark, d):
    features = (table(spark, d, "part").select(F.col("p_brand").alias("assay"))
                .unionByName(emb_values(spark, d).select("assay")))
    return V.add_absent_features(emb_values(spark, d), features).withColumn("value", r6("value"))


@query("B19_sex_restriction", sql("emb_meta", "m AS (SELECT *, CASE WHEN disease IN ('D3', 'D7') THEN 'F' ELSE sex END AS s FROM emb_meta)",
    "a AS (SELECT DISTINCT disease, s FROM m UNION SELECT 'D9', 'M' EXCEPT SELECT 'D9', 'F')",
    body="""SELECT a.disease, m.s AS sex, count(*) AS n FROM a JOIN m ON a.s = m.s
    GROUP BY 1, 2"""))
def sex_restriction(spark, d):
    meta = emb_meta(spark, d).withColumn("sex", F.when(F.col("disease").isin("D3", "D7"), "F").otherwise(F.col("sex")))
    pairs = V.allowed_sexes(meta, {"D9": "M"})
    sizes = meta.groupBy("sex").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(sizes, "sex").select("disease", "sex", "n")


# --- C: joins -------------------------------------------------------------------------------

@query("C1_left_join_metadata", sql("line_long line_meta", body="""SELECT assay, class, count(*) AS n
    FROM line_long l LEFT JOIN line_meta m USING (sample_id) GROUP BY 1, 2"""))
def left_join(spark, d):
    return (J.with_metadata(line_long(spark, d), line_meta(spark, d), "sample_id", ["class"])
            .groupBy("assay", "class").agg(F.count(F.lit(1)).alias("n")))


@query("C2_inner_join", sql("evt_long", body="""SELECT c_mktsegment, assay, count(*) AS n FROM evt_long
    JOIN customer ON subject = c_custkey GROUP BY 1, 2"""))
def inner_join(spark, d):
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), "c_mktsegment")
    return (evt_long(spark, d).join(cust, "subject", "inner")
            .groupBy("c_mktsegment", "assay").agg(F.count(F.lit(1)).alias("n")))


@query("C3_semi_join", """SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS
    (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def semi_join(spark, d):
    return J.keep_in(table(spark, d, "customer"), table(spark, d, "events"), "c_custkey", "user_id").select(
        "c_custkey", "c_mktsegment")


@query("C4_anti_join", """SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS
    (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def anti_join(spark, d):
    return J.keep_not_in(table(spark, d, "customer"), table(spark, d, "events"), "c_custkey", "user_id").select(
        "c_custkey", "c_mktsegment")


@query("C5_multi_key_join", sql("line_long", "a AS (SELECT assay, batch, avg(value) AS v FROM line_long GROUP BY 1, 2)",
    "b AS (SELECT assay, batch, avg(quantity) AS q FROM line_long WHERE flag = 'R' GROUP BY 1, 2)",
    body="SELECT a.assay, a.batch, round(v, 6) AS v, round(q, 6) AS q FROM a LEFT JOIN b ON a.assay = b.assay AND a.batch = b.batch"))
def multi_key_join(spark, d):
    ll = line_long(spark, d)
    a = ll.groupBy("assay", "batch").agg(r6(F.avg("value")).alias("v"))
    b = ll.filter("flag = 'R'").groupBy("assay", "batch").agg(r6(F.avg("quantity")).alias("q"))
    return a.join(b, ["assay", "batch"], "left")


@query("C6_natural_join", sql("emb_meta", body="""SELECT disease, class, count(*) AS n FROM emb_meta
    NATURAL JOIN (SELECT vec_id AS sample_id, len(embedding) AS width FROM embeddings) GROUP BY 1, 2"""))
def natural_join(spark, d):
    width = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.size("embedding").alias("width"))
    return J.natural(emb_meta(spark, d), width).groupBy("disease", "class").agg(F.count(F.lit(1)).alias("n"))


@query("C7_level_pairs", sql("line_meta", "g AS (SELECT DISTINCT disease FROM line_meta)",
    body="SELECT a.disease AS disease1, b.disease AS disease2 FROM g a CROSS JOIN g b WHERE a.disease <> b.disease"))
def level_pairs(spark, d):
    return J.level_pairs(line_meta(spark, d), "disease", ("disease1", "disease2"))


@query("C8_grid_completion", """SELECT p_brand, flag, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_brand FROM part) b
    CROSS JOIN (SELECT unnest(['SMALL', 'LARGE', 'ABSENT']) AS flag) f LEFT JOIN
    (SELECT p_brand, p_type AS flag, count(*) AS n FROM part GROUP BY 1, 2) c USING (p_brand, flag)""")
def grid_completion(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand", F.col("p_type").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return J.complete(counts, "p_brand", "flag", ["SMALL", "LARGE", "ABSENT"], "n")


@query("C9_lookup_default", """SELECT coalesce(s.kind, 'Not annotated') AS kind, count(*) AS n FROM part LEFT JOIN
    (SELECT p_partkey, 'Large ' || p_name AS kind FROM part WHERE p_size > 45) s USING (p_partkey) GROUP BY 1""")
def lookup_default(spark, d):
    part = table(spark, d, "part")
    sparse = part.filter("p_size > 45").select("p_partkey", F.concat(F.lit("Large "), "p_name").alias("kind"))
    return (J.lookup(part.select("p_partkey"), sparse, "p_partkey", "kind", "Not annotated")
            .groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


@query("C10_bind_predictions_by_key", sql("scored", body="""SELECT sample_id, score / 1000 AS predicted, quality AS truth
    FROM scored"""))
def bind_predictions(spark, d):
    preds = scored(spark, d).select("sample_id", (F.col("score") / 1000).alias("predicted"))
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("truth"))
    return preds.join(truth, "sample_id", "inner")


@query("C11_paired_results", sql("line_long", body="""SELECT assay, block, round(avg(value) FILTER (flag = 'R'), 6) AS discovery,
    round(avg(value) FILTER (flag = 'N'), 6) AS validation FROM line_long GROUP BY 1, 2
    HAVING count(*) FILTER (flag = 'R') > 0 AND count(*) FILTER (flag = 'N') > 0"""))
def paired_results(spark, d):
    ll = line_long(spark, d)
    part = lambda f: ll.filter(F.col("flag") == f).groupBy("assay", "block").agg(r6(F.avg("value")).alias("v"))
    return J.paired_results(part("R"), part("N"), ["assay", "block"], "v", ("discovery", "validation"))


@query("C12_presence_matrix", """SELECT p_name AS marker, study, CASE WHEN EXISTS (SELECT 1 FROM part x
    WHERE x.p_name = m.p_name AND x.p_type = study) THEN 'Yes' ELSE 'No' END AS present
    FROM (SELECT DISTINCT p_name FROM part) m CROSS JOIN (SELECT unnest(['SMALL', 'PROMO', 'OTHER']) AS study) s""")
def presence_matrix(spark, d):
    part = table(spark, d, "part").select(F.col("p_name").alias("marker"), F.col("p_type").alias("study"))
    return J.presence_matrix(part, part, "marker", "study", ["SMALL", "PROMO", "OTHER"])


# --- F, G, H: sorts, sets, reshapes ---------------------------------------------------------

@query("F1_level_sort", sql("line_meta", body="""SELECT disease, class, count(*) AS n, CAST(CASE class WHEN 'EUROPE' THEN 1
    WHEN 'ASIA' THEN 2 WHEN 'AFRICA' THEN 3 WHEN 'AMERICA' THEN 4 ELSE 5 END AS BIGINT) AS ordinal
    FROM line_meta GROUP BY 1, 2 ORDER BY 4, 1"""))
def level_sort(spark, d):
    counts = line_meta(spark, d).groupBy("disease", "class").agg(F.count(F.lit(1)).alias("n"))
    return V.order_by_levels(counts, "class", ["EUROPE", "ASIA"], "disease")


@query("F2_first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 35")
def first_n(spark, d):
    return W.first_rows(table(spark, d, "orders"), 35, F.col("o_totalprice").desc(), "o_orderkey").select(
        "o_orderkey", "o_totalprice")


@query("F3_top_with_ties", """SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part)
    WHERE r <= 10""")
def top_ties(spark, d):
    return W.top_with_ties(table(spark, d, "part").select("p_partkey", "p_size"), [], "p_size", 10)


@query("F4_balanced_top", """SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS r FROM lineitem
    WHERE l_returnflag IN ('A', 'R')) WHERE r <= 10""")
def balanced_top(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.balanced_top(li, "l_returnflag", ["A", "R"], "l_extendedprice", 10)


@query("G1_union_fill", """SELECT c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS name FROM customer
    UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier""")
def union_fill(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.stack(a, b)


@query("G2_intersection_size", """SELECT count(*) AS n FROM (SELECT p_name FROM part WHERE p_type = 'SMALL'
    INTERSECT SELECT p_name FROM part WHERE p_type = 'LARGE')""")
def intersection_size(spark, d):
    names = lambda t: table(spark, d, "part").filter(F.col("p_type") == t).select("p_name")
    return names("SMALL").intersect(names("LARGE")).agg(F.count(F.lit(1)).alias("n"))


@query("G3_distinct_values", "SELECT DISTINCT p_name FROM part")
def distinct_values(spark, d):
    return table(spark, d, "part").select("p_name").distinct()


@query("G4_difference", """SELECT DISTINCT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem
    WHERE l_quantity > 40""")
def difference(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity > 40").select("l_partkey")
    return J.keep_not_in(table(spark, d, "part").select("p_partkey").distinct(), used, "p_partkey", "l_partkey")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("H1_long_to_wide", sql("evt_long", body="SELECT subject, " + ", ".join(
    f"round(avg(value) FILTER (assay = '{t}'), 6) AS \"{t}\"" for t in TYPES) + " FROM evt_long GROUP BY 1"))
def long_to_wide(spark, d):
    return R.wide(evt_long(spark, d), "subject", "assay", r6(F.avg("value")), TYPES)


@query("H1_vectors", sql("emb_values", body="""SELECT sample_id, array_to_string(list(CAST(CAST(round(value * 1000) AS BIGINT)
    AS VARCHAR) ORDER BY assay), ',') AS vector FROM emb_values GROUP BY 1"""))
def vectors(spark, d):
    v = R.vectors(emb_values(spark, d), "sample_id", "assay", "value")
    return v.select("sample_id", F.array_join(F.transform(
        "vector", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("vector"))


@query("H2_wide_zero_fill", sql("line_meta", body="SELECT disease, " + ", ".join(
    f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in "FOPX") + " FROM line_meta GROUP BY 1"))
def wide_zero_fill(spark, d):
    return R.wide(line_meta(spark, d), "disease", "status", F.count(F.lit(1)), list("FOPX"), fill=0)


@query("H2_wide_first_value", sql("evt_long", body="SELECT subject, " + ", ".join(
    f"arg_min(value, sample_id) FILTER (assay = '{t}') AS \"{t}\"" for t in TYPES) + " FROM evt_long GROUP BY 1"))
def wide_first_value(spark, d):
    return R.wide(evt_long(spark, d), "subject", "assay", R.first_value("value", "sample_id"), TYPES)


@query("H3_wide_to_long", """SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber,
    l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax))""")
def wide_to_long(spark, d):
    return R.long(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
                  ["l_quantity", "l_discount", "l_tax"], "measure", "value")


@query("H4_one_hot", sql("emb_meta", body="SELECT sample_id, " + ", ".join(
    f"CASE WHEN class = '{c}' THEN 1 ELSE 0 END AS \"{c}\"" for c in ["C1", "C2", "C3", "Healthy"]) + " FROM emb_meta"))
def one_hot(spark, d):
    return R.one_hot(emb_meta(spark, d), "sample_id", "class", ["C1", "C2", "C3", "Healthy"])


@query("H5_transpose", sql("line_meta", body="""SELECT "column", """ + ", ".join(
    f"max(n) FILTER (class = '{c}') AS \"{c}\"" for c in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]) +
    """ FROM (SELECT class, status AS "column", count(*) AS n FROM line_meta GROUP BY 1, 2) GROUP BY 1"""))
def transpose(spark, d):
    w = R.wide(line_meta(spark, d), "class", "status", F.count(F.lit(1)), list("FOP"))
    return R.transpose(w, "class", list("FOP"), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


# --- I: scalar functions --------------------------------------------------------------------

@query("I1_neg_log10", """SELECT l_orderkey, l_linenumber, round(-log10((l_tax + 0.01) / l_quantity), 6) AS score
    FROM lineitem""")
def neg_log10(spark, d):
    p = (F.col("l_tax") + 0.01) / F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(S.neg_log10(p)).alias("score"))


@query("I2_arithmetic", """SELECT c_custkey, round(abs(c_acctbal - 500), 6) AS dist,
    CAST(round_even(c_acctbal / 500, 0) AS BIGINT) AS bucket, c_custkey % 7 AS rest FROM customer""")
def arithmetic(spark, d):
    a = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", r6(F.abs(a - 500)).alias("dist"), F.bround(a / 500, 0).cast("long").alias("bucket"),
        (F.col("c_custkey") % 7).alias("rest"))


@query("I3_p_floor", """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 1e-320 ELSE l_tax END AS p
    FROM lineitem""")
def p_floor(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.p_floor(F.col("l_tax")).alias("p"))


@query("I4_significance_call", """SELECT name, CASE WHEN l_tax < p AND l_quantity / 10 - 2.5 < -fc THEN 'significant down'
    WHEN l_tax < p AND l_quantity / 10 - 2.5 > fc THEN 'significant up' ELSE 'not significant' END AS call, count(*) AS n
    FROM lineitem CROSS JOIN (VALUES ('original', 0.05, 0.5), ('FC1_pval05', 0.05, 1.0), ('FC05_pval005', 0.005, 0.5),
    ('FC1_pval005', 0.005, 1.0), ('FC1_pval0005', 0.0005, 1.0)) t(name, p, fc) GROUP BY 1, 2""")
def significance_call(spark, d):
    settings = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p"), F.lit(c).alias("fc"))
                         for n, p, c in S.THRESHOLDS])
    li = table(spark, d, "lineitem").select("l_tax", (F.col("l_quantity") / 10 - 2.5).alias("fc"),
                                            F.explode(settings).alias("t"))
    return (li.groupBy(F.col("t.name").alias("name"),
                       S.significance(F.col("l_tax"), F.col("fc"), F.col("t.p"), F.col("t.fc")).alias("call"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("I5_replication_call", """SELECT p_brand, CASE WHEN a AND b THEN 'replicated' WHEN NOT a AND b THEN 'new' ELSE 'other' END
    AS call FROM (SELECT p_brand, bool_or(p_size > 49) AS a, bool_or(p_size < 2) AS b FROM part GROUP BY 1)""")
def replication_call(spark, d):
    flags = table(spark, d, "part").groupBy("p_brand").agg(
        F.bool_or(F.col("p_size") > 49).alias("a"), F.bool_or(F.col("p_size") < 2).alias("b"))
    return flags.select("p_brand", S.replication(F.col("a"), F.col("b")).alias("call"))


@query("I6_years_to_diagnosis", sql("emb_meta", body="SELECT sample_id, round(age - bmi, 6) AS years FROM emb_meta"))
def years_to_diagnosis(spark, d):
    return emb_meta(spark, d).select("sample_id", r6(S.years_to_diagnosis(F.col("age"), F.col("bmi"))).alias("years"))


@query("I7_prediction_offset", sql("scored", body="SELECT sample_id, round(quality - score / 20000, 6) AS off FROM scored"))
def prediction_offset(spark, d):
    return scored(spark, d).select("sample_id", r6(S.prediction_offset(F.col("quality"), F.col("score") / 20000)).alias("off"))


@query("I8_label_above", """SELECT n_name, n, CASE WHEN n > 60 THEN CAST(n AS VARCHAR) ELSE '' END AS label FROM
    (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""")
def label_above(spark, d):
    nat = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    counts = table(spark, d, "customer").join(nat, "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("label", S.label_above(F.col("n"), 60))
