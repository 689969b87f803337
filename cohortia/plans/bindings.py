"""How the test tables stand in for measurement cohorts, in Spark and as SQL.

``emb_*`` covariates (sex, age, bmi, gaps) are deterministic stand-ins derived from the id;
the test tables hold no such columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.session import lookup_side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_meta(spark: SparkSession, d: str) -> DataFrame:
    i, label = F.col("vec_id"), F.col("label")
    return table(spark, d, "embeddings").select(
        i.alias("sample_id"),
        F.concat(F.lit("D"), label.cast("string")).alias("disease"),
        F.when(label == 0, "Healthy").when(label <= 3, "C1").when(label <= 6, "C2").otherwise("C3").alias("class"),
        F.when(i % 2 == 0, "F").otherwise("M").alias("sex"),
        (20 + (i * 37) % 60).cast("double").alias("age"),
        (18 + ((i * 13) % 200) / 10).cast("double").alias("bmi"))


def emb_values(spark: SparkSession, d: str, gaps: bool = False) -> DataFrame:
    """sample_id, assay, value of every vector entry; with ``gaps`` some values are NULL."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    value = F.col("v").cast("double")
    if gaps:
        value = F.when((F.col("vec_id") * 31 + F.col("pos")) % 23 != 0, value)
    return e.select(F.col("vec_id").alias("sample_id"),
                    F.concat(F.lit("A"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("assay"),
                    value.alias("value"))


def emb_long(spark: SparkSession, d: str, gaps: bool = False) -> DataFrame:
    return emb_values(spark, d, gaps).join(emb_meta(spark, d), "sample_id")


def evt_long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("sample_id"), F.col("user_id").alias("subject"),
        F.col("event_type").alias("assay"), "value",
        F.get_json_object("props", "$.k").try_cast("double").alias("lod"),
        F.col("ts").alias("date"), F.weekofyear("ts").alias("visit"))


def line_long(spark: SparkSession, d: str, rows: int = 0) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return table(spark, d, "lineitem").join(lookup_side(part, rows), "l_partkey").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("line"),
        F.col("p_brand").alias("assay"), F.col("p_type").alias("block"),
        F.log("l_extendedprice").alias("value"), F.col("l_suppkey").alias("batch"),
        F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("flag"))


def line_meta(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return (t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("subject"),
                    F.col("n_name").alias("disease"), F.col("r_name").alias("class"),
                    F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"),
                    F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("age")))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Binary truth with a score, and the language as a group."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return (table(spark, d, "labels").join(docs, "doc_id")
            .select(F.col("doc_id").alias("sample_id"), "quality", "toxic", "lang", "source",
                    F.col("n_chars").cast("double").alias("score")))


_SQL = {
    "emb_meta": """emb_meta AS (SELECT vec_id AS sample_id, 'D' || CAST(label AS VARCHAR) AS disease,
        CASE WHEN label = 0 THEN 'Healthy' WHEN label <= 3 THEN 'C1' WHEN label <= 6 THEN 'C2' ELSE 'C3' END AS class,
        CASE WHEN vec_id % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
        CAST(20 + (vec_id * 37) % 60 AS DOUBLE) AS age,
        18 + CAST((vec_id * 13) % 200 AS DOUBLE) / 10 AS bmi FROM embeddings)""",
    "emb_values": """emb_values AS (SELECT vec_id AS sample_id,
        'A' || lpad(CAST(pos AS VARCHAR), 2, '0') AS assay, CAST(v AS DOUBLE) AS value,
        CASE WHEN (vec_id * 31 + pos) % 23 <> 0 THEN CAST(v AS DOUBLE) END AS gappy
        FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings) u)""",
    "emb_long": """emb_long AS (SELECT v.*, disease, class, sex, age, bmi
        FROM emb_values v JOIN emb_meta m USING (sample_id))""",
    "evt_long": """evt_long AS (SELECT event_id AS sample_id, user_id AS subject, event_type AS assay, value,
        TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS lod, ts AS date,
        CAST(week(ts) AS INTEGER) AS visit FROM events)""",
    "line_long": """line_long AS (SELECT l_orderkey AS sample_id, l_linenumber AS line, p_brand AS assay,
        p_type AS block, ln(l_extendedprice) AS value, l_suppkey AS batch, l_partkey AS gene,
        l_quantity AS quantity, l_returnflag AS flag
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "line_meta": """line_meta AS (SELECT o_orderkey AS sample_id, o_custkey AS subject, n_name AS disease,
        r_name AS class, o_orderdate AS date, o_orderstatus AS status, c_mktsegment AS segment,
        c_acctbal AS age
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey)""",
    "scored": """scored AS (SELECT l.doc_id AS sample_id, quality, toxic, lang, source,
        CAST(n_chars AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id))""",
}
_NEEDS = {"emb_long": ["emb_meta", "emb_values"]}


def sql(names: str, *ctes: str, body: str) -> str:
    """``WITH`` the named bindings and further CTEs, then the body."""
    wanted: list[str] = []
    for n in names.split():
        for dep in [*_NEEDS.get(n, []), n]:
            if dep not in wanted:
                wanted.append(dep)
    parts = [_SQL[n] for n in wanted] + list(ctes)
    return (f"WITH {', '.join(parts)} " if parts else "") + body
