"""A training corpus in five stages: quality rules, near duplicates, secrets, mix, packing.

Each stage takes the documents that its predecessor kept, written and read again. Rows of one text
and one id are one document after the second stage, and different texts of one id are judged each by itself; the mix may take a document twice, and packing
then packs it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm import mixing, neardup, packing, quality, secrets, tokens
from cohortia.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts of similarity 0.8 or more are one; 13 collections miss such a pair with probability 4e-5.
NEAR = neardup.Banding(percent=80, collections=13)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits."""
    return quality.judge(docs, keep=COLUMNS).filter("kept").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    A NULL id counts as one made from the row. Where rows of an id hold different texts, the text of smallest
    digest goes by the id and each other one by a number made from id and text.
    """
    own = -1 - F.pmod(F.xxhash64(*COLUMNS[1:]), F.lit(2**62))
    other = F.lit(2**62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**62))
    digest = F.xxhash64("text")
    split = cut(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("__first"), F.max(digest).alias("__last"))
                .filter("__first != __last").select("doc_id", "__first"))
    node = F.when(F.col("doc_id").isNull(), own).when(digest != F.col("__first"), other).otherwise(F.col("doc_id"))
    named = docs.select(COLUMNS).join(split, "doc_id", "left").select(*COLUMNS, node.alias("__node"))
    kept = neardup.near_duplicates(named, id_col="__node", banding=NEAR).filter("kept").select(F.col("doc_id").alias("__node")).distinct()
    # rows of one node are equal in id and text
    one = named.join(kept, "__node", "left_semi").groupBy("__node").agg(F.min(F.struct(COLUMNS)).alias("__row"))
    return one.select("__row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by a mark."""
    found = secrets.scan(docs, keep=COLUMNS)
    hit = F.size("spans") > 0
    clean = F.when(hit, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return (found.withColumn("__clean", clean)
            .select("doc_id", F.col("__clean").alias("text"), "lang", "source",
                    F.when(hit, F.length("__clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = mixing.mix(docs).groupBy("h").agg(F.sum("copies").alias("__copies")).filter("__copies > 0")
    told = docs.select(*COLUMNS, F.xxhash64("doc_id", "source", "text").alias("h")).dropDuplicates(["h"])
    return told.join(copies, "h").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their sequence and place."""
    cut_up = packing.pieces(docs, tokens.vocabulary())
    return packing.pack(cut_up.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan),
          ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Minhash, rounding and packing have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
