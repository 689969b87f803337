"""Table and model writers. Every task writes its own part file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> str:
    (df.write.mode(mode).option("header", True).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("nullValue", "NA").csv(path))
    return path


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists",
              partition_by: Sequence[str] = ()) -> str:
    writer = (df.write.mode(mode).option("header", True).option("sep", "\t").option("quote", '"')
              .option("escape", '"').option("nullValue", "NA"))
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
    return path


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
               mode: str = "errorifexists") -> str:
    """Parquet result table, with one folder per partition value (seed, task) where named."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().save(path)
    return path
