"""Table readers. Schemas are declared by the caller and never inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortia.functions.scalar import to_number


def _as_struct(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, the one missing marker used here."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None)) for f in df.schema.fields
                           if f.dataType.simpleString() in ("double", "float")})


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
                   missing: str = "NA", multi_line: bool = False) -> DataFrame:
    """Delimited text with a header row; quotes are doubled inside quoted text.

    ``multi_line`` reads quoted text with line feeds, one task per file.
    """
    return nan_to_null(
        spark.read.schema(_as_struct(schema)).option("header", True).option("sep", sep)
        .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
        .option("nullValue", missing).option("enforceSchema", False)
        .option("mode", "FAILFAST").csv(path))


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return read_delimited(spark, path, schema, "\t")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return read_delimited(spark, path, schema, ",")


def read_semicolon(spark: SparkSession, path: str, schema: StructType | str,
                   decimal_comma: bool = False) -> DataFrame:
    """``;``-delimited text, numbers with decimal comma where asked for."""
    want = _as_struct(schema)
    if not decimal_comma:
        return read_delimited(spark, path, want, ";")
    real = {"double", "float"}
    text = StructType([StructField(f.name, StringType() if f.dataType.simpleString() in real
                                   else f.dataType) for f in want.fields])
    raw = read_delimited(spark, path, text, ";")
    return raw.select(*[
        to_number(F.col(f.name), True).cast(f.dataType).alias(f.name)
        if f.dataType.simpleString() in real else F.col(f.name) for f in want.fields])


def read_blanks(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Text with columns set apart by runs of blanks or tabs, under a header line.

    The header is the line that names all columns, in any order; its absence and a cell that does not fit
    its type are errors. Lines equal to it are headers of further files.
    """
    want = _as_struct(schema)
    lines = spark.read.text(path).select(F.trim(F.translate("value", "\t", " ")).alias("value")).filter("value <> ''")
    wanted = F.array(*[F.lit(f.name) for f in want.fields])
    first = lines.filter(F.size(F.array_except(wanted, F.split("value", r"\s+"))) == 0).first()
    if first is None:
        raise ValueError(f"no line of {path!r} names all of {[f.name for f in want.fields]}")
    names = first["value"].split()
    parts = lines.select(F.split("value", r"\s+").alias("p")).filter(F.col("p") != F.array(*[F.lit(n) for n in names]))

    def cell(f: StructField) -> Column:
        text = F.nullif(F.get("p", F.lit(names.index(f.name))), F.lit("NA"))
        value = text.try_cast(f.dataType)
        return F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"bad {f.name}: "), text))).otherwise(value)

    return nan_to_null(parts.select(*[cell(f).alias(f.name) for f in want.fields]))


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return spark.read.schema(_as_struct(schema)).parquet(path) if schema else spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Choose the reader by file extension; an unknown extension is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind == "parquet":
        return read_parquet(spark, path, schema)
    by_kind = {"csv": read_csv, "tsv": read_tsv, "txt": read_blanks}
    if kind not in by_kind:
        raise ValueError(f"unsupported file type: {path!r}")
    if schema is None:
        raise ValueError(f"a schema is needed to read {path!r}")
    return by_kind[kind](spark, path, schema)


def _either(parts: Sequence[object] | None) -> str:
    """A listing pattern for any of some names."""
    return "*" if parts is None else "{" + ",".join(str(p) for p in parts) + "}"


def read_seed_results(spark: SparkSession, root: str, schema: StructType | str, types: Sequence[str] | None = None,
                      classes: Sequence[str] | None = None, seeds: Sequence[int] | None = None) -> DataFrame:
    """One scan over the per-seed result files below ``root``.

    Files lie at ``<type>/<class>/seed_<n>`` (or ``seed=<n>``; a file with any ending, or a folder of files); the three parts
    become the columns type, class and seed. ``types``, ``classes`` and ``seeds`` name what is wanted: other files are
    not even listed. It is an error if nothing is there.
    """
    root = f"{root.rstrip('/')}/{_either(types)}/{_either(classes)}/seed[_=]{_either(seeds)}" + ("" if seeds is None else "{,.*}")
    raw = (spark.read.schema(_as_struct(schema)).option("header", True).option("sep", "\t")
           .option("quote", '"').option("escape", '"').option("recursiveFileLookup", True)
           .option("nullValue", "NA").option("enforceSchema", False).option("mode", "FAILFAST").csv(root))
    where = F.col("_metadata.file_path")
    tag = r"/([^/]+)/([^/]+)/seed[_=](\d+)"
    return raw.select(
        *[F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else f.name
          for f in raw.schema.fields],
        F.regexp_extract(where, tag, 1).alias("type"),
        F.regexp_extract(where, tag, 2).alias("class"),
        F.regexp_extract(where, tag, 3).cast("int").alias("seed"))
