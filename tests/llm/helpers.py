"""Small tables with awkward rows, and plain-Python counterparts of the operators."""

import random
import re

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng: random.Random | None = None) -> list[tuple]:
    """NULLs in every column, empty, blank, short, long, equal and repeated rows."""
    rng = rng or random.Random(5)
    base = prose(rng, 120)
    return [(0, None, "en", "a", None), (1, "", None, "b", 0), (2, " \t\n ", "en", None, 3), (3, "one two", "en", "a", 7),
            (4, base, "en", "a", 5), (5, base, "de", "b", 5), (6, base.upper(), None, None, 9), (7, prose(rng, 30_000), "en", "a", 1),
            (8, "x\n\nx\n x\nx\n", "en", "c", 2), (9, "a " * 300, "en", "c", 2), (10, "é ü ﬁ 中文字 \x1c z İ", "fr", "", 1),
            (11, base + " tail", "en", "a", 5), (4, base, "en", "a", 5), (None, base, "en", "a", 5), (None, None, None, None, None)]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The same with further columns that bear names used inside the operators or in results."""
    from pyspark.sql import functions as F

    names = ["h", "n", "rep", "size", "kept", "n_words", "component_id", "length", "offset", "block", "id", "y", "spans", "target", "rank", "score"]
    return df.select("*", *[F.lit("x").alias(c) for c in names if c not in df.columns])


def documents(sf_dir: str) -> list[tuple]:
    return [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/documents.parquet").select(["doc_id", "text", "lang", "source", "n_chars"]).to_pylist()]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return "".join(c.lower() if c < "\x80" else c for c in text or "")
