"""Column expressions and readers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words.
WHITE_SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(text: Column) -> Column:
    """A-Z to lower case, all else as it is. `lower` does that on pure ASCII, and is much the faster."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key() -> Column:
    """Tells rows of one doc_id with different texts apart; use it together with doc_id."""
    return F.xxhash64("doc_id", "text")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on doc_id (null is a value) and row_key."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["row_key"] == right["row_key"])
