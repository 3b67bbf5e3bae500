"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.storage import spread

__all__ = ["documents", "let", "spare", "words"]

#: White space of the word contract: U+0020 and U+0009 to U+000D.
_GAPS = "[ \\t-\\r]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; one that splits into fewer parts than there are cores is dealt out first."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS), "")


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
