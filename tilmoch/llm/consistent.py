"""Visually identical text with different characters: one consistent form for whole text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmoch.llm.text_columns import consistent_form, joined


def consistent_texts(df: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """``(field, row_key, text, changed)`` of a text or token-array column, one row per row of df.

    A null text stays null and counts as unchanged; an empty text stays empty. A
    token array is its non-null tokens joined with blanks. Rows that occur twice
    come out twice; an empty table gives an empty result; other columns of df are
    not read, so their names cannot clash. The step is narrow: no shuffle.
    """
    col = F.col(f"`{text}`")
    if df.schema[text].dataType.typeName() == "array":
        col = joined(col)
    out = df.select(F.col(f"`{key}`").cast("string").alias("row_key"), consistent_form(col).alias("f"))
    return out.select(F.lit(field).alias("field"), "row_key", F.col("f.text").alias("text"), F.coalesce("f.changed", F.lit(False)).alias("changed"))
