"""Joins of large sides."""

from __future__ import annotations

from pyspark.sql import DataFrame


def many(df: DataFrame) -> DataFrame:
    """df, to be joined by a sorted shuffle.

    Spark's estimates don't count the rows that an explode makes, so haplotypes or calls made from a small file look
    small enough to be sent whole through the driver to every task.
    """
    return df.hint("merge")
