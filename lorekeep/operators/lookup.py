"""Single rows and distinct facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row with the key, or none."""
    return df.where(F.col(f"`{key}`") == value).limit(1)


def active_or_first(df: DataFrame, flag: str, key: str) -> DataFrame:
    """The flagged row of least key, else the row of least key."""
    return df.orderBy(F.col(f"`{flag}`").desc(), F.col(f"`{key}`")).limit(1)


def first_flagged(df: DataFrame, flag: str, key: str) -> DataFrame:
    """The flagged row of least key, or none."""
    return df.where(F.col(f"`{flag}`")).orderBy(key).limit(1)


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in binary order."""
    return df.select(column).distinct().orderBy(column)
