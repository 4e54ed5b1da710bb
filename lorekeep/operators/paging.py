"""Keyset pages: filters, a seek past a key, order, limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import is_blank

PAGE_SIZE = 20


def equal_filters(**wanted) -> list[Column]:
    """One equality for each given value; None, and blank text, filter nothing."""
    return [F.col(f"`{c}`") == v for c, v in wanted.items() if v is not None and not (isinstance(v, str) and is_blank(v))]


def keyset_page(df: DataFrame, key: str = "Id", after=None, size: int | None = PAGE_SIZE, filters: list[Column] = ()) -> DataFrame:
    """The first `size` rows past `after` that pass all filters, in order of key. None: no limit.

    Planned as one TakeOrderedAndProject over a scan with the filters and the seek pushed down.
    """
    if size is not None and size < 0:
        raise ValueError("a page has no negative size")
    for f in filters:
        df = df.where(f)
    if after is not None:
        df = df.where(F.col(f"`{key}`") > after)
    df = df.orderBy(key)
    return df if size is None else df.limit(size)
