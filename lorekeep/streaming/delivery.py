"""Row-at-a-time delivery of a result, which the receiver may cancel. (Not stream processing.)"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row


@contextmanager
def delivered(df: DataFrame, prefetch: bool = False) -> Iterator[Iterator[Row]]:
    """An iterator over the rows; leaving the block early stops the jobs behind it."""
    spark, tag = df.sparkSession, f"delivery-{uuid.uuid4().hex}"
    spark.addTag(tag)
    try:
        yield df.toLocalIterator(prefetchPartitions=prefetch)
    finally:
        spark.removeTag(tag)
        spark.interruptTag(tag)
