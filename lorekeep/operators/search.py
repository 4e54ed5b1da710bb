"""Case-insensitive search over several tables, as one union of tagged hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import contains_any
from lorekeep.operators.paging import keyset_page


@dataclass
class Searched:
    """One table of a search: which columns match, which are returned."""

    tag: str
    table: DataFrame
    matched: list[str]
    returned: list[str]
    key: str = "Id"


def search_union(parts: list[Searched], needle: str, cap: int | None = 1000) -> DataFrame:
    """Hits of all tables: Type, the returned columns, and (source_order, hit_key) to order by.

    The first `cap` rows of each table are searched, as the limit precedes the match; None: all rows.
    """
    out = None
    for n, p in enumerate(parts):
        page = keyset_page(p.table, p.key, None, cap) if cap is not None else p.table
        hits = page.where(contains_any([F.col(f"`{c}`") for c in p.matched], needle))
        hits = hits.select(F.lit(p.tag).alias("Type"), *[F.col(f"`{c}`") for c in p.returned], F.lit(n).alias("source_order"), F.col(f"`{p.key}`").alias("hit_key"))
        out = hits if out is None else out.unionByName(hits, allowMissingColumns=True)
    return out
