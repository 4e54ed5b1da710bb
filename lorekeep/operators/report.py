"""Grouped text reports as plans: only the finished text leaves Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_of(rows: DataFrame, line: Column, order: list[Column], name: str = "text") -> DataFrame:
    """One row: the lines one after another, in order; empty text without rows."""
    keys = [c.alias(f"o{k}") for k, c in enumerate(order)]
    items = F.sort_array(F.collect_list(F.struct(*keys, line.alias("line"))))
    return rows.agg(F.array_join(F.transform(items, lambda x: x["line"]), "").alias(name))


def grouped_lines(rows: DataFrame, group: str, line: Column, order: list[Column], keep: Column | None = None) -> DataFrame:
    """(group, body): the lines of each group in order. A group none of whose rows are kept has an empty body."""
    keys = [c.alias(f"o{k}") for k, c in enumerate(order)]
    kept = F.collect_list(F.struct(*keys, line.alias("line"))) if keep is None else F.collect_list(F.when(keep, F.struct(*keys, line.alias("line"))))
    return rows.groupBy(F.col(f"`{group}`").alias("group")).agg(F.array_join(F.transform(F.sort_array(kept), lambda x: x["line"]), "").alias("body"))


def grouped_section(rows: DataFrame, title: str, group: str, line: Column, order: list[Column], keep: Column | None = None, group_rank: Column | None = None, mark: str = "###") -> DataFrame:
    """One row: title, then each group's heading and lines, a blank line after each; empty text without rows.

    Groups are in dictionary order of their names, or of group_rank. Ranks, lines and title are fixed by data.
    """
    g = grouped_lines(rows, group, line, order, keep)
    by = [F.collate(F.col("group"), "UNICODE"), F.col("group")] if group_rank is None else [group_rank, F.col("group")]
    g = g.withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # one row a group
    heading = F.concat(F.lit(f"{mark} "), F.coalesce("group", F.lit("")), F.lit("\n"), F.col("body"), F.lit("\n"))
    body = text_of(g, heading, [F.col("rank")])
    return body.select(F.when(F.col("text") != "", F.concat(F.lit(f"{title}\n\n"), "text")).otherwise("").alias("text"))


def joined(parts: list[DataFrame]) -> DataFrame:
    """The one-row texts one after another."""
    numbered = [p.select(F.lit(n).alias("n"), "text") for n, p in enumerate(parts)]
    return text_of(reduce(DataFrame.unionByName, numbered), F.col("text"), [F.col("n")])
