"""Joins that add a parent's columns, a count of children, or lists of them. Row counts of the left side never change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_parent(df: DataFrame, parent: DataFrame, column: str, columns: dict[str, str], key: str = "Id", how: str = "left") -> DataFrame:
    """Adds parent columns {name: parent column} by df.column = parent.key. inner: rows without a parent go."""
    p = parent.select(F.col(f"`{key}`").alias("__key"), *[F.col(f"`{c}`").alias(n) for n, c in columns.items()])
    return df.join(p, df[column] == p["__key"], how).drop("__key")


def with_optional_struct(df: DataFrame, parent: DataFrame, column: str, name: str, fields: list[str], key: str = "Id") -> DataFrame:
    """Adds a struct of the parent's fields, null (not a struct of nulls) without a parent."""
    p = parent.select(F.col(f"`{key}`").alias("__key"), F.struct(*fields).alias("__struct"))
    return df.join(p, df[column] == p["__key"], "left").withColumn(name, F.when(F.col("__key").isNotNull(), F.col("__struct"))).drop("__key", "__struct")


def with_child_count(df: DataFrame, child: DataFrame, column: str, name: str, key: str = "Id") -> DataFrame:
    """Adds how many children a row has, 0 without any."""
    c = child.groupBy(F.col(f"`{column}`").alias("__key")).agg(F.count("*").alias("__n"))
    return df.join(c, df[key] == c["__key"], "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__key", "__n")


def with_children(df: DataFrame, child: DataFrame, column: str, name: str, item: Column, order: list[str], key: str = "Id") -> DataFrame:
    """Adds the list of a row's children as items in the given order, empty without any.

    Children are grouped before the join: several lists on one row never multiply one another.
    """
    c = child.select(F.col(f"`{column}`").alias("__key"), F.struct(*[F.col(f"`{o}`").alias(f"o{k}") for k, o in enumerate(order)], item.alias("item")).alias("__item"))
    c = c.groupBy("__key").agg(F.transform(F.sort_array(F.collect_list("__item")), lambda x: x["item"]).alias("__items"))
    kind = c.schema["__items"].dataType.simpleString()
    return df.join(c, df[key] == c["__key"], "left").withColumn(name, F.coalesce("__items", F.from_json(F.lit("[]"), kind))).drop("__key", "__items")
