"""Writes as pure functions: DataFrames in, the DataFrames after the write out. Checks raise before anything is written."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorekeep.functions.text import is_blank
from lorekeep.schemas import REFERENCES, SCHEMAS, UNIQUE

Tables = dict[str, DataFrame]


class UniqueViolation(ValueError):
    """Two rows share a unique key."""


class ReferenceViolation(ValueError):
    """A reference to a row that isn't there, or a restricted delete."""


def next_id(table: DataFrame, key: str = "Id", last: int = 0) -> int:
    """One above the highest key there is, and above `last`, the highest there ever was."""
    return max(last, table.agg(F.coalesce(F.max(key), F.lit(0)).alias("n")).first()["n"]) + 1


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def update(table: DataFrame, key: str, value, changes: dict) -> DataFrame:
    """The row with the key takes the changes; its other columns, and other rows, stay."""
    hit = F.col(f"`{key}`") == value
    return table.select(*[F.when(hit, F.lit(changes[f.name]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in changes else F.col(f"`{f.name}`") for f in table.schema])


def delete(table: DataFrame, key: str, value) -> DataFrame:
    return table.where((F.col(f"`{key}`") == value).isNull() | (F.col(f"`{key}`") != value))


def delete_children(child: DataFrame, column: str, gone: DataFrame, key: str = "Id") -> DataFrame:
    """Cascade: the children of rows that go, go."""
    keys = gone.select(F.col(f"`{key}`").alias("__gone")).distinct()
    return child.join(keys, child[column] == keys["__gone"], "left_anti")


def unlink_children(child: DataFrame, column: str, gone: DataFrame, key: str = "Id") -> DataFrame:
    """Set null: the children of rows that go lose the link."""
    keys = gone.select(F.col(f"`{key}`").alias("__gone")).distinct()
    out = child.join(keys, child[column] == keys["__gone"], "left")
    return out.select(*[F.when(F.col("__gone").isNull(), F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in child.columns])


def blocked(parents: DataFrame, child: DataFrame, column: str, key: str = "Id") -> DataFrame:
    """Restrict: the parents that some child still refers to."""
    keys = child.select(F.col(f"`{column}`").alias("__used")).distinct()
    return parents.join(keys, parents[key] == keys["__used"], "left_semi")


def set_exclusive(table: DataFrame, flag: str, key: str, value) -> DataFrame:
    """The flag holds for the row with the key alone; no row changes if there is no such row."""
    there = table.where(F.col(f"`{key}`") == value).select(F.lit(True).alias("__there")).limit(1)
    # the join has at most one row on its right side
    joined = table.join(F.broadcast(there), F.lit(True), "left")
    return joined.select(*[F.when(F.col("__there"), F.col(f"`{key}`") == value).otherwise(F.col(f"`{c}`")).alias(c) if c == flag else F.col(f"`{c}`") for c in table.columns])


def repeated(table: DataFrame, columns: list[str]) -> DataFrame:
    """The key values that more than one row has."""
    return table.groupBy(*columns).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")


def check_unique(name: str, table: DataFrame) -> None:
    for columns in UNIQUE.get(name, []):
        twice = repeated(table, columns).limit(1).collect()
        if twice:
            raise UniqueViolation(f"{name}: {', '.join(f'{c} = {twice[0][c]!r}' for c in columns)} exists")


def check_references(name: str, values: dict, tables: Tables) -> None:
    for r in REFERENCES:
        if r.child == name and values.get(r.column) is not None and tables[r.parent].where(F.col("Id") == values[r.column]).isEmpty():
            raise ReferenceViolation(f"{name}.{r.column}: {r.parent} has no row {values[r.column]}")


def check_values(name: str, values: dict) -> None:
    """What forms ask for, beyond what tables do: required texts, lengths aside; a priority from 0 to 10; a dependency between two layers."""
    for f in SCHEMAS[name]:
        if f.name in values and not f.nullable and isinstance(f.dataType, StringType) and is_blank(values[f.name]):
            raise ValueError(f"{f.name} is required")
    if not 0 <= values.get("Priority", 0) <= 10:
        raise ValueError("Priority goes from 0 to 10")
    ends = [values[c] for c in ("SourceLayerId", "TargetLayerId") if c in values]
    if any(x <= 0 for x in ends) or len(ends) != len(set(ends)):
        raise ValueError("a dependency needs two different layers")


def create_row(spark: SparkSession, tables: Tables, name: str, values: dict, now: datetime, last: int = 0) -> tuple[Tables, int]:
    """(changed tables, the new Id, above `last`). CreatedAt is set where the table has one."""
    check_references(name, values, tables)
    schema = SCHEMAS[name]
    row = {f.name: values.get(f.name) for f in schema} | {"Id": next_id(tables[name], last=last)}
    if "CreatedAt" in row:
        row["CreatedAt"] = now
    after = insert(tables[name], spark.createDataFrame([tuple(row[f.name] for f in schema)], schema))
    check_unique(name, after)
    return {name: after}, row["Id"]


def update_row(tables: Tables, name: str, key: int, changes: dict) -> Tables | None:
    """Changed tables; None if there is no such row."""
    if tables[name].where(F.col("Id") == key).isEmpty():
        return None
    check_references(name, changes, tables)
    after = update(tables[name], "Id", key, changes)
    check_unique(name, after)
    return {name: after}


def delete_row(tables: Tables, name: str, key: int) -> Tables | None:
    """Changed tables after the delete and what references make of it; None if there is no such row.

    A restricted child blocks the delete unless it goes in the same cascade.
    """
    gone = {name: tables[name].where(F.col("Id") == key)}
    if gone[name].isEmpty():
        return None
    after, todo = {name: delete(tables[name], "Id", key)}, [name]
    while todo:
        parent = todo.pop(0)
        for r in REFERENCES:
            if r.parent == parent and r.on_delete == "cascade":
                child = after.get(r.child, tables[r.child])
                keys = gone[parent].select(F.col("Id").alias("__gone"))
                gone[r.child] = child.join(keys, child[r.column] == keys["__gone"], "left_semi")
                after[r.child] = delete_children(child, r.column, gone[parent])
                todo.append(r.child)
    for r in REFERENCES:
        if r.parent in gone and r.on_delete == "restrict" and not blocked(gone[r.parent], after.get(r.child, tables[r.child]), r.column).isEmpty():
            raise ReferenceViolation(f"{r.child}.{r.column} still refers to a row of {r.parent} that would go")
        if r.parent in gone and r.on_delete == "set_null":
            after[r.child] = unlink_children(after.get(r.child, tables[r.child]), r.column, gone[r.parent])
    return after
