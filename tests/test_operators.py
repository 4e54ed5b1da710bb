"""Scalar functions, cursors, plans, and the registered queries against DuckDB."""

import uuid

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import cursor
from lorekeep.functions.text import has_words, is_blank, parse_name
from lorekeep.plans import registry
from lorekeep.schemas import SEVERITY_RANK

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    df = registry.queries()[name](spark, small)
    found = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, found.select(*[f'"{c}"' for c in columns]).fetchall()))


@pytest.mark.parametrize("name", ["search_union_of_three", "report_grouped", "report_kept_rows"])
def test_queries_read_whole_tables(spark, small, name):
    """On tables larger than any page."""
    sf = small.replace("0.001", "0.01")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    found = c.sql(registry.oracle_sql()[name]).select(*[f'"{x}"' for x in df.columns]).fetchall()
    got = sorted(map(repr, map(tuple, df.collect())))
    assert got == sorted(map(repr, found))
    assert name == "search_union_of_three" and len(got) > 900 or sum(x.count("\\n") for x in got) > 1000


@given(st.integers(-(1 << 31), (1 << 31) - 1))
def test_int_cursor_round_trip(n):
    assert cursor.decode_int(cursor.encode(n)) == n


@given(st.uuids())
def test_guid_cursor_round_trip(g):
    assert cursor.decode_guid(cursor.encode(g)) == g


def test_bad_cursors(spark):
    assert cursor.encode(42) == "NDI="
    for bad in ("", "!", "eHg=", cursor.encode(1 << 40)):
        assert cursor.try_decode_int(bad) is None
    assert cursor.try_decode_guid("NDI=") is None and cursor.try_decode_guid(cursor.encode(uuid.UUID(int=7))) == uuid.UUID(int=7)
    got = spark.createDataFrame([("NDI=",), ("!",), ("eHg=",), (None,)], "c string").select(cursor.decoded(F.col("c"))).collect()
    assert [r[0] for r in got] == [42, None, None, None]


def test_blank_and_names(spark):
    assert is_blank(None) and is_blank(" \t") and not is_blank("a")
    assert parse_name("NEVER", SEVERITY_RANK) == "Never"
    with pytest.raises(ValueError):
        parse_name("2", SEVERITY_RANK)
    got = spark.createDataFrame([(None,), ("",), (" \n",), ("x",)], "c string").select(has_words(F.col("c"))).collect()
    assert [r[0] for r in got] == [False, False, False, True]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_seek_is_pushed_down_and_a_page_is_one_top_k(spark, small):
    p = plan_of(registry.keyset_next_page(spark, small))
    assert "TakeOrderedAndProject" in p and "GreaterThan(o_orderkey,100)" in p
    assert "o_totalprice" not in p.split("ReadSchema")[1]


def test_four_lists_have_no_product(spark, small):
    assert "CartesianProduct" not in plan_of(registry.four_child_lists(spark, small))


def test_search_folds_letter_by_letter(spark):
    from lorekeep.functions.text import contains_any

    d = spark.createDataFrame([("İzmir",), ("ΟΔΟΣ",), ("straße",)], "t string")
    hits = lambda q: [r[0] for r in d.where(contains_any([F.col("t")], q)).collect()]
    assert hits("i") == ["İzmir"] and hits("iz") == [] and hits("İZ") == ["İzmir"]
    assert hits("οδος") == hits("ΟΔΟΣ") == ["ΟΔΟΣ"] and hits("SS") == [] and hits("STRAß") == ["straße"]
