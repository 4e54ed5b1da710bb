"""Every query of the catalog's operators over the star-schema tables, with the SQL that checks it.

Ordered results carry their position, or an ordered text, since comparisons ignore row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import cursor
from lorekeep.functions.text import PRIORITY_BANDS, band, contains_any, has_text, has_words, rank_of, severity_colour, shortened
from lorekeep.operators import dml
from lorekeep.operators.lookup import active_or_first, facet, first_flagged, lookup
from lorekeep.operators.nest import with_child_count, with_children, with_optional_struct, with_parent
from lorekeep.operators.paging import equal_filters, keyset_page
from lorekeep.operators.report import grouped_lines, grouped_section
from lorekeep.operators.search import Searched, search_union

Query = Callable[[SparkSession, str], DataFrame]

#: name -> (query, its SQL)
QUERIES: dict[str, tuple[Query, str]] = {}

# fixed values: roles in the order of a conversation
ROLE_RANK = {"assistant": 0, "user": 1, "system": 2}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20")
def keyset_first_page(spark, sf_dir):
    return keyset_page(_t(spark, sf_dir, "orders"), "o_orderkey").select(*ORDER_COLUMNS)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 100 ORDER BY o_orderkey LIMIT 20")
def keyset_next_page(spark, sf_dir):
    return keyset_page(_t(spark, sf_dir, "orders"), "o_orderkey", 100, 20, equal_filters(o_orderstatus="F")).select(*ORDER_COLUMNS)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_orderkey > 100 ORDER BY o_orderkey LIMIT 20")
def keyset_two_filters(spark, sf_dir):
    return keyset_page(_t(spark, sf_dir, "orders"), "o_orderkey", 100, 20, equal_filters(o_orderstatus="F", o_orderpriority="2-HIGH")).select(*ORDER_COLUMNS)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20")
def filter_blank_is_noop(spark, sf_dir):
    return keyset_page(_t(spark, sf_dir, "part"), "p_partkey", None, 20, equal_filters(p_brand="  ")).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7")
def filter_either_side(spark, sf_dir):
    return keyset_page(_t(spark, sf_dir, "lineitem"), "l_orderkey", None, None, [(F.col("l_partkey") == 7) | (F.col("l_suppkey") == 7)]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 ORDER BY c_custkey LIMIT 50")
def filter_via_parent(spark, sf_dir):
    own = _t(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey")
    c = _t(spark, sf_dir, "customer")
    return keyset_page(c.join(own, c["c_nationkey"] == own["n_nationkey"], "left_semi"), "c_custkey", None, 50).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return lookup(_t(spark, sf_dir, "customer"), "c_custkey", 42).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = -1")
def point_lookup_missing(spark, sf_dir):
    return lookup(_t(spark, sf_dir, "customer"), "c_custkey", -1).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT doc_id, quality FROM labels ORDER BY quality DESC, doc_id LIMIT 1")
def active_or_first_row(spark, sf_dir):
    return active_or_first(_t(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality")


@query("SELECT doc_id, toxic FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 1")
def first_active_row(spark, sf_dir):
    d = _t(spark, sf_dir, "labels")
    return first_flagged(d.withColumn("flag", F.col("toxic") == 1), "flag", "doc_id").select("doc_id", "toxic")


@query("SELECT DISTINCT event_type FROM events")
def facet_event_type(spark, sf_dir):
    return facet(_t(spark, sf_dir, "events"), "event_type")


@query("SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def facet_brand(spark, sf_dir):
    return facet(_t(spark, sf_dir, "part"), "p_brand").withColumn("place", F.row_number().over(Window.orderBy("p_brand")).cast("long"))


@query("SELECT DISTINCT lang FROM documents")
def facet_lang(spark, sf_dir):
    return facet(_t(spark, sf_dir, "documents"), "lang")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_optional_struct(spark, sf_dir):
    d = with_optional_struct(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id", "label", ["quality", "toxic"], "doc_id")
    return d.select("doc_id", F.col("label").isNotNull().alias("has_label"), *[F.coalesce(f"label.{c}", F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_name_lookup(spark, sf_dir):
    return with_parent(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id", {"quality": "quality"}, "doc_id").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("SELECT c_custkey, s_suppkey, a.n_name AS customer_nation, b.n_name AS supplier_nation FROM customer JOIN supplier ON c_custkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey")
def inner_two_roles(spark, sf_dir):
    c, s, n = (_t(spark, sf_dir, x) for x in ("customer", "supplier", "nation"))
    pairs = c.join(s, c["c_custkey"] == s["s_suppkey"])
    pairs = with_parent(pairs, n, "c_nationkey", {"customer_nation": "n_name"}, "n_nationkey", "inner")
    return with_parent(pairs, n, "s_nationkey", {"supplier_nation": "n_name"}, "n_nationkey", "inner").select("c_custkey", "s_suppkey", "customer_nation", "supplier_nation")


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_items FROM orders")
def child_count_with_zero(spark, sf_dir):
    return with_child_count(_t(spark, sf_dir, "orders").select("o_orderkey"), _t(spark, sf_dir, "lineitem"), "l_orderkey", "n_items", "o_orderkey")


@query("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag), '') AS items
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def nested_children(spark, sf_dir):
    item = F.concat_ws(":", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_returnflag"))
    o = with_children(_t(spark, sf_dir, "orders").select("o_orderkey"), _t(spark, sf_dir, "lineitem"), "l_orderkey", "items", item, ["l_linenumber", "l_partkey", "l_returnflag"], "o_orderkey")
    return o.select("o_orderkey", F.array_join("items", ",").alias("items"))


@query("""SELECT n_nationkey,
  coalesce((SELECT string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey), '') AS customers,
  coalesce((SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers,
  coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey), '') AS nation_orders,
  (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS n_items
FROM nation""")
def four_child_lists(spark, sf_dir):
    n, c, s, o, li = (_t(spark, sf_dir, x) for x in ("nation", "customer", "supplier", "orders", "lineitem"))
    own = with_parent(o.select("o_orderkey", "o_custkey"), c, "o_custkey", {"nation": "c_nationkey"}, "c_custkey", "inner")
    items = with_parent(li.select("l_orderkey"), own, "l_orderkey", {"nation": "nation"}, "o_orderkey", "inner")
    n = with_children(n.select("n_nationkey"), c, "c_nationkey", "customers", F.col("c_custkey").cast("string"), ["c_custkey"], "n_nationkey")
    n = with_children(n, s, "s_nationkey", "suppliers", F.col("s_suppkey").cast("string"), ["s_suppkey"], "n_nationkey")
    n = with_children(n, own, "nation", "nation_orders", F.col("o_orderkey").cast("string"), ["o_orderkey"], "n_nationkey")
    n = with_child_count(n, items, "nation", "n_items", "n_nationkey")
    return n.select("n_nationkey", *[F.array_join(x, ",").alias(x) for x in ("customers", "suppliers", "nation_orders")], "n_items")


@query("""SELECT 'Document' AS "Type", 0 AS source_order, doc_id AS hit_key FROM documents WHERE contains(lower(text), 'er')
UNION ALL SELECT 'Page', 1, page_id FROM pages WHERE contains(lower(url), 'er')
UNION ALL SELECT 'Part', 2, p_partkey FROM part WHERE contains(lower(p_name), 'er') OR contains(lower(p_type), 'er')""")
def search_union_of_three(spark, sf_dir):
    parts = [
        Searched("Document", _t(spark, sf_dir, "documents"), ["text"], [], "doc_id"),
        Searched("Page", _t(spark, sf_dir, "pages"), ["url"], [], "page_id"),
        Searched("Part", _t(spark, sf_dir, "part"), ["p_name", "p_type"], [], "p_partkey"),
    ]
    return search_union(parts, "er", None)


@query("""SELECT o_orderkey, coalesce(c_name, '') AS customer FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderkey > 200 ORDER BY o_orderkey LIMIT 30) LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 12""")
def limit_before_join(spark, sf_dir):
    """A page, then names: rows whose parent is missing stay, and the limit holds."""
    page = keyset_page(_t(spark, sf_dir, "orders"), "o_orderkey", 200, 30, equal_filters(o_orderstatus="O"))
    named = with_parent(page, _t(spark, sf_dir, "customer").where("c_nationkey < 12"), "o_custkey", {"customer": "c_name"}, "c_custkey")
    return named.select("o_orderkey", F.coalesce("customer", F.lit("")).alias("customer"))


# the expected values of the next three are written out: they follow from the rules alone

HEADINGS = "SELECT * FROM VALUES (1, 'Zed'), (2, 'api'), (3, 'Ärger'), (4, 'API'), (5, 'b'), (6, 'Zed') AS t(id, name)"


@query("""SELECT '## Kinds' || chr(10) || chr(10) || string_agg('### ' || name || chr(10) || body || chr(10), '' ORDER BY place) AS text
FROM (VALUES (1, 'api', '- 2' || chr(10)), (2, 'API', '- 4' || chr(10)), (3, 'Ärger', '- 3' || chr(10)), (4, 'b', '- 5' || chr(10)), (5, 'Zed', '- 1' || chr(10) || '- 6' || chr(10))) AS v(place, name, body)""")
def report_headings(spark, sf_dir):
    line = F.concat(F.lit("- "), F.col("id").cast("string"), F.lit("\n"))
    return grouped_section(spark.sql(HEADINGS), "## Kinds", "name", line, [F.col("id")])


@query("""SELECT * FROM (VALUES ('MTA=', 10), ('LTU=', -5), ('', -99), ('MTA', -99), ('%%%', -99), ('OTk5OTk5OTk5OTk5', -99), ('YWJj', -99)) AS v(cursor, back)""")
def bad_cursors(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in ("MTA=", "LTU=", "", "MTA", "%%%", "OTk5OTk5OTk5OTk5", "YWJj")], "cursor string")
    return d.withColumn("back", F.coalesce(cursor.decoded(F.col("cursor")), F.lit(-99)))


@query("""SELECT * FROM (VALUES (1, false, false), (2, false, false), (3, true, false), (4, true, false), (5, true, true)) AS v(id, has_text, has_words)""")
def blank_tests(spark, sf_dir):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "\t\n"), (5, " x ")], "id int, text string")
    return d.select("id", has_text(F.col("text")).alias("has_text"), has_words(F.col("text")).alias("has_words"))


@query("SELECT needle, count(*) AS n FROM documents, (VALUES ('die'), ('SS')) AS v(needle) WHERE contains(lower(text), lower(needle)) GROUP BY needle")
def search_case(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    parts = [d.where(contains_any([F.col("text")], x)).agg(F.count("*").alias("n")).select(F.lit(x).alias("needle"), "n") for x in ("die", "SS")]
    return parts[0].union(parts[1])


@query("SELECT count(*) AS n FROM documents")
def search_empty_needle(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(contains_any([F.col("text")], "")).agg(F.count("*").alias("n"))


@query("""SELECT event_type AS "group", string_agg('- ' || user_id || '/' || event_id || chr(10), '' ORDER BY user_id DESC, event_id) AS body
FROM events GROUP BY event_type""")
def report_grouped(spark, sf_dir):
    line = F.concat(F.lit("- "), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit("\n"))
    return grouped_lines(_t(spark, sf_dir, "events"), "event_type", line, [-F.col("user_id"), F.col("event_id")])


@query("""SELECT event_type AS "group", coalesce(string_agg(event_id || chr(10), '' ORDER BY event_id) FILTER (WHERE user_id % 7 = 0), '') AS body FROM events GROUP BY event_type""")
def report_kept_rows(spark, sf_dir):
    return grouped_lines(_t(spark, sf_dir, "events"), "event_type", F.concat(F.col("event_id").cast("string"), F.lit("\n")), [F.col("event_id")], F.col("user_id") % 7 == 0)


@query("""SELECT conv_id, turn, CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS "rank",
  row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 1 ELSE 0 END DESC, turn) AS place FROM conversations""")
def rank_order(spark, sf_dir):
    d = _t(spark, sf_dir, "conversations").select("conv_id", "turn", rank_of(F.col("role"), ROLE_RANK).alias("rank"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("rank"), "turn")).cast("long"))


@query("SELECT toxic = 1 AS flag, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM labels GROUP BY 1")
def partition_bool(spark, sf_dir):
    d = _t(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("flag"), "doc_id")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return d.groupBy("flag").agg(F.count("*").alias("n"), ids.alias("ids"))


@query("SELECT p_partkey, CASE WHEN p_size >= 8 THEN 'error' WHEN p_size >= 5 THEN 'warning' WHEN p_size >= 3 THEN 'info' ELSE 'default' END AS band FROM part")
def band_case(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", band(F.col("p_size"), PRIORITY_BANDS, "default").alias("band"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS colour FROM labels")
def severity_colours(spark, sf_dir):
    severity = F.when(F.col("toxic") == 1, "Never").when(F.col("quality") == 0, "StronglyAvoid").otherwise("Avoid")
    return _t(spark, sf_dir, "labels").select("doc_id", severity_colour(severity).alias("colour"))


@query("SELECT page_id, CASE WHEN length(url) <= 25 THEN url ELSE substr(url, 1, 22) || '...' END AS short FROM pages")
def truncate_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", shortened(F.col("url")).alias("short"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 25 THEN p_name ELSE substr(p_name, 1, 22) || '...' END AS short FROM part")
def truncate_short_text(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", shortened(F.col("p_name")).alias("short"))


@query("SELECT o_orderkey, base64(encode(CAST(o_orderkey AS VARCHAR))) AS cursor, CAST(o_orderkey AS INTEGER) AS back FROM orders")
def cursor_codec(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select("o_orderkey", cursor.encoded(F.col("o_orderkey")).alias("cursor"))
    return d.withColumn("back", cursor.decoded(F.col("cursor")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST((SELECT max(n_nationkey) + 1 FROM nation) AS INTEGER), 'NEWLAND', 1")
def post_insert(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    row = spark.createDataFrame([(dml.next_id(n, "n_nationkey"), "NEWLAND", 1)], n.schema)
    return dml.insert(n, row)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def post_update(spark, sf_dir):
    return dml.update(_t(spark, sf_dir, "nation"), "n_nationkey", 3, {"n_name": "RENAMED"})


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 3")
def post_delete(spark, sf_dir):
    return dml.delete(_t(spark, sf_dir, "nation"), "n_nationkey", 3)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 1)")
def post_delete_cascade(spark, sf_dir):
    gone = _t(spark, sf_dir, "orders").where("o_custkey = 1")
    return dml.delete_children(_t(spark, sf_dir, "lineitem"), "l_orderkey", gone, "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.doc_id ELSE -1 END AS label_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1")
def post_set_null(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("label_id"))
    d = dml.unlink_children(d, "label_id", _t(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return d.withColumn("label_id", F.coalesce("label_id", F.lit(-1).cast("long")))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def restrict_check(spark, sf_dir):
    used = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return dml.blocked(_t(spark, sf_dir, "customer"), used, "o_custkey", "c_custkey").select("c_custkey")


@query("SELECT doc_id, doc_id = (SELECT min(doc_id) FROM labels WHERE quality = 0) AS active FROM labels")
def post_exclusive_flag(spark, sf_dir):
    d = _t(spark, sf_dir, "labels")
    key = first_flagged(d.withColumn("flag", F.col("quality") == 0), "flag", "doc_id").first()["doc_id"]
    return dml.set_exclusive(d.select("doc_id", (F.col("quality") == 1).alias("active")), "active", "doc_id", key)


@query("SELECT doc_id, quality = 1 AS active FROM labels")
def post_exclusive_missing(spark, sf_dir):
    return dml.set_exclusive(_t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("active")), "active", "doc_id", -1)


@query("SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_check(spark, sf_dir):
    return dml.repeated(_t(spark, sf_dir, "part"), ["p_name"])


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
