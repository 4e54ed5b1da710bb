"""Mixing sources to target weights: random order within a source, prefix sums of sizes, an exact cut.

Keys are hashes of ids and texts, so each source is in random order. The key's leading digits cut a source
into ranges; the small table of range sums is prefix-summed, which tells in what range of each source the
cut lies. Only that range, some 1/4096 of the source, is put in order; all others are wholly in or out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import checkpointed

#: Leading hexadecimal digits of the key that name a range of a source: 16 ** RANGE_DIGITS ranges.
RANGE_DIGITS = 3
#: Sources at most; their table, one row each, is put in order by one task and broadcast.
MOST_SOURCES = 1_000_000
SEED = "mix-1"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with the weight and target of each source.

    Sources in code-point order, null last, take the weights in turn; together they share `share` times
    all sizes. A target stops at `most` times its source's size, the excess being shared again by weight:
    with sources in order of cap per weight that is one pass of prefix sums. One row a source throughout.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.array(*map(F.lit, weights))
    t = (
        sizes.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(upto), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_weight"))
        # the first source that its share doesn't fill sets the level of all after it
        .withColumn("open_level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("full"), F.col("level")))).over(every))
    )
    target = F.when(F.col("open_level").isNull() | (F.col("full") < F.col("open_level.full")), F.col("cap").cast("double")).otherwise(F.least(F.col("open_level.level") * F.col("weight"), F.col("cap").cast("double")))
    return t.select("source", "source_size", "weight", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def size_of(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long")


def key_of(seed: str, id_col: str, text_col: str) -> Column:
    """Random order within a source. The text's hash takes part, so rows with null or equal ids spread too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """rows (source, range, size) -> one row a source, for a broadcast: __source, __source_size, __target, __epochs, __rest, __cut_range, __cut_start.

    A source gives `__epochs` whole epochs and the first `__rest` words of one more. These end in __cut_range,
    which begins after __cut_start words: ranges before it are taken once more, those after it aren't. Raises
    beyond MOST_SOURCES sources.
    """
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ranges = checkpointed(ranges)  # at most 16 ** RANGE_DIGITS rows a source
    sizes = checkpointed(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    n = sizes.count()
    if n > MOST_SOURCES:
        raise ValueError(f"{n} sources; targets are shared out among {MOST_SOURCES} at most")
    words = F.floor("target").cast("long")
    t = source_targets(sizes, weights, share, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long"))
    t = checkpointed(t.withColumn("rest", words - F.col("epochs") * F.col("source_size")))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    at = starts.alias("r").join(F.broadcast(t.select("source", "rest")).alias("t"), F.expr("r.source <=> t.source")).where("r.start <= t.rest and t.rest < r.start + r.range_size").select(F.col("r.source").alias("at_source"), F.col("r.range").alias("cut_range"), F.col("r.start").alias("cut_start"))
    out = t.join(at, F.expr("source <=> at_source"), "left")
    return checkpointed(out.select(*[F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target", "epochs", "rest", "cut_range", "cut_start")]))


def _taken(rows: DataFrame, cut: DataFrame, source: str, size: str, key: str, range_: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all ranges but the cut ones, and of those, with the words the mix takes of each in __taken."""
    joined = rows.join(F.broadcast(cut), F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    is_cut = F.coalesce(F.col(range_) == F.col("__cut_range"), F.lit(False))
    more = F.when(F.col(range_) < F.col("__cut_range"), 1).otherwise(0)
    whole = joined.where(~is_cut).withColumn("__times", F.col("__epochs") + more).withColumn("__taken", F.col(size) * F.col("__times"))
    # one range of each source is put in order: a small part of it
    order = Window.partitionBy("__source").orderBy(key, F.col(f"`{tie}`"), size).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("__cut_start") + F.coalesce(F.sum(size).over(order), F.lit(0))
    part = joined.where(is_cut).withColumn("__taken", F.col(size) * F.col("__epochs") + F.least(F.col(size), F.greatest(F.lit(0), F.col("__rest") - so_far)))
    return whole, part


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (words the mix takes).

    Size: words between ASCII white space (null text: 0). A source gives floor(target / size) whole epochs
    and, of one more, the documents that come first in key order up to the rest of its budget; of the
    document on the cut the mix takes only the words that are left, so a source's taken words are its
    target rounded down. Null source: a source of its own, last. Rows equal in id, text and source are
    interchangeable. Empty texts take nothing. Empty table: no rows. Other columns are not read. Only
    DataFrame operations; reruns agree.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size_of(text_col).alias("size"), key_of(seed, id_col, text_col).alias("key")).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    d = checkpointed(d)  # a few numbers a row; the texts are read once
    parts = _taken(d, cuts(d, weights, share, most), "source", "size", "key", "range", "doc_id")
    columns = ["doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").cast("long").alias("taken")]
    return parts[0].select(*columns).union(parts[1].select(*columns))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix_col: str = "mix") -> DataFrame:
    """The documents of the mix (taken > 0): all columns of docs, and a struct `mix_col` (size, source_size, target, taken).

    As mixed(). Texts stay where they are, but for the one range of each source that the cut goes through.
    """
    d = docs.withColumn("__key", key_of(seed, id_col, text_col)).withColumn("__range", F.substring("__key", 1, RANGE_DIGITS)).withColumn("__size", size_of(text_col))
    cut = cuts(d.select(F.col(f"`{source_col}`").alias("source"), F.col("__range").alias("range"), F.col("__size").alias("size")), weights, share, most)
    whole, part = _taken(d, cut, source_col, "__size", "__key", "__range", id_col)
    # some word, and some epoch: what taken > 0 says, without counting the words twice
    whole = whole.where((F.col("__times") > 0) & F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(WORD))
    columns = [*[F.col(f"`{c}`") for c in docs.columns], F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").cast("long").alias("taken")).alias(mix_col)]
    return whole.select(*columns).union(part.where("__taken > 0").select(*columns))


#: DuckDB SQL for the rows of mixed() over {docs}, a relation with doc_id, text and source.
MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM {docs}),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS BIGINT) AS weight
  FROM d GROUP BY source),
-- water level: again and again, the sources above their cap are set to it
fill(step, budget, full_names, n_full) AS (
  SELECT 0, 1.5 * (SELECT sum(source_size) FROM s), CAST([] AS VARCHAR[]), 0
  UNION ALL
  SELECT step + 1, budget, names, len(names) FROM (
    SELECT f.step, f.budget, f.n_full, (
      SELECT coalesce(list(coalesce('v' || source, 'n') ORDER BY source), []) FROM s
      WHERE list_contains(f.full_names, coalesce('v' || source, 'n')) OR weight * (
        (f.budget - (SELECT coalesce(sum(2 * source_size), 0) FROM s s2 WHERE list_contains(f.full_names, coalesce('v' || s2.source, 'n'))))
        / (SELECT sum(weight) FROM s s3 WHERE NOT list_contains(f.full_names, coalesce('v' || s3.source, 'n')))) > 2 * source_size) AS names
    FROM fill f) WHERE len(names) > n_full),
done AS (SELECT budget, full_names FROM fill ORDER BY step DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE
      WHEN source_size = 0 THEN 0.0
      WHEN list_contains((SELECT full_names FROM done), coalesce('v' || source, 'n')) THEN CAST(2 * source_size AS DOUBLE)
      ELSE weight * (((SELECT budget FROM done) - (SELECT coalesce(sum(2 * source_size), 0) FROM s s2 WHERE list_contains((SELECT full_names FROM done), coalesce('v' || s2.source, 'n'))))
        / (SELECT sum(weight) FROM s s3 WHERE NOT list_contains((SELECT full_names FROM done), coalesce('v' || s3.source, 'n')))) END AS target
  FROM s),
r AS (
  SELECT d.*, t.source_size, CAST(t.target AS DOUBLE) AS target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (CAST(floor(target) AS BIGINT) // source_size)
            + least(size, greatest(0, CAST(floor(target) AS BIGINT) % source_size - before)) END AS BIGINT) AS taken
FROM r
"""


def mix_sql(docs: str = "documents") -> str:
    return MIX_SQL.replace("{docs}", docs).replace("{seed}", SEED)
