"""Line dedup by winnowing over line hashes, with DataFrame operations alone.

Every window of `run_lines` consecutive lines selects its least line hash; the selected positions are the
fingerprints, and any repeated run of at least `run_lines` lines is sure to contain one. Fingerprints
that occur more than once are joined to their positions, each match is extended to both sides over the
windows that selected it, and the lines of every window that occurred before are deleted.

A shorter run is a repeat too if it holds more than `long_words` words. Such runs are windows of their
own, one for each start and number of lines, and each is its own fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import checkpointed, skew_join

RUN_LINES = 3
#: Words beyond which a run of fewer lines counts as well (None: no such runs).
LONG_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long_runs(k: int, long_words: int) -> Column:
    """Windows of k lines with more than `long_words` words, as structs; their offset is -k."""
    words = lambda i: F.aggregate(F.slice("n_words", i + 1, k), F.lit(0), lambda a, x: a + x)
    part = lambda i: F.slice("h", i + 1, k)
    long = F.filter(F.sequence(F.lit(0), F.size("h") - k), lambda i: words(i) > long_words)
    runs = F.transform(long, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(-k), part(i)).alias("print"), F.lit(-k).alias("offset"), F.xxhash64(part(i)).alias("whole")))
    return F.when(F.size("h") >= k, runs).otherwise(F.array())


def repeated_lines(docs: DataFrame, run_lines: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """(doc_id, text_hash, removed): the line numbers to delete from each document that has any.

    A window of `run_lines` lines, or of fewer that hold more than `long_words` words (None: no such), is a
    repeat if an equal one begins earlier, in order of id (nulls first), text hash and line. Rows equal in
    id and text count as one document: both lose the same lines, and neither makes the other a repeat.
    """
    t = run_lines
    text = F.col(f"`{text_col}`")
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.transform(_lines(text), lambda x: F.xxhash64(x)).alias("h"), *([] if long_words is None else [F.transform(_lines(text), lambda x: F.regexp_count(x, F.lit(WORD))).alias("n_words")]))
    part = lambda i: F.slice("h", i + 1, t)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("h") - t),
        # of equal minima the last is selected
        lambda i: F.struct(i.alias("at"), F.array_min(part(i)).alias("print"), (F.lit(t) - F.array_position(F.reverse(part(i)), F.array_min(part(i)))).cast("int").alias("offset"), F.xxhash64(part(i)).alias("whole")),
    )
    if long_words is None:
        w = d.where(F.size("h") >= t).select("doc_id", "text_hash", F.explode(windows).alias("w"))
    else:
        parts = [F.when(F.size("h") >= t, windows).otherwise(F.array())] + [_long_runs(k, long_words) for k in range(1, t)]
        w = d.select("doc_id", "text_hash", F.explode(F.concat(*parts)).alias("w"))
    w = checkpointed(w.select("doc_id", "text_hash", "w.*"))  # five numbers a line; the texts are read once for this
    # a selected position is counted once, at the first window that selected it; n: the windows that it selects
    place = F.struct("doc_id", "text_hash", (F.col("at") + F.col("offset")).alias("line"))
    prints = w.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a != b").select("print", "n")
    candidates = skew_join(w, checkpointed(prints), ["print"], "n", "left_semi")
    key = ["print", "offset", "whole"]
    place = F.struct("doc_id", "text_hash", "at")
    first = candidates.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first != last").drop("last")
    later = skew_join(candidates, checkpointed(first), key, "n").where(place > F.col("first"))
    size = F.when(F.col("offset") < 0, -F.col("offset")).otherwise(t)
    lines = later.select("doc_id", "text_hash", F.explode(F.sequence("at", F.col("at") + size - 1)).alias("line"))
    return lines.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text", report_col: str = "line_report", long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs with the later repeats of runs of at least `run_lines` lines, or of more than `long_words` words, deleted from the text.

    All columns stay, and a struct `report_col` (n_lines, n_removed, n_runs) is added; pick another name
    if docs has one like it. Lines end at a line feed. The first occurrence of a run stays, also within a
    document. A null text is one empty line and stays null; a text without such runs stays as it is; a text
    all of whose lines go becomes empty; an empty table gives no rows. Time is linear in a text's lines.
    """
    removed = repeated_lines(docs, run_lines, id_col, text_col, long_words).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("removed").alias("__removed"))
    text = F.col(f"`{text_col}`")
    match = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own_hash") == F.col("__hash"))
    # the side of removed lines is the hashed one: texts are dealt out, but not sorted
    joined = docs.withColumn("__own_hash", F.xxhash64(text)).join(removed.hint("shuffle_hash"), match, "left")
    # each text is split once, in a step of its own
    joined = joined.withColumn("__lines", _lines(text)).withColumn("__removed", F.coalesce("__removed", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__removed")
    new = F.when(F.size("__removed") == 0, text).otherwise(F.array_join(F.transform(kept, lambda j: F.get("__lines", j)), "\n"))
    # a run begins at each line whose line before stays
    runs = F.size(F.array_except("__removed", F.transform("__removed", lambda x: x + 1)))
    report = F.struct(F.size("__lines").cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"), runs.cast("long").alias("n_runs"))
    return joined.select(*[(new.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns], report.alias(report_col))


def lines_sql(docs: str = "documents", run_lines: int = RUN_LINES, long_words: int | None = LONG_WORDS) -> str:
    """DuckDB CTEs; the last, lines_out, has doc_id, text and the report of dedup_lines() over a relation with distinct ids."""
    t = run_lines
    short = [] if long_words is None else [*range(1, t)]
    windows = "\n  UNION ALL ".join(
        f"SELECT {k} AS k, doc_id, pos, string_agg(line, chr(10)) OVER w AS body, count(*) OVER w AS n, sum(words) OVER w AS words FROM lines_all WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
        for k in [*short, t]
    )
    return f"""
lines_all AS (
  SELECT doc_id, line, pos, len(regexp_extract_all(line, '{WORD}')) AS words FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM {docs})),
lines_windows AS (
  {windows}),
lines_ranked AS (
  SELECT k, doc_id, pos, row_number() OVER (PARTITION BY k, body ORDER BY doc_id, pos) AS seen
  FROM lines_windows WHERE n = k AND (k = {t} OR words > {long_words or 0})),
lines_gone AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM lines_ranked, range({t}) AS r(j) WHERE seen > 1 AND j < k),
lines_flagged AS (
  SELECT a.doc_id, a.pos, a.line, g.pos IS NOT NULL AS gone,
         coalesce(lag(g.pos IS NOT NULL) OVER (PARTITION BY a.doc_id ORDER BY a.pos), false) AS gone_before
  FROM lines_all a LEFT JOIN lines_gone g USING (doc_id, pos)),
lines_out AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         count(*) FILTER (WHERE gone AND NOT gone_before) AS n_runs
  FROM lines_flagged GROUP BY doc_id)"""
