"""Operators 1, 4 and 8 and the pipeline, against brute force and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import chat, common, decontam, jaccard_join, line_dedup, mixing, toxicity
from lorekeep.llm.components import components
from lorekeep.llm.queries import llm_oracle_sql, llm_queries
from tests.llm.conftest import SCHEMA, rows_of

# 1: chat formatting


def test_best_path_by_enumeration():
    rng = random.Random(1)
    for _ in range(30):
        rows = [(i, rng.choice([None, "user", "assistant", "?"]), rng.choice(["hi?", "x" * 400, "User: yo", "You are b", "- a"])) for i in range(rng.randrange(1, 6))]
        lines = [x for r in rows for x in chat.observed(*r)]

        def score(path, lines=lines):
            return chat.START[path[0]] + lines[0][0][path[0]] + sum(chat.step(o)[a, b] + e[b] for (e, o, *_), a, b in zip(lines[1:], path, path[1:]))

        best = max(itertools.product(range(3), repeat=len(lines)), key=score)
        assert score(tuple(chat.decode(lines, None, None))) == score(best)


def test_partitions_do_not_change_turns(spark):
    rng = random.Random(2)
    rows = [(1 if i < 500 else None, i % 450, rng.choice([None, None, "user", "Assistant"]), "\n".join(rng.choice(["hi?", "x" * 400, "**Assistant:** ok", "", "- a"]) for _ in range(rng.randrange(1, 4)))) for i in range(560)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = (sorted(map(repr, chat.canonical_turns(df, partitions=n).collect())) for n in (1, 11))
    assert one == many


def test_roles_are_recovered(spark, small):
    sf = small.replace("0.001", "0.01")
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    truth = c.select("conv_id", "turn", F.col("role").alias("truth"))
    for role_col, least in (("role", 1.0), (None, 0.95)):
        r = chat.canonical_turns(c, role_col=role_col).where("part = 0").join(truth, ["conv_id", "turn"])
        assert r.where("role = truth").count() >= least * c.count()


def test_markers_and_odd_rows(spark):
    rows = [(1, 0, None, "### System: You are kind.\nUser: hello?\nmore\n<|assistant|> fine"), (1, 1, None, None), (None, None, None, None), (2, 0, "user", "same"), (2, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    r = chat.canonical_turns(df)
    first = [(x["role"], x["rendered"]) for x in r.where("conv_id = 1 and turn = 0").orderBy("part").collect()]
    assert first == [("system", "<|system|>\nYou are kind.\n<|end|>\n"), ("user", "<|user|>\nhello?\nmore\n<|end|>\n"), ("assistant", "<|assistant|>\nfine\n<|end|>\n")]
    assert r.count() == 7 and chat.canonical_turns(df.limit(0)).count() == 0


# 4: line dedup


def kept_lines(docs, t=line_dedup.RUN_LINES):
    """Brute force: windows in order of document; those seen before go."""
    seen, out = set(), {}
    for d, text in docs:
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - t + 1):
            w = tuple(lines[i : i + t])
            if w in seen:
                gone.update(range(i, i + t))
            seen.add(w)
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), sum(i - 1 not in gone for i in gone))
    return out


def test_line_dedup_equals_brute_force(spark, small):
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    docs += [(1000 + d, t) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY 1").fetchall()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], *r["line_report"]) for r in line_dedup.dedup_lines(df, long_words=None).collect()}
    assert got == kept_lines(docs)
    con = duckdb.connect()
    con.register("documents", pa.table(df.toArrow()))
    assert {r[0]: r[1:] for r in con.sql(f"WITH {line_dedup.lines_sql(long_words=None)} SELECT doc_id, text, n_lines, n_removed, n_runs FROM lines_out").fetchall()} == got


def kept_runs(docs, t=line_dedup.RUN_LINES, words=line_dedup.LONG_WORDS):
    """Brute force: as kept_lines(), and runs of fewer lines with more words go too."""
    seen, out = set(), {}
    for d, text in docs:
        lines, gone = text.split("\n"), set()
        for i in range(len(lines)):
            for k in range(1, min(t, len(lines) - i) + 1):
                w = tuple(lines[i : i + k])
                if k == t or sum(len(re.findall(r"[^ \t-\r]+", x)) for x in w) > words:
                    if w in seen:
                        gone.update(range(i, i + k))
                    seen.add(w)
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), sum(i - 1 not in gone for i in gone))
    return out


def test_long_runs_of_few_lines_go(spark, small):
    """A passage of more than 50 words goes however few lines it has, also from texts of one or two lines."""
    long, half = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(30))
    rng = random.Random(8)
    lines = [long, half, half + " x", "a", "b", "", " ".join("z" for _ in range(50)), " ".join("y" for _ in range(51))]
    docs = [(0, long), (1, f"x\n{long}\ny"), (2, f"{half}\n{half} x"), (3, f"p\n{half}\n{half} x\nq"), (4, long)]
    docs += [(10 + i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    docs += [(1000 + d, t) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY 1").fetchall()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], *r["line_report"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == kept_runs(docs)
    con = duckdb.connect()
    con.register("documents", pa.table(df.toArrow()))
    assert {r[0]: r[1:] for r in con.sql(f"WITH {line_dedup.lines_sql()} SELECT doc_id, text, n_lines, n_removed, n_runs FROM lines_out").fetchall()} == got
    assert [got[i][0] for i in (1, 3, 4)] == ["x\ny", "p\nq", ""]
    assert kept_runs(docs) != kept_lines(docs)


def test_very_many_lines(spark):
    """Time is linear in the lines of a text: 200,000 of them, half repeats, take seconds."""
    half = "\n".join(f"line {i} of many" for i in range(100_000))
    df = spark.createDataFrame([(0, f"a\n{half}"), (1, f"{half}\nb\n{half}")], "doc_id long, text string")
    start = time.monotonic()
    got = line_dedup.dedup_lines(df).select("doc_id", "line_report.*", F.md5("text").alias("md5")).orderBy("doc_id").collect()
    assert time.monotonic() - start < 60
    assert [tuple(r)[1:4] for r in got] == [(100_001, 0, 0), (200_001, 200_000, 2)] and got[1]["md5"] == hashlib.md5(b"b").hexdigest()


def test_hot_lines_are_split(spark, monkeypatch):
    """A line in most documents goes by broadcast, all else by shuffle; the result is that of brute force."""
    rng = random.Random(14)
    docs = [(i, "\n".join(["hot", "hot", "hot", *(rng.choice("abcdef") for _ in range(5))])) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for keys, rows in ((0, 0), (8, 0), (1 << 40, 0), (4096, 256)):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        got = {r["doc_id"]: (r["text"], *r["line_report"]) for r in line_dedup.dedup_lines(df).collect()}
        assert got == kept_runs(docs)


def test_line_dedup_is_native(spark, small):
    plan = line_dedup.dedup_lines(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_line_dedup_odd(spark, odd, none):
    r = line_dedup.dedup_lines(odd.withColumn("print", F.lit(1)))
    assert r.columns == [*odd.columns, "print", "line_report"] and r.count() == odd.count()
    # rows equal in id and text are one document
    assert r.where("doc_id = 3 and line_report.n_removed > 0").isEmpty()
    assert line_dedup.dedup_lines(none).count() == 0
    copies = line_dedup.dedup_lines(spark.createDataFrame(rows_of(["a\nb\nc"] * 3), SCHEMA)).orderBy("doc_id").collect()
    assert [x["text"] for x in copies] == ["a\nb\nc", "", ""]


# 8: Jaccard join


def shingles(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(docs):
    """doc -> (class, copies, links) by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    links, root = collections.Counter(), {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    copies = collections.Counter({d: 1 for d, _ in docs})
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 5 * len(x & y) >= 4 * len(x | y):
            links[a] += 1
            links[b] += 1
            copies[a] += x == y
            copies[b] += x == y
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (find(d), copies[d], links[d]) for d, _ in docs}


def near_copies(n, rng):
    words = [f"w{i}" for i in range(120)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_links_equal_all_pairs(spark, small, block):
    rng = random.Random(9)
    texts = near_copies(40, rng) + ["a b", "A, b!", "", "", None, "one two three four five six"] * 2
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["copies"], r["n_links"]) for r in jaccard_join.near_duplicates(df, block_classes=block).collect()}
    assert got == linked(docs)


def test_join_on_the_small_table(spark, small):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    got = jaccard_join.near_duplicates(spark.read.parquet(f"{small}/documents.parquet"))
    assert {r["doc_id"]: (r["class_id"], r["copies"], r["n_links"]) for r in got.collect()} == linked(docs)


def test_empty_parts_add_no_links(spark):
    """Clusters of two classes in three parts: often both are in one and a higher one is empty; no pair is counted twice."""
    texts = []
    for c in range(24):
        words = [f"c{c}w{i}" for i in range(100)]
        texts += [" ".join(words), " ".join([*words, "more"])]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["copies"], r["n_links"]) for r in jaccard_join.near_duplicates(df, block_shingles=70).collect()}
    assert got == linked(docs)


def test_crowded_runs_lose_no_link(spark):
    """Many texts on one theme, pairs from far below to just above the join's similarity, in runs of several clusters."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        theme = list(base)
        for k in rng.sample(range(400), 12):
            theme[k] = f"t{rng.randrange(10**6)}"
        for _ in range(25):
            w = list(theme)
            for k in rng.sample(range(400), rng.randrange(0, 12)):
                w[k] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = linked(docs)
    near = sum(0.8 <= len(x & y) / len(x | y) < 0.85 for x, y in itertools.combinations([shingles(t) for t in texts], 2))
    assert near > 200
    for join_at, block in ((0.6, 2048), (0.95, 9), (1.1, 30)):  # where a pair is compared changes nothing
        got = {r["doc_id"]: (r["class_id"], r["copies"], r["n_links"]) for r in jaccard_join.near_duplicates(df, join_at=join_at, block_classes=block).collect()}
        assert got == want


def test_small_sets_stop_at_longer_prefixes():
    third = jaccard_join.SIMILARITY
    for n in range(1, 30):  # by trying all sizes and overlaps
        found = [jaccard_join.Fraction(i, n + m - i) for m in range(1, 60) for i in range(1, min(n, m) + 1) if not i == n == m and 5 * i >= 4 * (n + m - i)]
        assert jaccard_join.least_similarity(n, third) == (min(found) if found else None)
    own = [jaccard_join.own_depth(n, third, jaccard_join.TREES, jaccard_join.DEPTH, jaccard_join.TARGET_RECALL) for n in (3, 4, 6, 7, 8, 500)]
    assert own == [0, 5, 6, 6, 5, 5]


def test_small_sets_link_as_all_pairs(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{k}" for k in range(rng.randrange(3), rng.randrange(8, 22)))) for i in range(60)]
    got = {r["doc_id"]: (r["class_id"], r["copies"], r["n_links"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == linked(docs)


def test_classes_of_rows_without_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(None, a), (7, a + " x"), (None, b), (None, b + " y"), (3, None), (None, "")], "doc_id long, text string")
    r = jaccard_join.near_duplicates(df).collect()
    assert len({(x["class_id"], x["class_hash"]) for x in r}) == 4 and sorted((x["class_id"] or -1, x["n_links"]) for x in r) == [(-1, 0), (-1, 1), (-1, 1), (3, 0), (7, 1), (7, 1)]
    assert sum(x["keeps"] for x in r) == 4


def test_prefixes_are_shortened_to_the_recall():
    depth = jaccard_join.prefix_depth(0.8, jaccard_join.TREES, jaccard_join.DEPTH, jaccard_join.TARGET_RECALL)
    assert 1 - (1 - 0.8**depth) ** jaccard_join.TREES >= jaccard_join.TARGET_RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** jaccard_join.TREES
    assert jaccard_join.prefix_depth(0.2, 2, 6, 0.999) == 1


def test_one_of_each(spark, odd, none):
    docs = spark.createDataFrame(rows_of(near_copies(12, random.Random(3)) + ["", ""], 5), SCHEMA)
    kept = jaccard_join.one_of_each(docs.unionByName(docs))
    want = {c for c, _, _ in linked([(r["doc_id"], r["text"]) for r in docs.collect()]).values()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and kept.columns == docs.columns
    assert jaccard_join.near_duplicates(odd.withColumn("node", F.lit(1))).count() == odd.count()
    assert jaccard_join.near_duplicates(none).count() == 0 and jaccard_join.one_of_each(none).count() == 0


def test_components(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# the pipeline


def test_pipeline_equals_brute_force(spark, small):
    """The classifier's own decisions, and all else by brute force."""
    d = spark.read.parquet(f"{small}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(d, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
    docs = [(i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY 1").fetchall() if i not in toxic]
    docs = [(i, text) for i, (text, n, gone, _) in kept_runs(docs).items() if gone < n]
    classes = linked(docs)
    docs = [(i, t) for i, t in docs if classes[i][0] == i]
    from tests.llm.test_documents import windows_hit

    dirty = {eval(r)[0] for r in windows_hit(docs, duckdb.sql(f"SELECT item_id, text FROM '{small}/benchmark.parquet'").fetchall()) if eval(r)[5]}
    docs = [(i, t) for i, t in docs if i not in dirty]
    source = {r["doc_id"]: r["source"] for r in d.select("doc_id", "source").collect()}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs], "source": [source[i] for i, _ in docs]}))
    want = {r[0]: r[1:] for r in con.sql(mixing.mix_sql()).fetchall() if r[5] > 0}
    got = corpus_pipeline.run(spark, small)
    assert {r["doc_id"]: (r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got.collect()} == want
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: t for i, t in docs if i in want}


def test_stages_take_odd_rows(spark, odd, none, small):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd.withColumn("target", F.lit("x")).withColumn("taken", F.lit(None).cast("int")), none):
            out = stage(spark, docs, small)
            rows = out.collect()
            assert len(rows) <= docs.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_registered_queries(spark, small):
    """One query for each operator; SQL where there is any agrees on the small table."""
    queries = llm_queries()
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries] == list(range(1, 11))
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in llm_oracle_sql().items():
        df, found = queries[name](spark, small), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(found.columns)
        assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, found.select(*[f'"{c}"' for c in columns]).fetchall())), name


def test_decisions_agree_between_forms(spark, small):
    """The filters of the pipeline and the reports they stand for."""
    d, b = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontam.contamination(d, b).where("contaminated").collect()}
    kept = {r["doc_id"] for r in decontam.clean_documents(d, b).collect()}
    assert bad and not bad & kept and len(bad) + len(kept) == d.count()
    assert np.isfinite(len(kept))


def test_checkpoints_drop_their_broadcasts(spark, monkeypatch):
    """Relations of joins that have run don't pile up in the executors, and the plan can still be run."""
    seen, find = [], common.broadcasts_of
    monkeypatch.setattr(common, "broadcasts_of", lambda df: seen.extend(found := find(df)) or found)
    few = spark.createDataFrame([(k, f"x{k}") for k in range(10)], "k long, name string")
    rows = spark.range(1000).withColumn("k", F.col("id") % 10).join(F.broadcast(few), "k").groupBy("name").count().join(F.broadcast(few), "name")
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            out = common.checkpointed(rows)
            assert len(seen) == 2 and not any(b.isValid() for b in seen)
            assert sorted(out.collect()) == sorted(rows.collect()) and out.count() == 10
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        seen.clear()


def test_workers_give_memory_back():
    """What a task has freed goes back to the system at its end, also between pieces that stay."""
    anonymous = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024  # noqa: E731, SIM115
    pins = []

    def run(batches):
        held = []
        for b in batches:
            for _ in range(1000):
                held.append(b"x" * 100_000)
                pins.append(b"y" * 1000)
            yield b

    before = anonymous()
    out = common.lean(run)(iter([1, 2]))
    assert [next(out), next(out)] == [1, 2] and anonymous() > before + 150
    assert list(out) == [] and anonymous() < before + 50
