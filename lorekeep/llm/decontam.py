"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is the run of documents that a task holds at a time, as word hashes. Its suffix array lists, in
order, the suffixes that begin with a word pair of the benchmark (no other can match a window). Every
benchmark window, that is every item suffix cut to a fixed number of words, is binary-searched in it for
its places. For each document and item that meet, the longest verbatim match and its place follow from there.

The benchmark is cut into blocks by tasks, which write them to the shared folder; a task that searches opens
one block at a time. So neither the driver nor a worker holds the benchmark, whatever its size.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import U64, byte_texts, filter_texts, map_file, map_texts, mix64, new_folder, pack, pieces, put_bytes, runs_of, unpack
from lorekeep.session import workers_import

WINDOW = 13
#: Bytes of benchmark text that a block is meant to hold (some 40 times that in a file that workers map).
BLOCK_BYTES = 2 << 20
#: A contaminated document has at least this share of its words hit.
SHARE_DIVISOR = 20
#: Words, and bytes of words, whose hashes a worker keeps at most.
WORDS_HELD, WORD_BYTES_HELD = 500_000, 32 << 20

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8."""
    return WORDS.findall(text.lower())


class WordHashes(dict):
    """64-bit hashes of words, none of them 0; kept up to a bound."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word)
        h = self[word] = xxhash.xxh3_64_intdigest(word) or 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), U64, len(words))
        if len(self) > WORDS_HELD or self.held > WORD_BYTES_HELD:
            self.clear()
            self.held = 0
        return out


class Block:
    """Part of the benchmark: its items' words, and their windows as sorted distinct rows of word hashes."""

    def __init__(self, arrays: dict[str, np.ndarray], window: int):
        self.arrays = arrays
        #: Windows in lexical order; zeros end the short ones.
        self.suffixes = arrays["windows"].reshape(-1, window)
        self.lengths = arrays["lengths"]
        self.pairs, self.single = arrays["pairs"], arrays["single"]

    @staticmethod
    def build(items: list[tuple[str | None, bytes]], window: int) -> bytes:
        hashes, rows, lengths, item_of, words = WordHashes(), [], [], [], []
        for k, (_, text) in enumerate(items):
            w = hashes.of(words_of(text))
            words.append(w)
            n = min(window, len(w))
            if n:
                row = np.zeros((len(w) - n + 1, window), U64)
                row[:, :n] = np.lib.stride_tricks.sliding_window_view(w, n)
                rows.append(row)
                lengths.append(np.full(len(row), n))
                item_of.append(np.full(len(row), k))
        every = np.concatenate(rows) if rows else np.zeros((0, window), U64)
        length, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lengths, item_of))
        order = np.lexsort((item, *every.T[::-1]))
        every, length, item = every[order], length[order], item[order]
        new = np.r_[np.ones(min(1, len(every)), bool), (every[1:] != every[:-1]).any(1)]
        number = np.cumsum(new) - 1
        keep = np.r_[np.ones(min(1, len(every)), bool), (number[1:] != number[:-1]) | (item[1:] != item[:-1])]
        windows, of = every[new], length[new]
        names = ["" if x is None else x for x, _ in items]
        raw = [x.encode() for x in names]
        return pack({
            "windows": windows.ravel(), "lengths": of, "single": np.unique(windows[of == 1, 0]), "pairs": np.unique(pair_of(windows[of > 1, 0], windows[of > 1, min(1, window - 1)])),
            "window_items": item[keep], "window_at": np.searchsorted(number[keep], np.arange(len(windows) + 1)),
            "words": np.concatenate(words) if words else np.zeros(0, U64), "words_at": np.cumsum([0, *map(len, words)]),
            "names": np.frombuffer(b"".join(raw), np.uint8), "names_at": np.cumsum([0, *map(len, raw)]), "named": np.array([x is not None for x, _ in items], bool),
        })

    def name(self, item: int) -> str | None:
        lo, hi = self.arrays["names_at"][item : item + 2].tolist()
        return bytes(self.arrays["names"][lo:hi]).decode() if self.arrays["named"][item] else None

    def items(self, window: int) -> list[int]:
        lo, hi = self.arrays["window_at"][window : window + 2].tolist()
        return self.arrays["window_items"][lo:hi].tolist()

    def words(self, item: int) -> np.ndarray:
        lo, hi = self.arrays["words_at"][item : item + 2].tolist()
        return self.arrays["words"][lo:hi]


@lru_cache(maxsize=1)
def opened(uri: str, window: int) -> Block:
    return Block(unpack(map_file(uri)), window)


def pair_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One 64-bit value for two neighbouring words."""
    return mix64(first) * U64(0x9E3779B97F4A7C15) + second


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `words` at `starts` in lexical order: (their words to `depth`, zero after a document's end; their starts)."""
    padded = np.concatenate([words, np.zeros(depth, U64)])
    rows = padded[starts[:, None] + np.arange(depth)]
    rows = np.where(np.cumsum(rows == 0, axis=1) > 0, U64(0), rows)
    order = np.lexsort(rows.T[::-1])
    return rows[order], starts[order]


def search(array: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the range of the sorted suffixes that begin with its first `length` words."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(array), np.int64)
    for column in range(queries.shape[1]):  # each word narrows the range by two binary searches
        live = np.flatnonzero((lengths > column) & (lo < hi))
        if not len(live):
            break
        words = array[:, column]
        for side, bound in (("left", lo), ("right", hi)):
            a, b, q = lo[live].copy(), hi[live].copy(), queries[live, column]
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                at = words[np.minimum(mid, len(words) - 1)]
                up = open_ & ((at < q) if side == "left" else (at <= q))
                a = np.where(up, mid + 1, a)
                b = np.where(open_ & ~up, mid, b)
            if side == "left":
                new_lo = a
            else:
                new_hi = a
        lo[live], hi[live] = new_lo, new_hi
    return lo, hi


def window_matches(words: np.ndarray, doc_of: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, window number) of every whole occurrence of a window in the shard."""
    empty = np.empty(0, np.int64)
    if not len(words) or not len(block.suffixes):
        return empty, empty, empty, empty
    starts = empty
    if len(block.pairs):
        pair = pair_of(words[:-1], words[1:])
        at = np.minimum(np.searchsorted(block.pairs, pair), len(block.pairs) - 1)
        starts = np.flatnonzero((block.pairs[at] == pair) & (words[:-1] > 0))
    if len(block.single):
        starts = np.union1d(starts, np.flatnonzero(np.isin(words, block.single)))
    if not len(starts):
        return empty, empty, empty, empty
    array, places = suffix_array(words, starts, block.suffixes.shape[1])
    lo, hi = search(array, block.suffixes, block.lengths)
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    index = np.repeat(lo[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    window = np.repeat(found, count)
    s = places[index]
    return s, s + block.lengths[window], doc_of[s], window


def longest_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(start in the item, start in the words, length) of the longest run of words that both hold; of equals the first.

    By bisection over the length, comparing hashes of all runs of a length; a run's hash is made of those of
    the two runs, a power of two long, that cover it.
    """
    layers = [(mix64(item), mix64(words))]

    def common(length: int):
        k = length.bit_length() - 1
        while len(layers) <= k:
            step = 1 << (len(layers) - 1)
            layers.append(tuple(mix64(x[:-step]) * U64(3) + mix64(x[step:] ^ U64(step)) if len(x) > step else x[:0] for x in layers[-1]))
        shift = length - (1 << k)
        a, b = (pair_of(x[: len(y) - length + 1], x[shift : shift + len(y) - length + 1]) for x, y in zip(layers[k], (item, words), strict=True))
        hit = np.flatnonzero(np.isin(b, a))
        return None if not len(hit) else (int(np.flatnonzero(a == b[hit[0]])[0]), int(hit[0]), length)

    best, lo, hi = (0, 0, 0), 1, min(len(item), len(words))
    while lo <= hi:
        mid = (lo + hi) // 2
        found = common(mid)
        if found:
            best, lo = found, mid + 1
        else:
            hi = mid - 1
    return best


def write_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, limit: int = BLOCK_BYTES) -> list[str]:
    """The benchmark in blocks of some `limit` bytes of text, written by tasks; their places."""
    spark = benchmark.sparkSession
    workers_import(spark)
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return []
    folder, n = new_folder(spark, "benchmark"), -(-size // limit)

    def write(batches):
        for b in batches:
            block, items, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2))
            yield from zip(block, items, texts, strict=True)

    def save(batches):
        now, held = None, []
        for block, item, text in write(batches):
            if held and block != now:
                yield done(now, held)
                held = []
            now = block
            held.append((item, text))
        if held:
            yield done(now, held)

    def done(block, items):
        put_bytes(f"{folder}/block-{block}", Block.build(items, window))
        return pa.record_batch([pa.array([block], pa.int64())], names=["block"])

    dealt = rows.select(F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("block"), "item", "text").repartition(n, "block").sortWithinPartitions("block")
    return [f"{folder}/block-{r['block']}" for r in dealt.mapInArrow(save, "block long").orderBy("block").collect()]


def judged(texts: list[bytes], blocks: list[str], window: int, hashes: WordHashes, matches: bool = True):
    """(words, hit words, hit runs, items with occurring windows, longest matches) of each text."""
    n_words, hits, spans, names, longest = [0] * len(texts), [0] * len(texts), [[] for _ in texts], [set() for _ in texts], [[] for _ in texts]
    for lo, hi in pieces(texts):
        words = [hashes.of(words_of(t)) for t in texts[lo:hi]]
        sizes = np.array([len(w) for w in words])
        n_words[lo:hi] = sizes.tolist()
        # a zero between documents keeps matches inside them
        begin = np.cumsum([0, *(sizes + 1)])
        shard = np.zeros(begin[-1], U64)
        shard[np.arange(sizes.sum()) + np.repeat(np.arange(len(words)), sizes)] = np.concatenate(words)
        doc_of = np.repeat(np.arange(lo, hi), sizes + 1)
        found = []
        for uri in blocks:
            block = opened(uri, window)
            s, e, d, window_no = window_matches(shard, doc_of, block)
            met: dict[int, set[int]] = {}
            for doc, number in set(zip(d.tolist(), window_no.tolist(), strict=True)):
                met.setdefault(doc, set()).update(block.items(number))
            for doc, items in met.items():
                for item in items:
                    name = block.name(item)
                    if name is not None:
                        names[doc].add(name)
                    if matches:
                        longest[doc].append((name, *longest_match(block.words(item), words[doc - lo])))
            found.append((s, e))
        if found:
            s, e = runs_of(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            for a, b, doc in zip(s.tolist(), e.tolist(), doc_of[s].tolist() if len(s) else [], strict=True):
                hits[doc] += b - a
                spans[doc].append([a - int(begin[doc - lo]), b - a])
    return n_words, hits, spans, names, longest


def is_contaminated(hit: int, words: int) -> bool:
    return hit > 0 and SHARE_DIVISOR * hit >= words


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and matches, for every document.

    A window is `window` consecutive words of an item (all its words, if fewer; none if it has none). A
    document word inside any occurrence of a window is hit; spans lists the hit runs as [first word,
    length]. contaminated: some word is hit and at least one in twenty. items_sha256 is over the ids of
    the items with occurring windows, as sorted distinct strings joined by commas; items without an id hit
    words but aren't listed there. matches: for each such item the longest run of words it shares with the
    document, and where it begins in both (of equal runs the first). Null texts have no words; an empty benchmark hits
    nothing; rows that repeat are judged each by itself; other columns are not read. Narrow over docs.
    """
    blocks = write_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    held: dict[int, WordHashes] = {}

    def run(ids, texts, batch):
        n_words, hits, spans, names, longest = judged(texts, blocks, window, held.setdefault(0, WordHashes()))
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
        found = [sorted(({"item": i, "item_word": a, "word": b, "length": n} for i, a, b, n in x), key=lambda m: (m["word"], m["item"] or "")) for x in longest]
        return pa.record_batch(
            [ids, pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digest), pa.array(list(map(is_contaminated, hits, n_words)), pa.bool_()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())])))],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "matches"],
        )

    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs, run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>, matches array<struct<item:string,item_word:long,word:long,length:long>>", id_col, text_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without those that contamination() calls contaminated. Narrow; the same rules for odd rows."""
    blocks = write_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    held: dict[int, WordHashes] = {}

    def keep(texts):
        n_words, hits, *_ = judged(texts, blocks, window, held.setdefault(0, WordHashes()), matches=False)
        return [not is_contaminated(h, n) for h, n in zip(hits, n_words, strict=True)]

    return filter_texts(docs, keep, text_col)


def contamination_sql(docs: str = "documents", benchmark: str = "benchmark", window: int = WINDOW) -> str:
    """DuckDB SQL for contamination() without spans and matches, over relations with distinct doc_id and no null item_id, by joining all windows."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM {docs}),
items AS (SELECT item_id, w, least({window}, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM {benchmark})),
wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items WHERE n > 0)),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wanted))),
met AS (SELECT doc_id, i, n, item_id FROM windows JOIN wanted USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM met, range({window}) AS r(k) WHERE k < n GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE_DIVISOR} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
