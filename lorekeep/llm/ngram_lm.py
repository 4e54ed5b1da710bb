"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

Level 1 is the vocabulary: word hashes as one monotone sequence, and prefix sums of exact counts as another.
Level 2 holds, for each context word, its followers: contexts, monotone pointers to their first followers,
and the followers as one monotone sequence relative to their context. Level 3 holds the followers of each
pair of level 2 in the same way: a pair's place is its context. All are Elias-Fano coded, with 16-bit
quantised probabilities. Levels are written in shards to the shared folder and memory-mapped by the tasks
that score; a triple lies in the shard of its first pair, so one shard answers a search down the trie.

P(w | u v) = max(c(u v w) - D, 0) / c(u v) + D * followers(u v) / c(u v) * P(w | v), and so on down to
P(w) = (c(w) + 1) / (N + V + 1), an unseen word being the one beyond the V known. A context that was never
met leaves the shorter one's probability.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import U64, fold, map_file, map_texts, mix64, new_folder, pack, pieces, put_bytes, unpack
from lorekeep.llm.elias_fano import EliasFano

ORDER = 3
DISCOUNT = 0.75
FOLDS, HELD_OUT = 7, 2
#: Steps of a quantised probability in one power of ten; probabilities are rounded down.
QUANTA = 4096
#: What the quantised values stand for.
LEVELS = 10.0 ** (-np.arange(1 << 16) / QUANTA)
#: Training tokens for each shard of levels 2 and 3; a context with more than a quarter of that is spread by its followers.
SHARD_TOKENS = 1_500_000
#: Counted entries that a task gathers before it hands them on.
HELD_ENTRIES = 1_500_000
#: Bytes of text that are hashed at a time; a word may go on in the next ones.
HASHED_BYTES = 1 << 16

#: A word's hash is a polynomial in a base, of values of its bytes: the same for A-Z as for a-z, and 0 for white space.
_BASE = 0x5851F42D4C957F2D
_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_VALUES[65:91] = _VALUES[97:123]
_VALUES[[32, *range(9, 14)]] = 0
#: Powers of the base from the first up, and their inverses modulo 2**64.
_POWERS, _INVERSES = (np.cumprod(np.full(HASHED_BYTES, b, U64), dtype=U64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
#: What stands for the end of a text.
END = 0xE2D0F7E87E15EA5D


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, between ASCII white space and with A-Z lower-cased, and then its end; and where the ends are."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    # the text begins as if after a space, and ends with one
    space = np.ones(len(data) + 1, bool)
    np.logical_or(data == 32, data - np.uint8(9) < 5, out=space[1:])
    border = np.flatnonzero(space[1:] != space[:-1])
    starts, sizes = border[::2], border[1::2] - border[::2]
    words = np.empty(len(starts), U64)
    step = min(HASHED_BYTES, len(_POWERS))
    firsts = np.searchsorted(starts, np.arange(0, len(data) + step, step)).tolist()
    for at, lo, hi in zip(range(0, len(data), step), firsts, firsts[1:], strict=False):
        part = data[at : at + step]
        terms = _VALUES[part] * _POWERS[: len(part)]
        own = starts[lo:hi] - at
        if lo:  # the rest of the word before; nothing, if it has ended
            rest = int(terms[: own[0] if len(own) else None].sum())
            words[lo - 1 : lo] += U64(rest * pow(_BASE, at - int(starts[lo - 1]) - 1, 1 << 64) % (1 << 64))
        if len(own):
            words[lo:hi] = np.add.reduceat(terms, own) * _INVERSES[own]
    words = mix64(words + sizes.astype(U64))
    # an end after the words of each text
    texts_at = np.cumsum([len(t) + 1 for t in texts])
    ends = np.searchsorted(starts, texts_at) + np.arange(len(texts))
    out = np.full(len(words) + len(texts), END, U64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = words
    return out, ends


def hash_of(word: bytes) -> int:
    return int(token_hashes([word])[0][0])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, which of them each key is). Unlike np.unique, of equal keys any one's place will do."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(-np.log10(np.maximum(p, 1e-30)) * QUANTA), 65535).astype(np.uint16)


Keys = tuple[np.ndarray, ...]


def squeeze(keys: Keys, counts: np.ndarray) -> bytes:
    """Keys in order, the first as differences, and counts, by byte planes, compressed."""
    columns = [np.diff(keys[0], prepend=U64(0)), *keys[1:], counts.astype(U64)]
    planes = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T for c in columns])
    return len(counts).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes) -> tuple[Keys, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8).reshape(-1, 8, n)
    columns = [np.ascontiguousarray(p.T).view(U64).ravel() for p in planes]
    return (np.cumsum(columns[0], dtype=U64), *columns[1:-1]), columns[-1]


def summed(parts: list[tuple[Keys, np.ndarray]]) -> tuple[Keys, np.ndarray]:
    """Distinct keys of all parts in order, with the sums of their counts. A second key is below 2**33."""
    keys, counts = tuple(map(np.concatenate, zip(*[k for k, _ in parts], strict=True))), np.concatenate([c for _, c in parts])
    if not len(counts):
        return keys, counts
    order = np.argsort(keys[0], kind="stable")  # the parts are in order, which this sort makes use of
    first = keys[0][order]
    new = np.r_[True, first[1:] != first[:-1]]
    if len(keys) == 2:
        both = (np.cumsum(new) - 1).astype(U64) << U64(33) | keys[1][order]
        again = np.argsort(both)
        order, both = order[again], both[again]
        new = np.r_[True, both[1:] != both[:-1]]
    at = np.flatnonzero(new)
    return tuple(k[order[at]] for k in keys), np.add.reduceat(counts[order], at)


class Gathered:
    """Counts of keys, kept merged, and handed on by shard when there are many. shard_of(keys) -> shards."""

    def __init__(self, shard_of):
        self.shard_of, self.parts, self.size = shard_of, [], 0

    def add(self, keys: Keys, counts: np.ndarray):
        """Keys in order."""
        self.parts.append((keys, counts))
        self.size += len(counts)
        if self.size > HELD_ENTRIES:
            self.parts = [summed(self.parts)]
            self.size = len(self.parts[0][1])
            if self.size > HELD_ENTRIES // 2:
                yield from self.out()

    def out(self):
        if not self.size:
            return
        keys, c = self.parts[0] if len(self.parts) == 1 else summed(self.parts)
        self.parts, self.size = [], 0
        for s, idx in groups_of(self.shard_of(keys)):
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([squeeze(tuple(k[idx] for k in keys), c[idx])], pa.binary())], names=["shard", "counts"])


def by_shard(rows: DataFrame, n: int, build, schema: str) -> DataFrame:
    """build(shard, merged keys, counts) for each shard of rows (shard, counts); one shard at a time in a task."""

    def run(batches):
        shard, parts = None, []

        def close():
            if parts:
                yield build(shard, *summed(parts))

        for b in batches:
            for s, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if s != shard:
                    yield from close()
                    shard, parts = s, []
                parts.append(unsqueeze(data.as_py()))
                if len(parts) > 16:
                    parts = [summed(parts)]
        yield from close()

    return rows.repartitionById(n, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def groups_of(labels: np.ndarray):
    """(label, places with it, in order) for each distinct label."""
    if len(labels):
        # 16-bit labels are sorted by counting
        small = labels.min() >= -(1 << 15) and labels.max() < 1 << 15
        order = np.argsort(labels.astype(np.int16) if small else labels, kind="stable")
        at = np.flatnonzero(np.diff(labels[order], prepend=labels[order[0]])) if len(labels) > 1 else np.zeros(0, np.int64)
        for q in np.split(order, at):
            yield int(labels[q[0]]), q


class Level:
    """The sequences and arrays of a file, opened when first asked for."""

    def __init__(self, uri: str):
        self.arrays, self.opened = unpack(map_file(uri)), {}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def sequence(self, name: str) -> EliasFano:
        if name not in self.opened:
            self.opened[name] = EliasFano.of(self.arrays, name)
        return self.opened[name]


@lru_cache(maxsize=4096)
def opened(uri: str) -> Level:
    return Level(uri)


class Vocabulary:
    """Level 1: shards of word hashes, with counts. A word's number is its place over all shards."""

    def __init__(self, folder: str, shard_bits: int, sizes: dict[int, int], total: int):
        self.folder, self.shard_bits, self.total = folder, shard_bits, total
        n = [sizes.get(s, 0) for s in range(1 << shard_bits)]
        self.first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.size = int(self.first[-1])

    @staticmethod
    def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
        return (hashes >> U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)

    @staticmethod
    def save(folder: str, shard: int, bits: int, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Within a shard all hashes begin with its number, so the rest of each is kept; counts as their running sums."""
        rest, sums = hashes & U64((1 << (64 - bits)) - 1), np.concatenate([[0], np.cumsum(counts)]).astype(U64)
        put_bytes(f"{folder}/words-{shard}", pack(EliasFano.build(rest, 1 << (64 - bits)).arrays("hash") | EliasFano.build(sums, int(sums[-1]) + 1).arrays("sums")))

    def _counts(self, level: Level, at: np.ndarray) -> np.ndarray:
        sums = level.sequence("sums")
        return (sums.get(at + 1) - sums.get(at)).astype(np.int64)

    def lookup(self, hashes: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts); -1 and 0 of a word that isn't there. Not counted: all counts are 0."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s, q in groups_of(self.shard_of(hashes, self.shard_bits)):
            if self.first[s + 1] == self.first[s]:
                continue
            level = opened(f"{self.folder}/words-{s}")
            at = level.sequence("hash").find(hashes[q] & U64((1 << (64 - self.shard_bits)) - 1))
            q, at = q[at >= 0], at[at >= 0]
            number[q] = self.first[s] + at
            if counted:
                count[q] = self._counts(level, at)
        return number, count

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for s, q in groups_of(np.searchsorted(self.first, numbers, side="right") - 1):
            out[q] = self._counts(opened(f"{self.folder}/words-{s}"), numbers[q] - self.first[s])
        return out


class Trie:
    """Levels 2 and 3 over a vocabulary, in shards. hot: numbers and counts of the words that are spread as contexts."""

    def __init__(self, vocabulary: Vocabulary, starts: int, shards: int, discount: float, hot: dict[int, int]):
        self.vocabulary, self.starts, self.shards, self.discount = vocabulary, starts, shards, discount
        self.width = vocabulary.size + 1  # the number beyond the words is the start of a text
        self.spread_from = max(1, SHARD_TOKENS // 4)
        if starts > self.spread_from:
            hot = hot | {self.width - 1: starts}
        self.hot = np.array(sorted(hot), np.int64)
        self.hot_counts = np.array([hot[x] for x in sorted(hot)], np.int64)
        #: Followers of the hot contexts over all shards.
        self.fan = np.zeros(len(self.hot), np.int64)
        self.present: set[int] = set()
        if self.width >= 1 << 32:
            raise ValueError("a vocabulary of 2**32 words or more needs wider keys")

    def hot_place(self, contexts: np.ndarray) -> np.ndarray:
        """Which hot context each is, or -1."""
        if not len(self.hot):
            return np.full(len(contexts), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
        return np.where(self.hot[at] == contexts, at, -1)

    def shard_of(self, contexts: np.ndarray, followers: np.ndarray) -> np.ndarray:
        """A frequent context goes to as many shards as its count asks for."""
        salt = np.zeros(len(contexts), U64)
        at = self.hot_place(contexts)
        q = np.flatnonzero(at >= 0)
        salts = (-(-self.hot_counts[at[q]] // self.spread_from)).astype(U64)
        salt[q] = mix64(followers[q].astype(U64) + U64(1)) % salts
        return (mix64(contexts.astype(U64) * U64(0x9E3779B97F4A7C15) + salt) % U64(self.shards)).astype(np.int32)

    def build(self, shard: int, keys: Keys, counts: np.ndarray) -> tuple[bytes, dict[int, int]]:
        """A shard's file, and how many followers its hot contexts have there. keys: (pair, next word, the width itself if none)."""
        width = U64(self.width)
        pair, word = keys
        at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])  # where each pair's triples begin
        pairs, of_pair = pair[at], np.add.reduceat(counts, at).astype(float)
        context, follower = (pairs // width).astype(np.int64), pairs % width
        begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        contexts = context[begin]
        own = np.full(len(contexts), self.starts, np.int64)
        own[contexts < self.width - 1] = self.vocabulary.counts(contexts[contexts < self.width - 1])
        rank = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(pairs)]))
        some = word < width
        place = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(pair)]))[some]
        fan = np.bincount(place, minlength=len(at))
        data = pack(
            EliasFano.build(contexts.astype(U64), self.width + 1).arrays("contexts")
            | EliasFano.build(np.r_[begin, len(pairs)].astype(U64), len(pairs) + 1).arrays("pointers2")
            | EliasFano.build(rank.astype(U64) * width + follower, len(begin) * self.width).arrays("followers2")
            | EliasFano.build(np.r_[0, np.cumsum(fan)].astype(U64), len(place) + 1).arrays("pointers3")
            | EliasFano.build(place.astype(U64) * width + word[some], len(at) * self.width).arrays("followers3")
            | {"p2": quantised((of_pair - self.discount) / own[rank]), "rest3": quantised(self.discount * fan / of_pair), "p3": quantised((counts[some].astype(float) - self.discount) / of_pair[place])}
        )
        spread = np.flatnonzero(self.hot_place(contexts) >= 0)
        return data, dict(zip(contexts[spread].tolist(), np.diff(np.r_[begin, len(pairs)])[spread].tolist(), strict=True))

    def pairs(self, contexts: np.ndarray, followers: np.ndarray, own: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(P(follower | context), shard, place or -1, what is left to shorter contexts after the pair) of pairs in order of context.

        own: counts of the contexts, above 0; base: P(follower); a follower may be -1.
        """
        n = len(contexts)
        seen, fan, place, rest = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.ones(n)
        shards = self.shard_of(contexts, followers)
        for s, q in groups_of(shards):
            if s not in self.present:
                continue
            level = opened(f"{self.vocabulary.folder}/grams-{s}")
            new = np.r_[True, contexts[q[1:]] != contexts[q[:-1]]]
            rank = level.sequence("contexts").find(contexts[q[new]])
            safe, pointers = np.maximum(rank, 0), level.sequence("pointers2")
            lo, hi = pointers.get(safe).astype(np.int64), pointers.get(safe + 1).astype(np.int64)
            hi = np.where(rank >= 0, hi, lo)
            back = np.cumsum(new) - 1
            fan[q] = (hi - lo)[back]
            k = np.flatnonzero((followers[q] >= 0) & (rank[back] >= 0))
            at = level.sequence("followers2").find(rank[back[k]].astype(U64) * U64(self.width) + followers[q[k]].astype(U64), lo[back[k]], hi[back[k]])
            hit = q[k[at >= 0]]
            place[hit] = at = at[at >= 0]
            seen[hit], rest[hit] = LEVELS[level["p2"][at]], LEVELS[level["rest3"][at]]
        at = self.hot_place(contexts)
        fan = np.where(at >= 0, self.fan[np.maximum(at, 0)], fan) if len(self.hot) else fan
        return seen + self.discount * fan / own * base, shards, place, rest

    def thirds(self, shards: np.ndarray, places: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The discounted share of each word after the pair at a place of a shard; 0 if it never followed. Places come in order within a shard."""
        seen = np.zeros(len(places))
        for s, q in groups_of(np.where(words >= 0, shards, -1)):
            if s < 0:
                continue
            level = opened(f"{self.vocabulary.folder}/grams-{s}")
            new = np.r_[True, places[q[1:]] != places[q[:-1]]]
            pointers, of = level.sequence("pointers3"), places[q[new]]
            lo, hi = pointers.get(of).astype(np.int64), pointers.get(of + 1).astype(np.int64)
            back = np.cumsum(new) - 1
            at = level.sequence("followers3").find(places[q].astype(U64) * U64(self.width) + words[q].astype(U64), lo[back], hi[back])
            seen[q[at >= 0]] = LEVELS[level["p3"][at[at >= 0]]]
        return seen


def _training(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(fold(F.col(f"`{id_col}`"), FOLDS) != HELD_OUT).select(F.lit(0).cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))


def _gather(rows: DataFrame, make, schema: str = "shard int, counts binary") -> DataFrame:
    """mapInArrow with make() -> (take(texts) -> batches, end() -> batches) for each task."""
    from lorekeep.llm.common import byte_texts

    def run(batches):
        take, end = make()
        for b in batches:
            texts = byte_texts(b.column(1))
            for lo, hi in pieces(texts):
                yield from take(texts[lo:hi])
        yield from end()

    return rows.mapInArrow(run, schema)


def _rows(shard: int, values: dict[int, int], first: tuple[int, int], names: list[str]) -> pa.RecordBatch:
    """Rows of a shard's report: `first`, then what is known of each of some numbers."""
    return pa.record_batch([pa.array([shard] * (len(values) + 1), pa.int32()), pa.array([first[0], *values], pa.int64()), pa.array([first[1], *values.values()], pa.int64())], names=names)


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT) -> Trie:
    """Counts all training texts, and writes the trie's levels to the shared folder.

    What comes to the driver is one row for each shard, and one for each very frequent context of a shard.
    """
    from lorekeep.session import workers_import

    spark = docs.sparkSession
    workers_import(spark)
    folder = new_folder(spark, "trie")
    training = _training(docs, id_col, text_col)
    n_out = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(n_out, docs.rdd.getNumPartitions(), 2).bit_length()
    hot_from = max(1, SHARD_TOKENS // 4)

    def words():
        gathered = Gathered(lambda keys: Vocabulary.shard_of(keys[0], bits))

        def take(texts):
            h, n = np.unique(token_hashes(texts)[0], return_counts=True)
            yield from gathered.add((h,), n.astype(U64))

        return take, gathered.out

    def save_words(shard, keys, counts):
        Vocabulary.save(folder, shard, bits, keys[0], counts)
        # places in the shard are below their number
        frequent = np.flatnonzero(counts > U64(hot_from))
        return _rows(shard, dict(zip(frequent.tolist(), counts[frequent].tolist(), strict=True)), (-len(counts) - 1, int(counts.sum())), ["shard", "n", "total"])

    got = by_shard(_gather(training, words), max(n_out, 1 << bits), save_words, "shard int, n long, total long").collect()
    vocabulary = Vocabulary(folder, bits, {r["shard"]: -r["n"] - 1 for r in got if r["n"] < 0}, sum(r["total"] for r in got if r["n"] < 0))
    hot = {int(vocabulary.first[r["shard"]]) + r["n"]: r["total"] for r in got if r["n"] >= 0}
    end_count = int(vocabulary.lookup(np.array([END], U64))[1][0]) if vocabulary.size else 0
    trie = Trie(vocabulary, end_count, max(1, -(-vocabulary.total // SHARD_TOKENS)), discount, hot)
    shared = spark.sparkContext.broadcast(trie)

    def grams():
        t = shared.value
        width = U64(t.width)
        gathered = Gathered(lambda keys: t.shard_of((keys[0] // width).astype(np.int64), (keys[0] % width).astype(np.int64)))

        def take(texts):
            context, follower, _, ends = sequences(texts, t)
            pair = context.astype(U64) * width + follower.astype(U64)
            after = np.append(follower[1:], 0).astype(U64)
            after[ends] = width  # nothing follows the end of a text
            some, _, number = distinct(pair)
            both, n = np.unique(number.astype(U64) << U64(33) | after, return_counts=True)
            yield from gathered.add((some[(both >> U64(33)).astype(np.int64)], both & U64((1 << 33) - 1)), n.astype(U64))

        return take, gathered.out

    def save_grams(shard, keys, counts):
        t = shared.value
        data, spread = t.build(shard, keys, counts)
        put_bytes(f"{t.vocabulary.folder}/grams-{shard}", data)
        return _rows(shard, spread, (-1, len(counts)), ["shard", "context", "n"])

    for r in by_shard(_gather(training, grams), max(n_out, trie.shards), save_grams, "shard int, context long, n long").collect():
        if r["context"] < 0:
            trie.present.add(r["shard"])
        else:
            trie.fan[trie.hot_place(np.array([r["context"]]))[0]] += r["n"]
    return trie


def sequences(texts: list[bytes], t: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the contexts, of the tokens, the tokens' counts) of all tokens, and where texts end; -1 is a word the vocabulary lacks."""
    hashes, ends = token_hashes(texts)
    different, _, back = distinct(hashes)
    number, count = t.vocabulary.lookup(different)
    follower = number[back]
    context = np.empty_like(follower)
    context[1:] = follower[:-1]
    context[np.append(0, ends[:-1] + 1)] = t.width - 1
    return context, follower, count[back], ends


def log_scores(texts: list[bytes], t: Trie, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known tokens, base score, score) of each text."""
    v = t.vocabulary
    context, follower, c, ends = sequences(texts, t)
    p = (c + 1.0) / (v.total + v.size + 1)
    full = p.copy()
    own = np.empty_like(c)  # how often the context occurs in training
    own[1:] = c[:-1]
    own[np.append(0, ends[:-1] + 1)] = t.starts
    met = np.flatnonzero((context >= 0) & (own > 0))
    key = context[met].astype(U64) * U64(t.width + 1) + (follower[met] + 1).astype(U64)
    _, first, back = distinct(key)
    if len(first):
        p2, shard, place, rest = t.pairs(context[met][first], follower[met][first], own[met][first], p[met][first])
        full[met] = p2[back]
        if order > 2:
            pair = np.full(len(p), -1, np.int64)
            pair[met] = back
            before = np.empty_like(pair)
            before[1:] = pair[:-1]
            before[np.append(0, ends[:-1] + 1)] = -1
            deep = np.flatnonzero((before >= 0) & (pair >= 0))
            deep = deep[place[before[deep]] >= 0]
            # pairs are in order of context and follower, so triples of a shard are in order of place
            triples, _, back = distinct(before[deep].astype(U64) << U64(32) | pair[deep].astype(U64))
            if len(triples):
                a, b = (triples >> U64(32)).astype(np.int64), (triples & U64(0xFFFFFFFF)).astype(np.int64)
                full[deep] = (t.thirds(shard[a], place[a], follower[met][first][b]) + rest[a] * p2[b])[back]
    at = np.append(0, ends[:-1] + 1)
    return ends - at + 1, np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(np.log10(p), at), np.add.reduceat(np.log10(full), at)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Trained on the texts of the folds that aren't held out. order: 2 or 3, the words of the longest n-gram
    that is looked up. Null texts are empty: one token, the end. An empty training set leaves P(w) = 1 for
    any word. Null ids fall in the fold of the empty text; rows that repeat count, and are scored, each by
    itself; other columns are not read.
    """
    if order not in (2, 3):
        raise ValueError("the trie has levels for an order of 2 or 3")
    trie = trained(docs, id_col, text_col, discount)
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def run(ids, texts, batch):
        t = shared.value
        parts = [log_scores(texts[lo:hi], t, order) for lo, hi in pieces(texts)]
        n, n_known, base, score = map(np.concatenate, zip(*parts, strict=True))
        total = np.full(len(texts), t.vocabulary.total, np.int64)
        return pa.record_batch([ids, batch.column(2), pa.array(n), pa.array(n_known), pa.array(total), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), (fold(F.col(f"`{id_col}`"), FOLDS) == HELD_OUT).alias("held_out"))
    return map_texts(rows, run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", "id", "text", ["held_out"])
