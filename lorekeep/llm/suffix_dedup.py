"""Exact removal of repeated byte strings, with a sparse suffix array over range-partitioned buckets.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.

Every window of `length` bytes is owned by one sampled position in it: the leftmost least hash of the
cores (strings of `core` bytes) inside. Equal windows are owned at equal offsets, so only suffixes at the
sampled positions are sorted, and only where the core occurs more than once.

1. Core hashes are counted (pre-aggregated in each task); those met twice are kept in the shared folder.
2. Suffixes at such positions go to buckets between splitters sampled from the suffixes. Ties are broken
   by a hash of their place, so even a suffix that a third of all texts hold is spread over buckets.
3. A bucket sorts its suffixes, and the reversed texts before them, by multikey quicksort; common prefix
   lengths of neighbours give, for each offset, which windows are equal.
4. Only a core that a splitter begins with can lie on both sides of it: its windows are compared across
   buckets by their 128-bit hashes.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import U64, byte_texts, checkpointed, map_texts, mix64, new_folder, runs_of
from lorekeep.llm.ngram_lm import Gathered, Vocabulary, by_shard

LENGTH, CORE = 200, 64
#: Suffixes that a bucket is meant to hold.
BUCKET_SUFFIXES = 40_000
#: Suffixes of the sample that splitters are taken from, for each bucket, and of the whole sample at most
#: (each some 250 bytes on the driver). Splitters only deal suffixes out; a coarser sample changes no result.
SAMPLE_PER_BUCKET, SAMPLE_MOST = 60, 200_000
#: Of large tables, one row in so many is looked through for the splitters' sample; copies are drawn each by itself.
SAMPLE_ROWS_EVERY = 16
#: Bytes of text that a worker takes at a time; longer texts are taken in parts that share `length` - 1 bytes.
SEGMENT_BYTES = 2 << 20
#: Suffixes in an Arrow batch.
BATCH_ROWS = 10_000
#: A text with a repeated sampled position in so many bytes is periodic: its own repeats are found first.
CROWDED = 16
#: Below this many suffixes a part is left to the library's sort.
SMALL = 48

BASE = U64(0x5851F42D4C957F2D)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each `width` neighbouring values."""
    out, done = values, 1
    while done * 2 <= width:
        out = pick(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def segments(texts: list[bytes], length: int, limit: int | None = None):
    """(text number and offset of each part, the parts): texts together, or parts of one long text, of some SEGMENT_BYTES.

    The parts of a text overlap by `length` - 1 bytes, so each window lies in one part, and in one alone.
    """
    limit = limit or SEGMENT_BYTES
    members, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), limit):
            part = t[at : at + limit + length - 1] if len(t) > limit else t
            if parts and size + len(part) > limit:
                yield members, parts
                members, parts, size = [], [], 0
            members.append((i, at))
            parts.append(part)
            size += len(part)
            if part is t:
                break
    if parts:
        yield members, parts


class Sampler:
    """Sampled positions of texts, each with the window starts it owns."""

    def __init__(self, length: int = LENGTH, core: int = CORE):
        if core & (core - 1) or not core <= length:
            raise ValueError("core is a power of two, and at most length")
        self.length, self.core, self.cores = length, core, length - core + 1

    def of(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all texts joined, their starts, core hashes, positions, first and last owned window start) in joined bytes."""
        data = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        none = np.zeros(0, np.int64)
        if len(data) < self.length:
            return data, starts, np.zeros(0, U64), none, none, none
        h = np.frombuffer(data, np.uint8).astype(U64) + U64(1)
        done, factor = 1, int(BASE)
        while done < self.core:
            h = h[: len(h) - done] * U64(factor) + h[done:]
            factor = factor * factor % (1 << 64)
            done *= 2
        h = mix64(h) | U64(1)
        least = _sliding(h, self.cores, np.minimum)  # for each window start of the joined bytes
        valid = np.zeros(len(least) + 1, np.int8)
        long = sizes >= self.length
        np.add.at(valid, starts[long], 1)
        np.add.at(valid, (starts + sizes - self.length + 1)[long], -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
        least = np.where(valid, least, U64(0))
        pad = np.zeros(self.cores - 1, U64)
        owned = _sliding(np.concatenate([pad, least, pad]), self.cores, np.maximum)
        places = np.flatnonzero(owned[: len(h)] == h)
        if not len(places):
            return data, starts, np.zeros(0, U64), none, none, none
        # runs of window starts with one least value, within one text
        edge = np.r_[True, least[1:] != least[:-1]]
        edge[starts[long & (starts < len(edge))]] = True
        lo = np.flatnonzero(edge)
        hi = np.r_[lo[1:] - 1, len(least) - 1]
        keep = least[lo] > 0
        lo, hi = lo[keep], hi[keep]
        value = least[lo]
        first = np.searchsorted(places, lo)
        hp = h[places]
        while (wrong := hp[first] != value).any():
            first[wrong] += 1
        # equal values follow one another in places: each owns the starts after the one before it
        group_end = np.r_[np.flatnonzero(hp[1:] != hp[:-1]) + 1, len(hp)]
        end = np.maximum(first + 1, np.minimum(group_end[np.searchsorted(group_end, first, side="right")], np.searchsorted(places, hi) + 1))
        n = end - first
        k = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run_first, run_lo, run_hi = np.repeat(first, n), np.repeat(lo, n), np.repeat(hi, n)
        own_lo = np.where(k > run_first, np.maximum(run_lo, places[k - 1] + 1), run_lo)
        own_hi = np.minimum(run_hi, places[k])
        some = own_lo <= own_hi
        k, own_lo, own_hi = k[some], own_lo[some], own_hi[some]
        # least values are small ones; scrambled again, they spread over the shards of counts
        return data, starts, mix64(hp[k]), places[k], own_lo, own_hi


    def first_windows(self, text: bytes, place: np.ndarray, own_lo: np.ndarray, own_hi: np.ndarray):
        """(positions, window starts, covered runs): of the windows that positions own, the first of each content, and the ranges that the text's own repeats cover."""
        n = own_hi - own_lo + 1
        owner = np.repeat(np.arange(len(place)), n)
        start = np.repeat(own_lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(start, kind="stable")
        owner, start = owner[order], start[order]
        content = _window_hashes(text, self.length)[start]
        _, first, back, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        twice = start[count[back] > 1]
        runs = runs_of(twice, twice + self.length)
        return place[owner[first]], start[first], list(zip(runs[0].tolist(), runs[1].tolist(), strict=True))


def _window_hashes(text: bytes, length: int) -> np.ndarray:
    """A 64-bit hash of each `length` bytes of the text."""
    h, done, factor = np.frombuffer(text, np.uint8).astype(U64) + U64(1), 1, int(BASE)
    while done * 2 <= length:
        h = h[: len(h) - done] * U64(factor) + h[done:]
        factor = factor * factor % (1 << 64)
        done *= 2
    # the two stretches of `done` bytes that begin and end a window cover it
    n = len(text) - length + 1
    return mix64(h[:n]) * U64(0x9E3779B97F4A7C15) + mix64(h[length - done : length - done + n] ^ BASE)


def multikey_quicksort(strings: np.ndarray) -> np.ndarray:
    """The order of equally long byte strings (rows of uint8), split three ways on eight bytes at a time."""
    n, width = strings.shape
    padded = np.zeros((n, width + -width % 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(U64)
    out = np.empty(n, np.int64)
    todo = [(np.arange(n), 0, 0)]  # members, word, where they begin in the order
    while todo:
        part, word, at = todo.pop()
        if len(part) == 1 or word == words.shape[1]:
            out[at : at + len(part)] = part
            continue
        if len(part) <= SMALL:
            rows = [padded[i, 8 * word :].tobytes() for i in part]
            out[at : at + len(part)] = part[sorted(range(len(rows)), key=rows.__getitem__)]
            continue
        x = words[part, word]
        pivot = np.sort(x[:: max(1, len(x) // 9)])[len(x[:: max(1, len(x) // 9)]) // 2]
        below, same, above = part[x < pivot], part[x == pivot], part[x > pivot]
        for members, next_word in ((below, word), (same, word + 1), (above, word)):
            if len(members):
                todo.append((members, next_word, at))
                at += len(members)
    return out


def common_prefixes(ordered: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; the first has 0."""
    differ = ordered[1:] != ordered[:-1]
    some = differ.any(1)
    return np.r_[0, np.where(some, differ.argmax(1), ordered.shape[1])] if len(ordered) else np.zeros(0, np.int64)


def equal_windows(right: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray, length: int):
    """Yields, offset by offset, (offset, members that own a window there, a number of its content).

    right: suffixes from the sampled position; left: what stands before it, reversed; both padded. A
    window of offset o is the last o bytes before the position and the first length - o bytes from it.
    """
    by_right, by_left = multikey_quicksort(right), multikey_quicksort(left)
    prefix_right, prefix_left = common_prefixes(right[by_right]), common_prefixes(left[by_left])
    n = len(right)
    class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        members = np.flatnonzero((least <= o) & (o <= most))
        if len(members):
            class_right[by_right] = np.cumsum(prefix_right < length - o)
            class_left[by_left] = np.cumsum(prefix_left < o)
            yield o, members, class_right[members] * (n + 1) + class_left[members]


COVER = "doc_id long, text_hash long, start long, end long"
PLACED = "bucket int, key binary, before binary, least int, most int, doc_id long, text_hash long, place long, covered_to long"


def bucket_key(right: bytes, doc: int | None, text_hash: int, place: int, length: int) -> bytes:
    """What suffixes are ordered by: their bytes, then a hash of their place."""
    return right.ljust(length, b"\0") + xxhash.xxh3_64_digest(b"%d,%d,%d" % (doc or 0, text_hash, place))


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, bucket_suffixes: int = BUCKET_SUFFIXES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, start, end): byte ranges to remove, not yet merged. See without_repeats()."""
    from lorekeep.session import workers_import

    spark = docs.sparkSession
    workers_import(spark)
    folder = new_folder(spark, "suffixes")
    n_out = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(n_out, docs.rdd.getNumPartitions(), 2).bit_length()
    sampler = Sampler(length, core)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash")).where(F.octet_length("text") >= length)

    def counted(batches):
        gathered = Gathered(lambda keys: Vocabulary.shard_of(keys[0], bits))
        for b in batches:
            for _, texts in segments(byte_texts(b.column(1)), length):
                h, n = np.unique(sampler.of(texts)[2], return_counts=True)
                yield from gathered.add((h,), n.astype(U64))
        yield from gathered.out()

    def save(shard, keys, counts):
        twice = counts > 1
        Vocabulary.save(folder, shard, bits, keys[0][twice], counts[twice])
        return pa.record_batch([pa.array([shard], pa.int32()), pa.array([int(twice.sum())], pa.int64()), pa.array([int(counts[twice].sum())], pa.int64())], names=["shard", "n", "total"])

    got = by_shard(d.mapInArrow(counted, "shard int, counts binary"), max(n_out, 1 << bits), save, "shard int, n long, total long").collect()
    cores = Vocabulary(folder, bits, {r["shard"]: r["n"] for r in got}, sum(r["total"] for r in got))
    buckets = max(1, -(-cores.total // bucket_suffixes))
    shared = spark.sparkContext.broadcast(cores)

    def suffixes(batches, every: int = 1):
        """Rows of (key, before, least, most, doc_id, text_hash, place, covered to), at most BATCH_ROWS at a time.

        covered to: null, or the end of a range from `place` that repeats within its own text; such a row holds
        no suffix. every: only one in so many hashes of places, and no ranges.
        """
        for b in batches:
            ids, hashes = b.column(0).to_pylist(), b.column(2).to_pylist()
            for members, texts in segments(byte_texts(b.column(1)), length):
                data, starts, h, place, own_lo, own_hi = sampler.of(texts)
                if not len(h):
                    continue
                u, back = np.unique(h, return_inverse=True)
                keep = np.flatnonzero((shared.value.lookup(u, counted=False)[0] >= 0)[back])
                place, own_lo, own_hi = place[keep], own_lo[keep], own_hi[keep]
                doc = np.searchsorted(starts, place, side="right") - 1
                rows = []
                crowded = np.flatnonzero(np.bincount(doc, minlength=len(texts)) * CROWDED > [len(t) for t in texts])
                for k in crowded.tolist():
                    mine = doc == k
                    p, s, runs = sampler.first_windows(texts[k], place[mine] - starts[k], own_lo[mine] - starts[k], own_hi[mine] - starts[k])
                    place, own_lo, own_hi, doc = (np.r_[x[~mine], y] for x, y in ((place, p + starts[k]), (own_lo, s + starts[k]), (own_hi, s + starts[k]), (doc, np.full(len(p), k))))
                    at, offset = members[k]
                    if every == 1:
                        rows += [(bucket_key(texts[k][a : a + length], ids[at], hashes[at], a + offset, length), b"", 0, 0, ids[at], hashes[at], a + offset, z + offset) for a, z in runs]
                for p, s_lo, s_hi, k in zip(place.tolist(), own_lo.tolist(), own_hi.tolist(), doc.tolist(), strict=True):
                    at, offset = members[k]
                    own = p - int(starts[k]) + offset
                    key = bucket_key(data[p : s_hi + length], ids[at], hashes[at], own, length)
                    if every == 1 or int.from_bytes(key[-8:], "big") % every == 0:
                        rows.append((key, data[s_lo:p][::-1], p - s_hi, p - s_lo, ids[at], hashes[at], own, None))
                    if len(rows) >= BATCH_ROWS:
                        yield rows
                        rows = []
                if rows:
                    yield rows

    def drawn(rows: DataFrame, every: int) -> list[bytes]:
        """The keys of one suffix in `every`, in order; one job, and some SAMPLE_MOST keys at most come here."""

        def sampled(batches):
            for found in suffixes(batches, every):
                yield pa.record_batch([pa.array([r[0] for r in found], pa.binary())], names=["key"])

        return sorted(rows.mapInArrow(sampled, "key binary").toArrow().column("key").to_pylist())

    keys = []
    if buckets > 1:
        wanted = min(buckets * SAMPLE_PER_BUCKET, SAMPLE_MOST)
        every = max(1, cores.total // wanted)
        rows_every = min(every, SAMPLE_ROWS_EVERY)
        keys = drawn(d.sample(1 / rows_every, seed=1), every // rows_every) if rows_every > 1 else []
        if len(keys) < wanted // 2:  # a small table, or one of few and long texts
            keys = drawn(d, every)
    splitters = [keys[len(keys) * k // buckets] for k in range(1, buckets)] if keys else []
    split = spark.sparkContext.broadcast(splitters)

    def placed(batches):
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in PLACED.split(", ")]
        for rows in suffixes(batches):
            bucket = [bisect.bisect_right(split.value, r[0]) for r in rows]
            yield pa.record_batch([pa.array(c, t) for c, t in zip([bucket, *zip(*rows, strict=True)], kinds, strict=True)], names=names)

    def solved(batches):
        for rows in _buckets(batches):
            yield from solve_bucket(rows, split.value, length, core)

    rows = d.mapInArrow(placed, PLACED).repartitionById(max(n_out, buckets), "bucket").sortWithinPartitions("bucket")
    found = checkpointed(rows.mapInArrow(solved, COVER + ", content binary, bucket int"))
    across = found.where("content is not null")
    both = across.groupBy("content").agg(F.min("bucket").alias("x"), F.max("bucket").alias("y")).where("x != y").select("content")
    names = ["doc_id", "text_hash", "start", "end"]
    return found.where("content is null").select(*names).union(across.where("start is not null").join(both, "content", "left_semi").select(*names))


def _buckets(batches):
    """The rows of each bucket as columns; buckets come one after another."""
    now, parts = None, []
    for b in batches:
        ids = b.column(0).to_numpy()
        for at in np.split(np.arange(len(ids)), np.flatnonzero(ids[1:] != ids[:-1]) + 1):
            if len(at):
                if ids[at[0]] != now and parts:
                    yield pa.Table.from_batches(parts)
                    parts = []
                now = ids[at[0]]
                parts.append(b.slice(at[0], len(at)))
    if parts:
        yield pa.Table.from_batches(parts)


def solve_bucket(table: pa.Table, splitters: list[bytes], length: int, core: int):
    """Batches of byte ranges that windows met twice in the bucket cover, and of the windows of cores that a splitter cuts."""
    bucket = table.column("bucket")[0].as_py()
    own = pc.is_valid(table.column("covered_to"))
    known = table.filter(own)
    if known.num_rows:
        yield _cover(*[known.column(c).to_pylist() for c in ("doc_id", "text_hash", "place", "covered_to")], None, bucket)
    table = table.filter(pc.invert(own))
    n = table.num_rows
    if not n:
        return
    keys, before = table.column("key").to_pylist(), table.column("before").to_pylist()
    least, most = table.column("least").to_numpy(), table.column("most").to_numpy()
    doc, text_hash, place = table.column("doc_id").to_pylist(), table.column("text_hash").to_pylist(), table.column("place").to_numpy()
    width = max(map(len, before))
    right = np.frombuffer(b"".join(k[:length] for k in keys), np.uint8).reshape(n, length)
    left = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in before), np.uint8).reshape(n, width) if width else np.zeros((n, 1), np.uint8)
    edges = {s[:core] for s in splitters[max(0, bucket - 1) : bucket + 1]}
    cut = np.array([k[:core] in edges for k in keys])
    member, start, contents = [], [], []
    for o, members, content in equal_windows(right, left, least, most, length):
        _, first, back, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        member.append(members[twice])
        start.append(place[members[twice]] - o)
        if cut.any():
            for k in np.flatnonzero(cut[members[first]]).tolist():  # each content once; its place only if it isn't covered yet
                i = int(members[first[k]])
                digest = xxhash.xxh3_128_digest(before[i][:o][::-1] + keys[i][: length - o])
                contents.append((doc[i], text_hash[i], None if count[k] > 1 else int(place[i]) - o, digest))
    member, start = np.concatenate(member), np.concatenate(start)
    order = np.lexsort((start, member))
    member, start = member[order], start[order]
    if len(member):
        # starts of one member that overlap make one range
        new = np.flatnonzero(np.r_[True, (member[1:] != member[:-1]) | (start[1:] > start[:-1] + length)])
        end = start[np.r_[new[1:] - 1, len(start) - 1]] + length
        who = member[new].tolist()
        yield _cover([doc[i] for i in who], [text_hash[i] for i in who], start[new].tolist(), end.tolist(), None, bucket)
    if contents:
        yield _cover([c[0] for c in contents], [c[1] for c in contents], [c[2] for c in contents], [None if c[2] is None else c[2] + length for c in contents], [c[3] for c in contents], bucket)


def _cover(doc, text_hash, start, end, content, bucket) -> pa.RecordBatch:
    columns = [doc, text_hash, start, end, content or [None] * len(doc), [bucket] * len(doc)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "text_hash", "start", "end", "content", "bucket"])


def without_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, bucket_suffixes: int = BUCKET_SUFFIXES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), spans ([start, end] of the removed runs).

    Texts are UTF-8 bytes, a null one empty; matches never cross documents. Every place where a string of
    `length` bytes occurs more than once is removed, the first place too, judged on the texts as they
    are. Shorter texts stay whole. Rows that repeat are documents of their own, and so repeats of each
    other. Ids are integers; rows without an id are told apart by their text. An empty table gives no rows;
    other columns are not read.
    """
    covered = repeated_spans(docs, length, core, bucket_suffixes, id_col, text_col)
    spans = covered.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    joined = own.join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_hash")), "left")

    def cut(ids, texts, batch):
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        for text, starts, ends in zip(texts, batch.column(2), batch.column(3), strict=True):
            s, e = runs_of(np.array(starts.as_py() or [], np.int64), np.array(ends.as_py() or [], np.int64))
            kept, at = [], 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            for k, v in zip(out, (len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept, np.stack([s, e], 1).tolist()), strict=True):
                out[k].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        return pa.record_batch([ids, *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["doc_id", *out])

    return map_texts(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>", "id", "text", ["starts", "ends"])
