"""Join of documents by the Jaccard similarity of their word shingles: a MinHash LSH forest, then exact checks.

1. Documents of equal shingle sets become one class; only classes go on.
2. Each class has a label in each tree of the forest: `depth` MinHash values. Sorted by label, a tree is a
   prefix trie, whose nodes are runs of equal prefixes. From the full label down, a class shortens the prefix
   it matches on until it would meet the least similar partner that a set of its size can have with the
   target recall, in some tree; a set too small to have any partner meets none.
3. Each run is clustered around leaders by estimated similarity; components of these links are clusters of
   much the same text. Within a cluster all pairs are compared exactly, once for all trees. Of a run that
   holds several clusters, the members of all but its largest visit that one and are compared with it once,
   for all trees; pairs of others are compared in the first run they share. So an estimate decides only where a
   pair is compared, never whether. All go in blocks of bounded size, by products of shingle incidence
   matrices; what leaves a block is a count and one spanning link a class.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import U64, byte_texts, checkpointed, lean, map_texts, mix64, pieces, skew_join
from lorekeep.llm.components import components
from lorekeep.session import workers_import

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
TREES, DEPTH = 24, 6
TARGET_RECALL = 0.9999
#: Estimated similarity from which a member of a run joins a leader's cluster. The lower, the fewer pairs are
#: compared by runs, for which a class goes to each of its trees; the higher, the smaller the clusters.
JOIN_AT = 0.6
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 2_000_000
#: Bytes of shingles in an Arrow batch.
BATCH_BYTES = 8 << 20
#: Longer words are hashed each time instead of being kept.
WORD_BYTES_KEPT = 64

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BASE = U64(0x9E3779B97F4A7C15)


def prefix_depth(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from `depth` down, at which a pair meets in some tree with the recall."""
    for d in range(depth, 1, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    return 1


@lru_cache(maxsize=4096)
def least_similarity(n: int, similarity: Fraction) -> Fraction | None:
    """The least similarity, from `similarity` up, that a set of n can have with another set; None if it can have none."""
    found = None
    for m in range(-(-n * similarity.numerator // similarity.denominator), int(n / similarity) + 1):
        shared = -(-(n + m) * similarity // (1 + similarity))  # the fewest that suffice
        if shared <= min(n, m) and not shared == n == m:
            own = Fraction(int(shared), int(n + m - shared))
            found = own if found is None else min(found, own)
    return found


@lru_cache(maxsize=4096)
def own_depth(n: int, similarity: Fraction, trees: int, depth: int, recall: float) -> int:
    """How far a set of n shortens its prefix; 0: it has no partners. Beyond 64 the least similarity is near enough the join's."""
    least = similarity if n > 64 else least_similarity(n, similarity)
    return prefix_depth(float(least), trees, depth, recall) if least else 0


class Shingler:
    """Distinct 64-bit shingle hashes of texts; hashes of words that aren't long are kept up to a bound."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.seen = size, {}

    def hashed(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES_KEPT:
            self.seen[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingles; all words together, if they are fewer than a shingle's; none without words."""
        words, seen = WORDS.findall(text.lower()), self.seen
        if not words:
            return np.zeros(0, U64)
        if len(seen) > 500_000:
            seen.clear()
        try:
            ids = [seen[w] for w in words]
        except KeyError:
            ids = [seen.get(w) or self.hashed(w) for w in words]
        h = np.array(ids, U64)
        k = min(self.size, len(h))
        n = len(h) - k + 1
        total = np.zeros(n, U64)
        for j in range(k):
            total = total * BASE + h[j : j + n]
        return np.unique(mix64(total + U64(k)))


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """MinHash values (16 bits) of non-empty sets, one row a set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    rng = np.random.default_rng(20240101)
    out = np.empty((len(sets), values), np.uint16)
    for k, (a, b) in enumerate(zip(rng.integers(1, 1 << 63, values, dtype=U64) | U64(1), rng.integers(0, 1 << 63, values, dtype=U64), strict=True)):
        h = flat * a + b
        h ^= h >> U64(32)
        out[:, k] = np.minimum.reduceat(h * BASE, starts) & U64(0xFFFF)
    return out


def run_links(nodes: list[bytes], values: np.ndarray, join_at: float = JOIN_AT) -> tuple[list[tuple[bytes, bytes]], list[int]]:
    """Links of a run's members to the leaders whose clusters they join, and the leaders' places.

    A member is compared with every leader up to the one it joins. Members come in order of their hashes, so
    the runs of one group in many trees choose much the same few leaders.
    """
    rest, links, leaders = np.array(sorted(range(len(nodes)), key=nodes.__getitem__)), [], []
    while len(rest):
        leader = int(rest[0])
        leaders.append(leader)
        near = (values[rest] == values[leader]).mean(1) >= join_at
        links += [(nodes[k], nodes[leader]) for k in rest[near].tolist() if k != leader]
        rest = rest[~near & (rest != leader)]
    return links, leaders


def _runs(batches, width: int):
    """(run key, nodes, signatures) from rows (tree, label, node, signature) in order of tree and label."""
    key, nodes, held = None, [], []
    for b in batches:
        for tree, label, node, signature in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            k = (tree, label[:width])
            if k != key and nodes:
                yield key, nodes, np.frombuffer(b"".join(held), np.uint16).reshape(len(nodes), -1)
                nodes, held = [], []
            key = k
            nodes.append(node)
            held.append(signature)
    if nodes:
        yield key, nodes, np.frombuffer(b"".join(held), np.uint16).reshape(len(nodes), -1)


LINK_SCHEMA = "a binary, b binary, tree int, label binary, signature binary"


def _link_batch(links, edge) -> pa.RecordBatch:
    """Rows of links (a, b), and of leaders (a, tree, label, signature) whose run may go on in the next partition."""
    a = [x[0] for x in links] + [x[0] for x in edge]
    none = [None] * len(links)
    columns = [a, [x[1] for x in links] + [None] * len(edge), none + [x[1] for x in edge], none + [x[2] for x in edge], none + [x[3] for x in edge]]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["a", "b", "tree", "label", "signature"])


def trie_links(rows: DataFrame, width: int, join_at: float = JOIN_AT) -> DataFrame:
    """(a, b) links among rows (tree, label, node, signature): classes of much the same text that share a label prefix of `width` bytes.

    Rows are range-partitioned by sampled splitters on (tree, label, a hash of the node), so even the rows of
    one label are split; leaders of the first and last run of each partition meet in a second, much smaller pass.
    """

    def inside(batches):
        last = None
        for n, (key, nodes, values) in enumerate(_runs(batches, width)):
            links, leaders = run_links(nodes, values, join_at)
            edge = [(nodes[i], *key, values[i].tobytes()) for i in leaders]
            yield _link_batch(links, edge if n == 0 else [])
            last = edge if n else None
        if last:
            yield _link_batch([], last)

    def across(batches):
        for _, nodes, values in _runs(batches, width):
            yield _link_batch(run_links(nodes, values, join_at)[0], [])

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "label", "tie"]
    # the hash mixes the nodes of a split label, so its parts choose from the same smallest nodes
    rows = rows.select("tree", "label", "node", "signature", F.xxhash64("node").alias("tie"))
    first = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lean(inside), LINK_SCHEMA))
    again = first.where("b is null").select("tree", "label", F.col("a").alias("node"), "signature").repartition(n, "tree", "label").sortWithinPartitions("tree", "label").mapInArrow(lean(across), LINK_SCHEMA)
    return first.where("b is not null").select("a", "b").union(again.select("a", "b")).distinct()


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Matrix of which sets of `left` (rows) and of `right` (columns) are similar; a set is not paired with itself."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    count = np.diff(np.r_[np.flatnonzero(new), len(ordered)])
    shared = count > 1
    column = (np.cumsum(shared) - 1)[np.cumsum(new) - 1]
    keep = shared[np.cumsum(new) - 1]
    r, c = row[order][keep], column[keep]
    inter = np.zeros((len(left), len(right)), np.float32)
    n_columns, step = int(shared.sum()), 2048
    bounds = np.searchsorted(c, np.arange(0, n_columns + step, step))
    for k in range(len(bounds) - 1):
        a = np.zeros((m, min(step, n_columns - k * step)), np.float32)
        a[r[bounds[k] : bounds[k + 1]], c[bounds[k] : bounds[k + 1]] - k * step] = 1
        inter += a[left] @ a[right].T
    p, q = similarity.numerator, similarity.denominator
    # intersection / union >= p / q
    out = inter * np.float64(p + q) >= p * (sizes[left][:, None] + sizes[right][None, :]).astype(np.float64)
    return out & (left[:, None] != right[None, :])


def first_shared(values: np.ndarray, depths: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int) -> np.ndarray:
    """Which pairs meet in `tree`, at the longer of their prefixes, and in no tree before it. values: (set, tree, value)."""
    need = np.maximum(depths[left][:, None], depths[right][None, :])

    def meet(t):
        out = np.zeros(need.shape, bool)
        for d in np.unique(need).tolist():
            _, code = np.unique(np.ascontiguousarray(values[:, t, :d]).view(f"V{2 * d}").ravel(), return_inverse=True)
            out |= (need == d) & (code[left][:, None] == code[right][None, :])
        return out

    out = meet(tree)
    for t in range(tree):
        if not out.any():
            break
        out &= ~meet(t)
    return out


class Block:
    """Classes to compare: a cluster's own and its visitors (tree None), or those in a run that aren't of its largest cluster."""

    FIELDS = ("node", "copies", "side", "shingles", "cluster", "visits", "signature")

    def __init__(self, tree: int | None, name: bytes, within: bool):
        self.tree, self.name, self.within = tree, name, within
        self.rows = {k: [] for k in self.FIELDS}

    def add(self, *row) -> None:
        if not self.rows["node"] or self.rows["node"][-1] != row[0]:  # rows equal in id and text come twice
            for held, x in zip(self.rows.values(), row, strict=True):
                held.append(x)

    def allowed(self, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], forest: tuple) -> np.ndarray | None:
        """Which pairs are compared here, so that each is compared in one place; None: all."""
        clusters = self.rows["cluster"]
        if self.tree is None and all(c == self.name for c in clusters):
            return None
        names, code = np.unique(np.array(clusters, object), return_inverse=True)
        visited = np.zeros((len(clusters), len(names)), bool)
        at = {n: k for k, n in enumerate(names.tolist())}
        for k, visits in enumerate(self.rows["visits"]):
            visited[k, [at[v] for v in visits or () if v in at]] = True
        goes, comes = visited[left][:, code[right]], visited[right][:, code[left]].T
        if self.tree is None:
            own = np.array([c == self.name for c in clusters])
            # two clusters that visit each other: a pair that goes both ways is compared in the one of the lesser name
            later = np.array([c < self.name for c in clusters])
            a, b = own[left][:, None], own[right][None, :]
            return (a & b) | (a & ~b & ~(goes & later[right][None, :])) | (~a & b & ~(comes & later[left][:, None]))
        similarity, trees, depth, recall = forest
        values = np.frombuffer(b"".join(self.rows["signature"]), np.uint16).reshape(-1, trees, depth)
        depths = np.array([own_depth(len(x), similarity, trees, depth, recall) for x in sets])
        return (code[left][:, None] != code[right][None, :]) & ~goes & ~comes & first_shared(values, depths, left, right, self.tree)

    def solved(self, *forest):
        """(node, links, root) of the classes: links counts the documents of similar classes, roots span what is linked."""
        nodes, side = self.rows["node"], np.array(self.rows["side"])
        sets = [np.frombuffer(x, U64) for x in self.rows["shingles"]]
        m = len(nodes)
        links, root = np.zeros(m, np.int64), np.arange(m)
        left, right = (np.arange(m),) * 2 if self.within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        may = self.allowed(left, right, sets, forest)
        if may is not None:
            rows, columns = may.any(1), may.any(0)
            left, right, may = left[rows], right[columns], may[np.ix_(rows, columns)]
        if len(left) and len(right) and m > 1:
            hit = similar_pairs(sets, left, right, forest[0])
            if may is not None:
                hit &= may
            copies = np.array(self.rows["copies"], np.int64)
            links[left] += hit @ copies[right]
            if not self.within:
                links[right] += copies[left] @ hit
            root = spanned(m, left, right, hit)
        return nodes, links.tolist(), [nodes[i] for i in root.tolist()]


def spanned(m: int, left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The first member of each member's component, by a search over the rows of the matrix."""
    root, seen = np.arange(m), np.ones(m, bool)
    seen[left[hit.any(1)]] = seen[right[hit.any(0)]] = False
    for s in range(m):
        if seen[s]:
            continue
        front = np.array([s])
        seen[s] = True
        while len(front):
            mask = np.zeros(m, bool)
            mask[right[hit[np.isin(left, front)].any(0)]] = True
            mask[left[hit[:, np.isin(right, front)].any(1)]] = True
            front = np.flatnonzero(mask & ~seen)
            seen[front] = True
            root[front] = s
    return root


def shingle_classes(docs: DataFrame, shingle: int, trees: int, depth: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, text_hash, node (16-byte hash of its shingle set; null without words), n, signature."""
    kind = dict(docs.dtypes)[id_col]

    def run(ids, texts, batch):
        s, node, sizes, sig = Shingler(shingle), [], [], []
        for lo, hi in pieces(texts, 1 << 20):
            sets = [s.of(t) for t in texts[lo:hi]]
            some = [x for x in sets if len(x)]
            values = iter(signatures(some, trees * depth)) if some else iter(())
            for x in sets:
                node.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                sizes.append(len(x))
                sig.append(next(values).astype(">u2").tobytes() if len(x) else None)
        return pa.record_batch([ids, batch.column(2), pa.array(node, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "node", "n", "signature"])

    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    return map_texts(d, run, f"doc_id {kind}, text_hash long, node binary, n long, signature binary", "id", "text", ["text_hash"])


def groups_to_compare(classes: DataFrame, similarity: Fraction, trees: int, depth: int, recall: float, join_at: float, block_classes: int, block_shingles: int) -> DataFrame:
    """(node, groups, cluster, visits): the classes to compare with others, and where. A group: tree (null: a cluster's), name, nb, its number of parts; visits: the clusters it visits."""
    base = prefix_depth(float(similarity), trees, depth, recall)
    none = [n for n in range(65) if not own_depth(n, similarity, trees, depth, recall)]
    label = lambda t: F.expr(f"substring(signature, {2 * depth} * {t} + 1, {2 * depth})")
    prefix = F.expr(f"substring(label, 1, {2 * base})").alias("prefix")
    # a prefix that one class alone has leads nowhere: only shared ones get their signatures
    keys = classes.where(~F.col("n").isin(none)).select("node", F.posexplode(F.array(*[F.xxhash64(F.expr(f"substring(signature, {2 * depth * t + 1}, {2 * base})")) for t in range(trees)])).alias("tree", "prefix"))
    shared = keys.groupBy("tree", "prefix").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("n")).where("x != y").select("tree", "prefix", "n")
    met = skew_join(keys, checkpointed(shared), ["tree", "prefix"], "n", "left_semi").select("node", "tree")
    rows = checkpointed(met.join(classes.select("node", "signature"), "node").select("tree", label("tree").alias("label"), "node", "signature"))
    clusters = components(trie_links(rows, 2 * base, join_at))
    placed = rows.select("tree", prefix, "node").join(clusters, "node", "left").select("tree", "prefix", "node", F.coalesce("root", "node").alias("cluster"))
    placed = checkpointed(placed)
    run = ["tree", "prefix"]
    mixed = placed.groupBy(*run, "cluster").agg(F.count("*").alias("n")).groupBy(*run).agg(F.max(F.struct("n", "cluster")).alias("most"), F.count("*").alias("clusters"), F.sum("n").alias("n"))
    mixed = mixed.where("clusters > 1").select(*run, F.col("most.cluster").alias("host"), "n")
    strangers = checkpointed(skew_join(placed, checkpointed(mixed), run, "n").where("cluster != host"))
    sizes = classes.select("node", F.col("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.count("*") / block_classes), F.ceil(F.sum("shingles") / block_shingles)).cast("int").alias("nb")

    def grouped(rows: DataFrame, key: list[str]) -> DataFrame:
        """rows (node, and the key of a group) of groups of more than one class, with the number of their parts."""
        rows = checkpointed(rows)
        sized = rows.join(sizes, "node").groupBy(*key).agg(F.count("*").alias("n"), parts).where("n > 1")
        return skew_join(rows, checkpointed(sized), key, "n")

    # pairs of strangers in a run
    several = strangers.groupBy(*run).agg(F.min("cluster").alias("x"), F.max("cluster").alias("y"), F.count("*").alias("n")).where("x != y").select(*run, "n")
    in_runs = grouped(skew_join(strangers, checkpointed(several), run, "n").select("tree", F.col("prefix").alias("name"), "node"), ["tree", "name"])
    # a cluster's own classes and its visitors
    in_clusters = grouped(placed.select(F.col("cluster").alias("name"), "node").union(strangers.select("host", "node")).distinct(), ["name"]).withColumn("tree", F.lit(None).cast("int"))
    # a class is in one cluster, a visitor of one at most a tree, and in one run a tree
    groups = in_runs.unionByName(in_clusters).groupBy("node").agg(F.collect_list(F.struct("tree", "name", "nb")).alias("groups"))
    visits = strangers.groupBy("node").agg(F.collect_set("host").alias("visits"))
    return groups.join(placed.select("node", "cluster").distinct(), "node").join(visits, "node", "left")


def near_duplicates(docs: DataFrame, similarity: Fraction = SIMILARITY, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = TARGET_RECALL, join_at: float = JOIN_AT, id_col: str = "doc_id", text_col: str = "text", block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row a document: doc_id, text_hash, class_id, class_hash, copies, n_links, keeps.

    Words are [0-9a-z] and all letters beyond ASCII, after lower-casing A-Z. Two documents are linked if
    the Jaccard similarity of their sets of `shingle`-word shingles is at least `similarity`. n_links is
    how many documents a document is linked to, class_id the least doc_id of its connected component (null
    only if all of its ids are), class_hash that row's text_hash, which tells components led by one id or
    by none apart, copies how many documents have its very shingle set, itself counted. keeps holds for the
    row that leads its component. A text of fewer words is one shingle; a text without words (null too)
    links to nothing and keeps its row; rows equal in id and text share what they get. Links are
    exact; one at the least similarity is missed with a chance of 1 - recall.
    """
    spark = docs.sparkSession
    workers_import(spark)
    d = checkpointed(shingle_classes(docs, shingle, trees, depth, id_col, text_col))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = checkpointed(d.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min(row).alias("first"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    groups = groups_to_compare(classes, similarity, trees, depth, recall, join_at, block_classes, block_shingles)
    members = groups.join(classes, "node").select("node", "cluster", "visits", "groups", "copies", "signature", F.col("first.doc_id").alias("m_id"), F.col("first.text_hash").alias("m_hash"))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("own_hash"))
    texts = own.join(members, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("own_hash") == F.col("m_hash"))).select("text", "node", "cluster", "visits", "copies", "signature", "groups")
    columns = {"tree": pa.int32(), "name": pa.binary(), "i": pa.int32(), "j": pa.int32(), "node": pa.binary(), "copies": pa.int64(), "side": pa.int32(), "shingles": pa.binary(), "cluster": pa.binary(), "visits": pa.list_(pa.binary()), "signature": pa.binary()}

    def shingled(batches):
        """A row for each block that a class is in; a group of nb parts has a block for each two of them, and each by itself."""
        s, out, held = Shingler(shingle), {k: [] for k in columns}, 0

        def flush():
            batch = pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), columns.values(), strict=True)], names=list(out))
            for v in out.values():
                v.clear()
            return batch

        for b in batches:
            for text, node, cluster, visits, copies, signature, groups in zip(byte_texts(b.column(0)), *[c.to_pylist() for c in b.columns[1:]], strict=True):
                data = s.of(text).tobytes()
                # big-endian values make labels sort; numbers from here on
                values = np.frombuffer(signature, ">u2").astype(np.uint16).tobytes()
                for g in groups:
                    part = int.from_bytes(node[:8], "big") % g["nb"]
                    signed = None if g["tree"] is None else values
                    for other in range(g["nb"]):
                        for k, v in zip(out, (g["tree"], g["name"], min(part, other), max(part, other), node, copies, int(part > other), data, cluster, visits, signed), strict=True):
                            out[k].append(v)
                        held += len(data)
                        if held > BATCH_BYTES:
                            yield flush()
                            held = 0
        if out["node"]:
            yield flush()

    def compared(batches):
        block, key = None, None
        for b in batches:
            for tree, name, i, j, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (tree, name, i, j) != key:
                    if block:
                        yield _solved_batch(block.solved(similarity, trees, depth, recall))
                    key, block = (tree, name, i, j), Block(tree, name, i == j)
                block.add(*row)
        if block:
            yield _solved_batch(block.solved(similarity, trees, depth, recall))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "name", "i", "j"]
    kinds = "tree int, name binary, i int, j int, node binary, copies long, side int, shingles binary, cluster binary, visits array<binary>, signature binary"
    blocks = checkpointed(texts.mapInArrow(lean(shingled), kinds).repartition(n, *order).sortWithinPartitions(*order, "node").mapInArrow(lean(compared), "node binary, links long, root binary"))
    spans = components(blocks.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = blocks.groupBy("node").agg(F.sum("links").alias("links"))
    known = checkpointed(spans.join(links, "node").join(classes.select("node", "first"), "node"))
    heads = checkpointed(known.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("n")))
    known = skew_join(known, heads, ["root"], "n").select("node", "links", "head")
    per_class = classes.select("node", "copies", "first").join(known, "node", "left").select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("head", "first").alias("head"))
    out = skew_join(d.where("node is not null").select("doc_id", "text_hash", "node"), checkpointed(per_class.withColumn("n", F.col("copies"))), ["node"], "n")
    out = out.select(
        "doc_id",
        "text_hash",
        F.col("head.doc_id").alias("class_id"),
        F.col("head.text_hash").alias("class_hash"),
        F.col("copies").cast("long").alias("copies"),
        (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.text_hash") == F.col("text_hash"))).alias("keeps"),
    )
    bare = d.where("node is null")
    return out.unionByName(bare.select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("text_hash").alias("class_hash"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keeps")))


def _solved_batch(found) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(found, [pa.binary(), pa.int64(), pa.binary()], strict=True)], names=["node", "links", "root"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, of each component of near duplicates the first document alone; rows equal in id and text count once."""
    keep = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("keeps").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    keep = checkpointed(keep)
    own = docs.withColumn("__own_hash", F.xxhash64(F.col(f"`{text_col}`")))
    match = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own_hash") == F.col("__hash"))
    out = own.join(keep.distinct(), match, "left_semi")
    if keep.count() != keep.distinct().count():
        out = out.dropDuplicates([id_col, "__own_hash"])
    return out.drop("__own_hash")


def pairs_sql(docs: str = "documents") -> str:
    """DuckDB SQL for doc_id, class_id, copies and n_links, over a relation with distinct ids, by comparing sets exactly."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {docs}),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM w),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a, b, i FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b
  WHERE i * 9 >= 4 * (za.n + zb.n)),
same AS (SELECT a, count(*) AS c FROM p JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE i = za.n AND i = zb.n GROUP BY a),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a)
SELECT d.doc_id, c.class_id, coalesce(same.c, 0) + 1 AS copies, coalesce(l.n, 0) AS n_links
FROM w d JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN same ON same.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = d.doc_id
"""
