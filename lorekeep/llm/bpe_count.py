"""Token counts by byte-pair merging, without emitting identifiers.

A word starts as one symbol a byte. The adjacent pair of lowest rank is popped from a heap and merged in
a linked list until no pair has a rank; the word's count is its initial symbols minus its merges.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lorekeep.llm.common import map_texts

#: Words kept with their counts in a worker; beyond it the table starts anew. Longer words than LONG are counted each time.
CACHE_WORDS, LONG = 700_000, 48

# fixed values: ranges of letters and numbers that are newer than the library's Unicode tables (16), and so symbols to it
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_NEWER = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)

# fixed values of the vocabulary's pre-tokenizer
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\P{{L}}{_NEWER}]+|[^\P{{N}}{_NEWER}]|(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{_NEWER}])+")
SPACE = regex.compile(r"\p{White_Space}+")
#: Python's split() takes these for white space, the vocabulary's rule does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


class PairMerger:
    """Counts the tokens of texts under a word-end byte-pair vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab, merges = model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        known = dict(vocab)
        for m in merges:
            for s in (*m, "".join(m)):
                known.setdefault(s, len(known))
        #: (left << 20 | right) -> rank << 20 | merged symbol
        self.rank = {known[a] << 20 | known[b]: n << 20 | known[a + b] for n, (a, b) in reversed([*enumerate(merges)])}
        self.silent = {known.setdefault(c + e, len(known)) for c in byte_symbols() for e in ("", self.end)} - set(vocab.values())
        self.inner = [known[c] for c in byte_symbols()]
        self.last = [known[c + self.end] for c in byte_symbols()]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        #: Counts of stretches between white space, and of the words in them.
        self.seen: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def merge(self, word: bytes) -> int:
        """Symbols left when no ranked pair is left: the initial ones less one for each merge."""
        inner, rank = self.inner, self.rank.get
        sym = [inner[b] for b in word[:-1]]
        sym.append(self.last[word[-1]])
        n = len(sym)
        #: the rank entry of the pair that begins at each symbol; -1 if it has none or was merged away
        pair = [rank(a << 20 | b, -1) for a, b in zip(sym, sym[1:])]
        pair.append(-1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        if heap:
            left, right = [*range(-1, n - 1)], [*range(1, n), -1]
            heapify(heap)
            while heap:
                top = heappop(heap)
                i = top & 0xFFFFFFFF
                r = top >> 32
                # the library too takes an old entry whose place now makes the same symbol from another pair
                if pair[i] < 0 or (pair[i] ^ r) & 0xFFFFF:
                    continue
                j = right[i]
                sym[i] = a = r & 0xFFFFF
                sym[j] = pair[j] = -1
                right[i] = k = right[j]
                n -= 1
                if k >= 0:
                    left[k] = i
                    pair[i] = r = rank(a << 20 | sym[k], -1)
                    if r >= 0:
                        heappush(heap, r << 32 | i)
                else:
                    pair[i] = -1
                h = left[i]
                if h >= 0:
                    pair[h] = r = rank(sym[h] << 20 | a, -1)
                    if r >= 0:
                        heappush(heap, r << 32 | h)
        if self.silent:
            n -= sum(1 for s in sym if s in self.silent)
        return n

    def words(self, text: str) -> int:
        """Tokens of a text that holds no special string."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if text.isascii() and text.isalpha():
            found = (text.lower(),)
        else:
            found = WORDS.findall(text.replace("Σ", "σ").lower())
        known, n = self.known, 0
        for w in found:
            c = known.get(w)
            if c is None:
                c = self.merge(w.encode())
                if len(w) <= LONG:
                    known[w] = c
            n += c
        return n

    def chunk(self, text: str) -> int:
        """Tokens of a stretch without white space; special strings count one each."""
        if self.special and any(m in text for m in self.marks):
            return sum(map(self.words, self.special.split(text))) + len(self.special.findall(text))
        return self.words(text)

    def count(self, text: str) -> int:
        seen = self.seen
        if len(seen) > CACHE_WORDS // 2:
            seen.clear()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        chunks = SPACE.split(text) if any(c in text for c in SEPARATORS) else text.split()
        try:
            return sum(map(seen.__getitem__, chunks))
        except KeyError:
            n = 0
            for c in chunks:
                k = seen.get(c)
                if k is None:
                    k = self.chunk(c)
                    if len(c) <= LONG:
                        seen[c] = k
                n += k
            return n


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every whole text.

    vocabulary: the path of the vocabulary file, the same on every machine. A null text counts as empty
    (0 bytes, 0 tokens); rows that repeat and null ids each get their row; no rows give no rows; other
    columns are not read. Narrow: no shuffle, and a worker holds one Arrow batch and CACHE_WORDS words of LONG letters at most.
    """

    def run(ids, texts, batch):
        m = merger(vocabulary)
        n = [m.count(t.decode("utf-8", "replace")) for t in texts]
        return pa.record_batch([ids.cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_texts(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)
