"""Byte-pair encoding with a segment tree over adjacent pair ranks.

A word's adjacent pairs are the leaves of a segment tree whose inner nodes hold
the smaller (rank, position), so its root is the leftmost pair of lowest rank.
That pair is merged, at most three leaves change, and each change climbs the
tree in logarithmic time, until the root says that no pair can be merged.

All words of a batch that have no encoding yet are merged side by side, one
tree each, as rows of numpy arrays. Encodings are kept as packed 32-bit tokens,
so that those of a text are one join of bytes. The vocabulary is a public rank
file whose path is a parameter; nothing is trained here.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrays import chunks

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""How byte-level BPE vocabularies of this family cut text into words; the cuts join up to the whole text."""

NONE = np.int64(1) << np.int64(40)
CACHE_WORDS = 200_000
"""Words that a worker keeps in each of two generations; when the later is full, words that only the earlier holds are forgotten."""


def _narrow_pattern() -> re.Pattern:
    """PATTERN for texts without characters beyond U+00FF: its classes are spelt out, which `re` reads faster than `regex` does."""

    def members(kind: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if regex.fullmatch(kind, chr(c)))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_NARROW = _narrow_pattern()
_BEYOND = re.compile("[^\x00-\xff]")


class Vocabulary:
    """Ranks of byte strings, and the rank of each mergeable pair of tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.narrow = _NARROW if pattern == PATTERN else self.pattern
        self.size = max(ranks.values()) + 1
        self.pieces: list[bytes] = [b""] * self.size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self._hash_pairs(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        self.whole = {piece: np.int32(rank).tobytes() for piece, rank in ranks.items()}
        self.late: dict[str, bytes] = {}
        self.early: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> Vocabulary:
        """From a rank file: lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def _hash_pairs(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A table of pairs by hash, linear probing, a quarter full at most; a free slot holds -1 and NONE."""
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(slots, -1, np.int64), np.full(slots, NONE)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) % slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens, NONE where there is none; negative tokens are no token."""
        key = np.where(right >= 0, left * self.size + right, -1)  # with a negative left one it is no pair's either
        at = self._slot(key)
        there = self.keys[at]
        out = self.values[at]
        on = np.flatnonzero((there != key) & (there != -1))
        while len(on):
            at[on] = (at[on] + 1) % len(self.keys)
            there = self.keys[at[on]]
            out[on] = self.values[at[on]]
            on = on[(there != key[on]) & (there != -1)]
        return out

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of each word."""
        return [tuple(np.frombuffer(x, np.int32).tolist()) for x in self._packed_words(words)]

    def _packed_words(self, words: list[bytes]) -> list[bytes]:
        """Packed tokens of each word, words of similar length side by side."""
        out = list(map(self.whole.get, words))
        rest = [k for k, x in enumerate(out) if x is None]
        lengths = np.fromiter((len(words[k]) for k in rest), np.int64, len(rest))
        bits = np.maximum(1, np.frexp(np.maximum(lengths - 2, 0))[1])  # the bit length
        bits[lengths == 0] = 0
        for b in np.unique(bits).tolist():
            members = [rest[i] for i in np.flatnonzero(bits == b).tolist()]
            step = max(1, 2_000_000 >> b)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                for k, packed in zip(some, self._merge([words[k] for k in some], b) if b else [b""] * len(some)):
                    out[k] = packed
        return out

    def _merge(self, words: list[bytes], bits: int) -> list[bytes]:
        """Words of 2 to 2**bits + 1 bytes: at most 2**bits pairs each."""
        n, leaves = len(words), 1 << bits
        width = leaves + 1
        length = np.array([len(w) for w in words])
        token = np.full((n, width), -1, np.int64)
        inside = np.arange(width)[None, :] < length[:, None]
        token[inside] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        # a node holds rank * leaves + position: the smaller is of lower rank, then further left
        tree = np.full((n, 2 * leaves), NONE * leaves)
        rank = self.pair_ranks(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, leaves)
        tree[:, leaves:] = rank * leaves + np.arange(leaves)
        for level in range(bits - 1, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2])

        def point(rows, leaf, value):
            node = leaf + leaves
            tree[rows, node] = value
            for _ in range(bits):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        alive = np.arange(n)
        while True:
            root = tree[alive, 1]
            alive, root = alive[root < NONE * leaves], root[root < NONE * leaves]
            if not len(alive):
                break
            at = root % leaves
            right = after[alive, at]
            token[alive, at] = root // leaves
            token[alive, right] = -1
            beyond = after[alive, right]
            after[alive, at] = beyond
            has = beyond < width
            before[alive[has], beyond[has]] = at[has]
            # the merged token with its right neighbour; the pair that began at the right part is gone
            follower = np.where(has, token[alive, np.minimum(beyond, width - 1)], -1)
            point(alive, at, self.pair_ranks(token[alive, at], follower) * leaves + at)
            gone = right < leaves
            point(alive[gone], right[gone], NONE * leaves)
            prior = before[alive, at]
            some = prior >= 0
            rows, prior = alive[some], prior[some]
            point(rows, prior, self.pair_ranks(token[rows, prior], token[rows, at[some]]) * leaves + prior)
        left = token >= 0
        flat, ends = token[left].astype(np.int32).tobytes(), (4 * np.cumsum(left.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def words(self, text: str) -> list[str]:
        """The words of a text; they join up to it."""
        return (self.pattern if _BEYOND.search(text) else self.narrow).findall(text)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Tokens of each text; an empty text has none."""
        return [x.tolist() for x in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """encode_batch() with 32-bit arrays."""
        words = [self.words(t) for t in texts]
        unknown = set().union(*words).difference(self.late)
        missing = unknown.difference(self.early)
        self.late.update((w, self.early[w]) for w in unknown - missing)
        fresh = list(missing)
        self.late.update(zip(fresh, self._packed_words([w.encode("utf-8") for w in fresh])))
        look = self.late.__getitem__
        out = [np.frombuffer(b"".join(map(look, x)), np.int32) for x in words]
        if len(self.late) > CACHE_WORDS:
            self.early = self.late if len(self.late) <= 2 * CACHE_WORDS else {}  # a batch of very many words isn't kept
            self.late = {}
        return out

    def decode(self, tokens) -> str:
        """The text of tokens; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.pieces.__getitem__, tokens)).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, read once per process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def _encoder(path: str, digest: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for rows in batches:
            texts = rows["text"].tolist()
            for a, b in chunks(texts, 500_000):
                known = [isinstance(t, str) for t in texts[a:b]]
                lists = v.encode_arrays([t if k else "" for t, k in zip(texts[a:b], known)])
                out = {
                    "doc_id": rows["doc_id"].iloc[a:b].astype("Int64"),
                    "tokens": [t if k else None for t, k in zip(lists, known)],
                    "n_tokens": pd.array([len(t) if k else None for t, k in zip(lists, known)], "Int32"),
                }
                if digest:
                    out["text_sha256"] = [hashlib.sha256(v.decode(t.tolist()).encode("utf-8")).hexdigest() if k else None for t, k in zip(lists, known)]
                yield pd.DataFrame(out)

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tokens, n_tokens of docs(doc_id, text, ...) under the rank file at `path` (present on every executor).

    A null text has null tokens and a null count, an empty text an empty list.
    Null ids stay null, repeated rows are encoded each, texts of any length are
    encoded whole, an empty table gives an empty result, and other columns are
    not read.
    """
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return lean.mapInPandas(_encoder(path, False), "doc_id long, tokens array<int>, n_tokens int")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encoded(doc_id, tokens, ...); null tokens give a null text. A token outside the vocabulary is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "text": [None if t is None else v.decode(t.tolist() if hasattr(t, "tolist") else t) for t in rows["tokens"]]})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tokens, n_tokens and text_sha256, the digest of the text that the tokens decode to, in one pass over docs.

    The same cases as encode(); a null text has a null digest.
    """
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return lean.mapInPandas(_encoder(path, True), "doc_id long, tokens array<int>, n_tokens int, text_sha256 string")
