"""Array forms of a batch of texts, for operators that must read whole texts fast.

A batch is laid end to end as UTF-8 bytes or code points, and every step is a
numpy pass over that one buffer, so the cost per character is a few machine
operations and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def chunks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` characters each; a longer text is a range of its own or ends one."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size > limit:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


_WORDS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _WORDS:
        _WORDS.clear()
        _WORDS[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _WORDS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public-domain splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of each text, and word counts.

    A word is a maximal run of letters, digits, underscores and non-ASCII
    characters. Returns (hashes of all words in order, words per text). A null
    counts as an empty text.
    """
    parts = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    word = _IS_WORD[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    hashes = mix((total[stop] - total[start]) * inverse[start])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return hashes, counts.astype(np.int64)


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, and how many each has.

    A text of 1 to n-1 words has one shingle of all its words; an empty text
    has none.
    """
    many = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    base = np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else np.zeros(0, np.int64)
    at = np.arange(int(many.sum())) - np.repeat(base - first, many)
    last = np.repeat(first + counts, many)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = at + k < last
        step = np.zeros(len(at), np.uint64)
        step[there] = hashes[at[there] + k]
        out = (out * np.uint64(_BASE)) + step
    return mix(out), many


_GAP = 0x110000


def code_points(texts: list, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each after one space and followed by
    one space and `pad` gap marks, and the row of each position (-1 at gap marks).

    A run of white space becomes one space, so that line breaks don't matter.
    """
    parts = [" " + " ".join(t.lower().split()) + " " if t else "" for t in texts]
    tail = "\x00" * pad
    raw = np.frombuffer(tail.join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    size = np.array([len(p) + pad for p in parts], np.int64)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), size)
    ends = np.cumsum(size)
    for k in range(1, pad + 1):
        raw[ends - k] = _GAP
        row[ends - k] = -1
    return raw, row


def window_hashes(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n code points from each position on, and whether none of them is a gap mark.

    Needs `pad` >= n - 1 gap marks behind each text, else windows span texts.
    """
    many = max(0, len(points) - n + 1)
    if not many:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = points[:many].astype(np.uint64)
    for k in range(1, n):
        h = h * np.uint64(_BASE) + points[k : k + many]
    return h, (points[:many] != _GAP) & (points[n - 1 : n - 1 + many] != _GAP)


def line_repeats(parts: list[bytes]) -> np.ndarray:
    """Share of the non-empty lines of each text that repeat an earlier one."""
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    if not len(raw):
        return np.zeros(len(parts))
    power, inverse = _tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    stop = np.flatnonzero(raw == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    row = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
    h, row = ((total[stop] - total[start]) * inverse[start])[stop > start], row[stop > start]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[again], minlength=len(parts)) / np.maximum(np.bincount(row, minlength=len(parts)), 1)
