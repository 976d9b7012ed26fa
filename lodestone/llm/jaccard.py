"""Exact self-join of documents by the Jaccard similarity of their word n-grams.

Universe partition and the pigeonhole principle, after Deng, Li, Wen & Feng,
"An efficient partition based method for exact set similarity joins".

Two sets r, s with J(r, s) >= t differ in at most
H = (1 - t) / (1 + t) * (|r| + |s|) elements.

0. The sets are cut down and put into bins that no pair leaves. The universe is
   divided by hash into as many cells as the corpus asks for; a cell counts how
   many rows hold each element. A partner shares at least t of a set's elements,
   so sets with fewer shared ones go; and of the shared ones, rarest first, both
   sets of a pair hold a common one among the first (shared - t * size + 1).
   Sets that share one there are connected, unless a lower bound of their
   difference, from parities of their shared elements, is above H; of an element
   that many sets hold there, all are connected without that. A bin holds whole
   components, and a component beyond a bin is joined in pairs of blocks of its
   sets. So no later task grows with the corpus.
1. The sets of a bin are divided by size into ranges so wide that every possible
   pair shares one, and the universe of each range is divided by hash into G groups.
   By the pigeonhole principle a pair differs by at most H / G in some group.
   Each (bin, range, group) meets as one task that holds its part of every set.
2. Inside a group, first go the parts that hold so many elements no other set
   has that nothing can be near enough. The rest is divided again by hash into
   segments. A probing set gives each segment a budget of -1 (not looked at),
   0 (equal subsets) or 1 (equal up to one deletion on either side) so that the
   sum of budget + 1 exceeds the difference allowed: then some segment must
   match. Which segments get how much is decided by cost, the number of partners
   that a look-up brings, known exactly from the group's own index. A pair found
   so is kept if its parts really differ by at most H / G.
3. Kept pairs form a graph whose components are small groups of near copies. The
   whole sets of a component meet (split into pairs of blocks if it is large)
   and every pair in it is verified by its exact overlap.

Nothing is sampled and no partner list is cut: every pair with J >= t is found.
Results are pairs of class representatives with memberships, or one row for each
document with its class and number of links; neither expands copies into pairs.
Sets are sets of 64-bit hashes of n-grams; equal sets are handled once under the
hash of the set. What is shuffled is 4 bytes per n-gram, 6 per shared one, the
texts once and those of the sets in bins a second time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrays import chunks, mix, shingles, word_hashes
from lodestone.operators.components import components
from lodestone.runtime import drop_ids, materialise

RATIO = 2
"""A size range spans this factor, beside the smaller partners from all ranges below."""


_PAIRED, _PAIRS = 64, 4_000_000
"""Sets that hold a common element in their prefixes are looked at in pairs if they are at most so many; and so many pairs a cell."""

_PIECE = 16_000_000
"""Bytes of blobs that a mapper hands on at once."""

_CHARS = 250_000
"""Characters that are hashed at once; what is held beside them is some 80 bytes for each."""

_EDGES = 1_000_000
"""Edges whose components one task finds, with some 100 bytes for each; more go through rounds of tables."""

_KEYS = 1 << 24
"""Group numbers of one size range; a range has RATIO**level // group_tokens groups, far fewer for any text."""


def groups_of(level: int, group_tokens: int) -> int:
    """Number of universe groups of the size range [RATIO**level, RATIO**(level + 1))."""
    return int(min(_KEYS, max(1, RATIO**level // group_tokens)))


def allowed(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Largest symmetric difference at Jaccard >= threshold for a sum of two sizes."""
    return np.floor((1 - threshold) / (1 + threshold) * sizes + 1e-9)


def token_sets(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of all texts, ascending within each; how many each has)."""
    pieces = [_token_sets(texts[a:b], n) for a, b in chunks(texts, _CHARS)] or [_token_sets([], n)]
    return np.concatenate([t for t, _ in pieces]), np.concatenate([many for _, many in pieces])


def _token_sets(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    h, many = shingles(*word_hashes(texts), n)
    row = np.repeat(np.arange(len(texts)), many)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.bincount(row[keep], minlength=len(texts)).astype(np.int64)


def set_ids(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit identity of each set; 0 for empty sets."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = mix(np.add.reduceat(mix(tokens + np.uint64(0x5851F42D4C957F2D)), starts) + counts[full].astype(np.uint64))
    return out


def _packed(many: np.ndarray) -> bytes:
    """Small counts in a byte each, where all of them fit."""
    return many.astype(np.uint8 if not len(many) or many.max() < 256 else np.uint32).tobytes()


def _unpacked(blob: bytes, sets: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint8 if len(blob) == sets else np.uint32).astype(np.int64)


def frequencies(tokens: np.ndarray, slices: int = 16) -> np.ndarray:
    """How often each token occurs, up to 65535; in slices of the token range, so that little is held beside them."""
    out = np.empty(len(tokens), np.uint16)
    part = (tokens >> np.uint32(28)).astype(np.uint8)
    for k in range(slices):
        at = np.flatnonzero(part == k).astype(np.uint32)
        if not len(at):
            continue
        key = (tokens[at].astype(np.uint64) << np.uint64(32)) | at
        key.sort()
        high = (key >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        many = np.diff(np.append(first, len(key)))
        out[key.astype(np.uint32)] = np.repeat(np.minimum(many, 65535), many)
    return out


def _cells(n: int, cells: int):
    """Batches of (doc_id, text) -> blobs of set parts, one per (chunk, cell of the universe)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for rows in batches:
            texts = [t if isinstance(t, str) else None for t in rows["text"]]
            ids = rows["doc_id"].to_numpy(np.int64)
            for a, b in chunks(texts, 4_000_000):
                tokens, size = token_sets(texts[a:b], n)
                full = size > 0
                if not full.any():
                    continue
                sid, docs, size = set_ids(tokens, size)[full], ids[a:b][full], size[full]
                number += 1
                name = mix(np.array([number], np.uint64) + mix(sid + np.arange(len(sid), dtype=np.uint64)).sum()).view(np.int64)[0]
                cell = ((tokens >> np.uint64(34)) % np.uint64(cells)).astype(np.uint16 if cells <= 65536 else np.int64)
                order = np.argsort(cell, kind="stable")
                low, owner = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], np.repeat(np.arange(len(sid)), size)[order]
                cut = np.searchsorted(cell[order], np.arange(cells + 1))
                out = []
                # what belongs to no cell goes by a negative one that few chunks have, so that no cell holds it for the whole corpus
                out.append((-1 - int(name) % cells, name, len(sid), None, None, sid.tobytes(), size.astype(np.uint32).tobytes(), docs.tobytes()))
                for j in range(cells):
                    x, y = cut[j], cut[j + 1]
                    out.append((j, name, len(sid), _packed(np.bincount(owner[x:y], minlength=len(sid))), low[x:y].tobytes(), None, None, None))
                yield pd.DataFrame(out, columns=["cell", "chunk", "sets", "many", "tokens", "sid", "size", "ids"])

    return run


def _weigh(rows: pd.DataFrame) -> pd.DataFrame:
    """Blobs of one cell -> the same less the elements that one row alone holds, each of the others with its frequency."""
    if rows["cell"].iat[0] < 0:
        return rows.assign(weights=None)[["cell", "chunk", "sets", "many", "tokens", "weights", "sid", "size", "ids"]]
    tokens = np.frombuffer(b"".join(rows["tokens"]), np.uint32)
    every, x, left, kept, weights = frequencies(tokens), 0, [], [], []
    for sets, many, blob in zip(rows["sets"], rows["many"], rows["tokens"]):
        y = x + len(blob) // 4
        shared = every[x:y] > 1
        left.append(_packed(np.bincount(np.repeat(np.arange(sets), _unpacked(many, sets))[shared], minlength=sets)))
        kept.append(tokens[x:y][shared].tobytes())
        weights.append(every[x:y][shared].tobytes())
        x = y
    return rows.assign(many=left, tokens=kept, weights=weights)[["cell", "chunk", "sets", "many", "tokens", "weights", "sid", "size", "ids"]]


def _widths(shared: np.ndarray) -> np.ndarray:
    """Bytes of the parities of so many elements: a power of 2, from 8 to 4096, of 4 bits or more an element if that is enough."""
    return (1 << np.ceil(np.log2(np.clip(shared / 2, 8, 4096))).astype(np.int64)).astype(np.int64)


def sketches(owner: np.ndarray, cell: np.ndarray, low: np.ndarray, shared: np.ndarray) -> bytes:
    """Parities of the elements (cell, low) of each set by hash, set after set; owner ascends.

    The parities of two sets differ in no more places than the sets in elements;
    those of half the width are the one half XOR the other.
    """
    width = _widths(shared) * 8
    base = np.cumsum(width) - width
    place = mix((cell.astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64)).view(np.int64) & (width - 1)[owner]
    odd = np.bincount(base[owner] + place, minlength=int(width.sum())).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def _prefixes(threshold: float, cells: int):
    """All cells of one chunk -> blobs of the prefixes of its sets, one per cell, and at cell -1 the sets that may have a partner."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        own, rows = rows.iloc[0], rows.iloc[1:]
        if own["cell"] >= 0 or rows["cell"].tolist() != list(range(cells)):
            raise RuntimeError("a chunk came back in part: its task was repeated over other rows")
        sets = int(own["sets"])
        sid, size, ids = np.frombuffer(own["sid"], np.int64), np.frombuffer(own["size"], np.uint32).astype(np.int64), np.frombuffer(own["ids"], np.int64)
        owner = np.concatenate([np.repeat(np.arange(sets), _unpacked(m, sets)) for m in rows["many"]])
        low, weight = np.frombuffer(b"".join(rows["tokens"]), np.uint32), np.frombuffer(b"".join(rows["weights"]), np.uint16)
        cell = np.repeat(np.arange(cells), [len(t) // 4 for t in rows["tokens"]])
        shared = np.bincount(owner, minlength=sets)
        least = np.maximum(1, np.ceil((threshold - 1e-9) * size - 1e-9)).astype(np.int64)  # elements that a partner shares
        alive = shared >= least
        pick = alive[owner]
        owner, low, weight, cell = owner[pick], low[pick], weight[pick], cell[pick]
        order = np.lexsort((low, cell, weight, owner))
        owner, low, cell = owner[order], low[order], cell[order]
        sketch = sketches((np.cumsum(alive) - 1)[owner], cell, low, shared[alive])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(shared * alive) - shared * alive, shared * alive)
        pick = place <= (shared - least)[owner]
        owner, low, cell = owner[pick], low[pick], cell[pick]
        order = np.argsort(cell, kind="stable")
        owner, low = owner[order], low[order]
        cut = np.searchsorted(cell[order], np.arange(cells + 1))
        out = [(j, sid[owner[x:y]].tobytes(), low[x:y].tobytes(), None, None, None, None) for j, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
        if alive.any():
            out.append((-1, sid[alive].tobytes(), None, size[alive].astype(np.int32).tobytes(), ids[alive].tobytes(), shared[alive].astype(np.int32).tobytes(), sketch))
        return pd.DataFrame(out, columns=["cell", "sid", "tokens", "size", "ids", "shared", "sketch"])

    return run


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for sid, size, ids in zip(rows["sid"], rows["size"], rows["ids"]):
            yield pd.DataFrame({"doc_id": np.frombuffer(ids, np.int64), "sid": np.frombuffer(sid, np.int64), "size": np.frombuffer(size, np.int32)})


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for sid, size, shared, blob in zip(rows["sid"], rows["size"], rows["shared"], rows["sketch"]):
            shared = np.frombuffer(shared, np.int32)
            ends = np.cumsum(_widths(shared)).tolist()
            parts = [blob[x:y] for x, y in zip([0, *ends], ends)]
            yield pd.DataFrame({"sid": np.frombuffer(sid, np.int64), "size": np.frombuffer(size, np.int32), "shared": shared, "sketch": parts})


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Prefixes of one cell -> pairs of the sets that share an element of them.

    Where many sets share one, it is a spanning forest of them, marked hot.
    """
    sid, which = np.unique(np.frombuffer(b"".join(rows["sid"]), np.int64), return_inverse=True)
    tokens, n = np.frombuffer(b"".join(rows["tokens"]), np.uint32), len(sid)
    order = np.lexsort((which, tokens))
    tokens, which = tokens[order], which[order]
    one = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (which[1:] != which[:-1])])  # equal sets come from many rows
    tokens, which = tokens[one], which[one]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    many = np.diff(np.append(first, len(which)))
    left, pairs = _PAIRS, [np.zeros(0, np.int64)]
    hot = many > _PAIRED
    for m in range(2, _PAIRED + 1):
        at = first[many == m]
        fit = left // (m * (m - 1) // 2)
        if len(at) > fit:
            hot |= (many == m) & (np.cumsum(many == m) > fit)
            at = at[:fit]
        left -= len(at) * (m * (m - 1) // 2)
        for i in range(m - 1):
            x = which[at + i]
            pairs.append(np.unique(np.concatenate([x * n + which[at + j] for j in range(i + 1, m)])))
    pair = np.unique(np.concatenate(pairs))
    forest = _Forest(n)
    start, count = first[hot], many[hot]
    forest.join(which[_ranges(start, count)], np.repeat(which[start], count))
    child = np.flatnonzero(forest.root != np.arange(n))
    return pd.DataFrame({"a": sid[np.append(pair // n, forest.root[child])], "b": sid[np.append(pair % n, child)], "hot": np.arange(len(pair) + len(child)) >= len(pair)})


def _close(threshold: float):
    """Pairs with sizes and parities -> those whose sets may be near enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            size = [rows[c].to_numpy(np.int64) for c in ("size_a", "size_b")]
            least = sum(size) - rows["shared_a"].to_numpy(np.int64) - rows["shared_b"].to_numpy(np.int64)  # no other set holds these
            wide = np.stack([rows[c].str.len().to_numpy(np.int64) for c in ("sketch_a", "sketch_b")], axis=1).reshape(-1, 2)
            for kind in np.unique(wide, axis=0):
                at = np.flatnonzero((wide == kind).all(axis=1))
                parity = [np.frombuffer(b"".join(rows[c].iloc[at]), np.uint8).reshape(len(at), -1) for c in ("sketch_a", "sketch_b")]
                for k in (0, 1):
                    while parity[k].shape[1] > kind.min():
                        half = parity[k].shape[1] // 2
                        parity[k] = parity[k][:, :half] ^ parity[k][:, half:]
                least[at] += np.bitwise_count(parity[0] ^ parity[1]).sum(axis=1, dtype=np.int64)
            good = (least <= allowed(sum(size), threshold)) & (np.minimum(*size) >= threshold * np.maximum(*size) - 1e-9)
            yield rows.loc[good, ["a", "b"]]

    return run


def _spread(n: int, threshold: float, group_tokens: int):
    """Placed texts -> blobs of set parts, one per (chunk, bin, pair of blocks, range, group)."""
    columns = ["bin", "low", "high", "key", "sid", "size", "part", "tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows["text"].tolist()
            for a, b in chunks(texts, 4_000_000):
                tokens, size = token_sets(texts[a:b], n)
                sid = set_ids(tokens, size)
                start = np.cumsum(size) - size
                # another row with the same doc_id may hold another text
                usable = (size > 0) & (sid.view(np.int64) == rows["sid"].to_numpy()[a:b])
                level = np.floor(np.log(np.maximum(size, 1)) / np.log(RATIO) + 1e-12).astype(np.int64)
                level += (RATIO ** (level + 1) <= size).astype(np.int64) - (RATIO**level > size).astype(np.int64)
                own, blocks, block = (rows[c].to_numpy()[a:b] for c in ("bin", "blocks", "block"))
                mine = np.flatnonzero(usable)
                mine = mine[np.lexsort((mine, level[mine], block[mine], own[mine]))]
                kind = np.stack([own[mine], block[mine], level[mine]], axis=1)
                cut = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]).any(axis=1), [True]])) if len(mine) else []
                out, held = [], 0
                for x, y in zip(cut, cut[1:]):
                    where, of, k, many_blocks = *kind[x].tolist(), int(blocks[mine[x]])
                    for at in itertools.count(k):  # the ranges above whose sets it may be near to
                        members = mine[x:y]
                        if at > k:
                            members = members[size[members] >= threshold * RATIO**at - 1e-9]
                        if not len(members):
                            break
                        many = groups_of(at, group_tokens)
                        t, w = tokens[_ranges(start[members], size[members])], np.repeat(np.arange(len(members)), size[members])
                        g = ((t >> np.uint64(34)) % np.uint64(many)).astype(np.int64)
                        low = (t & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                        order = np.lexsort((low, w, g))
                        g, w, low = g[order], w[order], low[order]
                        edge = np.searchsorted(g, np.arange(many + 1))
                        for j in range(many):
                            p, q = edge[j], edge[j + 1]
                            part = np.bincount(w[p:q], minlength=len(members)).astype(np.uint32).tobytes()
                            blob = (sid[members].tobytes(), size[members].astype(np.uint32).tobytes(), part, low[p:q].tobytes())
                            for z in range(many_blocks):
                                out.append((where, min(of, z), max(of, z), at * _KEYS + j, *blob))
                                held += sum(map(len, blob))
                                if held > _PIECE:
                                    yield pd.DataFrame(out, columns=columns)
                                    out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return run


class _Forest:
    """Components under repeated batches of edges."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (r := self.root[self.root] != self.root).any():
                self.root[r] = self.root[self.root[r]]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of arange(first[i], first[i] + count[i])."""
    base = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(base - first, count)


def _shared(tokens: np.ndarray, slices: int = 16) -> np.ndarray:
    """For each token whether another set holds it too; in slices of the token range, so that little is held beside them."""
    out = np.zeros(len(tokens), bool)
    part = (tokens >> np.uint32(28)).astype(np.uint8)
    for k in range(slices):
        at = np.flatnonzero(part == k).astype(np.uint32)
        key = tokens[at].astype(np.uint64)
        key <<= np.uint64(32)
        key |= at
        key.sort()
        high = (key >> np.uint64(32)).astype(np.uint32)
        same = np.zeros(len(key), bool)
        same[1:] = high[1:] == high[:-1]
        same[:-1] |= same[1:].copy()
        out[key[same].astype(np.uint32)] = True
    return out


def _parities(n: int, owner: np.ndarray, value: np.ndarray, part: np.ndarray) -> np.ndarray:
    """4 words for each set: the parity of its elements in each of 256 cells."""
    out, ends = np.empty((4, n), np.uint64), np.cumsum(part)
    for a in range(0, n, 4096):
        b = min(n, a + 4096)
        x, y = int(ends[a] - part[a]), int(ends[b - 1])
        cells = np.bincount((owner[x:y] - a) * 256 + (value[x:y] >> np.uint64(56)).astype(np.int64), minlength=(b - a) * 256).astype(np.uint8) & 1
        out[:, a:b] = np.packbits(cells.reshape(b - a, 256), axis=1).view(np.uint64).T
    return out


def local_pairs(size: np.ndarray, part: np.ndarray, tokens: np.ndarray, groups: int, threshold: float) -> np.ndarray:
    """Component of each set in the graph of pairs whose parts differ by at most H / groups.

    size: whole sizes of distinct sets; part: elements of each in this group;
    tokens: those elements as uint32, set after set, ascending within each.
    """
    n = len(size)
    forest = _Forest(n)
    rate = (1 - threshold) / (1 + threshold) / groups
    alive = np.arange(n)
    for _ in range(2):  # parts that nothing can be near; each round makes more elements unshared
        if not len(alive):
            return forest.root
        owner = np.repeat(np.arange(len(alive), dtype=np.int32), part[alive])
        unshared = part[alive] - np.bincount(owner[np.flatnonzero(_shared(tokens))], minlength=len(alive))
        room = rate * size[alive]
        least = part[alive] - room
        step = np.log(1.05)
        place = np.floor(np.log(size[alive]) / step).astype(np.int64)
        floor_of = np.full(int(place.max()) + 1, np.inf)
        np.minimum.at(floor_of, place, least)
        reach = int(np.ceil(np.log(1 / threshold) / step)) + 1
        padded = np.concatenate([np.full(reach, np.inf), floor_of, np.full(reach, np.inf)])
        near = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1).min(axis=1)
        keep = near[place] <= room + part[alive] - 2 * unshared + 1e-9
        tokens = tokens[keep[owner]]
        alive = alive[keep]
    size, part = size[alive].astype(np.int64), part[alive].astype(np.int64)
    n = len(size)
    if n < 2:
        return forest.root
    start = np.cumsum(part) - part
    owner = np.repeat(np.arange(n), part)
    sorted_keys = (owner.astype(np.uint64) << np.uint64(32)) | tokens
    value = mix(tokens.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))

    common = np.bincount(owner[_shared(tokens)], minlength=n)
    # parity of the elements in each of 256 cells: two parts differ in at least as many elements as cells
    parity = _parities(n, owner, value, part)

    def limits(a, b):
        return np.floor(allowed(size[a] + size[b], threshold) / groups + 1e-9)

    def possible(a, b):
        """Pairs that lower bounds of the difference don't rule out."""
        limit = limits(a, b)
        fits = part[a] + part[b] - 2 * np.minimum(common[a], common[b]) <= limit
        fits &= np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
        a, b, limit = a[fits], b[fits], limit[fits]
        least = np.zeros(len(a), np.int64)
        for word in parity:
            least += np.bitwise_count(word[a] ^ word[b])
            fits = least <= limit
            a, b, limit, least = a[fits], b[fits], limit[fits], least[fits]
        return a, b

    def near_enough(a, b):
        """Pairs whose parts differ by little enough."""
        limit = limits(a, b)
        which = np.repeat(np.arange(len(a)), part[a])
        query = (b[which].astype(np.uint64) << np.uint64(32)) | tokens[_ranges(start[a], part[a])]
        at = np.searchsorted(sorted_keys, query)
        hit = sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == query if len(sorted_keys) else np.zeros(len(query), bool)
        both = np.bincount(which[hit], minlength=len(a))
        good = part[a] + part[b] - 2 * both <= limit
        return a[good], b[good]

    def link(a, b):
        x, y = forest.root[alive[a]], forest.root[alive[b]]
        apart = (x != y) & (a != b)
        if not apart.any():
            return
        a, b = possible(a[apart], b[apart])
        pair = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
        for k in range(0, len(pair), 200_000):
            p, q = near_enough(pair[k : k + 200_000] // n, pair[k : k + 200_000] % n)
            forest.join(alive[p], alive[q])

    def search(lookups):
        """lookups: (probing set, its key, sorted keys of the index, sets of those) of each kind of match."""
        spans = []
        for probe, key, index, sets in lookups:
            lo, hi = np.searchsorted(index, key), np.searchsorted(index, key, side="right")
            some = hi > lo
            spans.append((probe[some], lo[some], (hi - lo)[some], sets))
        for probe, lo, _, sets in spans:  # one partner of each look-up: joins most true groups
            link(probe, sets[lo])
        for probe, lo, many, sets in spans:  # then all
            edges = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()), 2_000_000)).tolist() + [len(many)]
            for x, y in zip(edges, edges[1:]):
                link(np.repeat(probe[x:y], many[x:y]), sets[_ranges(lo[x:y], many[x:y])])

    low = int(size.min())
    while low <= size.max():  # bands of probing sets; partners are at most as large
        high = max(low + 1, int(np.ceil(low / threshold)))
        probes = np.flatnonzero((size >= low) & (size < high))
        if len(probes):
            index = np.flatnonzero((size >= threshold * low - 1e-9) & (size < high))
            need = np.floor(allowed(2 * size[probes], threshold) / groups + 1e-9).astype(np.int64) + 1
            segments = int(max(1, np.ceil(0.6 * need.max())))
            mine = _ranges(start[index], part[index])
            who = np.repeat(np.arange(len(index)), part[index])
            seg = ((tokens[mine].astype(np.uint64) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
            cell = who * segments + seg
            whole = np.zeros(len(index) * segments, np.uint64)
            if len(cell):
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                whole[cell[first]] = np.add.reduceat(value[mine], first)
            salt = mix(np.arange(segments, dtype=np.uint64) + np.uint64(1))
            full = mix(whole ^ np.tile(salt, len(index)))
            less = mix((whole[cell] - value[mine]) ^ salt[seg])
            by_full, by_less = np.argsort(full, kind="stable"), np.argsort(less, kind="stable")
            fulls, lesses = full[by_full], less[by_less]
            full_sets, less_sets = index[by_full // segments], index[who[by_less]]

            def count(keys, key):
                return np.searchsorted(keys, key, side="right") - np.searchsorted(keys, key)

            zero = count(fulls, full).astype(np.int64) - 1
            one = count(lesses, full).astype(np.int64) + np.bincount(cell, count(fulls, less), len(full)).astype(np.int64)
            rows = np.searchsorted(index, probes)
            zero, one = zero.reshape(-1, segments)[rows], one.reshape(-1, segments)[rows]
            cost = np.hstack([zero, np.maximum(zero, one)])
            rank = np.empty_like(cost)
            np.put_along_axis(rank, np.argsort(cost, axis=1, kind="stable"), np.arange(cost.shape[1])[None, :], axis=1)
            taken = rank < need[:, None]
            equal, near = taken[:, :segments], taken[:, segments:]
            here = full.reshape(-1, segments)[rows]
            is_near = np.zeros((len(index), segments), bool)
            is_near[rows] = near
            mark = is_near.ravel()[cell]
            r0, s0 = np.nonzero(equal & (zero > 0))
            r1, s1 = np.nonzero(near)
            search(
                [
                    (probes[r0], here[r0, s0], fulls, full_sets),
                    (index[who[mark]], less[mark], fulls, full_sets),
                    (probes[r1], here[r1, s1], lesses, less_sets),
                ]
            )
        low = high
    return forest.root


def _match(threshold: float, group_tokens: int):
    """Blobs of one (bin, pair of blocks, range, group) -> edges (a, b) between sets."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        level = int(key[3]) // _KEYS
        # the blobs go as they are read: they are most of what the task holds
        sid, size, part, tokens = (np.frombuffer(b"".join(rows.pop(c)), kind) for c, kind in (("sid", np.uint64), ("size", np.uint32), ("part", np.uint32), ("tokens", np.uint32)))
        size, part = size.astype(np.int64), part.astype(np.int64)
        _, first = np.unique(sid, return_index=True)
        if len(first) < len(sid):
            one = np.zeros(len(sid), bool)
            one[first] = True
            tokens = tokens[np.repeat(one, part)]
        first.sort()
        ids = sid[first].view(np.int64)
        root = local_pairs(size[first], part[first], tokens, groups_of(level, group_tokens), threshold)
        child = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": ids[child], "b": ids[root[child]]})

    return run


def unit_overlaps(tokens: list[np.ndarray], across: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlap sizes of all pairs i < j of the sets that share an element; with `across` only of pairs where it differs."""
    k = len(tokens)
    who = np.repeat(np.arange(k), [len(t) for t in tokens])
    every = np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    many = np.diff(np.append(first, len(every)))
    overlap = np.zeros((k, k), np.float32)
    column = np.repeat(np.arange(len(first)), many)
    for wide in (False, True):
        pick = (many > 1) & ((many > 4) == wide)
        if not pick.any():
            continue
        if wide:
            number = np.full(len(first), -1)
            number[pick] = np.arange(int(pick.sum()))
            mine = pick[column]
            c, w = number[column[mine]], who[mine]
            for a in range(0, int(pick.sum()), 4096):
                inside = (c >= a) & (c < a + 4096)
                x = np.zeros((k, min(4096, int(pick.sum()) - a)), np.float32)
                x[w[inside], c[inside] - a] = 1
                overlap += x @ x.T
        else:
            for m in (2, 3, 4):
                at = first[pick & (many == m)]
                for i in range(m):
                    for j in range(i + 1, m):
                        overlap += np.bincount(who[at + i] * k + who[at + j], minlength=k * k).reshape(k, k)
    # elements held by few sets were counted from the earlier to the later row only
    a, b = np.nonzero(np.triu(overlap, 1))
    if across is not None:
        differ = across[a] != across[b]
        a, b = a[differ], b[differ]
    return a, b, overlap[a, b]


def _verify(threshold: float, forest: bool):
    """Whole sets of several components -> (a, b, jaccard) of their pairs, or of a spanning forest of them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["label", "low", "high", "sid"]).sort_values(["label", "low", "high", "sid"])
        unit = rows[["label", "low", "high"]].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(axis=1), [True]])) if len(rows) else []
        sid, size, block = rows["sid"].to_numpy(), rows["size"].to_numpy(), rows["block"].to_numpy()
        blobs = rows["tokens"].tolist()
        out = []
        for x, y in zip(cut, cut[1:]):
            if y - x < 2:
                continue
            a, b, both = unit_overlaps([np.frombuffer(t, np.uint64) for t in blobs[x:y]], block[x:y] if unit[x, 1] != unit[x, 2] else None)
            jaccard = both / (size[x:y][a] + size[x:y][b] - both)
            good = jaccard >= threshold - 1e-9
            a, b, jaccard = a[good], b[good], jaccard[good]
            if forest:
                f = _Forest(y - x)
                f.join(a, b)
                a = np.flatnonzero(f.root != np.arange(y - x))
                b, jaccard = f.root[a], np.ones(len(a))
            out.append((sid[x:y][a], sid[x:y][b], np.asarray(jaccard, float)))
        a, b, j = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64), "jaccard": j})

    return run


def _sets(n: int):
    """Texts with the place of their set -> the set, once for every unit it takes part in."""
    columns = ["label", "low", "high", "block", "sid", "size", "tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, out, held = rows["text"].tolist(), [], 0
            for a, b in chunks(texts, 4_000_000):
                tokens, size = token_sets(texts[a:b], n)
                ids = set_ids(tokens, size).view(np.int64)
                ends = np.cumsum(size)
                same = ids == rows["sid"].to_numpy()[a:b]  # another row with the same doc_id may hold another text
                for i in np.flatnonzero(same):
                    own, many, block = rows["label"].iat[a + i], rows["blocks"].iat[a + i], rows["block"].iat[a + i]
                    blob = tokens[ends[i] - size[i] : ends[i]].tobytes()
                    for k in range(many):
                        out.append((own, min(block, k), max(block, k), block, ids[i], size[i], blob))
                        held += len(blob)
                        if held > _PIECE:
                            yield pd.DataFrame(out, columns=columns)
                            out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return run


def _labelled(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges -> (node, label) as of components()."""
    node, ends = np.unique(np.concatenate([rows.pop("a").to_numpy(), rows.pop("b").to_numpy()]), return_inverse=True)
    forest, many = _Forest(len(node)), len(ends) // 2
    forest.join(ends[:many], ends[many:])
    return pd.DataFrame({"node": node, "label": node[forest.root]})


def _labels(edges: DataFrame) -> DataFrame:
    """components(edges) of a written table; of few edges without a table for each round."""
    if edges.limit(_EDGES + 1).count() > _EDGES:
        return components(edges)
    return materialise(edges.where("a <> b").groupBy().applyInPandas(_labelled, "node long, label long"), "labels")


def _written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table of files that are worth their making, instead of one from each task: where nothing but programs can set a file's mode, each file takes three of them."""
    return materialise(df.hint("rebalance", *by), name)


def _near(met: DataFrame, prefixes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of met(a, b, hot): the hot ones, and of the others those that parities don't rule out."""
    every = prefixes.where("cell < 0").select("sid", "size", "shared", "sketch").mapInPandas(_sketched, "sid long, size int, shared int, sketch binary")
    every = materialise(every.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("size", "shared", "sketch"))), "sketches")
    pairs = met.where("not hot").select("a", "b")
    for x in "ab":
        pairs = pairs.join(every.select(F.col("sid").alias(f"sid_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "shared", "sketch"))), F.col(x) == F.col(f"sid_{x}")).drop(f"sid_{x}")
    near = pairs.mapInPandas(_close(threshold), "a long, b long")
    return _written(near.unionByName(met.where("hot").select("a", "b")), "near")


def _placed(lean: DataFrame, n: int, threshold: float, cell_chars: int, bin_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(members(doc_id, sid), texts(sid, _doc, size, bin, blocks, block, text)): the sets that may have a partner, and a text of each, in bins that no pair leaves."""
    spark = lean.sparkSession
    chars = lean.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    cells = max(12, -(-chars // cell_chars))
    own = "sid binary, size binary, ids binary"
    blobs = lean.mapInPandas(_cells(n, cells), f"cell int, chunk long, sets int, many binary, tokens binary, {own}")
    weighed = blobs.groupBy("cell").applyInPandas(_weigh, f"cell int, chunk long, sets int, many binary, tokens binary, weights binary, {own}")
    prefixes = _written(weighed.groupBy("chunk").applyInPandas(_prefixes(threshold, cells), "cell int, sid binary, tokens binary, size binary, ids binary, shared binary, sketch binary"), "prefixes", "cell")
    members = materialise(prefixes.where("cell < 0").select("sid", "size", "ids").mapInPandas(_members, "doc_id long, sid long, size int").distinct(), "members")
    met = prefixes.where("cell >= 0").select("cell", "sid", "tokens").groupBy("cell").applyInPandas(_meet, "a long, b long, hot boolean")
    labels = _labels(_near(materialise(met.groupBy("a", "b").agg(F.max("hot").alias("hot")), "met"), prefixes, threshold))
    first = members.groupBy("sid").agg(F.min("doc_id").alias("_doc"), F.max("size").alias("size")).join(labels, F.col("sid") == F.col("node")).drop("node")
    first = materialise(first, "first")
    bins = max(1, -(-first.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // bin_tokens))
    # a component beyond a bin is joined in pairs of blocks
    heavy = first.groupBy("label").agg(F.ceil(F.sum("size") / bin_tokens).cast("int").alias("blocks"))
    where = F.when(F.col("blocks") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bins)))
    placed = first.join(heavy, "label").select("sid", "_doc", "size", where.alias("bin"), "blocks", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"))
    texts = lean.join(placed.hint("shuffle_hash"), F.col("doc_id") == F.col("_doc")).select("sid", "_doc", "size", "bin", "blocks", "block", "text")
    return members.select("doc_id", "sid"), materialise(texts.repartition("bin", "block"), "texts")


def _parts(texts: DataFrame, n: int, threshold: float, group_tokens: int) -> DataFrame:
    """What the group tasks hold: rows of one (bin, low, high, key) meet."""
    kinds = "bin long, low int, high int, key long, sid binary, size binary, part binary, tokens binary"
    return texts.select("sid", "bin", "blocks", "block", "text").mapInPandas(_spread(n, threshold, group_tokens), kinds)


def _matched(docs: DataFrame, n: int, threshold: float, group_tokens: int, unit_tokens: int, unit_sets: int, forest: bool, cell_chars: int = 32_000_000, bin_tokens: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(members(doc_id, sid), verified(a, b, jaccard) between sets)."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")
    spark = docs.sparkSession
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null and text is not null")
    members, texts = _placed(lean, n, threshold, cell_chars, bin_tokens)
    found = _parts(texts, n, threshold, group_tokens).groupBy("bin", "low", "high", "key").applyInPandas(_match(threshold, group_tokens), "a long, b long")
    labels = _labels(_written(found, "found"))
    first = texts.select("sid", "size").distinct().join(labels, F.col("sid") == F.col("node"))
    # a component of many elements or sets is verified in pairs of blocks, each a bounded piece of work
    blocks = first.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / unit_tokens), F.ceil(F.count("*") / unit_sets)).cast("int").alias("blocks"))
    placed = first.join(blocks, "label").select("label", F.col("sid").alias("_sid"), "size", "blocks", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"))
    placed = materialise(placed, "placed")
    near = texts.select("sid", "text").join(placed.hint("shuffle_hash"), F.col("sid") == F.col("_sid")).select("label", "sid", "blocks", "block", "text")
    units = near.mapInPandas(_sets(n), "label long, low int, high int, block int, sid long, size int, tokens binary")
    held = placed.agg(F.coalesce(F.sum(F.col("size") * F.col("blocks")), F.lit(0))).first()[0]
    spread = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // unit_tokens))
    units = units.withColumn("bucket", F.pmod(F.xxhash64("label", "low", "high"), F.lit(spread)))
    return members, units.groupBy("bucket").applyInPandas(_verify(threshold, forest), "a long, b long, jaccard double")


def similar_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.55, group_tokens: int = 64, unit_tokens: int = 2_000_000, unit_sets: int = 1500, **bounds) -> DataFrame:
    """doc_id_a < doc_id_b and jaccard (rounded to 6 places) of the documents of docs(doc_id, text, ...) with Jaccard >= threshold.

    A set holds the distinct n-grams of lower-cased words (runs of letters,
    digits, underscores and non-ASCII characters); a text of fewer than n words
    is one n-gram. Documents with the same set form a class, represented by its
    lowest id. The result holds every pair of representatives that is near
    enough, and the membership of every other document: the pair of its
    representative and itself, with 1.0. Two documents are near by what their
    representatives are.

    Null ids, null texts and texts without a word pair with nothing. Repeated
    rows count once; rows that share an id but not the text belong to a class
    each, pair with others by the higher value and never with each other. An
    empty table gives an empty result. Other columns are not read.
    """
    members, verified = _matched(docs, n, threshold, group_tokens, unit_tokens, unit_sets, False, **bounds)
    verified = _written(verified, "pairs")
    classes = members.groupBy("sid").agg(F.min("doc_id").alias("rep"))
    left, right = (classes.select(F.col("rep").alias(f"d{x}"), F.col("sid").alias(f"s{x}")) for x in "ab")
    near = verified.join(left, F.col("a") == F.col("sa")).join(right, F.col("b") == F.col("sb")).select("da", "db", "jaccard")
    same = members.join(classes, "sid").where("doc_id <> rep").select(F.col("rep").alias("da"), F.col("doc_id").alias("db"), F.lit(1.0).alias("jaccard"))
    # each pair of documents comes once, as each document has one set, unless ids repeat
    pairs = near.unionByName(same).where("da <> db").select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b"), F.round("jaccard", 6).alias("jaccard"))
    repeats = members.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return pairs.groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard")) if repeats else pairs


def near_copies(docs: DataFrame, n: int = 3, threshold: float = 0.55, group_tokens: int = 64, unit_tokens: int = 2_000_000, unit_sets: int = 1500, **bounds) -> DataFrame:
    """(doc_id, keeper) of every document that similar_pairs() connects, directly or through others, to a document of lower id.

    Null ids, null texts, texts without a word, repeated rows, very long texts,
    an empty table and other columns are treated as there.
    """
    members, verified = _matched(docs, n, threshold, group_tokens, unit_tokens, unit_sets, True, **bounds)
    labels = _labels(_written(verified.select("a", "b"), "links"))
    grouped = members.join(labels, F.col("sid") == F.col("node"), "left").select("doc_id", F.coalesce("label", "sid").alias("label"))
    keeper = grouped.groupBy("label").agg(F.min("doc_id").alias("keeper"))
    return grouped.join(keeper, "label").where("doc_id <> keeper").groupBy("doc_id").agg(F.min("keeper").alias("keeper"))


def near_classes(docs: DataFrame, n: int = 3, threshold: float = 0.55, group_tokens: int = 64, unit_tokens: int = 2_000_000, unit_sets: int = 1500, **bounds) -> DataFrame:
    """doc_id, class_id, links: one row for each document of docs(doc_id, text, ...).

    class_id is the lowest id among the documents that it is connected to by
    pairs with Jaccard >= threshold or by equal sets, directly or through others;
    links is the number of different sets that its own is near enough to. Every
    pair is verified; sets are those of similar_pairs().

    Rows with a null id have no row. Null texts and texts without a word are
    alone: their own class, no link. Repeated rows count once; an id with several
    texts takes the lowest class of them and the links of all. An empty table
    gives an empty result. Other columns are not read.
    """
    members, verified = _matched(docs, n, threshold, group_tokens, unit_tokens, unit_sets, False, **bounds)
    verified = _written(verified.select("a", "b"), "links")
    labels = _labels(verified)
    links = verified.select(F.explode(F.array("a", "b")).alias("linked")).groupBy("linked").agg(F.count("*").alias("links"))
    grouped = members.join(labels, F.col("sid") == F.col("node"), "left").join(links, F.col("sid") == F.col("linked"), "left")
    grouped = grouped.select("doc_id", F.coalesce("label", "sid").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = grouped.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    placed = grouped.join(classes, "label").select("doc_id", "class_id", "links")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    alone = every.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    # each document's own row is above no class of it and adds no link
    return placed.unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns as they are, less those near_copies() names.

    Rows with null ids or without words stay, as do all rows of an id that stays
    (repeated rows are one document). An empty table gives an empty result.
    """
    gone = near_copies(docs, **options)
    return drop_ids(docs, gone.select("doc_id"))
