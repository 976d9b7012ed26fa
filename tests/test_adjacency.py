"""Communities and depth-first walks that don't hold their edges in memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.config import CommunityConfig
from lodestone.operators import adjacency, communities, traversal


def packed(rows, cells=7):
    """Batches of PACKED rows of sorted (group, node, neighbour, value), one row of `cells` neighbours each, in a shuffled order."""
    out, begun = [], {}
    for g in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == g]
        for k in range(0, len(own), cells):
            part = own[k : k + cells]
            nodes, counts = np.unique([r[1] for r in part], return_counts=True)
            start = begun.get((g, part[0][1]), 0)
            out.append((g, nodes.tobytes(), counts.tobytes(), start, np.array([r[2] for r in part]).tobytes(), np.array([r[3] for r in part], float).tobytes()))
            for n, c in zip(nodes.tolist(), counts.tolist()):
                begun[g, n] = begun.get((g, n), 0) + c
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    names = ["grp", "nodes", "counts", "start", "neighbours", "cells"]
    for i in np.random.default_rng(1).permutation(len(out)):
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out[i], kinds)], names=names)


def some_rows(groups=3, nodes=20, size=300):
    rng = np.random.default_rng(4)
    rows = {(int(g), int(a) * 3, int(b) * 3) for g, a, b in zip(rng.integers(0, groups, size), rng.integers(0, nodes, size), rng.integers(0, nodes, size))}
    return sorted((g, a, b, (a * 7 + b) % 11 / 4) for g, a, b in rows)


def test_lists_come_back_in_order_whatever_the_order_of_their_pieces(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "BLOCK", 13)
    rows = some_rows()
    frame = spark.createDataFrame(rows, "grp long, node long, neighbour long, value double")
    monkeypatch.setattr(adjacency, "CELLS", 5)
    own = [pa.RecordBatch.from_pandas(frame.transform(lambda d: adjacency.pack(d, ["neighbour"])).toPandas())]
    for batches in (packed(rows), own):
        got = []
        for g, nodes, starts, near, value in adjacency.lists(batches, False):
            got += [(g, int(n), int(near[k]), float(value[k])) for i, n in enumerate(nodes) for k in range(starts[i], starts[i + 1])]
        assert got == rows


def test_passes_hold_nodes_not_edges(monkeypatch):
    n, each = 300, 1000
    rng = np.random.default_rng(2)
    near = np.sort(rng.integers(0, n, (n, each)), axis=1).ravel().astype(np.int32)
    weight = rng.random(n * each)
    monkeypatch.setattr(adjacency, "BLOCK", 5000)
    tracemalloc.start()
    passes = list(communities.sweeps(np.arange(n + 1) * each, near, weight, weight.sum(), CommunityConfig(max_iterations=3)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(passes) > 1 and passes[-1][1] >= passes[0][1]
    assert peak < 4_000_000  # a list of 300,000 pairs is 30 MB


def plain_walk(near, start, limit):
    seen, out, stack = set(), [], [(start, 0, None, None)]
    while stack:
        node, depth, parent, value = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append((node, depth, parent, value))
        if depth < limit:
            stack += [(b, depth + 1, node, v) for b, v in reversed(near.get(node, []))]
    return out[1:]


def test_walks_over_files_as_over_lists():
    rows = [r for r in some_rows(1, 30, 150)]
    near = {}
    for _, a, b, v in rows:
        near.setdefault(a, []).append((b, v))
    (_, nodes, starts, found, value), = adjacency.lists(packed(rows), False)
    for limit in range(6):
        for start in sorted(near)[:5]:
            visited = np.zeros(100, bool)
            visited[start] = True
            got = [(int(x), d, int(p), float(v)) for f, ps, vs, d in traversal._preorder(start, nodes, starts, found, value, visited, limit) for x, p, v in zip(f, ps, vs)]
            assert got == plain_walk(near, start, limit)
