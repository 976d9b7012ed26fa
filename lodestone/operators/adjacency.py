"""Neighbour lists too long for a task's memory: packed by many tasks, laid out in files of the worker by the one that walks them."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELLS = 512
"""So many neighbours in a packed row at most: batches hold thousands of rows."""
BLOCK = 1 << 20
"""Neighbours that are read at once."""
PACKED = "grp long, nodes binary, counts binary, start long, neighbours binary, cells binary"


def pack(rows: DataFrame, order: list[str]) -> DataFrame:
    """PACKED rows of rows(grp long, node long, neighbour long, value double): a node's neighbours follow each other by `order`.

    The rows of a node are sorted by one task, a group's nodes by all of them; `start` is where in its first node's list a row begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            grp, node, near, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "node", "neighbour", "value"))
            if not len(grp):
                continue
            fresh = np.flatnonzero(np.diff(grp)) + 1
            cuts = np.unique(np.concatenate([np.arange(0, len(grp), CELLS), fresh, [len(grp)]]))
            out: dict[str, list] = {c: [] for c in ("grp", "nodes", "counts", "start", "neighbours", "cells")}
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                runs = np.concatenate([[0], np.flatnonzero(np.diff(node[a:b])) + 1])
                counts = np.diff(np.append(runs, b - a))
                seen = seen if (grp[a], node[a]) == last else 0
                for c, x in (("grp", int(grp[a])), ("nodes", node[a:b][runs].astype(np.int64).tobytes()), ("counts", counts.astype(np.int64).tobytes()), ("start", seen)):
                    out[c].append(x)
                out["neighbours"].append(near[a:b].astype(np.int64).tobytes())
                out["cells"].append(value[a:b].astype(np.float64).tobytes())
                seen = int(counts[-1]) + (seen if len(runs) == 1 else 0)
                last = grp[b - 1], node[b - 1]
            kinds = {"grp": pa.int64(), "start": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.binary())) for c, x in out.items()], names=list(out))

    placed = rows.select("grp", "node", "neighbour", "value", *[c for c in order if c not in ("grp", "node", "neighbour", "value")])
    return placed.repartition("grp", "node").sortWithinPartitions("grp", "node", *order).mapInArrow(run, PACKED)


def _file():
    return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


def _read(file, kind) -> np.ndarray:
    file.flush()
    size = os.fstat(file.fileno()).st_size // np.dtype(kind).itemsize
    return np.memmap(file, kind, "r", shape=(size,)) if size else np.zeros(0, kind)


def _bytes(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def blocks(ends: np.ndarray, most: int = 0) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of runs of lists of about `most` cells together; ends holds where each list starts, and the end."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (most or BLOCK), "right")) - 1)
        yield a, min(b, n)
        a = b


def lists(batches: Iterator[pa.RecordBatch], dense: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, nodes, starts, neighbours, values) of each group of PACKED rows, which may come in any order.

    nodes are sorted; node i has the cells starts[i] to starts[i + 1] of the last
    two, which lie in files: memory holds the nodes, not their neighbours. dense
    puts a neighbour's place in nodes for its number.
    """
    near, cells, index = _file(), _file(), []
    for batch in batches:
        if not batch.num_rows:
            continue
        node, count = (_bytes(batch.column(c)).view(np.int64) for c in ("nodes", "counts"))
        at = np.frombuffer(batch.column("nodes").buffers()[1], np.int32)[batch.column("nodes").offset :][: batch.num_rows + 1]
        many = np.diff(at) // 8
        start = np.zeros(len(node), np.int64)
        start[np.cumsum(many) - many] = batch.column("start").to_numpy()
        index.append((np.repeat(batch.column("grp").to_numpy(), many), node.copy(), start, count.copy()))
        near.write(_bytes(batch.column("neighbours")))
        cells.write(_bytes(batch.column("cells")))
    if not index:
        return
    grp, node, start, count = (np.concatenate(x) for x in zip(*index))
    index.clear()
    place = np.cumsum(count) - count
    order = np.lexsort((start, node, grp))
    grp, node, count, place = grp[order], node[order], count[order], place[order]
    del order, start
    near, cells = _read(near, np.int64), _read(cells, np.float64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        first = np.concatenate([[0], np.flatnonzero(np.diff(node[a:b])) + 1])
        nodes = node[a:b][first]
        laid = np.concatenate([[0], np.cumsum(count[a:b])])
        starts = np.append(laid[first], laid[-1])
        kind = np.int32 if dense else np.int64
        x, y = _file(), _file()
        for i, j in blocks(laid):
            many = count[a + i : a + j]
            at = np.repeat(place[a + i : a + j] - (laid[i:j] - laid[i]), many) + np.arange(many.sum())
            found = near[at]
            x.write((np.searchsorted(nodes, found) if dense else found).astype(kind))
            y.write(cells[at])
        yield int(grp[a]), nodes, starts, _read(x, kind), _read(y, np.float64)
