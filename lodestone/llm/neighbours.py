"""Approximate nearest neighbours by collision counting (query-aware hashing,
Huang et al., "Query-aware locality-sensitive hashing").

Every vector is projected on `projections` random lines and the projections are
kept as sorted arrays. A query opens, on each array, a window centred on its own
projection; virtual rehashing widens all windows together by the factor `grow`,
and each widening looks only at the newly covered flanks. A vector that has
fallen into at least `share` of the windows has collided often enough: it is
verified by its true distance. A query ends when `k` verified vectors are
nearer than the current radius over `margin`. At a radius equal to its distance
a vector falls into the share 0.68 of the windows on average and so into 28 of
40 only every other time; at 1.25 times its distance into 0.79 of them, and into
28 of 40 with probability 0.94, whatever the data look like.

A stated set of queries meets all rows, a block of queries with a block of rows,
so a task's memory is bounded; the best k of all blocks are merged at the end.
Work and shuffle grow as queries times rows: with few dimensions less of a row
block falls into the windows, with many nearly all of it does, and no index
changes that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.runtime import materialise

SCHEMA = "query long, vec_id long, neighbour_id long, distance double"


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, data: np.ndarray, projections: int = 40, seed: int = 11):
        self.data = data
        self.lines = np.random.default_rng(seed).standard_normal((projections, data.shape[1]))
        self.placed = np.ascontiguousarray((data @ self.lines.T).T)
        self.order = np.argsort(self.placed, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.placed, self.order, axis=1)
        self.norms = (data**2).sum(axis=1)
        # the same projections in 256 steps, for windows that hold much of the block
        self.least = self.placed.min(axis=1)
        self.step = np.maximum((self.placed.max(axis=1) - self.least) / 255, 1e-300)
        self.codes = np.clip(np.floor((self.placed - self.least[:, None]) / self.step[:, None]), 0, 255).astype(np.uint8)

    def count_windows(self, centre: np.ndarray, half: float, counts: np.ndarray, gap: np.ndarray, inside: np.ndarray) -> bool:
        """Counts, for every row, the windows that hold it, widened to whole steps; whether they hold everything."""
        first = np.floor((centre - half - self.least) / self.step)
        last = np.floor((centre + half - self.least) / self.step)
        low, high = np.clip(first, 0, 255).astype(np.uint8), np.clip(last, 0, 255).astype(np.uint8)
        np.subtract(self.codes, low[:, None], out=gap)  # below the window it wraps around
        np.less_equal(gap, (high - low)[:, None], out=inside)
        inside[(last < 0) | (first > 255)] = False
        np.add.reduce(inside.view(np.uint8), axis=0, dtype=counts.dtype, out=counts)
        return bool(((first <= 0) & (last >= 255)).all())

    def search(self, queries: np.ndarray, skip: np.ndarray, k: int, radius: float, width: float = 2.0, share: float = 0.7, grow: float = 1.25, margin: float = 1.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, data row, squared distance) of up to k neighbours of each query, data rows with skip[query] == their number left out.

        `radius` is where the windows start: half-width radius * width / 2. The
        last widening goes to `margin` times the k-th distance and no further.
        Rows that tie with the k-th are returned too.

        A widening adds one to the counts of the rows on its flanks. Once the
        flanks hold much of the block, the windows of every row are counted
        again, in steps of a 256th of the projections' range (windows widen to
        whole steps, so no collision is lost), and the distances of many queries
        are taken at once.
        """
        n, m = len(self.data), len(self.lines)
        need = int(np.ceil(share * m))
        out_q, out_d, out_s = [], [], []
        centre = queries @ self.lines.T
        counts = np.zeros(n, np.uint8 if m < 256 else np.uint16)
        verified = np.zeros(n, bool)
        gap, inside = np.empty((m, n), np.uint8), np.empty((m, n), bool)
        middle = np.stack([a.searchsorted(centre[:, j]) for j, a in enumerate(self.values)], axis=1)
        many, many_from = None, -64
        for q in range(len(queries)):
            counts[:] = 0
            verified[:] = False
            lo, hi = middle[q].copy(), middle[q].copy()
            r = radius
            seen, dist, every = np.zeros(0, np.int64), np.zeros(0), None
            own = int(skip[q])
            dense = False
            while True:
                half = r * width / 2
                if not dense:
                    left = np.array([a.searchsorted(c - half) for a, c in zip(self.values, centre[q])])
                    right = np.array([a.searchsorted(c + half, side="right") for a, c in zip(self.values, centre[q])])
                    left, right = np.minimum(left, lo), np.maximum(right, hi)
                    dense = 40 * int((lo - left + right - hi).sum()) > m * n
                if dense:
                    whole = self.count_windows(centre[q], half, counts, gap, inside)
                else:
                    for j in range(m):
                        counts[self.order[j, left[j] : lo[j]]] += 1
                        counts[self.order[j, hi[j] : right[j]]] += 1
                    lo, hi = left, right
                    whole = bool((lo == 0).all() and (hi == n).all())
                found = np.flatnonzero(counts >= need)
                if len(found) > len(seen):
                    fresh = found[~verified[found]]
                    if every is None and 400 * len(fresh) > n:
                        if not many_from <= q < many_from + 64:
                            many_from = q
                            many = queries[q : q + 64] @ self.data.T
                        every = np.maximum(self.norms + queries[q] @ queries[q] - 2 * many[q - many_from], 0)
                    if every is None:
                        verified[fresh] = True
                        step = self.data[fresh] - queries[q]
                        seen, dist = np.concatenate([seen, fresh]), np.concatenate([dist, np.einsum("ij,ij->i", step, step)])
                    else:
                        seen, dist = found, every[found]  # counts never fall, so these hold all seen before
                others = seen != own
                known = dist[others]
                if len(known) >= n - (0 <= own < n):
                    break
                # as far as the k-th verified distance asks for, which may fall on the way; at once where all windows are counted anyway
                goal = margin * float(np.sqrt(np.partition(known, k - 1)[k - 1])) if len(known) >= k else np.inf
                if goal <= r or whole:
                    break
                r = goal if dense and goal < np.inf else min(r * grow, goal)
            rows, d = seen[others], dist[others]
            if len(rows) > k:
                edge = np.partition(d, k - 1)[k - 1]
                rows = rows[d <= edge + 1e-9 * (1 + edge + self.norms.max())]  # ties, and rounding of the distances of many
            step = self.data[rows] - queries[q]
            out_q.append(np.full(len(rows), q))
            out_d.append(rows)
            out_s.append(np.einsum("ij,ij->i", step, step))
        return np.concatenate(out_q), np.concatenate(out_d), np.concatenate(out_s)


def start_radius(data: np.ndarray, k: int, probes: int = 64) -> float:
    """A radius below that of the k nearest: 0.8 of the median distance of some rows to their k-th neighbour in the block."""
    if len(data) < 2:
        return 1.0
    picked = data[np.linspace(0, len(data) - 1, min(probes, len(data))).astype(int)]
    d = np.maximum((picked**2).sum(1)[:, None] + (data**2).sum(1)[None, :] - 2 * picked @ data.T, 0)
    kth = np.partition(d, min(k, len(data) - 1), axis=1)[:, min(k, len(data) - 1)]
    return float(max(0.8 * np.sqrt(np.median(kth)), 1e-6))


def _block(key: tuple, rows: pd.DataFrame, k: int, projections: int, share: float) -> pd.DataFrame:
    data, ask = rows[~rows["asks"]], rows[rows["asks"]]
    empty = pd.DataFrame({"query": [], "vec_id": [], "neighbour_id": [], "distance": []}).astype({"query": "int64", "vec_id": "int64", "neighbour_id": "int64"})
    if data.empty or ask.empty:
        return empty
    data = data.sort_values("row", kind="stable")
    points = np.array(data["vector"].tolist(), np.float64)
    queries = np.array(ask["vector"].tolist(), np.float64)
    place = pd.Series(np.arange(len(data)), index=data["row"].to_numpy())
    skip = place.reindex(ask["row"]).fillna(-1).to_numpy().astype(np.int64)
    q, d, squared = Index(points, projections).search(queries, skip, k, start_radius(points, k), share=share)
    ids, wanted = data["vec_id"].to_numpy()[d], ask["vec_id"].to_numpy()[q]
    frame = pd.DataFrame({"query": ask["row"].to_numpy()[q], "vec_id": wanted, "neighbour_id": ids, "distance": np.sqrt(squared)})
    frame = frame[frame["vec_id"] != frame["neighbour_id"]].sort_values(["query", "distance", "neighbour_id"], kind="stable")
    return frame.groupby("query").head(k) if len(frame) else empty


def _usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, width, vector of the rows that can be compared, each once."""
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
    lean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable).distinct()
    lean = lean.withColumn("width", F.size("vector")).withColumn("row", F.xxhash64("vec_id", "vector"))
    return lean.select("row", "vec_id", "width", F.col("vector").cast("array<float>").alias("vector") if dict(vectors.dtypes).get("embedding") == "array<float>" else "vector")


def nearest(vectors: DataFrame, k: int = 10, projections: int = 40, share: float = 0.7, query_rows: int = 2048, data_rows: int = 16_384, queries: DataFrame | None = None) -> DataFrame:
    """vec_id, neighbour_id, distance (Euclidean, 6 places), rank 1..k for every row of queries(vec_id, embedding, ...),
    sought among all rows of vectors(vec_id, embedding, ...); without queries every row of vectors is one.

    Equal distances rank by neighbour_id. Rows with a null id, a null or empty
    embedding, or one that holds a null or not-a-number are neither queries nor
    neighbours; vectors of different dimension don't meet. Repeated rows count
    once; rows that share an id but not the vector are queries of their own and
    never each other's neighbours. With fewer than k others all are returned. An
    empty table gives an empty result. Other columns are not read.
    """
    lean = materialise(_usable(vectors), "vectors")
    asked = lean if queries is None else materialise(_usable(queries), "queries")
    asks, holds = (max(1, -(-t.count() // rows)) for t, rows in ((asked, query_rows), (lean, data_rows)))
    asking = asked.withColumn("qb", F.pmod("row", F.lit(asks)).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(holds - 1)))).withColumn("asks", F.lit(True))
    data = lean.withColumn("db", F.pmod(F.shiftright("row", 20), F.lit(holds)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))).withColumn("asks", F.lit(False))

    def run(key, rows):
        return _block(key, rows, k, projections, share)

    kind = lean.schema["vector"].dataType if asked.schema["vector"].dataType == lean.schema["vector"].dataType else "array<double>"
    columns = ["width", "qb", "db", "asks", "row", "vec_id", F.col("vector").cast(kind).alias("vector")]
    found = asking.select(columns).unionByName(data.select(columns)).groupBy("width", "qb", "db").applyInPandas(run, SCHEMA)
    order = Window.partitionBy("query").orderBy("distance", "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("vec_id", "neighbour_id", F.round("distance", 6).alias("distance"), "rank")
