"""Hash embedding and exact nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import plain_tokens
from lodestone.operators.adjacency import blocks


def latest(vectors: DataFrame, sequence: str) -> DataFrame:
    """The last vector of each id; rows keep the order of the first."""
    newest = Window.partitionBy("id").orderBy(F.desc(sequence))
    first = F.min(sequence).over(Window.partitionBy("id"))
    return vectors.withColumn("_r", F.row_number().over(newest)).withColumn("vector_ord", first).where("_r = 1").drop("_r", sequence)


def hash_terms(texts: DataFrame, dimension: int, key: str = "id", text: str = "content") -> DataFrame:
    """(key, bucket, value): the entries of each signed hash vector before scaling, for every bucket that a term falls into.

    Terms are hashed and counted within the row; only where a key comes twice are rows put together.
    """
    dimension = max(1, dimension)

    @F.arrow_udf("array<struct<bucket:int,value:bigint>>")
    def entries(lists: pa.Array) -> pa.Array:
        many, held = np.zeros(len(lists), np.int64), []
        for a, b, cell, sign in _cells(lists, dimension):
            at = np.flatnonzero(np.bincount(cell, minlength=(b - a) * dimension))
            many[a:b] = np.bincount(at // dimension, minlength=b - a)
            held.append((at % dimension, np.bincount(cell, sign, (b - a) * dimension)[at]))
        places, values = (np.concatenate([h[i] for h in held]) if held else np.zeros(0) for i in range(2))
        rows = pa.StructArray.from_arrays([pa.array(places.astype(np.int32)), pa.array(values.astype(np.int64))], ["bucket", "value"])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), rows)

    found = texts.select(key, F.explode(entries(plain_tokens(F.coalesce(F.col(text), F.lit(""))))).alias("e")).select(key, "e.bucket", "e.value")
    if texts.groupBy(key).count().where("count > 1").limit(1).count():
        found = found.groupBy(key, "bucket").agg(F.sum("value").alias("value"))
    return found


def _hash(term: str) -> int:
    h = 0xCBF29CE484222325
    for octet in term.encode("utf-8"):
        h = (h ^ octet) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _hashes(words: pa.Array) -> np.ndarray:
    """_hash() of each word, one byte of all words at a time."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    octets = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    start, left = at[:-1][order], -size[order]
    h = np.full(len(words), 0xCBF29CE484222325, np.uint64)
    for i in range(int(size.max(initial=0))):
        m = int(np.searchsorted(left, -i))  # so many are longer than i
        h[:m] = (h[:m] ^ octets[start[:m] + i]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


PIECE_TOKENS = 250_000
"""So many tokens are counted at once."""


def _cells(lists: pa.Array, dimension: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, behind the last, row within these * dimension + bucket, sign) of the tokens of runs of rows.

    Distinct words alone are hashed, and no token becomes a Python object.
    """
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, h = coded.indices.to_numpy(zero_copy_only=False), _hashes(coded.dictionary)
    place, sign = (h % np.uint64(dimension)).astype(np.int64), np.where(h & np.uint64(1), -1.0, 1.0)
    for a, b in blocks(ends, PIECE_TOKENS):
        own = codes[ends[a] : ends[b]]
        yield a, b, np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])) * dimension + place[own], sign[own]


def hash_embedding(tokens: Column, dimension: int, kind: str = "float") -> Column:
    """The unit-length signed hash vector of a token array as array<kind>; all zero without a token."""
    dimension = max(1, dimension)

    @F.arrow_udf(f"array<{kind}>")
    def embed(lists: pa.Array) -> pa.Array:
        out = np.zeros((len(lists), dimension), np.float32 if kind == "float" else np.float64)
        for a, b, cell, sign in _cells(lists, dimension):
            v = np.bincount(cell, sign, (b - a) * dimension).reshape(b - a, dimension)
            size = np.sqrt((v * v).sum(axis=1, keepdims=True))
            out[a:b] = np.divide(v, size, out=v, where=size > 0)
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, dimension).astype(np.int32), out.ravel())

    return embed(tokens)


def embed_texts(texts: DataFrame, dimension: int, text: str = "content", into: str = "embedding", kind: str = "float") -> DataFrame:
    return texts.withColumn(into, hash_embedding(plain_tokens(F.coalesce(F.col(text), F.lit(""))), dimension, kind))


BROADCAST_NUMBERS = 4_000_000
"""Up to so many numbers in all queries together are sent to every executor; more meet the vectors block by block."""
BLOCK_NUMBERS = 4_000_000
"""So many numbers of vectors, and of queries, meet in a task."""
BLOCK_TASKS = 48
"""Queries are cut into smaller blocks until there are so many tasks."""
TILE = 1024, 4096
"""Queries and vectors that are multiplied at once."""


def _by_width(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width -> (rows, matrix) of a list column; 0 for those that are null or empty."""
    widths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths) - widths
    return {int(w): (i, flat[at[i][:, None] + np.arange(w)].astype(np.float64)) for w in np.unique(widths) for i in [np.flatnonzero(widths == w)]}


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.linalg.norm(m, axis=1)
    return size, np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] > 0).astype(np.float32)


def _best(of: np.ndarray, score: np.ndarray, k: int, tie: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of `of` and falling score, rank within `of` from 0)."""
    order = np.lexsort((-score, of) if tie is None else (tie, -score, of))
    first = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if len(of) else np.zeros(0, np.int64)
    return order, np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))


def _near(q: np.ndarray, v: np.ndarray, k: int | None, least: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of unit float32 rows that may be among a query's k best and may reach `least`, found up to `slack`."""
    floor = np.full(len(q), least - slack, np.float32)
    c, r, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

    def tighten() -> None:
        nonlocal c, r, s
        order, rank = _best(c, s, k)
        at = order[rank == k - 1]
        floor[c[at]] = np.maximum(floor[c[at]], s[at] - slack)
        keep = s >= floor[c]
        c, r, s = c[keep], r[keep], s[keep]

    for a in range(0, len(v), TILE[1]):
        score = q @ v[a : a + TILE[1]].T
        if k is not None and a == 0 and k <= score.shape[1]:
            some = score[:, : max(k, 1024)]
            floor = np.maximum(floor, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - np.float32(slack))
        at = np.flatnonzero((score >= floor[:, None]).ravel())
        c, r, s = np.append(c, at // score.shape[1]), np.append(r, at % score.shape[1] + a), np.append(s, score.ravel()[at])
        if k is not None and len(c) > 4 * k * len(q):
            tighten()
    if k is not None:
        tighten()
    return c, r


def _meet(ids: pa.Array, column: pa.Array, groups: dict, k: int | None, threshold: float | None) -> Iterator[pa.RecordBatch]:
    """Batches of (query_id, id, score) of vectors and the queries of groups, cut to the best k, ties by id, that reach the threshold.

    float32 finds what can be among them, up to its error; those scores are then
    taken exactly. Queries and vectors of different widths score 0.
    """
    tie = None
    if ids.null_count == 0 and (pa.types.is_integer(ids.type) or pa.types.is_string(ids.type)):
        tie = np.empty(len(ids), np.int64)
        tie[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    held = _by_width(column)
    least = -2.0 if threshold is None else threshold
    for w, (asked, q) in groups.items():
        v = np.zeros((len(ids), w))
        if w in held:
            v[held[w][0]] = held[w][1]
        (vn, vf), (qn, qf) = _unit(v), _unit(q)
        slack = 2.0**-22 * (w + 8) + 2e-9
        for a in range(0, len(q), TILE[0]):
            c, r = _near(qf[a : a + TILE[0]], vf, k, least, slack)
            score = np.zeros(len(c))
            for i in range(0, len(c), 65_536):
                x, y = c[i : i + 65_536] + a, r[i : i + 65_536]
                both = qn[x] * vn[y]
                score[i : i + 65_536] = np.divide(np.einsum("ij,ij->i", q[x], v[y]), both, out=np.zeros(len(x)), where=both > 0)
            score = np.round(score, 9)
            keep = score >= least
            c, r, score = c[keep], r[keep], score[keep]
            if k is not None and tie is not None:
                order, rank = _best(c, score, k, tie[r])
                at = order[rank < k]
                c, r, score = c[at], r[at], score[at]
            for i in range(0, len(c), 65_536):
                x, y = pa.array(c[i : i + 65_536] + a), pa.array(r[i : i + 65_536])
                yield pa.RecordBatch.from_arrays([asked.take(x), ids.take(y), pa.array(score[i : i + 65_536])], names=["query_id", "id", "score"])


def _asked(table: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
    table = table.combine_chunks()
    ids, column = (pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("query_id", "embedding"))
    return {w: (ids.take(pa.array(i)), m) for w, (i, m) in _by_width(column).items()}


def _scored(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float | None, query_rows: int | None = None, vector_rows: int | None = None) -> DataFrame:
    """(query_id, id, score), the score rounded to 9 places; ids keep their types.

    Queries meet the vectors in numpy, tile by tile, and only what can be among
    the best k of its batch, or reaches the threshold, leaves it. Beyond
    BROADCAST_NUMBERS a block of queries meets a block of vectors in each task;
    blocks hold BLOCK_NUMBERS, so that few copies of them are sent.
    """
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((queries, "query_id"), (vectors, "id"))]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    size = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    asked, held = queries.select("query_id", "embedding"), vectors.select("id", "embedding")
    best = None if k is None else max(1, k)
    if size <= BROADCAST_NUMBERS:
        shared = queries.sparkSession.sparkContext.broadcast(_asked(asked.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                yield from _meet(rows.column("id"), rows.column("embedding"), shared.value, best, threshold)

        return held.mapInArrow(run, schema)
    counts = [t.count() for t in (asked, held)]
    most = max(1, BLOCK_NUMBERS * counts[0] // max(1, size))
    many_v = max(1, -(-counts[1] // (vector_rows or most)))
    many_q = max(1, -(-counts[0] // (query_rows or most)))
    if query_rows is None:
        many_q = max(many_q, min(-(-counts[0] // TILE[0]), -(-BLOCK_TASKS // many_v)))
    blocks_of = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (many_q, many_v)]
    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id", "embedding"), F.lit(many_q)).cast("int")).withColumn("vb", blocks_of[1])
    right = held.withColumn("vb", F.pmod(F.xxhash64("id", "embedding"), F.lit(many_v)).cast("int")).withColumn("qb", blocks_of[0])

    def pair(q: pa.Table, v: pa.Table) -> pa.Table:
        kinds = [q.schema.field("query_id").type, v.schema.field("id").type, pa.float64()]
        wanted = pa.schema(list(zip(("query_id", "id", "score"), kinds)))
        if not q.num_rows or not v.num_rows:
            return wanted.empty_table()
        ids, column = (pa.concat_arrays(v.column(c).chunks) for c in ("id", "embedding"))
        return pa.Table.from_batches(list(_meet(ids, column, _asked(q), best, threshold)), wanted)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(pair, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of vectors(id, embedding) nearest by cosine to each of queries(query_id, embedding).

    Every pair is compared, ties go by id; k None takes all; a threshold keeps
    what reaches it among the top k.
    """
    scored = _scored(vectors, queries, k, threshold)
    if k is not None and k <= 0:
        return scored.withColumn("rank", F.lit(1)).limit(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def similar(vectors: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, id, score) of all pairs with cosine >= threshold."""
    return _scored(vectors, queries, None, threshold)


def collection_stats(vectors: DataFrame) -> DataFrame:
    """One row (count, dimension): the dimension is that of the vector with the least id order; null when empty."""
    return vectors.agg(F.count("*").alias("count"), F.min_by(F.size("embedding"), "id").alias("dimension"))
