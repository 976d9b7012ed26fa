"""Sum-of-squares packing of documents into training sequences.

Every document goes to the open bin for which the sum, over residual gaps, of
the squared numbers of open bins becomes smallest (Csirik et al., "On the
sum-of-squares algorithm for bin packing"). A document longer than a bin is cut
into full bins and one remainder, so no token is lost.

The rule is sequential, so the corpus is spread by a hash of the id over shards
of about `shard_docs` documents that are packed side by side; only ids and
lengths are shuffled, never texts. A shard's partly filled bins are its only
loss against packing everything in one place (less than a bin per residual gap
in use). A shard is a bounded piece of work at any corpus size.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import materialise

SCHEMA = "bin_id long, doc_id long, piece int, start_token long, n_tokens long"


def token_count(text):
    """Number of maximal runs of non-space characters; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def place(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each size (1..capacity), taken in the given order.

    Ties between gaps go to the smallest gap, ties between bins of one gap to
    the bin that has waited longest.
    """
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; a gap of `capacity` is a new bin
    waiting: dict[int, deque] = {}
    out = np.empty(len(sizes), np.int64)
    made = 0
    for k, size in enumerate(sizes.tolist()):
        # change of the sum when a bin of gap g takes the document: gap g loses one, g - size gains one
        change = 2 * open_bins[: capacity + 1 - size] - 2 * open_bins[size:] + 2
        change[0] -= 2 * open_bins[0] + 1  # a full bin is closed and no longer counts
        change[-1] -= 1  # a new bin takes none from a gap
        barred = open_bins[size:] == 0
        barred[-1] = False
        change[barred] = np.iinfo(np.int64).max
        gap = size + int(change.argmin())
        if gap == capacity:
            number, made = made, made + 1
        else:
            number = waiting[gap].popleft()
            open_bins[gap] -= 1
        out[k] = number
        if gap > size:
            waiting.setdefault(gap - size, deque()).append(number)
            open_bins[gap - size] += 1
    return out


def _pack_shard(key: tuple, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
    total = rows["n_tokens"].to_numpy()
    full, rest = total // capacity, total % capacity
    pieces = full + (rest > 0)
    row = np.repeat(np.arange(len(rows)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(total[row] - piece * capacity, capacity)
    whole = size == capacity
    number = np.empty(len(row), np.int64)
    number[whole] = np.arange(int(whole.sum()))
    order = np.flatnonzero(~whole)
    order = order[np.argsort(-size[order], kind="stable")]
    number[order] = int(whole.sum()) + place(size[order], capacity)
    return pd.DataFrame(
        {
            "bin_id": (np.int64(key[0]) << 32) + number,
            "doc_id": rows["doc_id"].astype("Int64").to_numpy()[row] if len(rows) else [],
            "piece": piece.astype(np.int32),
            "start_token": piece * capacity,
            "n_tokens": size,
        }
    ).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, capacity: int = 2048, shard_docs: int = 50_000) -> DataFrame:
    """Pack the documents of docs(doc_id, text, ...) into bins of `capacity` tokens.

    Returns bin_id, doc_id, piece, start_token, n_tokens: one row for each piece
    of a document. Tokens are runs of non-space characters.

    Null and empty texts hold no token and get no row. A null doc_id is packed
    and stays null. Rows that share an id are packed as separate documents.
    Equal lengths are taken in order of id. An empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text")).alias("n_tokens"))
    lengths = materialise(lengths.where("n_tokens > 0"), "lengths")
    shards = max(1, -(-lengths.count() // shard_docs))
    keyed = lengths.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def run(key, rows):
        return _pack_shard(key, rows, capacity)

    return keyed.groupBy("shard").applyInPandas(run, SCHEMA)
