import random

import numpy as np
import pytest

from lodestone.llm import packing

SCHEMA = "doc_id long, text string, bin_id string, n_tokens string"


def brute(sizes, capacity):
    """The rule as it is written: try every open bin and a new one, count the squares."""
    gaps, out = [], []
    for s in sizes:
        def cost(i):
            g = list(gaps) + ([capacity] if i == len(gaps) else [])
            g[i] -= s
            return sum(n * n for n in np.bincount([x for x in g if 0 < x < capacity] or [0], minlength=2)[1:])

        options = [i for i, g in enumerate(gaps) if g >= s] + [len(gaps)]
        best = min(cost(i) for i in options)
        tied = [i for i in options if cost(i) == best]
        room = lambda i: capacity if i == len(gaps) else gaps[i]
        out.append((best, min(room(i) for i in tied)))
        i = next(i for i in tied if room(i) == out[-1][1])
        if i == len(gaps):
            gaps.append(capacity)
        gaps[i] -= s
    return out


def replay(sizes, bins, capacity):
    gaps, out = {}, []
    for s, b in zip(sizes, bins):
        room = gaps.get(b, capacity)
        gaps[b] = room - s
        assert gaps[b] >= 0
        out.append((sum(n * n for n in np.bincount([x for x in gaps.values() if x > 0] or [0], minlength=2)[1:]), room))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_place_follows_the_rule(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 12) for _ in range(60)]
    assert replay(sizes, packing.place(np.array(sizes), 12).tolist(), 12) == brute(sizes, 12)


def test_pack_covers_every_token(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, 256, 50).toPandas()
    lengths = docs.select("doc_id", packing.token_count(docs.text).alias("n")).toPandas().set_index("doc_id")["n"]
    assert rows.groupby("bin_id")["n_tokens"].sum().max() <= 256
    assert rows.groupby("doc_id")["n_tokens"].sum().equals(lengths[lengths > 0].sort_index().rename("n_tokens"))
    whole = packing.pack(docs, 256).toPandas()
    assert whole["bin_id"].nunique() <= 1.05 * lengths.sum() / 256 + 2


def test_pack_edges(spark):
    long = "w " * 1000
    rows = [(1, "a b c", "x", "y"), (None, "a b", "x", "y"), (3, None, "x", "y"), (4, "  ", "x", "y"), (5, long, "x", "y"), (1, "a b c", "x", "y")]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), 64).toPandas()
    assert sorted(out["doc_id"].dropna().unique()) == [1, 5] and out["doc_id"].isna().sum() == 1
    assert (out[out["doc_id"] == 5]["n_tokens"].sum(), len(out[out["doc_id"] == 5]), len(out[out["doc_id"] == 1])) == (1000, 16, 2)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
