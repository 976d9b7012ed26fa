"""Vector search, hashing and keywords that hold tiles and candidates, not everything."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestone.operators import keywords, vector_search


def brute(v, q, k, threshold):
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
    score = np.round(np.divide(q @ v.T, size, out=np.zeros_like(size), where=size > 0), 9)
    out = []
    for i, row in enumerate(score):
        best = sorted((-s, j) for j, s in enumerate(row))[:k]
        out += [(i, j, -s) for s, j in best if threshold is None or -s >= threshold]
    return sorted(out)


def test_tiles_find_what_brute_force_finds_in_little_memory(monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(6000, 16))
    v[100:140] = v[100]  # equal vectors, whose ties go by id
    v[5] = 0
    q = np.concatenate([v[::40], np.zeros((2, 16)), v[:1] * (1 + 1e-7)])
    column = pa.array(v.tolist(), pa.list_(pa.float64()))
    groups = {16: (pa.array(np.arange(len(q))), q)}
    for tile in ((1024, 4096), (32, 512)):
        monkeypatch.setattr(vector_search, "TILE", tile)
        for k, threshold in ((5, None), (5, 0.3), (None, 0.6), (7000, 0.7)):
            got = [tuple(r.values()) for b in vector_search._meet(pa.array(np.arange(len(v))), column, groups, k, threshold) for r in b.to_pylist()]
            assert [r[:2] for r in sorted(got)] == [r[:2] for r in brute(v, q, k, threshold)]
    many = rng.normal(size=(5000, 16))
    tracemalloc.start()
    n = sum(b.num_rows for b in vector_search._meet(pa.array(np.arange(len(v))), column, {16: (pa.array(np.arange(5000)), many)}, 5, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 25_000 and peak < 30_000_000  # 5,000 by 6,000 scores are 240 MB


def test_hashes_and_counts_of_rows_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "PIECE_TOKENS", 3)
    words = ["graph", "été", "", "x" * 300, "𝔘nicode", "b"]
    assert vector_search._hashes(pa.array(words)).tolist() == [vector_search._hash(w) for w in words]
    lists = pa.array([["a", "b", "a", "c", "d"], [], None, ["b"], ["z", "y"]])
    got = Counter((a + int(c) // 8, int(c) % 8) for a, _, cell, sign in vector_search._cells(lists, 8) for c in cell)
    assert got == Counter((i, vector_search._hash(w) % 8) for i, row in enumerate(lists.to_pylist()) for w in row or [])
    # the same key twice is one vector; a bucket whose terms cancel stays
    texts = spark.createDataFrame([("k", "graph nodes graph"), ("k", "nodes"), ("n", None)], "id string, content string")
    want: Counter = Counter()
    for w in "graph nodes graph nodes".split():
        h = vector_search._hash(w)
        want[h % 1] += -1 if h & 1 else 1
    assert [tuple(r) for r in vector_search.hash_terms(texts, 1).collect()] == [("k", 0, want[0])]


def test_few_terms_are_left_to_be_joined(spark, monkeypatch):
    monkeypatch.setattr(keywords, "VOCABULARY_ROWS", 40)
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"word{int(x)}x" for x in rng.zipf(1.3, 120) if x < 5000)) for i in range(150)]
    docs = spark.createDataFrame(texts, "doc_id long, content string")
    got = sorted((r.doc_id, r["rank"], r.term) for r in keywords.keywords(docs, 5, docs).collect())
    df = Counter(t for _, x in texts for t in set(x.split()))
    want = []
    for i, x in texts:
        words = x.split()
        idf = {t: max(np.log(151 / (df[t] + 1)) + 1, 0) for t in set(words)}
        best = sorted((-n / len(words) * idf[t], t) for t, n in Counter(words).items())[:5]
        want += [(i, r + 1, t) for r, (_, t) in enumerate(best)]
    assert got == sorted(want)
    listed = docs.select("doc_id", keywords.keyword_tokens(docs.content).alias("t")).selectExpr("doc_id", "size(t) as length", "t").withColumn("terms", keywords.term_counts(keywords.F.col("t"))).drop("t")
    left = keywords._candidates(listed, keywords.corpus_frequencies(docs), 150, 5).count()
    assert left < sum(len(set(x.split())) for _, x in texts) * 0.6
