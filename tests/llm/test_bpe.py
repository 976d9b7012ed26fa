import base64
import random

import numpy as np
import pytest

from lodestone.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.tiktoken"))


def brute(v, word):
    parts = [bytes([b]) for b in word]
    if word in v.ranks:
        return (v.ranks[word],)
    while True:
        ranks = [(v.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in v.ranks]
        if not ranks:
            return tuple(v.ranks[p] for p in parts)
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_against_brute_force():
    v = bpe.vocabulary(PATH)
    r = random.Random(3)
    words = [bytes(r.choice(b"abcdefgh intheron\xc3\xa9") for _ in range(r.randint(1, 70))) for _ in range(400)] + [b"a" * 500]
    assert v.merge_words(words) == [brute(v, w) for w in words]


def test_words_that_come_again_are_merged_once(monkeypatch):
    v, merged = bpe.Vocabulary(bpe.vocabulary(PATH).ranks), []
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    merge = v._merge
    monkeypatch.setattr(v, "_merge", lambda words, bits: (merged.extend(words), merge(words, bits))[1])
    for k in range(30):
        texts = [" ".join("zqx" + "".join(map(chr, (97 + k, 97 + j, 120))) for j in range(9)), "zqxjkvw" if k % 2 else ""]
        assert v.encode_batch(texts) == [[t for w in v.pattern.findall(x) for t in brute(v, w.encode())] for x in texts]
    assert merged.count(b"zqxjkvw") == 1
    assert len(v.late) <= 40 + 10 and len(v.early) <= 40 + 10


def test_cuts_and_pairs_against_brute_force():
    v, r = bpe.vocabulary(PATH), random.Random(5)
    texts = [chr(a) + chr(b) + end for a in range(256) for b in range(256) for end in ("", "s", " ")]
    texts += ["".join(r.choice("ab' \t\r\n\x1c\x85\xa0sd\xe9\xb2\xaa7_-\u2019\u4e00") for _ in range(30)) for _ in range(2_000)]
    assert all(v.words(t) == v.pattern.findall(t) for t in texts)
    ids = [-1, *range(300), *(r.randrange(v.size) for _ in range(700))]
    left, right = np.repeat(ids, len(ids)), np.tile(ids, len(ids))
    known = {v.ranks[p[:c]] * v.size + v.ranks[p[c:]]: k for p, k in v.ranks.items() for c in range(1, len(p)) if p[:c] in v.ranks and p[c:] in v.ranks}
    expected = [known.get(a * v.size + b, int(bpe.NONE)) if min(a, b) >= 0 else int(bpe.NONE) for a, b in zip(left.tolist(), right.tolist())]
    assert v.pair_ranks(left, right).tolist() == expected and min(expected) < bpe.NONE
    pairs = np.array(list(known), np.int64)
    assert v.pair_ranks(pairs // v.size, pairs % v.size).tolist() == list(known.values())


def test_same_tokens_as_a_public_library(spark, sf):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
    encoded = bpe.encode(docs, PATH).persist()
    for r in encoded.collect():
        assert r.tokens == other.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.tokens)
    assert dict((r.doc_id, r.text) for r in bpe.decode(encoded, PATH).collect()) == texts


def test_edges(spark):
    rows = [(1, "don't\r\n  stop \U0001f600 你好", 1), (None, None, 1), (2, "", 1), (2, "", 1), (3, "ab" * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens long")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert [(r.doc_id, r.text) for r in out] == [r[:2] for r in rows]
    assert [r.n_tokens for r in bpe.round_trip(docs, PATH).collect()][1:4] == [None, 0, 0]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
