import numpy as np
import pytest

from lodestone.llm import quality as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality double, site string, p double"


def test_posteriors_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(f"s{i % 3}", f"p{i % 2 if i % 3 else 0}", float(x)) for i, x in enumerate(r.random(40))]
    got = {(x.site, x.path): (x.site_rate, x.path_rate) for x in Q.posteriors(spark.createDataFrame(rows, "site string, path string, p double")).collect()}
    mean = sum(p for *_, p in rows) / len(rows)
    sites = {s: [p for t, _, p in rows if t == s] for s in {x[0] for x in rows}}
    clip = lambda v: min(1000.0, max(1.0, mean * (1 - mean) / max(v, 1e-9) - 1))
    k = clip(np.var([np.mean(v) for v in sites.values()]))
    rate = {s: (k * mean + sum(v)) / (k + len(v)) for s, v in sites.items()}
    paths = {(s, q): [p for t, u, p in rows if (t, u) == (s, q)] for s, q, _ in rows}
    k2 = clip(np.mean([(np.mean(v) - rate[s]) ** 2 for (s, _), v in paths.items()]))
    for (s, q), v in paths.items():
        assert got[s, q] == pytest.approx((rate[s], (k2 * rate[s] + sum(v)) / (k2 + len(v))))


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas().groupby("doc_id")["quality"].min()
    got = Q.assess(docs, train).toPandas().set_index("doc_id")["keep"]
    assert (got[held.index] == held).mean() > 0.95
    assert got[held[held == 1].index].mean() > 0.97


def test_edges(spark):
    rows = [(1, "Good text here. It goes on.", "en", "a", 1), (1, "Good text here. It goes on.", "en", "a", 1), (None, None, None, None, None), (2, "", "en", None, 0), (3, "A | B | C!!", None, "b", 3), (4, "word " * 50_000, "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 0.0, "x", 0.0) for r in rows], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.assess(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r.quality <= 1 for r in out) and sum(r.evidence is None for r in out) == 2
    kept = Q.reject(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, None, 4}
    assert Q.assess(docs.limit(0), labels).count() == 0
    assert Q.assess(docs, labels.limit(0)).count() == 6
