import math
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import toxicity as T


def halves(spark, folder):
    """Model of the even labelled documents, and (label, verdict) of the odd ones."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = T.train(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").toPandas().groupby("doc_id")["toxic"].max()
    return held, T.score(docs, model).toPandas().set_index("doc_id")["toxic"][held.index]


def test_held_out_accuracy(spark, sf):
    held, got = halves(spark, sf.replace("0.001", "0.1"))
    assert got[held == 1].mean() > 0.9 and got[held == 0].mean() < 0.02


def test_held_out_accuracy_of_few_rows(spark, sf):
    """With 16 toxic training rows the bound of 0.9 is out of reach: none of them is Spanish, as more than a tenth of the
    held-out toxic rows are, and others of those hold no toxic word. A second, public method (a decision list over words
    by log-likelihood, its cut chosen with the held-out labels in view) marks what such rows can carry."""
    folder = sf.replace("0.001", "0.01")
    held, got = halves(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().groupby("doc_id")["toxic"].max()
    train = labels[labels.index % 2 == 0]
    positive, negative = train.sum(), (1 - train).sum()
    assert positive == 16 and not (docs.loc[train.index[train == 1], "lang"] == "es").any()
    assert (docs.loc[held.index[held == 1], "lang"] == "es").mean() > 0.1
    words = {i: set(re.findall(r"\w+", docs.at[i, "text"].lower())) for i in labels.index}
    count = {k: Counter(w for i in train.index[train == k] for w in words[i]) for k in (0, 1)}
    weight = {w: math.log((count[1][w] + 1) / (positive + 2)) - math.log((count[0][w] + 1) / (negative + 2)) for w in {*count[0], *count[1]}}
    strongest = held.index.to_series().map(lambda i: max((weight.get(w, 0.0) for w in words[i]), default=0.0))
    public = (strongest[held == 1] > strongest[held == 0].quantile(0.98)).mean()
    assert 0.5 < public < 0.9
    assert got[held == 0].mean() < 0.02 and got[held == 1].mean() >= public


def brute(texts, toxic, sizes, significance, ridge, steps):
    """The method over n-gram strings, one text and one n-gram at a time; (score function without calibration)."""

    def grams(text):
        t = " " + " ".join(text.lower().split()) + " " if text else ""
        return [t[i : i + n] for n in sizes for i in range(len(t) - n + 1)]

    P, Q = sum(toxic), len(toxic) - sum(toxic)
    p, q = Counter(), Counter()
    for t, k in zip(texts, toxic):
        (p if k else q).update(set(grams(t)))

    def tested(g):
        total = 0.0
        for have, seen in ((True, (p[g], q[g])), (False, (P - p[g], Q - q[g]))):
            for x, side in zip(seen, (P, Q)):
                total += x * math.log(x * (P + Q) / (sum(seen) * side)) if x else 0
        return math.erfc(math.sqrt(total)) <= significance  # tail of chi-square at 2 * total

    names = [g for g in {*p, *q} if tested(g)]
    ratio = {g: math.log((p[g] + 1) / (P + 2)) - math.log((q[g] + 1) / (Q + 2)) for g in names}

    def row(text):
        every = grams(text)
        return {g: ratio[g] * math.sqrt(1000 / len(every)) for g in set(every) if g in ratio}

    rows = [row(t) for t in texts]
    w, b = dict.fromkeys(names, 0.1), math.log((P + 0.5) / (Q + 0.5))
    m, s = Counter(), Counter()
    for t in range(1, steps + 1):
        grad = Counter({g: ridge * w[g] for g in names})
        for x, k in zip(rows, toxic):
            gap = 1 / (1 + math.exp(-(b + sum(w[g] * v for g, v in x.items())))) - k
            grad[None] += gap / len(rows)
            for g, v in x.items():
                grad[g] += gap * v / len(rows)
        for g in [*names, None]:
            m[g], s[g] = 0.9 * m[g] + 0.1 * grad[g], 0.99 * s[g] + 0.01 * grad[g] ** 2
            step = 0.05 * (m[g] / (1 - 0.9**t)) / (math.sqrt(s[g] / (1 - 0.99**t)) + 1e-9)
            if g is None:
                b -= step
            else:
                w[g] -= step
    return lambda text: b + sum(w[g] * v for g, v in row(text).items())


def test_scores_against_brute_force():
    texts = ["you idiot person", "a calm text about rivers", "Idiot\n IDIOT words", "rivers and calm hills", "", ""] * 4
    toxic = [1, 0, 1, 0, 0, 0] * 4
    model = T.fit(texts, np.array(toxic), sizes=(2, 3), significance=1e-3, steps=30, folds=100)
    want = brute(texts, toxic, (2, 3), 1e-3, 1e-3, 30)
    fresh = [*texts[:6], "an idiot by the river", "hills", "x", None]
    assert len(model.slots) and np.allclose(model.scores(fresh), [want(t) for t in fresh])
    assert np.allclose(model.scores(fresh), [model.scores([t])[0] for t in fresh])


@pytest.mark.parametrize("scores, toxic, cut", [([0, 1, 4, 5], [0, 0, 1, 1], 2.5), ([0, 1, 2, 3], [1, 0, 0, 1], 2.5), ([1, 1, 1, 1], [0, 1, 0, 1], 2.0)])
def test_cut(scores, toxic, cut):
    assert T.best_cut(np.array(scores, float), np.array(toxic, float), 0.01) == cut


def test_edges(spark):
    model = T.fit(["bad idiot"] * 6 + ["good day"] * 6, np.array([1] * 6 + [0] * 6))
    schema = "doc_id long, text string, toxic string, probability string"
    docs = spark.createDataFrame([(1, "bad idiot", "", ""), (1, "bad idiot", "", ""), (None, None, "", ""), (2, " ", "", ""), (3, "good day " * 50_000, "", "")], schema)
    assert [(r.doc_id, r.toxic) for r in T.score(docs, model).collect()] == [(1, 1), (1, 1), (None, 0), (2, 0), (3, 0)]
    kept = T.reject(docs, model)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [None, 2, 3]
    assert T.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.score(docs, T.train(docs, labels)).where("toxic = 1").count() == 0
