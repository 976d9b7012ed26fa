"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios (Wang & Manning, "Baselines and Bigrams", Bernoulli form).

An n-gram that p of P toxic and q of Q clean training texts hold has the ratio
r = log((p + a) / (P + 2a)) - log((q + a) / (Q + 2a)). A logistic regression is
fitted on features r * [n-gram in text] * sqrt(1000 / n-grams of the text), so
that long texts don't score higher for their length. Features are all n-grams
that depend on the label by the likelihood-ratio test at `significance`
(G squared against the chi-square quantile), however many or few there are.

The decision is calibrated on folds of the training rows: of the cuts at which at
most `false_alarms` of the clean rows, each scored by a model that hasn't seen
it, count as toxic, the one that finds most toxic rows.

Trained on a bounded, hash-ordered sample of labelled rows (`sample` per class)
that the driver holds; scoring is one numpy pass over every whole text on the
executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrays import chunks, code_points, mix, window_hashes

CHUNK_CHARS = 2_000_000


SIZES, BITS = (4, 6, 8), 21


def _grams(texts: list, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of each n-gram occurrence, one size after another: white space runs are one space, case is folded."""
    points, row = code_points(texts, max(sizes))
    for n in sizes:
        h, real = window_hashes(points, n)
        at = np.flatnonzero(real)
        yield row[at], (mix(h[at] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)


def _length_scale(many: np.ndarray) -> np.ndarray:
    return np.sqrt(1000 / np.maximum(many, 1))


@dataclass
class Model:
    sizes: tuple[int, ...]
    bits: int
    slots: np.ndarray
    """The slots that carry weight, ascending."""
    weights: np.ndarray
    """w * r of each."""
    bias: float
    """Calibrated: a text is toxic from log-odds 0 on."""

    def scores(self, texts: list) -> np.ndarray:
        """Log-odds of each text; every distinct n-gram of a text counts once."""
        place = np.full(1 << self.bits, -1, np.int32)
        place[self.slots] = np.arange(len(self.slots))
        out = np.full(len(texts), self.bias)
        for a, b in chunks(texts, CHUNK_CHARS):
            keys, many = [], np.zeros(b - a)
            for row, slot in _grams(texts[a:b], self.sizes, self.bits):
                many += np.bincount(row, minlength=b - a)
                at = place[slot]
                hit = np.flatnonzero(at >= 0)
                keys.append(row[hit].astype(np.int64) * len(self.slots) + at[hit])
            key = np.unique(np.concatenate(keys))
            if len(key):
                out[a:b] += _length_scale(many) * np.bincount(key // len(self.slots), self.weights[key % len(self.slots)], b - a)
        return out


def likelihood_ratio(p: np.ndarray, q: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """G squared of the 2 x 2 table of label and presence, for n-grams that p of the toxic and q of the clean texts hold."""
    held, total = p + q, toxic + clean

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    return 2 * (part(p, held * toxic / total) + part(q, held * clean / total) + part(toxic - p, (total - held) * toxic / total) + part(clean - q, (total - held) * clean / total))


def _solve(keys: list, many: np.ndarray, toxic: np.ndarray, chosen: np.ndarray | None, bits: int, smooth: float, critical: float, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(slots, weights, bias, log-odds of all rows); rows outside `chosen` take no part in the fit."""
    use = np.ones(len(toxic), bool) if chosen is None else chosen
    p, q, mask = np.zeros(1 << bits), np.zeros(1 << bits), (1 << bits) - 1
    for key in keys:
        row, slot = (key >> bits).astype(np.int64), (key & mask).astype(np.int64)
        for count, side in ((p, use & (toxic > 0)), (q, use & (toxic == 0))):
            count += np.bincount(slot[side[row]], minlength=1 << bits)
    size = float(use.sum())
    positive = float(toxic[use].sum())
    base = float(np.log((positive + 0.5) / (size - positive + 0.5)))
    slots = np.flatnonzero(likelihood_ratio(p, q, positive, size - positive) >= critical)
    ratio = np.log((p[slots] + smooth) / (positive + 2 * smooth)) - np.log((q[slots] + smooth) / (size - positive + 2 * smooth))
    place = np.full(1 << bits, -1, np.int32)
    place[slots] = np.arange(len(slots))
    held = [key[place[(key & mask).astype(np.int64)] >= 0].astype(np.int64) for key in keys]
    key = np.concatenate(held)
    row, column = key >> bits, place[key & mask]
    value = ratio[column] * _length_scale(many)[row]
    w, b, n, inside = np.full(len(slots), 0.1), base, len(toxic), use[row]
    x, y, v = row[inside], column[inside], value[inside]
    m, s = np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)
    for t in range(1, steps + 1):  # Adam on the full sample
        z = b + np.bincount(x, w[y] * v, n)
        gap = np.where(use, 1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic, 0.0)
        grad = np.append(np.bincount(y, gap[x] * v, len(w)) / size + ridge * w, gap.sum() / size)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return slots, w * ratio, float(b), b + np.bincount(row, w[column] * value, n)


def best_cut(scores: np.ndarray, toxic: np.ndarray, false_alarms: float) -> float:
    """Of the cuts above which at most the share `false_alarms` of the clean rows score, the middle of those that find
    most toxic rows with the fewest clean ones."""
    edges = np.unique(scores)
    cuts = np.concatenate([[edges[0] - 1], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 1]])
    above = [(k > 0).sum() - np.searchsorted(np.sort(scores[k > 0]), cuts, side="right") for k in (toxic, 1 - toxic)]
    caught, wrong = (np.where(a, a, 0) for a in above)
    fits = wrong <= false_alarms * (toxic == 0).sum()
    fits &= caught == caught[fits].max()
    fits &= wrong == wrong[fits].min()
    tied = cuts[fits]
    return float((tied[0] + tied[-1]) / 2)


def fit(
    texts: list, toxic: np.ndarray, sizes: tuple[int, ...] = SIZES, bits: int = BITS, significance: float = 1e-4, smooth: float = 1.0, ridge: float = 1e-3, steps: int = 120, folds: int = 5, false_alarms: float = 0.01
) -> Model:
    """Train on texts and 0/1 labels.

    With one class, no text or no n-gram that depends on the label, every score
    is the log-odds of the labels. With fewer rows of a class than folds the cut
    stays at even odds.
    """
    toxic = np.asarray(toxic, float)
    base = float(np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))) if len(toxic) else -10.0
    empty = Model(sizes, bits, np.zeros(0, np.int64), np.zeros(0), base)
    if not len(texts) or toxic.min() == toxic.max():
        return empty
    compact = np.uint32 if len(texts) << bits <= 1 << 32 else np.int64
    keys, many = [], np.zeros(len(texts))
    for a, b in chunks(texts, 200_000):  # small steps: the driver holds one number for each distinct n-gram of a text, no more
        found = []
        for row, slot in _grams(texts[a:b], sizes, bits):
            many[a:b] += np.bincount(row, minlength=b - a)
            found.append(((row.astype(np.int64) + a) << bits) | slot)
        keys.append(np.unique(np.concatenate(found)).astype(compact))
    critical = NormalDist().inv_cdf(1 - significance / 2) ** 2  # chi-square with one degree of freedom
    options = (bits, smooth, critical, ridge, steps)
    slots, weights, bias, _ = _solve(keys, many, toxic, None, *options)
    if not len(slots):
        return empty
    model = Model(sizes, bits, slots, weights, bias)
    if min(toxic.sum(), len(toxic) - toxic.sum()) < folds:
        return model
    order = np.empty(len(toxic), np.int64)
    for k in (0, 1):
        side = np.flatnonzero(toxic == k)
        order[side] = np.arange(len(side))
    unseen = np.zeros(len(toxic))
    for f in range(folds):
        out = order % folds == f
        unseen[out] = _solve(keys, many, toxic, ~out, *options)[3][out]
    return replace(model, bias=model.bias - best_cut(unseen, toxic, false_alarms))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list, np.ndarray]:
    """Texts and labels of at most `sample` labelled documents per class, taken in order of a hash of the id.

    A document with several labels counts as toxic if one says so; labels and
    ids that are null, and labels other than 0 and 1, are not used. Rows that
    repeat a labelled id are training rows each.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64("_id", F.lit(7))
    ids = [known.where(F.col("_toxic") == k).orderBy(order, "_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # at most 2 * sample small rows
    rows = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_text")).where("_text is not null").join(chosen, F.col("_d") == F.col("_id")).select("_d", "_text", "_toxic").toPandas()
    rows = rows.sort_values(["_d", "_text"], kind="stable")
    return rows["_text"].tolist(), rows["_toxic"].to_numpy(float)


def train(docs: DataFrame, labels: DataFrame, sample: int = 1000, **options) -> Model:
    """Model from the labelled documents; sample bounds the rows of each class that the driver holds, options are those of fit().

    Texts are read whole, however long; null texts are not used. Empty tables of
    documents or labels give a model that calls nothing toxic.
    """
    texts, toxic = training_rows(docs, labels, sample)
    return fit(texts, toxic, **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, probability (rounded to 6 places) and toxic (0/1) for every row of docs(doc_id, text, ...).

    A null or empty text holds no n-gram: it is never toxic and its probability
    is 0. Null ids stay null, repeated rows are scored each, texts of any length
    are read whole, an empty table gives an empty result, other columns are not
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: `features` weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for rows in batches:
            texts = [t if isinstance(t, str) and t.strip() else None for t in rows["text"]]
            chance = 1 / (1 + np.exp(-np.clip(m.scores(texts), -40, 40)))
            chance[[t is None for t in texts]] = 0
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "probability": np.round(chance, 6), "toxic": (chance >= threshold).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, probability double, toxic int")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is not toxic; null and empty texts stay.

    Repeated rows stay or go together, texts of any length are read whole, an
    empty table gives an empty result. No column is added on the way, so that no
    name can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        m = shared.value
        known = [t if isinstance(t, str) and t.strip() else None for t in texts]
        chance = 1 / (1 + np.exp(-np.clip(m.scores(known), -40, 40)))
        return pd.Series([t is None or c < threshold for t, c in zip(known, chance)])

    return docs.where(clean(F.col("text")))
