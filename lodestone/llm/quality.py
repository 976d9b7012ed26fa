"""Quality of documents: hierarchical empirical Bayes over site, path and text.

A logistic model of text shape gives each document evidence. Sites (`source`)
and paths below them ((`source`, `lang`), the finest grouping the table has) get
posteriors that shrink towards their parent: a path towards its site, a site
towards the global rate, the more so the fewer documents it has. How strongly
is itself estimated from the spread of the groups (method of moments), so all
of it is two grouped aggregations over (source, lang, evidence).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text_arrays import chunks, line_repeats
from lodestone.runtime import drop_ids, materialise

FEATURES = ("letters", "upper", "digits", "symbols", "bars", "bangs", "lines", "word_length", "repeated_lines", "log_length")


def _classes() -> np.ndarray:
    of = np.zeros(256, np.uint8)
    of[[*range(97, 123), *range(128, 256)]] = 1
    of[65:91] = 2
    of[48:58] = 3
    of[[ord(c) for c in "#$%&*@^~=+<>{}[]\\_/"]] = 4
    of[ord("|")] = 5
    of[[ord(c) for c in "!?"]] = 6
    of[10] = 7
    of[[9, 13, 32]] = 8
    return of


_CLASS = _classes()


def text_features(texts: list) -> np.ndarray:
    """One row of FEATURES per text; all zero for null and empty texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in chunks(texts, 4_000_000):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts[a:b]]
        size = np.array([len(p) for p in parts], np.int64)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        if not len(raw):
            continue
        row = np.repeat(np.arange(b - a, dtype=np.int64), size)
        seen = np.bincount(row * 9 + _CLASS[raw], minlength=9 * (b - a)).reshape(b - a, 9).astype(float)
        some = np.maximum(size, 1)
        words = seen[:, 7] + seen[:, 8] + (size > 0)
        out[a:b, 0] = (seen[:, 1] + seen[:, 2]) / some
        out[a:b, 1] = seen[:, 2] / np.maximum(seen[:, 1] + seen[:, 2], 1)
        for k in (3, 4, 5, 6):
            out[a:b, k - 1] = np.sqrt(seen[:, k] / some)
        out[a:b, 6] = np.sqrt(seen[:, 7] / some)
        out[a:b, 7] = np.log1p(some / np.maximum(words, 1))
        out[a:b, 8] = line_repeats(parts)
        out[a:b, 9] = np.log1p(size) / 10
        out[a:b][size == 0] = 0
    return out


class Shape:
    """Logistic regression on standardised features and their squares."""

    def __init__(self, mean, spread, weights):
        self.mean, self.spread, self.weights = mean, spread, weights

    @staticmethod
    def _expand(x):
        return np.hstack([x, x**2])

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Shape:
        """Newton's method; with no row, or labels of one class, the prior log-odds alone."""
        x = cls._expand(np.asarray(x, float).reshape(-1, len(FEATURES)))
        good = np.asarray(good, float)
        mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        spread = (x.std(0) if len(x) else np.ones(x.shape[1])) + 1e-6
        z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / spread, -8, 8)])
        w = np.zeros(z.shape[1])
        w[0] = np.log((good.sum() + 1) / (len(good) - good.sum() + 1))
        if len(good) and 0 < good.mean() < 1:
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                pull = np.append(0.0, np.full(len(w) - 1, ridge))
                grad = z.T @ (p - good) + pull * w
                hess = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(pull + 1e-6)
                step = np.linalg.solve(hess, grad)
                w = w - step
                if np.abs(step).max() < 1e-8:
                    break
        return cls(mean, spread, w)

    def chance(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self._expand(x) - self.mean) / self.spread, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, site, path and the features of each row of docs(doc_id, source, lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = text_features([t if isinstance(t, str) else None for t in rows["text"]])
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "site": rows["site"], "path": rows["path"], "has_text": x[:, -1] > 0, "x": list(x)})

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("site"), F.coalesce(F.col("lang"), F.lit("")).alias("path"), "text")
    return lean.mapInPandas(run, "doc_id long, site string, path string, has_text boolean, x array<double>")


def fit_shape(described: DataFrame, labels: DataFrame, sample: int = 20_000) -> Shape:
    """Train on at most `sample` labelled rows in order of a hash of the id; of repeated labels the lowest counts."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
    known = F.broadcast(known.orderBy(F.xxhash64("_id", F.lit(4)), "_id").limit(sample))  # bounded by `sample`
    rows = described.where("has_text").join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "x", "_good").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return Shape.fit(np.array(rows["x"].tolist()), rows["_good"].to_numpy(float))


def _strength(between, within_mean):
    """Beta prior weight for which the groups' spread is what is seen: m (1 - m) / variance - 1, kept in 1..1000."""
    return F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.coalesce(within_mean * (1 - within_mean) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1000.0))))


def posteriors(evidence: DataFrame) -> DataFrame:
    """site, path, site_rate, path_rate, global_rate of evidence(site, path, p).

    p is each document's chance of being good by its text alone. A group's rate
    is (strength * parent's rate + sum of p) / (strength + documents).
    """
    paths = evidence.groupBy("site", "path").agg(F.sum("p").alias("s"), F.count("p").alias("n"))
    sites = paths.groupBy("site").agg(F.sum("s").alias("S"), F.sum("n").alias("N"))
    whole = sites.agg((F.sum("S") / F.sum("N")).alias("global_rate"), F.coalesce(F.var_pop(F.col("S") / F.col("N")), F.lit(0.0)).alias("v_site"))
    # the two one-row tables are aggregates over everything: of fixed size
    sites = sites.crossJoin(F.broadcast(whole)).withColumn("k_site", _strength(F.col("v_site"), F.col("global_rate")))
    sites = sites.withColumn("site_rate", (F.col("k_site") * F.col("global_rate") + F.col("S")) / (F.col("k_site") + F.col("N")))
    joined = paths.join(sites.select("site", "site_rate", "global_rate"), "site")
    spread = joined.agg(F.avg(F.pow(F.col("s") / F.col("n") - F.col("site_rate"), 2)).alias("v_path"))
    joined = joined.crossJoin(F.broadcast(spread)).withColumn("k_path", _strength(F.col("v_path"), F.col("global_rate")))
    return joined.select("site", "path", "global_rate", "site_rate", ((F.col("k_path") * F.col("site_rate") + F.col("s")) / (F.col("k_path") + F.col("n"))).alias("path_rate"))


def _logit(p):
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return F.log(q / (1 - q))


def assess(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, evidence, site_rate, path_rate, quality, keep for each row of docs(doc_id, text, lang, source, ...).

    quality is the chance of a good document given its text and its path: the
    text's log-odds plus the path's log-odds less the global ones. keep is
    quality >= threshold. Numbers are rounded to 6 places.

    A null or empty text gives no evidence: it takes the path's rate, which it
    doesn't enter. Null sources and languages form groups of their own (the
    same as empty strings). Null ids stay null; repeated rows count each. An
    empty table gives an empty result; without labels the evidence is even
    (0.5). Other columns are not read.
    """
    described = materialise(features(docs), "features")
    model = fit_shape(described, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def chance(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.chance(np.array(x.tolist()).reshape(len(x), -1)) if len(x) else [], dtype=float)

    evidence = described.select("doc_id", "site", "path", F.when(F.col("has_text"), chance("x")).alias("p"))
    evidence = materialise(evidence, "evidence")
    groups = posteriors(evidence.where("p is not null"))
    joined = evidence.join(groups, ["site", "path"], "left")
    path_rate = F.coalesce(F.col("path_rate"), F.lit(0.5))
    log_odds = F.when(F.col("p").isNull(), _logit(path_rate)).otherwise(_logit(F.col("p")) + _logit(path_rate) - _logit(F.coalesce(F.col("global_rate"), F.lit(0.5))))
    quality = 1 / (1 + F.exp(-log_odds))
    return joined.select("doc_id", F.round("p", 6).alias("evidence"), F.round("site_rate", 6).alias("site_rate"), F.round(path_rate, 6).alias("path_rate"), F.round(quality, 6).alias("quality"), (quality >= threshold).cast("int").alias("keep"))


def reject(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that assess() keeps.

    Rows that share an id stay if one of them is kept. Rows with a null id are
    kept. Null, empty and very long texts and an empty table are treated as
    there.
    """
    bad = assess(docs, labels, sample, threshold).where("doc_id is not null").groupBy("doc_id").agg(F.max("keep").alias("keep")).where("keep = 0")
    return drop_ids(docs, bad.select("doc_id"))
