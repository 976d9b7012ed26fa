"""Keywords by term frequency and inverse document frequency."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.lexicons import STOPWORDS
from lodestone.functions.text import keyword_tokens, term_counts
from lodestone.runtime import materialise, sized

VOCABULARY_ROWS = 300_000
"""Up to so many terms with their frequencies are broadcast."""
ROWS = 2000
"""So many rows of terms are weighed at once."""


def corpus_frequencies(documents: DataFrame, text: str = "content") -> DataFrame:
    """(term, df): in how many rows each term occurs."""
    return documents.select(F.explode(F.array_distinct(keyword_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(documents: DataFrame, text: str = "content") -> DataFrame:
    """One row (documents, terms)."""
    terms = documents.select(F.explode_outer(F.array_distinct(keyword_tokens(F.col(text)))).alias("term")).agg(F.countDistinct("term").alias("terms"))
    return documents.agg(F.count("*").alias("documents")).crossJoin(terms)


def inverse_document_frequency(documents: Column, df: Column) -> Column:
    """max(ln((documents + 1) / (df + 1)) + 1, 0); an unknown term counts as df 1."""
    return F.greatest(F.log((documents + 1) / (F.coalesce(df, F.lit(1)) + 1)) + 1, F.lit(0.0))


def _candidates(listed: DataFrame, frequencies: DataFrame, documents: int, top_k: int) -> DataFrame:
    """(key, length, term, tf) of the terms of listed(key, length, terms) that can be among the top_k of their row.

    The most frequent terms, VOCABULARY_ROWS at most, are known to every worker;
    the rest have a df below theirs, so that their scores lie between two bounds.
    A term goes if top_k others of its row are sure to be above it, so that few
    are left to be joined with their df.
    """
    levels = {r["level"]: r["count"] for r in frequencies.groupBy(F.floor(F.log2("df")).cast("int").alias("level")).count().collect()}
    least, held = max(levels, default=-1) + 1, 0
    while least > 0 and held + levels.get(least - 1, 0) <= VOCABULARY_ROWS:
        least -= 1
        held += levels.get(least, 0)
    common = frequencies.where(F.col("df") >= 2**least).select("term", "df").toArrow().combine_chunks()
    shared = frequencies.sparkSession.sparkContext.broadcast((common.column("term"), common.column("df").to_numpy()))

    name = listed.columns[0]

    def idf(df):
        return np.maximum(np.log((documents + 1) / (df + 1)) + 1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df = shared.value
        terms = pa.concat_arrays(terms.chunks) if terms.num_chunks else pa.array([], terms.type)
        low, high = np.append(idf(df), idf(max(1, 2**least - 1))), np.append(idf(df), idf(1))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                key, length, lists = batch.slice(a, ROWS).columns
                entries = lists.flatten()
                term, tf = entries.field("term"), entries.field("tf").to_numpy(zero_copy_only=False)
                many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(many)), many)
                at = pc.fill_null(pc.index_in(term, value_set=terms), len(df)).to_numpy(zero_copy_only=False)  # the last entry is for the rest
                share = tf / length.to_numpy(zero_copy_only=False)[row]
                sure = share * low[at]
                order = np.lexsort((-sure, row))
                first = np.cumsum(many) - many
                floor = np.zeros(len(many))
                full = many >= top_k
                floor[full] = sure[order[first[full] + top_k - 1]]
                keep = np.flatnonzero(share * high[at] * (1 + 1e-9) + 1e-11 >= floor[row])
                rows = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays([key.take(rows), length.take(rows), term.take(pa.array(keep)), pa.array(tf[keep])], names=[name, "length", "term", "tf"])

    kinds = [listed.schema[0].dataType.simpleString(), listed.schema["length"].dataType.simpleString()]
    return listed.mapInArrow(run, f"`{name}` {kinds[0]}, length {kinds[1]}, term string, tf bigint")


def keywords(documents: DataFrame, top_k: int, corpus: DataFrame | None = None, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, term, score, rank): the top_k terms of each row by share of its tokens times idf, ties by term.

    Without a corpus every term has the same idf. Rows without a token have none.
    """
    if top_k <= 0:
        return documents.select(key, F.lit("").alias("term"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    same = corpus is documents
    tokens = documents.select(key, keyword_tokens(F.col(text)).alias("tokens"))
    listed = tokens.select(key, F.size("tokens").alias("length"), term_counts(F.col("tokens")).alias("terms"))
    listed = materialise(listed, "terms") if same else listed  # tokenised once, counted within the row
    counted = listed.select(key, "length", F.explode("terms").alias("t")).select(key, "length", "t.term", "t.tf")
    if corpus is None:
        counted = counted.withColumn("idf", inverse_document_frequency(F.lit(0), F.lit(None).cast("long")))
    else:
        size = (listed if same else corpus).agg(F.count("*").alias("documents"))
        frequencies = materialise(counted.groupBy("term").agg(F.count("*").alias("df")) if same else corpus_frequencies(corpus, text), "frequencies")
        documents_in = size.first()[0]
        counted = _candidates(listed.select(key, "length", "terms"), frequencies, documents_in, top_k)
        frequencies, small = sized(frequencies, VOCABULARY_ROWS)
        counted = counted.join(small(frequencies), "term", "left").crossJoin(F.broadcast(size)).withColumn("idf", inverse_document_frequency(F.col("documents"), F.col("df")))
    scored = counted.withColumn("score", F.col("tf") / F.col("length") * F.col("idf"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(key, "term", "score", "rank")


def frequent_terms(text: str, top_k: int) -> list[str]:
    """The top_k terms of one text without a corpus: most frequent first, ties by term. For code that already runs in Python."""
    words = (w if w.isalnum() else "".join(c for c in w if c.isalpha() or c.isnumeric() or c in "-_" or unicodedata.category(c)[0] == "M") for w in text.lower().split())
    counted = Counter(w for w in words if len(w) >= 3 and w not in STOPWORDS and not all(map(str.isnumeric, w)))
    return sorted(counted, key=lambda w: (-counted[w], w))[: max(0, top_k)]
