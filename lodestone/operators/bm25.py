"""Okapi BM25 over an inverted index held as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import BM25Config
from lodestone.functions.text import index_tokens, term_counts
from lodestone.runtime import materialise, sized


ASKED_ROWS = 200_000
"""Up to so many (query, term) rows are broadcast."""


@dataclass(frozen=True)
class BM25Index:
    """postings(id, term, tf, length), frequencies(term, df) and totals(n, average), views of one written table."""

    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def build(contents: DataFrame) -> BM25Index:
    """Index of contents(id, content). Rows without a token count in n and the average length.

    Texts are read and tokenised once; terms are counted within the row, so nothing is shuffled.
    """
    listed = contents.select("id", index_tokens(F.coalesce(F.col("content"), F.lit(""))).alias("tokens"))
    listed = materialise(listed.select("id", F.size("tokens").alias("length"), term_counts(F.col("tokens")).alias("terms")), "index")
    postings = listed.select("id", "length", F.explode("terms").alias("t")).select("id", "t.term", "length", "t.tf")
    return BM25Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), listed.agg(F.count("*").alias("n"), F.avg("length").alias("average")))


def remove(contents: DataFrame, ids: DataFrame) -> DataFrame:
    """contents without ids(id); an index is a view of its contents, so build() of the rest is the index after removal."""
    return contents.join(ids.select("id"), "id", "left_anti")


def stats(index: BM25Index) -> DataFrame:
    """One row (documents, terms, average_length)."""
    terms = index.frequencies.agg(F.count("*").alias("terms"))
    return index.totals.crossJoin(terms).select(F.col("n").alias("documents"), "terms", F.coalesce("average", F.lit(0.0)).alias("average_length"))


def search(index: BM25Index, queries: DataFrame, limit: int, config: BM25Config = BM25Config()) -> DataFrame:
    """(query_id, id, score, rank) of queries(query_id, query): the best `limit` of each, ties by id.

    Scores are rounded to 9 places, so that equal documents tie whatever the order of
    summation.

    The postings are cut down to the queries' terms before anything is counted or
    shuffled, by a broadcast of those terms up to ASKED_ROWS of them and by a
    shuffled join beyond; then they are summed by (query, id).
    """
    asked, small = sized(queries.select("query_id", F.explode(F.array_distinct(index_tokens(F.col("query")))).alias("term")), ASKED_ROWS)
    terms = small(asked.select("term").distinct())
    held = index.postings.join(terms, "term", "left_semi")
    frequencies = small(held.groupBy("term").agg(F.count("*").alias("df")))
    weight = F.log(F.col("n") / F.col("df")) + 1
    length = F.lit(1 - config.b) + config.b * F.col("length") / F.greatest(F.col("average"), F.lit(1.0))
    part = weight * F.col("tf") * (config.k1 + 1) / F.greatest(F.col("tf") + config.k1 * length, F.lit(1e-4))
    # totals is one row by construction
    met = held.join(small(asked.join(frequencies, "term")), "term").crossJoin(F.broadcast(index.totals))
    scored = met.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    if limit <= 0:
        return scored.withColumn("rank", F.lit(1)).limit(0)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
