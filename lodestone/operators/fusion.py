"""Fusing a semantic and a keyword ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import BM25Config, Fusion, HybridConfig
from lodestone.operators import bm25, vector_search


def fuse(semantic: DataFrame, keyword: DataFrame, config: HybridConfig = HybridConfig()) -> DataFrame:
    """(query_id, id, score, semantic_score, keyword_score) of two rankings (query_id, id, score, rank), all ids of either."""
    left = semantic.select("query_id", "id", F.col("score").alias("s"), F.col("rank").alias("sr"))
    right = keyword.select("query_id", "id", F.col("score").alias("k"), F.col("rank").alias("kr"))
    both = left.join(right, ["query_id", "id"], "full")
    s, k = F.coalesce("s", F.lit(0.0)), F.coalesce("k", F.lit(0.0))
    if config.fusion is Fusion.RRF:
        # rank counts from 1, so the first of a list adds weight / (rrf_k + 1)
        score = F.coalesce(config.semantic_weight / (config.rrf_k + F.col("sr")), F.lit(0.0)) + F.coalesce(config.keyword_weight / (config.rrf_k + F.col("kr")), F.lit(0.0))
    elif config.fusion is Fusion.WEIGHTED:
        query = Window.partitionBy("query_id")
        top_s, top_k = F.max(s).over(query), F.max(k).over(query)
        score = F.when(top_s > 0, s / top_s).otherwise(0.0) * config.semantic_weight + F.when(top_k > 0, k / top_k).otherwise(0.0) * config.keyword_weight
    elif config.fusion is Fusion.COMB_SUM:
        score = s + k
    else:
        score = F.greatest(s, k)
    return both.select("query_id", "id", F.round(score, 9).alias("score"), s.alias("semantic_score"), k.alias("keyword_score"))


def rank_fused(fused: DataFrame, limit: int, config: HybridConfig = HybridConfig()) -> DataFrame:
    """The best `limit` of each query with rank; scores that aren't rank-based must reach min_score."""
    if limit <= 0:
        return fused.withColumn("rank", F.lit(1)).limit(0)
    kept = fused if config.fusion is Fusion.RRF else fused.where(F.col("score") >= config.min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def hybrid_search(
    index: bm25.BM25Index | None,
    vectors: DataFrame | None,
    queries: DataFrame,
    limit: int,
    config: HybridConfig = HybridConfig(),
    threshold: float = 0.0,
    include_keyword: bool = True,
    include_semantic: bool = True,
    scoring: BM25Config = BM25Config(),
) -> DataFrame:
    """Search queries(query_id, query, embedding) in both ways and fuse; cosines must be positive and reach the threshold."""
    empty = queries.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    keyword = bm25.search(index, queries, config.max_candidates, scoring) if include_keyword and index is not None else empty
    semantic = empty
    if include_semantic and vectors is not None:
        asked = queries.where(F.col("embedding").isNotNull())
        semantic = vector_search.nearest(vectors, asked, config.max_candidates).where((F.col("score") > 0) & (F.col("score") >= threshold))
    return rank_fused(fuse(semantic, keyword, config), limit, config)
