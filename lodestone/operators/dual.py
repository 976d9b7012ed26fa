"""Two-level retrieval: community summaries above, chunks below."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import DualConfig, HybridConfig, KeywordConfig, Merge, SearchOptions
from lodestone.functions.lexicons import QUESTION_WORDS
from lodestone.operators import bm25, communities, fusion, vector_search
from lodestone.operators.graph_store import Graph
from lodestone.operators.llm_extraction import LanguageModel, fill

KEYWORD_PROMPT = """Split this question into search keywords of two kinds and answer with one JSON object:
{"high_level": ["broad themes"], "low_level": ["names and details"]}
At most {limit} keywords in all, one to three words each, none in both lists. Language: {language}.

Question: {question}
"""


def strip_thinking(text: str) -> str:
    """text without <think> blocks, trimmed; a close mark ahead of any open one ends the search."""
    while True:
        start, end = text.find("<think>"), text.find("</think>")
        if start < 0 or end < start:
            return text.strip()
        text = text[:start] + text[end + len("</think>") :]


def _words(question: str) -> list[str]:
    return "".join(c if c.isalpha() or c.isnumeric() else " " for c in question).split()


def fallback_keywords(question: str, limit: int) -> tuple[list[str], list[str]]:
    """The question's words without stopwords (all of them if nothing is left), each once, for both levels."""

    def once(words):
        return list({w.lower(): w for w in reversed(words)}.values())[::-1]

    words = _words(question)
    kept = once([w for w in words if w.lower() not in QUESTION_WORDS]) or once(words)
    order = {w.lower(): i for i, w in reversed(list(enumerate(words)))}
    kept = sorted(kept, key=lambda w: order[w.lower()])[: max(0, limit)]
    return kept, list(kept)


def parse_keywords(answer: str) -> tuple[list[str], list[str]] | None:
    text = strip_thinking(answer)
    first, last = text.find("{"), text.rfind("}")
    if not 0 <= first < last:
        return None
    try:
        found = json.loads(text[first : last + 1])
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    high, low = (x if isinstance(x, list) and all(isinstance(w, str) for w in x) else [] for x in (found.get("high_level"), found.get("low_level")))
    return high, low


def extract_keywords(question: str, model: LanguageModel | None = None, config: KeywordConfig = KeywordConfig()) -> tuple[list[str], list[str]]:
    """(high, low) keywords by the model, or by words alone if there is none, it fails, or its answer holds nothing."""
    limit = max(0, config.max_keywords)
    try:
        if model is not None and model.is_available():
            prompt = fill(KEYWORD_PROMPT, {"limit": str(limit), "language": config.language, "question": question})
            found = parse_keywords(model.complete(prompt))
            if found and (found[0] or found[1]):
                high = found[0][:limit]
                return high, found[1][: limit - len(high)] if len(found[0]) + len(found[1]) > limit else found[1]
    except Exception:  # a model that fails must never fail the question
        pass
    return fallback_keywords(question, limit)


@dataclass(frozen=True)
class Store:
    """A searchable level: contents(id, content, source_chunks), its index and its vectors."""

    contents: DataFrame
    index: bm25.BM25Index
    vectors: DataFrame
    dimension: int
    size: int
    options: SearchOptions = SearchOptions()

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        """(query_id, id, score, rank, content, source_chunks) of queries(query_id, query)."""
        asked = vector_search.embed_texts(queries, self.dimension, "query")
        config = HybridConfig(max_candidates=max(100, self.size))
        found = fusion.hybrid_search(self.index, self.vectors, asked, top_k, config, self.options.threshold, self.options.include_keyword)
        return found.select("query_id", "id", "score", "rank").join(self.contents, "id")


def build_store(contents: DataFrame, dimension: int, options: SearchOptions = SearchOptions()) -> Store:
    """Store of contents(id, content, source_chunks[, embedding]); an embedding of the right length is used as it is."""
    fresh = vector_search.embed_texts(contents.select("id", "content"), dimension, into="fresh")
    if "embedding" in contents.columns:
        given = contents.select("id", "embedding").join(fresh, "id")
        vectors = given.select("id", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.col("fresh")).alias("embedding"))
    else:
        vectors = fresh.select("id", F.col("fresh").alias("embedding"))
    lean = contents.select("id", "content", "source_chunks").persist()
    return Store(lean, bm25.build(lean), vectors.persist(), dimension, lean.count(), options)


def chunk_store(graph: Graph, dimension: int, options: SearchOptions = SearchOptions()) -> Store:
    chunks = graph.chunks
    columns = [F.col("chunk_id").alias("id"), "content", F.array("chunk_id").alias("source_chunks")]
    return build_store(chunks.select(*columns, *(["embedding"] if "embedding" in chunks.columns else [])), dimension, options)


def community_contents(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(id, content, source_chunks): one row per community."""
    sources = communities.source_chunks(graph, assignment)
    joined = communities.summaries(graph, assignment).join(sources, "community_id", "left")
    return joined.select(F.concat(F.lit("community_"), F.col("community_id").cast("string")).alias("id"), "content", F.coalesce("source_chunks", F.array().cast("array<string>")).alias("source_chunks"))


def merge_levels(high: DataFrame, low: DataFrame, top_k: int, config: DualConfig = DualConfig()) -> DataFrame:
    """(query_id, level, id, score, position) of two lists (query_id, id, score, rank): the first top_k distinct of each query.

    Scores stay as they were; an id may come once from each level.
    """
    both = high.select("query_id", "id", "score", "rank", F.lit("h").alias("level")).unionByName(low.select("query_id", "id", "score", "rank", F.lit("l").alias("level")))
    if config.strategy is Merge.INTERLEAVE:
        key = F.struct(F.col("rank").cast("double").alias("a"), "level", F.lit(0.0).alias("b"))
    elif config.strategy is Merge.WEIGHTED:
        weight = F.when(F.col("level") == "h", F.lit(config.high_weight)).otherwise(F.lit(config.low_weight))
        key = F.struct((-F.col("score") * weight).alias("a"), "id", "level")
    else:
        first = "h" if config.strategy is Merge.HIGH_FIRST else "l"
        key = F.struct(F.when(F.col("level") == first, 0.0).otherwise(1.0).alias("a"), F.col("rank").cast("double").alias("b"), "level")
    keyed = both.withColumn("k", key).groupBy("query_id", "level", "id").agg(F.min("k").alias("k"), F.min_by("score", "k").alias("score"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("k"))
    return keyed.withColumn("position", position).where(F.col("position") <= max(0, top_k)).select("query_id", "level", "id", "score", "position")


def retrieve(high: Store, low: Store, question: str, top_k: int, model: LanguageModel | None = None, keywords: KeywordConfig = KeywordConfig(), config: DualConfig = DualConfig()) -> DataFrame | None:
    """merge_levels() rows with content and source_chunks for one question; None, before anything is searched, when nothing can be found."""
    if top_k <= 0 or keywords.max_keywords <= 0:
        return None
    spark = low.contents.sparkSession
    found = []
    for store, words in zip((high, low), extract_keywords(question, model, keywords)):
        asked = spark.createDataFrame([("q", " ".join(words))], "query_id string, query string")
        found.append(store.search(asked, top_k) if words else store.search(asked, 1).limit(0))
    merged = merge_levels(found[0], found[1], top_k, config)
    texts = found[0].withColumn("level", F.lit("h")).unionByName(found[1].withColumn("level", F.lit("l"))).select("level", "id", "content", "source_chunks").dropDuplicates(["level", "id"])
    return merged.join(texts, ["level", "id"]).orderBy("position")
