"""The engine: ingest, build, search, ask."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import ChunkConfig, CommunityConfig, DualConfig, EngineConfig, HybridConfig, KeywordConfig, ModelServerConfig, SearchOptions
from lodestone.errors import NoDocumentsError, NotBuiltError, ValidationError
from lodestone.operators import bm25, communities, dual, extraction, fusion, graph_store, vector_search
from lodestone.operators.chunking import chunk
from lodestone.operators.graph_store import Graph
from lodestone.operators.llm_extraction import ANSWER, EmbeddingModel, LanguageModel, ModelExtractor, fill
from lodestone.runtime import materialise, number_rows
from lodestone.sources import graph_json
from lodestone.sources.model_server import ChatClient, EmbeddingClient

NOTHING_FOUND = "I don't have enough information to answer that."
DOCUMENTS = "doc_id string, title string, content string, metadata map<string,string>, ingest_seq struct<batch:long,row:long>"


@dataclass(frozen=True)
class Answer:
    text: str
    confidence: float
    sources: list[str]


def context_of(results: list) -> str:
    return "\n\n---\n\n".join(f"[Chunk | Relevance: {r['score']:.3f}]\n{r['content']}" for r in results)


def context_column(hits: DataFrame) -> DataFrame:
    """(query_id, context) of hits(query_id, rank, score, content): context_of() of each query's hits.

    Scores are written by Python, which rounds the binary value as C and SQL do;
    the JVM's formats round its shortest decimal form, half up.
    """

    @F.pandas_udf("string")
    def written(scores: pd.Series) -> pd.Series:
        return pd.Series([f"{x:.3f}" for x in scores])

    piece = F.format_string("[Chunk | Relevance: %s]\n%s", written("score"), "content")
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), "\n\n---\n\n").alias("context"))


def _numbered(rows: DataFrame, place: str, name: str) -> DataFrame:
    """rows as a table, with 0, 1, ... in the order of the column `place` in its stead; no key is packed into bits that could run out."""
    return materialise(number_rows(rows.withColumnRenamed(place, "_place"), ["_place"], place).drop("_place"), name)


class Engine:
    """A corpus and what is built from it. DataFrames are lazy; build() materialises each stage once."""

    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig(), embedder: EmbeddingModel | None = None, model: LanguageModel | None = None, extractor=None):
        self.spark, self.config, self.embedder, self.model, self.extractor = spark, config, embedder, model, extractor
        self.chunking = ChunkConfig(config.chunk_size, config.chunk_overlap)
        self.graph: Graph | None = None
        self._pending: list[DataFrame] = []
        self._count = 0
        self._built = False
        self._index = self._vectors = self._contents = None

    def add_document(self, content: str, title: str | None = None, doc_id: str | None = None, metadata: dict | None = None) -> str:
        """Add or replace one document; an id is made up if none is given."""
        key = doc_id or str(uuid.uuid4())
        row = [(key, title or f"Document {self._count + 1}", content, metadata or {}, (self._count, 0))]
        self._pending.append(self.spark.createDataFrame(row, DOCUMENTS))
        self._count += 1
        self._built = False
        return key

    def add_documents(self, documents: DataFrame) -> None:
        """Add or replace documents(doc_id, title, content[, metadata]); of repeated ids within the batch the row with the greatest hash stays."""
        if "metadata" not in documents.columns:
            documents = documents.withColumn("metadata", F.create_map().cast("map<string,string>"))
        rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "title", "content", "metadata")
        # behind all earlier batches, and the same however the rows lie
        place = F.struct(F.lit(self._count).cast("long").alias("batch"), F.xxhash64("doc_id", "title", "content").alias("row"))
        self._pending.append(rows.withColumn("ingest_seq", place))
        self._count += 1
        self._built = False

    def documents(self) -> DataFrame:
        if not self._pending:
            raise NoDocumentsError("add documents first")
        rows = self._pending[0]
        for more in self._pending[1:]:
            rows = rows.unionByName(more)
        return graph_store.latest_documents(rows)

    def _embed(self, chunks: DataFrame) -> DataFrame:
        if self.embedder is None:
            return vector_search.embed_texts(chunks, self.config.embedding_dimension)
        embedder = self.embedder

        @F.pandas_udf("array<float>")
        def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                yield pd.Series([embedder.embed(t) for t in batch])

        return chunks.withColumn("embedding", embed("content"))

    def build(self) -> Engine:
        """Chunk, extract, cap, merge, annotate, embed and index everything that was added."""
        c = self.config
        documents = _numbered(self.documents(), "doc_ord", "documents")
        chunks = _numbered(chunk(documents, self.chunking), "chunk_ord", "chunks")
        found = materialise(extraction.extract(chunks, c.min_confidence, self.extractor), "extracted")
        kept = materialise(extraction.cap_entities(found, c.min_confidence, c.max_entities_per_chunk), "kept")
        seq = F.struct("chunk_ord", "at")
        entities = _numbered(graph_store.merge_entities(kept.withColumn("seq", seq)), "entity_ord", "entities")
        gated = extraction.gate_relationships(found, kept)
        if not c.extract_relationships:
            gated = gated.limit(0)
        relationships = _numbered(graph_store.merge_relationships(gated.withColumn("seq", seq), entities), "rel_ord", "relationships")
        noted = kept.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity_id"))), lambda x: x["entity_id"]).alias("entities"))
        chunks = chunks.join(noted, "chunk_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
        chunks = self._embed(chunks) if c.includes_semantic else chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        chunks = materialise(chunks, "chunks")
        self.graph = Graph(entities, relationships, chunks, documents, merged=True)
        self._contents = chunks.select(F.col("chunk_id").alias("id"), "content")
        index = bm25.build(self._contents)
        self._index = bm25.BM25Index(materialise(index.postings, "postings"), materialise(index.frequencies, "frequencies"), materialise(index.totals, "totals"))
        self._vectors = chunks.where("embedding is not null").select(F.col("chunk_id").alias("id"), "embedding") if c.includes_semantic else None
        self._built = True
        return self

    def _need_built(self) -> None:
        if not self._built:
            raise NotBuiltError("call build() first")

    def search_many(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """(query_id, id, score, semantic_score, keyword_score, rank, content) of queries(query_id, query)."""
        self._need_built()
        c = self.config
        asked = queries.select("query_id", "query")
        if c.includes_semantic:
            asked = self._embed(asked.withColumnRenamed("query", "content")).withColumnRenamed("content", "query")
        pool = HybridConfig(max_candidates=max(100, c.top_k * 10))
        hits = fusion.hybrid_search(self._index, self._vectors, asked, c.top_k if limit is None else limit, pool, c.similarity_threshold, c.includes_keyword, c.includes_semantic)
        return hits.join(self._contents, "id")

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        return self.search_many(asked, limit).orderBy("rank")

    def _answer(self, question: str, hits: list, top_k: int, sources: list[str]) -> Answer:
        if not hits:
            return Answer(NOTHING_FOUND, 0.0, [])
        sure = min(1.0, len(hits) / max(1, top_k))
        if self.model is not None and self.model.is_available():
            text = self.model.complete(fill(ANSWER, {"context": context_of(hits), "question": question}))
            return Answer(dual.strip_thinking(text), sure, sources)
        return Answer("Based on the retrieved context:\n\n" + "\n\n".join(h["content"] for h in hits[:3]), sure, sources)

    def ask(self, question: str) -> Answer:
        """An answer by the model, or the best three chunks where there is none."""
        hits = self.search(question).collect()
        return self._answer(question, hits, self.config.top_k, [h["id"] for h in hits])

    def ask_many(self, queries: DataFrame) -> DataFrame:
        """(query_id, text, confidence, sources): the extractive answers of all queries at once, those without a hit left out."""
        hits = self.search_many(queries)
        return extractive_answers(hits, self.config.top_k)

    def stats(self) -> DataFrame:
        """One row (documents, chunks, entities, relationships)."""
        self._need_built()
        g = self.graph
        parts = [t.agg(F.count("*").alias(n)) for n, t in (("documents", g.documents), ("chunks", g.chunks), ("entities", g.entities), ("relationships", g.relationships))]
        return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])

    def detect_communities(self, config: CommunityConfig = CommunityConfig()) -> DataFrame:
        self._need_built()
        return communities.detect(self.graph, config)

    def save_json(self, path: str) -> None:
        graph_json.save_json(self.graph, path)

    def dual(self, config: DualConfig = DualConfig(), keywords: KeywordConfig = KeywordConfig(), community: CommunityConfig = CommunityConfig()) -> DualEngine:
        """Two-level retrieval over what was built; it needs embeddings."""
        self._need_built()
        if not self.config.includes_semantic:
            raise ValidationError("two-level retrieval needs embeddings, which approach 'keyword' leaves out")
        options = SearchOptions(self.config.similarity_threshold, self.config.includes_keyword)
        return DualEngine(self, config, keywords, community, options)


def extractive_answers(hits: DataFrame, top_k: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "content")))
    grouped = hits.groupBy("query_id").agg(ordered.alias("h"))
    text = F.concat(F.lit("Based on the retrieved context:\n\n"), F.array_join(F.transform(F.slice("h", 1, 3), lambda x: x["content"]), "\n\n"))
    return grouped.select("query_id", text.alias("text"), F.least(F.lit(1.0), F.size("h") / max(1, top_k)).alias("confidence"), F.transform("h", lambda x: x["id"]).alias("sources"))


class DualEngine:
    """Communities and both stores, made on first use and kept."""

    def __init__(self, engine: Engine, config: DualConfig, keywords: KeywordConfig, community: CommunityConfig, options: SearchOptions):
        self.engine, self.config, self.keywords, self.community, self.options = engine, config, keywords, community, options
        self.top_k = engine.config.top_k
        self._stores: tuple[dual.Store, dual.Store] | None = None

    def detect_communities(self) -> DataFrame:
        return communities.detect(self.engine.graph, self.community)

    def stores(self) -> tuple[dual.Store, dual.Store]:
        if self._stores is None:
            graph, size = self.engine.graph, self.engine.config.embedding_dimension
            high = dual.community_contents(graph, materialise(self.detect_communities(), "communities"))
            self._stores = dual.build_store(materialise(high, "summaries"), size, self.options), dual.chunk_store(graph, size, self.options)
        return self._stores

    def retrieve(self, question: str, top_k: int | None = None) -> list:
        k = self.top_k if top_k is None else top_k
        if k <= 0 or self.keywords.max_keywords <= 0:
            return []
        return dual.retrieve(*self.stores(), question, k, self.engine.model, self.keywords, self.config).collect()

    def ask(self, question: str, top_k: int | None = None) -> Answer:
        hits = self.retrieve(question, top_k)
        sources = list(dict.fromkeys(c for h in hits for c in h["source_chunks"]))
        return self.engine._answer(question, hits, self.top_k if top_k is None else top_k, sources)


@dataclass(frozen=True)
class Builder:
    """Fluent configuration: every with_ call returns a changed copy."""

    config: EngineConfig = EngineConfig()

    def _but(self, **changes) -> Builder:
        return Builder(replace(self.config, **changes))

    def with_config(self, config: EngineConfig) -> Builder:
        return Builder(config)

    def with_output_dir(self, path: str) -> Builder:
        return self._but(output_dir=path)

    def with_chunk_size(self, size: int) -> Builder:
        return self._but(chunk_size=size)

    def with_chunk_overlap(self, overlap: int) -> Builder:
        return self._but(chunk_overlap=overlap)

    def with_top_k(self, k: int) -> Builder:
        return self._but(top_k=k)

    def with_similarity_threshold(self, threshold: float) -> Builder:
        return self._but(similarity_threshold=threshold)

    def with_approach(self, approach: str) -> Builder:
        return self._but(approach=approach)

    def with_embedding_dimension(self, dimension: int) -> Builder:
        return self._but(embedding_dimension=dimension)

    def with_hash_embeddings(self) -> Builder:
        return self._but(embedding_backend="hash")

    def with_model_server(self, server: ModelServerConfig = ModelServerConfig()) -> Builder:
        """Chat and extraction by the server."""
        return self._but(server=server, use_chat_model=True)

    def with_server_embeddings(self, server: ModelServerConfig = ModelServerConfig()) -> Builder:
        return self._but(server=server, embedding_backend="server", embedding_dimension=server.embedding_dimension)

    def with_local_defaults(self) -> Builder:
        return self.with_model_server().with_server_embeddings()

    def build(self, spark: SparkSession) -> Engine:
        c = self.config
        model = ChatClient(c.server) if c.use_chat_model else None
        embedder = EmbeddingClient(c.server) if c.embedding_backend.lower() in ("server", "ollama") else None
        return Engine(spark, c, embedder, model, ModelExtractor(model) if model else None)
