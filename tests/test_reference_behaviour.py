"""Small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.config import BM25Config, ChunkConfig, CommunityConfig, DualConfig, EngineConfig, KeywordConfig, Merge, ModelServerConfig, TraversalConfig
from lodestone.functions import text as T
from lodestone.functions.vectors import bucket, cosine, fnv1a, sign
from lodestone.operators import analytics, bm25, chunking, communities, dual, extraction, graph_store, keywords, llm_extraction, traversal, vector_search
from lodestone.operators.graph_store import MENTION, Graph
from lodestone.plans.engine import Builder, Engine
from lodestone.sources import graph_json
from lodestone.streaming import ingest

ENTITY = f"entity_ord long, entity_id string, name string, entity_type string, confidence double, mentions array<{MENTION}>"
EDGE = "rel_ord long, source string, target string, relation_type string, confidence double, context array<string>"


def graph(spark, names, edges):
    nodes = spark.createDataFrame([(i, n, n.upper(), "T", 0.9, []) for i, n in enumerate(names)], ENTITY)
    rows = [(i, s, t, k, c, []) for i, (s, t, k, c) in enumerate(edges)]
    return Graph(nodes, spark.createDataFrame(rows, EDGE))


def chain(spark):
    return graph(spark, "abcd", [("a", "b", "R", 1.0), ("b", "c", "R", 1.0), ("c", "d", "R", 1.0)])


def triangles(spark):
    e = [(f"{x}{i}", f"{x}{j}", "R", 1.0) for x in "ab" for i, j in ((1, 2), (2, 3), (1, 3))]
    return graph(spark, ["a1", "a2", "a3", "b1", "b2", "b3"], e)


def one(df, column="value"):
    return df.first()[column]


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_chunks_overlap_and_cover():
    text = "The first sentence is about graphs here. The second sentence is about trees. " * 20
    got = chunking.spans(text, ChunkConfig(200, 50, min_size=10))
    assert len(got) > 1 and all(text[a:b] == c for c, a, b in got)
    assert all(x[1] < y[1] < x[2] for x, y in zip(got, got[1:])) and got[-1][2] == len(text)
    assert chunking.spans("", ChunkConfig()) == [] and chunking.spans("abc", ChunkConfig()) == [("abc", 0, 3)]
    assert [b - a for _, a, b in chunking.spans("x" * 2500, ChunkConfig(1000, 200))] == [1000, 1000, 500]
    for bad in (dict(overlap=-10), dict(size=0), dict(size=10, overlap=10)):
        with pytest.raises(errors.ConfigError):
            ChunkConfig(**bad)


def test_chunk_table(spark):
    docs = spark.createDataFrame([(0, "doc1", "A short document about graphs and graphs."), (1, "doc2", None)], "doc_ord long, doc_id string, content string")
    rows = chunking.chunk(docs).collect()
    assert [(r.chunk_id, r.metadata.word_count) for r in rows] == [("doc1_0", 7)] and rows[0].metadata.keywords[0] == "graphs"


def test_keywords_leave_out_stopwords(spark):
    docs = spark.createDataFrame([("d", "Graphs and graphs and the nodes don't matter 123")], "doc_id string, content string")
    got = [r.term for r in keywords.keywords(docs, 3).orderBy("rank").collect()]
    assert got == ["graphs", "dont", "matter"] == keywords.frequent_terms(docs.first().content, 3)
    assert keywords.keywords(docs, 0).count() == 0


def test_bm25_known_scores(spark):
    rows = [("a", "graph nodes edges link graph structure"), ("b", "cooking pasta sauce tomato basil"), ("c", "nodes edges graph graph theory rank")]
    docs = spark.createDataFrame(rows, "id string, content string")
    ask = spark.createDataFrame([("q", "graph nodes edges")], "query_id string, query string")
    got = bm25.search(bm25.build(docs), ask, 10, BM25Config()).orderBy("rank").collect()
    idf = math.log(3 / 2) + 1
    part = lambda tf: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 6 / (17 / 3)))
    assert [(r.id, round(r.score, 6)) for r in got] == [(x, round(part(2) + 2 * part(1), 6)) for x in "ac"]
    assert bm25.search(bm25.build(docs), ask, -1).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    assert df.select(*(cosine(F.col("a"), F.col(x)).alias(x) for x in "abzs")).first().asDict() == {"a": 1.0, "b": 0.0, "z": 0.0, "s": 0.0}
    h = fnv1a(F.lit("graph"))
    row = spark.range(1).select(((h["hi"].cast("decimal(20,0)") * 4294967296) + h["lo"]).alias("h"), bucket(h, 384).alias("b"), sign(h).alias("s")).first()
    assert (int(row.h), row.b, row.s) == (3669475100274348679, 7, -1) and vector_search._hash("graph") == 3669475100274348679
    texts = spark.createDataFrame([("g", "graphs and nodes"), ("c", "cooking pasta")], "id string, content string")
    stored = vector_search.embed_texts(texts, 128)
    asked = vector_search.embed_texts(spark.createDataFrame([("q", "nodes of graphs")], "query_id string, content string"), 128)
    assert one(vector_search.nearest(stored, asked, 1), "id") == "g"
    for most in (0, 4_000_000):
        vector_search.BROADCAST_NUMBERS = most
        assert [(r.id, r.rank) for r in vector_search.nearest(stored, asked, 2).orderBy("rank").collect()] == [("g", 1), ("c", 2)]


def test_merge_and_neighbours(spark):
    g = graph(spark, "ab", [])
    raw = spark.createDataFrame([(0, "a", "b", "R", 0.5, ["c1"]), (1, "a", "b", "R", 0.9, ["c2", "c1"]), (2, "a", "zz", "R", 0.9, [])], EDGE.replace("rel_ord", "seq"))
    edges = graph_store.merge_relationships(raw, g.entities).collect()
    assert [(e.confidence, e.context, e.rel_ord) for e in edges] == [(0.9, ["c1", "c2"], 0)]
    g = graph(spark, "ab", [("a", "b", "R", 0.4), ("b", "a", "R", 0.8), ("a", "a", "S", 1.0)])
    near = {(r.node, r.neighbour, r.relation_type): r.confidence for r in graph_store.neighbours(g.relationships).collect()}
    assert near == {("a", "b", "R"): 0.8, ("b", "a", "R"): 0.8, ("a", "a", "S"): 1.0}
    assert values(graph_store.degrees(g), "entity_id", "degree") == {"a": 4, "b": 2}
    assert graph_store.find_by_name(g.entities, "A").count() == 1 and graph_store.find_by_name(g.entities, "").count() == 2


def test_pagerank(spark):
    g = graph(spark, ["a", "b", "c", "hub"], [(x, "hub", "R", 1.0) for x in "abc"])
    got = values(analytics.pagerank(g), "entity_id", "score")
    assert got["hub"] == pytest.approx(0.541985, abs=1e-5) and got["a"] == pytest.approx(0.152672, abs=1e-5) and sum(got.values()) == pytest.approx(1)
    assert [r.entity_id for r in analytics.top_entities(analytics.pagerank(g, iterations=9), 2).collect()] == ["hub", "a"]
    assert values(analytics.pagerank(graph(spark, "a", [])), "entity_id", "score") == {"a": 1.0}


def test_walks(spark):
    g = chain(spark)
    nodes, tree = traversal.bfs(g, ["a", "nobody"], TraversalConfig(max_depth=2))
    assert values(nodes, "entity_id", "distance") == {"a": 0, "b": 1, "c": 2} and tree.count() == 2
    walked = traversal.dfs(g, ["a"], TraversalConfig(max_depth=2)).orderBy("ord").collect()
    assert [(r.entity_id, r.distance, r.target) for r in walked] == [("a", 0, None), ("b", 1, "b"), ("c", 2, "c")]
    assert one(traversal.shortest_path(g, "a", "d"), "path") == list("abcd") and traversal.shortest_path(g, "a", "d", 2).count() == 0
    assert one(traversal.shortest_path(g, "b", "b"), "path") == ["b"] and traversal.shortest_path(g, "a", "zz").count() == 0
    weak = graph(spark, "ab", [("a", "b", "R", 0.2)])
    assert traversal.bfs(weak, ["a"])[0].count() == 1 and traversal.bfs(weak, ["a"], TraversalConfig(use_weights=False))[0].count() == 2
    square = graph(spark, "abcd", [("a", "b", "R", 1.0), ("a", "b", "S", 1.0), ("a", "c", "R", 1.0), ("b", "d", "R", 1.0), ("c", "d", "R", 1.0), ("b", "c", "R", 1.0)])
    paths = ["".join(r.path) for r in traversal.all_paths(square, "a", "d").collect()]
    assert paths == ["abd", "abcd", "acd", "acbd"] or sorted(paths) == ["abcd", "abd", "acbd", "acd"]
    assert traversal.all_paths(square, "a", "d", TraversalConfig(max_paths=2)).count() == 2
    assert traversal.ego_network(square, "a", 1)[1].count() == 3


def test_shape(spark):
    g = chain(spark)
    c = {r.entity_id: r for r in analytics.centralities(g).collect()}
    assert (c["a"].closeness, c["b"].closeness, c["a"].betweenness, round(c["b"].betweenness, 4)) == (0.5, 0.75, 0.0, 0.6667)
    s = analytics.graph_stats(g).first()
    assert (s.node_count, s.edge_count, s.average_degree, s.max_depth) == (4, 3, 1.5, 3) and one(analytics.density(g), "density") == 0.5
    assert set(values(analytics.clustering(g), "entity_id", "clustering").values()) == {0.0}
    assert set(values(analytics.clustering(triangles(spark)), "entity_id", "clustering").values()) == {1.0}
    pair = graph(spark, "abc", [("a", "b", "R", 1.0)])
    assert values(analytics.degree_centrality(pair), "entity_id", "degree")["a"] == 0.5
    assert analytics.connected_components(pair).select("component").distinct().count() == 2
    assert {r.entity_id for r in analytics.connected_component(pair, "b").collect()} == {"a", "b"}


def test_communities(spark):
    g = triangles(spark)
    got = values(communities.detect(g), "entity_id", "community_id")
    assert got == {"a1": 0, "a2": 0, "a3": 0, "b1": 1, "b2": 1, "b3": 1}
    placed = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, community int")
    assert one(communities.modularity(communities.undirected_weights(g), placed), "modularity") == pytest.approx(0.5)
    assert len(set(values(communities.detect(g, CommunityConfig(max_iterations=0)), "entity_id", "community_id").values())) == 6
    assert sorted(values(communities.detect(graph(spark, "xyz", [])), "entity_id", "community_id").values()) == [0, 1, 2]
    assert communities.detect(graph(spark, "", [])).count() == 0
    text = values(communities.summaries(g, communities.detect(g)), "community_id", "content")
    assert text[0] == "Entities: A1, A2, A3. Relationships: R"


def test_extraction():
    text = "Dr. Ada Lovelace works for Acme, Inc. in London. Bob Stone is married to Carol White."
    entities, edges = extraction.extract_text(text, "c1", 0.5)
    assert {(e["name"], e["entity_type"]) for e in entities} == {("Dr. Ada Lovelace", "PERSON"), ("Acme, Inc", "ORGANIZATION"), ("London", "LOCATION"), ("Bob Stone", "PERSON"), ("Carol White", "PERSON")}
    kinds = {(e["source"], e["relation_type"], e["target"]) for e in edges}
    assert ("person_dr_ada_lovelace", "WORKS_FOR", "organization_acme_inc") in kinds and ("person_bob_stone", "MARRIED_TO", "person_carol_white") in kinds
    assert all(text[m["start_offset"] : m["end_offset"]] == e["name"] for e in entities for m in e["mentions"])
    names = {e["name"] for e in extraction.extract_text("Ada Lovelace worked with Charles Babbage in London.", "c")[0]}
    assert names == {"Ada Lovelace", "Charles Babbage", "London"}
    assert extraction.classify("The United States") == ("LOCATION", 0.9) and extraction.classify("Monday") is None


class Model:
    def __init__(self, *answers):
        self.answers = list(answers)

    def complete(self, prompt, temperature=None, max_tokens=None):
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]

    def is_available(self):
        return True


def test_model_extraction():
    answer = '<x> ```json\n{"entities": [{"entity_name": "Ann", "type": "person"}, {"name": "Bo", "type": ""}], "relationships": [{"source": "ann", "target": "Bo", "description": "is a friend of", "strength": 7}, {"source": "Ann", "target": "Zed"}]}\n``` end'
    entities, edges = llm_extraction.ModelExtractor(Model(answer, '{"entities": [{"name": "Cy"}]}', "nothing"), gleaning=5)("Annabelle met Ann and Bo.", "c")
    assert [(e["entity_id"], len(e["mentions"])) for e in entities] == [("person_ann", 1), ("concept_bo", 1), ("concept_cy", 0)]
    assert entities[0]["mentions"][0]["start_offset"] == 14 and [(e["relation_type"], e["confidence"]) for e in edges] == [("IS_A_FRIEND", 1.0)]
    assert llm_extraction.parse("no json") is None and llm_extraction.fill("{a} {b}", {"a": "{b}"}) == "{b} {b}"


def test_question_keywords():
    f = dual.fallback_keywords
    assert f("Ada Bob IBM", 20)[0] == ["Ada", "Bob", "IBM"] and f("what is the", 20)[0] == ["what", "is", "the"]
    assert f("graph-based retrieval Graph", 20)[1] == ["graph", "based", "retrieval"] and f("alpha beta gamma delta", 2) == (["alpha", "beta"], ["alpha", "beta"])
    assert KeywordConfig(-1).max_keywords == 0
    found = dual.extract_keywords("q", Model('<think>{</think> {"high_level": ["a", "b"], "low_level": ["c"]}'), KeywordConfig(2))
    assert found == (["a", "b"], [])


def test_dual_merge(spark):
    schema = "query_id string, id string, score double, rank int"
    high, low = spark.createDataFrame([("q", "community_0", 0.9, 1), ("q", "h2", 0.4, 2)], schema), spark.createDataFrame([("q", "community_0", 0.8, 1)], schema)

    def merged(strategy, k=10):
        return [(r.level, r.id) for r in dual.merge_levels(high, low, k, DualConfig(strategy=strategy)).orderBy("position").collect()]

    assert merged(Merge.INTERLEAVE) == [("h", "community_0"), ("l", "community_0"), ("h", "h2")] and merged(Merge.INTERLEAVE, 0) == []
    assert merged(Merge.LOW_FIRST)[0] == ("l", "community_0") and merged(Merge.HIGH_FIRST, 2) == [("h", "community_0"), ("h", "h2")]
    assert merged(Merge.WEIGHTED) == [("h", "community_0"), ("l", "community_0"), ("h", "h2")]


def test_text_columns(spark):
    row = spark.createDataFrame([("One two. Three!\n four", "<think>a</think> b <think>c</think>", "x</think> y <think>z</think>")], "a string, b string, c string").select(
        T.sentences(F.col("a")).alias("s"), T.word_count(F.col("a")).alias("w"), T.clean_text(F.col("a")).alias("c"), T.strip_thinking(F.col("b")).alias("b"), T.strip_thinking(F.col("c")).alias("k"), T.entity_id(F.lit("PERSON"), F.lit("Dr. Ada  L!")).alias("e"),
    ).first()
    assert row.asDict() == {"s": ["One two.", "Three!", "four"], "w": 4, "c": "One two. Three! four", "b": "b", "k": "x</think> y <think>z</think>", "e": "person_dr_ada_l"}


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, EngineConfig(chunk_size=400, chunk_overlap=50, top_k=3, similarity_threshold=0.0, min_confidence=0.5))
    with pytest.raises(errors.NotBuiltError):
        engine.ask("anything?")
    with pytest.raises(errors.NoDocumentsError):
        engine.build()
    engine.add_document("Ada Lovelace worked with Charles Babbage in London. They wrote programs for computing engines.", doc_id="fixed")
    engine.add_document("Pasta is cooked in salted water. Tomato sauce goes well with basil.", doc_id="cooking")
    engine.build()
    stats = engine.stats().first()
    assert (stats.documents, stats.chunks) == (2, 2) and stats.entities >= 3
    answer = engine.ask("Who worked on computing engines?")
    assert "Lovelace" in answer.text and "fixed_0" in answer.sources and 0 < answer.confidence <= 1
    two = engine.dual()
    assert two.retrieve("computing", 0) == [] and len(two.retrieve("Lovelace Babbage computing", 2)) == 2 and two.ask("Lovelace computing").sources
    path = str(tmp_path / "g.json")
    engine.save_json(path)
    back = graph_json.load_json(spark, path)
    assert back.entities.count() == stats.entities and back.chunks.count() == 2 and graph_json.to_json(back).count("entity_id") == graph_json.to_json(engine.graph).count("entity_id")
    engine.add_document("A new version without the old names.", doc_id="fixed")
    engine.build()
    assert engine.stats().first().documents == 2 and engine.search("Lovelace").where("keyword_score > 0").count() == 0


def test_builder_and_addresses(spark):
    assert ModelServerConfig(host="localhost").base_url == "http://localhost:11434" and ModelServerConfig(host="https://h:1").base_url == "https://h:1"
    engine = Builder().with_chunk_size(100).with_chunk_overlap(10).with_top_k(-5).with_approach("keyword").build(spark)
    engine.add_document("Some text about rivers and hills.")
    engine.build()
    assert engine.ask("rivers").sources == []
    with pytest.raises(errors.ValidationError):
        engine.dual()


def test_engine_batches(spark):
    engine = Engine(spark, EngineConfig(chunk_size=200, chunk_overlap=20, top_k=3, similarity_threshold=0.0, min_confidence=0.5))
    schema = "doc_id string, title string, content string, extra int"
    first = [("a", "A", "Ada Lovelace worked with Charles Babbage in London. " * 6, 1), ("b", "B", "Pasta is cooked in salted water.", 1), ("c", "C", "Bob Stone lives in Paris.", 1)]
    engine.add_documents(spark.createDataFrame(first, schema))
    engine.add_documents(spark.createDataFrame([("b", "B", "Grace Hopper works for Acme, Inc. in Boston.", 2), ("d", "D", None, 2), ("e", None, "", 2)], schema))
    engine.build()
    stats = engine.stats().first()
    assert stats.documents == 5 and stats.chunks >= 4 and stats.entities >= 6
    assert engine.search("pasta salted").where("keyword_score > 0").count() == 0 and "b_0" in engine.ask("Grace Hopper Boston").sources
    g = engine.graph
    for rows, place in ((g.documents, "doc_ord"), (g.chunks, "chunk_ord"), (g.entities, "entity_ord"), (g.relationships, "rel_ord")):
        got = sorted(r[0] for r in rows.select(place).collect())
        assert got == list(range(len(got)))
    at = values(g.documents, "doc_id", "doc_ord")
    assert {at[x] for x in "abc"} == {0, 1, 2} and {at[x] for x in "de"} == {3, 4}  # a replaced document keeps its place
    assert engine.detect_communities().count() == stats.entities


def test_vector_ids_keep_their_types_in_both_plans(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([(100 + i, e) for i, e in rows[::7]], "query_id int, embedding array<double>")
    few = sorted(vector_search.nearest(vectors, asked, 5, 0.1).collect())
    monkeypatch.setattr(vector_search, "BROADCAST_NUMBERS", 0)
    many = sorted(vector_search.nearest(vectors, asked, 5, 0.1).collect())
    blocks = sorted(r[:3] for r in vector_search._scored(vectors, asked, None, 0.1, 2, 7).collect())
    assert few == many and len(few) > 20 and isinstance(few[0]["id"], int)
    assert blocks == sorted(r[:3] for r in vector_search.similar(vectors, asked, 0.1).collect())


def test_stream_upserts(spark, tmp_path):
    schema = "doc_id string, title string, content string"
    source, stored = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", "A", "old"), ("b", "B", "kept")], [("a", "A", "new")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.upsert_stream(spark.readStream.schema(schema).parquet(source), stored, str(tmp_path / "state")).awaitTermination()
    assert values(ingest.current_documents(spark, stored), "doc_id", "content") == {"a": "new", "b": "kept"}


def test_pagerank_against_power_iteration(spark):
    rng = np.random.default_rng(1)
    names = [f"n{i}" for i in range(20)]
    edges = [(names[a], names[b], f"T{k % 2}", round(float(w), 2)) for k, (a, b, w) in enumerate(zip(rng.integers(0, 15, 60), rng.integers(0, 20, 60), rng.random(60)))]
    edges = list({e[:3]: e for e in edges}.values())
    got = values(analytics.pagerank(graph(spark, names, edges)), "entity_id", "score")
    w = np.zeros((20, 20))
    for a, b, _, v in edges:
        w[names.index(a), names.index(b)] += v
    out, s = w.sum(1), np.full(20, 0.05)
    for _ in range(100):
        fresh = 0.15 / 20 + 0.85 * s[out == 0].sum() / 20 + 0.85 * (s[out > 0] / out[out > 0]) @ w[out > 0]
        moved, s = np.abs(fresh - s).max(), fresh
        if moved < 1e-6:
            break
    assert got == pytest.approx(dict(zip(names, s / s.sum())), abs=1e-9)


def test_clustering_against_brute_force(spark):
    rng = np.random.default_rng(2)
    names = [f"n{i:02}" for i in range(25)]
    pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 24, 90), rng.integers(0, 24, 90))} | {(0, i) for i in range(20)} | {(3, 3)}
    got = values(analytics.clustering(graph(spark, names, [(names[a], names[b], "R", 1.0) for a, b in pairs])), "entity_id", "clustering")
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(25)}
    for i, n in near.items():
        both = [(x, y) for x in n for y in n if x < y]
        assert got[names[i]] == pytest.approx(sum(y in near[x] for x, y in both) / len(both) if both else 0.0), i
