"""Chunks and extraction in pieces, and only what is asked for."""

from lodestone.config import ChunkConfig
from lodestone.operators import chunking, extraction, keywords


def test_chunks_of_many_documents_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chunking, "CHARACTERS", 500)
    texts = [(i, f"d{i}", None if i == 3 else "Ada Lovelace met Bob. " * (i % 7)) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_ord long, doc_id string, content string")
    config = ChunkConfig(size=60, overlap=10)
    got = sorted((r.doc_id, r.metadata["index"], r.content, r.start_offset, r.end_offset, r.metadata["keywords"]) for r in chunking.chunk(docs, config).collect())
    want = sorted((d, k, c, a, b, keywords.frequent_terms(c, config.keywords)) for _, d, t in texts for k, (c, a, b) in enumerate(chunking.spans(t, config)))
    assert got == want and len(got) > 50


def test_extraction_counts_no_keywords(spark):
    docs = spark.createDataFrame([(0, "a", "Ada Lovelace met Bob.")], "doc_ord long, doc_id string, content string")
    plan = extraction.extract(chunking.chunk(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "terms" not in plan


def test_sentences_bound_what_is_related():
    crowd = " ".join(f"Person{chr(65 + i // 26)}{chr(97 + i % 26)} Smith sang." for i in range(300))
    calls = 0

    def counted(*x, real=extraction.relation_type):
        nonlocal calls
        calls += 1
        return real(*x)

    kept, extraction.relation_type = extraction.relation_type, counted
    try:
        entities, edges = extraction.extract_text(crowd, "c")
    finally:
        extraction.relation_type = kept
    assert len(entities) == 300 and edges == [] and calls == 0
    assert extraction._sentence_ends("Dr. No! Yes.\n") == [6, 11, 12]
