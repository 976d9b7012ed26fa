"""Keyword, vector and hybrid retrieval over the documents, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Fusion, HybridConfig
from lodestone.functions.vectors import bucket, fnv1a, sign
from lodestone.functions.text import plain_tokens
from lodestone.operators import bm25, fusion, vector_search
from lodestone.plans.engine import context_column, extractive_answers
from lodestone.plans.text_queries import index_sql, plain_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


POSTINGS = f"""
docs as (select cast(doc_id as varchar) as id, text as content, {index_sql()} as ts from documents),
lens as (select id, len(ts) as n from docs),
tf as (select id, term, count(*) as tf from (select id, unnest(ts) as term from docs) group by 1, 2),
df as (select term, count(*) as df from tf group by 1),
tot as (select count(*) as docs, avg(n) as average from lens)
"""
ASKED = f"asked as (select query_id, unnest(list_distinct({index_sql('query')})) as term from (select item_id as query_id, text as query from benchmark))"


def bm25_sql(limit: int) -> str:
    return (
        f"{POSTINGS}, {ASKED}, "
        "bscore as (select query_id, id, round(sum((ln(docs / cast(df as double)) + 1) * tf * 2.2 / greatest(tf + 1.2 * (0.25 + 0.75 * n / greatest(average, 1)), 1e-4)), 9) as score "
        "from tf join asked using (term) join df using (term) join lens using (id), tot group by 1, 2), "
        f"kw as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from bscore where score > 0) where rank <= {limit})"
    )


FNV = (
    "(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, octet_length(encode(term)) + 1), lambda i: ('0x' || substr(hex(encode(term)), 2 * i - 1, 2))::integer::hugeint)), "
    "lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint))"
)


@query(f"with {POSTINGS} select docs as documents, (select count(*) from df) as terms, round(average, 6) as average_length from tot")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.stats(bm25.build(contents(spark, sf_dir))).withColumn("average_length", F.round("average_length", 6))


@query(f"with {bm25_sql(10)} select query_id, id, cast(rank as integer) as rank, round(score, 6) as score from kw")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(bm25.build(contents(spark, sf_dir)), questions(spark, sf_dir), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_SINGLE = "the thing or station reading that heather"


@query(f"with {bm25_sql(10).replace('(select item_id as query_id, text as query from benchmark)', f'''(select 0 as query_id, '{_SINGLE}' as query)''')} select id, cast(rank as integer) as rank, round(score, 6) as score from kw")
def bm25_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(0, _SINGLE)], "query_id int, query string")
    return bm25.search(bm25.build(contents(spark, sf_dir)), asked, 10).select("id", "rank", F.round("score", 6).alias("score"))


_REMAINING = POSTINGS.replace("from documents)", "from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1))")


@query(f"with {_REMAINING} select docs as documents, (select count(*) from df) as terms, round(average, 6) as average_length from tot")
def bm25_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return bm25.stats(bm25.build(bm25.remove(contents(spark, sf_dir), gone))).withColumn("average_length", F.round("average_length", 6))


@query(
    f"with t as (select distinct term from (select unnest({plain_sql()}) as term from documents)) "
    f"select term, cast({FNV} % 384 as integer) as bucket, case when {FNV} % 2 = 0 then 1 else -1 end as sign from t"
)
def fnv_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = contents(spark, sf_dir).select(F.explode(plain_tokens(F.col("content"))).alias("term")).distinct().withColumn("h", fnv1a(F.col("term")))
    return terms.select("term", bucket(F.col("h"), 384).alias("bucket"), sign(F.col("h")).alias("sign"))


def _sparse_sql(name: str, source: str, text: str, key: str, dimension: int) -> str:
    return (
        f"{name}_t as (select {key} as id, term, count(*) as tf from (select {key}, unnest({plain_sql(text)}) as term from {source}) group by 1, 2), "
        f"{name}_h as (select term, {FNV} as h from (select distinct term from {name}_t)), "
        f"{name} as (select id, cast(h % {dimension} as integer) as bucket, sum(case when h % 2 = 0 then tf else -tf end) as value from {name}_t join {name}_h using (term) group by 1, 2)"
    )


@query(f"with {_sparse_sql('v', 'documents', 'text', 'doc_id', 128)} select cast(id as varchar) as id, bucket, cast(value as bigint) as value from v")
def hash_embed_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.hash_terms(contents(spark, sf_dir), 128)


_PAIR = "coalesce(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 0)"
_KNN = (
    f"with s as (select a.vec_id as query_id, cast(b.vec_id as varchar) as id, round({_PAIR}, 9) as score from embeddings a, embeddings b), "
    "r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, id, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= 5"
)


def _all_vectors(spark, sf_dir, k, threshold=None) -> DataFrame:
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_search.nearest(vectors(spark, sf_dir), asked, k, threshold).withColumn("score", F.round("score", 6))


@query(_KNN)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_vectors(spark, sf_dir, 5)


@query(_KNN + " and score >= 0.3")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_vectors(spark, sf_dir, 5, 0.3)


@query(f"select a.vec_id as query_id, cast(b.vec_id as varchar) as id, round(round({_PAIR}, 9), 6) as score from embeddings a, embeddings b where round({_PAIR}, 9) >= 0.35")
def range_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_search.similar(vectors(spark, sf_dir), asked, 0.35).withColumn("score", F.round("score", 6))


@query("select count(*) as count, cast(len(arg_min(embedding, cast(vec_id as varchar))) as integer) as dimension from embeddings")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.collection_stats(vectors(spark, sf_dir))


def hybrid_sql(kind: Fusion, keyword: bool = True, semantic: bool = True, limit: int = 10) -> str:
    sem = (
        "qv as (select item_id as id, text from benchmark), "
        + _sparse_sql("dv", "documents", "text", "doc_id", 128)
        + ", "
        + _sparse_sql("qs", "qv", "text", "id", 128)
        + ", dn as (select id, sqrt(sum(value * value)) as n from dv group by 1), qn as (select id, sqrt(sum(value * value)) as n from qs group by 1), "
        "cosines as (select qs.id as query_id, cast(dv.id as varchar) as id, round(cast(sum(qs.value * dv.value) as double) / (any_value(qn.n) * any_value(dn.n)), 9) as score from dv join qs using (bucket) join dn on dn.id = dv.id join qn on qn.id = qs.id group by 1, 2), "
        "sem as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from cosines where score > 0) where rank <= 100)"
    )
    if not semantic:
        sem = "sem as (select * from kw where false)"
    kw = bm25_sql(100)
    if not keyword:
        kw += ", kw2 as (select * from kw where false)"
    right = "kw" if keyword else "kw2"
    s, k = "coalesce(s.score, 0)", "coalesce(k.score, 0)"
    score = {
        Fusion.RRF: "coalesce(0.7 / (60 + s.rank), 0) + coalesce(0.3 / (60 + k.rank), 0)",
        Fusion.WEIGHTED: f"coalesce({s} / nullif(max({s}) over w, 0), 0) * 0.7 + coalesce({k} / nullif(max({k}) over w, 0), 0) * 0.3",
        Fusion.COMB_SUM: f"{s} + {k}",
        Fusion.MAX_SCORE: f"greatest({s}, {k})",
    }[kind]
    least = "" if kind is Fusion.RRF else "where score >= 0.1"
    return (
        f"with {kw}, {sem}, fused as (select coalesce(s.query_id, k.query_id) as query_id, coalesce(s.id, k.id) as id, round(cast({score} as double), 9) as score, {s} as semantic_score, {k} as keyword_score "
        f"from sem s full join {right} k on s.query_id = k.query_id and s.id = k.id window w as (partition by coalesce(s.query_id, k.query_id))), "
        f"ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from fused {least}) "
        f"select query_id, id, cast(rank as integer) as rank, round(score, 6) as score, round(cast(semantic_score as double), 5) as semantic_score, round(cast(keyword_score as double), 6) as keyword_score from ranked where rank <= {limit}"
    )


def hybrid(spark: SparkSession, sf_dir: str, kind: Fusion = Fusion.RRF, keyword: bool = True, semantic: bool = True) -> DataFrame:
    docs, asked = contents(spark, sf_dir), questions(spark, sf_dir)
    stored = vector_search.embed_texts(docs, 128, kind="double").select("id", "embedding")
    found = fusion.hybrid_search(bm25.build(docs) if keyword else None, stored, vector_search.embed_texts(asked, 128, "query", kind="double"), 10, HybridConfig(fusion=kind), 0.0, keyword, semantic)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"), F.round("semantic_score", 5).alias("semantic_score"), F.round("keyword_score", 6).alias("keyword_score"))


for _name, _kind, _kw, _sem in (
    ("hybrid_rrf", Fusion.RRF, True, True),
    ("hybrid_weighted", Fusion.WEIGHTED, True, True),
    ("hybrid_combsum", Fusion.COMB_SUM, True, True),
    ("hybrid_maxscore", Fusion.MAX_SCORE, True, True),
    ("semantic_only", Fusion.RRF, False, True),
    ("keyword_only", Fusion.RRF, True, False),
):
    QUERIES[_name] = partial(hybrid, kind=_kind, keyword=_kw, semantic=_sem)
    ORACLES[_name] = hybrid_sql(_kind, _kw, _sem)

_HITS = f"with {bm25_sql(10)}, hits as (select kw.*, content from kw join docs using (id)) "


@query(
    _HITS + "select query_id, 'Based on the retrieved context:' || chr(10) || chr(10) || string_agg(content, chr(10) || chr(10) order by rank) filter (where rank <= 3) as text, "
    "least(1.0, count(*) / 10.0)::double as confidence, string_agg(id, ',' order by rank) as sources from hits group by 1"
)
def ask_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contents(spark, sf_dir)
    hits = bm25.search(bm25.build(docs), questions(spark, sf_dir), 10).join(docs, "id")
    return extractive_answers(hits, 10).withColumn("sources", F.array_join("sources", ","))


@query(_HITS + "select query_id, string_agg('[Chunk | Relevance: ' || printf('%.3f', round(score, 6)) || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from hits group by 1")
def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contents(spark, sf_dir)
    hits = bm25.search(bm25.build(docs), questions(spark, sf_dir), 10).join(docs, "id")
    return context_column(hits.withColumn("score", F.round("score", 6)))
