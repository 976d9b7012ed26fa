"""Text operators over the documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.lexicons import NOT_ENTITIES, ORGANISATION_BEGINNINGS, ORGANISATION_ENDINGS, PLACES, QUESTION_WORDS, STOPWORDS, TITLES
from lodestone.operators import extraction, keywords
from lodestone.operators.chunking import chunk

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (doc_ord, doc_id string, content)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))


def listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NONSPACE = SPACE.replace("[", "[^", 1)
WORD = r"(?:[\p{L}\p{N}]\p{M}*)+"


def plain_sql(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def index_sql(text: str = "text") -> str:
    return f"list_filter({plain_sql(text)}, lambda t: length(t) >= 2 and t not in {listed(STOPWORDS)})"


def keyword_sql(text: str = "text") -> str:
    bare = f"list_transform(regexp_extract_all(lower({text}), '{NONSPACE}+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}\\p{{M}}_-]', '', 'g'))"
    return f"list_filter({bare}, lambda t: length(t) >= 3 and t not in {listed(STOPWORDS)} and not regexp_matches(t, '^\\p{{N}}+$'))"


def _tokens(spark, sf_dir, tokens) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.explode(tokens(F.col("content"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _tokens_sql(tokens: str) -> str:
    return f"select cast(doc_id as varchar) as doc_id, term, count(*) as tf from (select doc_id, unnest({tokens}) as term from documents) group by 1, 2"


@query(_tokens_sql(index_sql()))
def tok_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, T.index_tokens)


@query(_tokens_sql(plain_sql()))
def tok_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, T.plain_tokens)


@query(_tokens_sql(keyword_sql()))
def tok_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, T.keyword_tokens)


@query(
    "with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+'), "
    f"lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') as s from documents) "
    "select cast(doc_id as varchar) as doc_id, generate_subscripts(s, 1) - 1 as position, unnest(s) as sentence from s"
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("content"))).alias("position", "sentence")).withColumn("position", F.col("position").cast("long"))


@query(f"select cast(doc_id as varchar) as doc_id, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) as text from documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", T.clean_text(F.col("content")).alias("text"))


@query(f"select cast(doc_id as varchar) as doc_id, cast(len(regexp_extract_all(text, '{NONSPACE}+')) as integer) as words from documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", T.word_count(F.col("content")).alias("words"))


_TFIDF = f"""
with t as (select cast(doc_id as varchar) as doc_id, {keyword_sql()} as ts from documents),
flat as (select doc_id, len(ts) as n, unnest(ts) as term from t),
tf as (select doc_id, n, term, count(*) as tf from flat group by 1, 2, 3),
df as (select term, count(*) as df from tf group by 1),
size as (select count(*) as docs from documents)
"""


@query(
    _TFIDF + ", scored as (select doc_id, term, tf / cast(n as double) * greatest(ln((docs + 1) / cast(df + 1 as double)) + 1, 0) as score from tf join df using (term), size), "
    "ranked as (select *, row_number() over (partition by doc_id order by round(score, 12) desc, term) as r from scored) "
    "select doc_id, term, round(score, 6) as score, cast(r as integer) as rank from ranked where r <= 5"
)
def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    return keywords.keywords(docs, 5, docs).withColumn("score", F.round("score", 6))


@query(_TFIDF + "select term, df from df")
def tfidf_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.corpus_frequencies(corpus(spark, sf_dir))


@query(_TFIDF + "select docs as documents, (select count(*) from df) as terms from size")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.corpus_stats(corpus(spark, sf_dir))


@query()
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(corpus(spark, sf_dir)).select("chunk_id", "doc_id", "content", "start_offset", "end_offset", F.col("metadata.word_count").alias("word_count"), F.array_join("metadata.keywords", " ").alias("keywords"))


_NORMAL = "lower('{0}') || '_' || regexp_replace(regexp_replace(lower({1}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"select p_partkey, {_NORMAL.format('PART', 'p_name')} as entity_id from part")
def entity_id_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.entity_id(F.lit("PART"), F.col("p_name")).alias("entity_id"))


_NAMES = "select distinct name from (select p_name as name from part union all select n_name from nation union all select r_name from region union all select s_name from supplier union all select unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) from documents)"


def _class_sql() -> str:
    w = "case when len(ws) > 1 and lower(ws[1]) in ('the', 'a', 'an') then ws[2:] else ws end"
    starts = " or ".join(f"starts_with(whole, '{x}')" for x in ORGANISATION_BEGINNINGS)
    return (
        f"with names as ({_NAMES}), split as (select name, list_filter(string_split(name, ' '), lambda x: x <> '') as ws from names), bare as (select name, {w} as ws from split), "
        "parts as (select name, ws, len(ws) as n, lower(array_to_string(ws, ' ')) as whole, lower(ws[1]) as f, lower(ws[len(ws)]) as l from bare), "
        f"classes as (select name, case when n = 0 or (n = 1 and f in {listed(NOT_ENTITIES)}) then null when l in {listed(ORGANISATION_ENDINGS)} or {starts} then 'ORGANIZATION' "
        f"when whole in {listed(PLACES)} then 'LOCATION' when trim(f, '.') in {listed(TITLES)} or n > 1 then 'PERSON' when length(ws[1]) >= 3 then 'CONCEPT' end as entity_type, "
        f"case when l in {listed(ORGANISATION_ENDINGS)} or {starts} or whole in {listed(PLACES)} or trim(f, '.') in {listed(TITLES)} then 0.9 when n > 1 then 0.8 else 0.6 end as confidence from parts) "
        "select name, entity_type, cast(confidence as double) as confidence from classes where entity_type is not null"
    )


@query(_class_sql())
def classify_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = corpus(spark, sf_dir).select(F.explode(F.regexp_extract_all("content", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))).alias("name"))
    for name, column in (("part", "p_name"), ("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name")):
        runs = runs.unionByName(table(spark, sf_dir, name).select(F.col(column).alias("name")))
    found = runs.distinct().withColumn("c", extraction.classify_column(F.col("name"))).where("c is not null")
    return found.select("name", "c.entity_type", "c.confidence")


@query(
    f"with l as (select turn, conv_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '{NONSPACE}+')[1:3], lambda w: upper(replace(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'ß', 'ss'))), lambda w: w <> ''), '_') as label from conversations) "
    "select conv_id, turn, case when coalesce(label, '') = '' then 'RELATED_TO' else label end as label from l"
)
def relation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.relation_label(F.col("text")).alias("label"))


@query(
    "with q as (select conv_id, turn, case when role = 'assistant' then '<think>' || text || '</think> ' || role when role = 'user' then text else text || '</think>' || role end as t from conversations) "
    f"select conv_id, turn, regexp_replace(case when position('</think>' in t) > 0 and (position('<think>' in t) = 0 or position('</think>' in t) < position('<think>' in t)) then t else regexp_replace(t, '(?s)<think>.*?</think>', '', 'g') end, '^{SPACE}+|{SPACE}+$', '', 'g') as text from q"
)
def strip_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    role, text = F.col("role"), F.col("text")
    shown = F.when(role == "assistant", F.concat(F.lit("<think>"), text, F.lit("</think> "), role)).when(role == "user", text).otherwise(F.concat(text, F.lit("</think>"), role))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_thinking(shown).alias("text"))


_FIRST = "list_filter({0}, lambda w, i: list_position(list_transform({0}, lambda x: lower(x)), lower(w)) = i)"


def _fallback_sql() -> str:
    kept = f"list_filter(ws, lambda w: lower(w) not in {listed(QUESTION_WORDS)})"
    return (
        f"with q as (select item_id, regexp_extract_all(text, '{WORD}') as ws from benchmark), k as (select item_id, ws, {kept} as ks from q), "
        f"d as (select item_id, {_FIRST.format('ws')} as ws, {_FIRST.format('ks')} as ks from k) "
        "select item_id, array_to_string((case when len(ks) > 0 then ks else ws end)[1:20], ' ') as keywords from d"
    )


@query(_fallback_sql())
def kw_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.question_keywords(F.col("text"), 20), " ").alias("keywords"))


@query()
def pattern_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(chunk(corpus(spark, sf_dir)), 0.5)
    return found.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", "e.entity_id", "e.name", "e.entity_type", "e.confidence", F.size("e.mentions").alias("mentions"))


@query()
def pattern_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(chunk(corpus(spark, sf_dir)), 0.5)
    return found.select("chunk_id", F.explode("relationships").alias("r")).select("chunk_id", "r.source", "r.target", "r.relation_type", "r.confidence")
