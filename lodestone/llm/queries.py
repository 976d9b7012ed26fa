"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, html_text, jaccard, jpeg, neighbours, packing, quality, quotations, secrets, toxicity
from lodestone.runtime import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """The rank file that op8_bpe uses: that of the installed public tokenizers, unless LODESTONE_BPE_RANKS names another."""
    return os.environ.get("LODESTONE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two runs: English documents first, then all; the second scans what the ledger lacks and reports every path
    docs = _table(spark, sf_dir, "documents")
    found, added = secrets.scan(docs.where("lang = 'en'"))
    folder = f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}"
    secrets.save(folder, 1, added, found)
    ledger, reported = secrets.load(spark, folder)
    return secrets.scan(docs, ledger, reported=reported)[0]


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no table holds pictures: each embedding is drawn and stored as a JPEG file first
    return jpeg.media_columns(jpeg.media_of_vectors(_table(spark, sf_dir, "embeddings")))


def op6_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_order(_table(spark, sf_dir, "conversations"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, queries=rows.where("vec_id % 20 = 0"))  # a stated query set against all rows


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pack": op1_pack,
    "op2_secrets": op2_secrets,
    "op3_html": op3_html,
    "op4_quality": op4_quality,
    "op5_jpeg": op5_jpeg,
    "op6_quotations": op6_quotations,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_jaccard": op9_jaccard,
    "op10_neighbours": op10_neighbours,
}


def _secret_sql() -> str:
    parts = []
    for r in secrets.RULES:
        parts.append(
            f"select blob, '{r.name}' as rule, {r.version} as rule_version, unnest(regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}')) as secret, "
            f"generate_subscripts(regexp_extract_all(text, '{r.pattern.replace(chr(39), chr(39) * 2)}'), 1) as ordinal from blobs"
        )
    return (
        "with paths as (select doc_id, source, text, sha256(text) as blob from documents where text is not null), "
        "blobs as (select distinct blob, text from paths), found as (" + " union all ".join(parts) + ") "
        "select doc_id, source, blob, rule, cast(rule_version as integer) as rule_version, cast(ordinal as integer) as ordinal, sha256(secret) as secret_sha256, cast(length(secret) as integer) as secret_chars "
        "from paths join found using (blob)"
    )


_JACCARD_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') as w from documents where doc_id is not null and text is not null
), grams as (
  select doc_id, list_distinct(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g
  from words where len(w) > 0
), classes as (
  select min(doc_id) as rep, g, len(g) as size from (select doc_id, list_sort(g) as g from grams) group by g
), flat as (
  select rep, size, unnest(g) as gram from classes
), shared as (
  select a.rep as doc_id_a, b.rep as doc_id_b, any_value(a.size) as sa, any_value(b.size) as sb, count(*) as common
  from flat a join flat b on a.gram = b.gram and a.rep < b.rep group by 1, 2
), near as (
  select doc_id_a, doc_id_b from shared where common / cast(sa + sb - common as double) >= 0.55 - 1e-12
), adj as (
  select doc_id_a as x, doc_id_b as y from near union all select doc_id_b, doc_id_a from near
), reach as (
  select rep as x, rep as root from classes union select y, root from reach join adj using (x)
), placed as (
  select doc_id, (select min(root) from reach where x = rep) as class_id, (select count(*) from adj where x = rep) as links
  from (select doc_id, list_sort(g) as g from grams) join classes using (g)
  union all select doc_id, doc_id, 0 from documents where doc_id is not null
)
select doc_id, min(class_id) as class_id, cast(sum(links) as bigint) as links from placed group by 1
"""

ORACLES = {"op2_secrets": _secret_sql(), "op9_jaccard": _JACCARD_SQL}
