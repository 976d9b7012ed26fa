"""The interchange file of a graph: one JSON object with four sorted arrays."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import SerializationError, StorageError
from lodestone.operators.graph_store import MENTION, Graph, merge_entities, merge_relationships

TABLES = {
    "documents": ("doc_ord", "doc_ord long, doc_id string, title string, content string, metadata map<string,string>"),
    "chunks": ("chunk_ord", "chunk_ord long, chunk_id string, doc_id string, content string, start_offset int, end_offset int, embedding array<float>, entities array<string>, metadata struct<index:int,word_count:int,keywords:array<string>,extra:map<string,string>>"),
    "entities": ("entity_ord", f"entity_ord long, entity_id string, name string, entity_type string, confidence float, mentions array<{MENTION}>, embedding array<float>"),
    "relationships": ("rel_ord", "rel_ord long, source string, target string, relation_type string, confidence float, context array<string>"),
}


def save_tables(graph: Graph, folder: str) -> None:
    """One Parquet table per part: the form for graphs of any size."""
    for name in TABLES:
        table = getattr(graph, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{folder}/{name}") for name in ("entities", "relationships", "chunks", "documents")))


def to_json(graph: Graph) -> str:
    """The graph as sorted, indented JSON. For graphs that fit the driver; use save_tables() beyond."""
    whole = {}
    for name, (order, _) in TABLES.items():
        table = getattr(graph, name)
        rows = [] if table is None else table.orderBy(order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()
        whole[name] = [{k: v for k, v in json.loads(r[0]).items() if v is not None} for r in rows]
    return json.dumps(whole, indent=2, sort_keys=True, ensure_ascii=False)


def save_json(graph: Graph, path: str) -> None:
    try:
        Path(path).write_text(to_json(graph), encoding="utf-8")
    except OSError as e:
        raise StorageError(f"can't write {path}: {e}") from e


def _table(spark: SparkSession, rows: list, name: str) -> DataFrame:
    order, schema = TABLES[name]
    lines = [(i, json.dumps(r)) for i, r in enumerate(rows)]
    parsed = spark.createDataFrame(lines, "_i long, line string").select("_i", F.from_json("line", schema).alias("x"))
    return parsed.select("x.*", "_i").withColumn(order, F.coalesce(order, "_i")).drop("_i")


def from_json(spark: SparkSession, text: str) -> Graph:
    """A graph from to_json() text; entities and edges are merged again, and edges without both ends dropped."""
    try:
        whole = json.loads(text)
    except ValueError as e:
        raise SerializationError(str(e)) from e
    if not isinstance(whole, dict):
        raise SerializationError("not a graph")
    parts = {name: _table(spark, whole.get(name) or [], name) for name in TABLES}
    entities = merge_entities(parts["entities"].withColumnRenamed("entity_ord", "seq"))
    relationships = merge_relationships(parts["relationships"].withColumnRenamed("rel_ord", "seq"), entities)
    return Graph(entities, relationships, parts["chunks"], parts["documents"])


def load_json(spark: SparkSession, path: str) -> Graph:
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise StorageError(f"can't read {path}: {e}") from e
    return from_json(spark, text)
