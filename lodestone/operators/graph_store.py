"""A property graph as DataFrames: keyed merges, cascading deletes, look-ups.

entities(entity_ord, entity_id, name, entity_type, confidence, mentions, embedding)
relationships(rel_ord, source, target, relation_type, confidence, context)
chunks(chunk_ord, chunk_id, doc_id, content, ..., entities)
documents(doc_ord, doc_id, title, content, metadata)

Everything that depends on insertion order reads an explicit *_ord column.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 100_000
MENTION = "struct<chunk_id:string,start_offset:int,end_offset:int,confidence:float>"


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    relationships: DataFrame
    chunks: DataFrame | None = None
    documents: DataFrame | None = None
    merged: bool = False
    """Whether relationships has one row per (source, target, relation_type), as merge_relationships() makes them."""


def hashed(table: DataFrame) -> DataFrame:
    """table as the side of a join that is hashed: sent to all if it is small, else shuffled; the other side is not sorted."""
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if few else table.hint("shuffle_hash")


def merge_entities(rows: DataFrame) -> DataFrame:
    """One entity per entity_id of rows(seq, entity_id, name, entity_type, confidence, mentions[, embedding]).

    First name, first type that isn't empty, highest confidence, all mentions in
    order of seq, first embedding there is; entity_ord is the first seq.
    """
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    first = F.min(F.when(F.coalesce("entity_type", F.lit("")) != "", F.struct("seq", "entity_type")))["entity_type"]
    vector = F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("seq")))
    mentions = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "mentions"))), lambda x: F.coalesce(x["mentions"], F.array().cast(f"array<{MENTION}>"))))
    return rows.groupBy("entity_id").agg(
        F.min("seq").alias("entity_ord"), F.min_by("name", "seq").alias("name"), F.coalesce(first, F.lit("")).alias("entity_type"), F.max("confidence").alias("confidence"), mentions.alias("mentions"), vector.alias("embedding")
    )


def merge_relationships(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """One directed edge per (source, target, relation_type) of rows(seq, ..., confidence, context); edges without both ends go.

    Highest confidence, distinct context in order of first use, rel_ord the first seq.
    """
    known = hashed(entities.select("entity_id"))
    held = rows.join(known.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(known.withColumnRenamed("entity_id", "target"), "target", "left_semi")
    context = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "context"))), lambda x: F.coalesce(x["context"], F.array().cast("array<string>")))))
    return held.groupBy("source", "target", "relation_type").agg(F.min("seq").alias("rel_ord"), F.max("confidence").alias("confidence"), context.alias("context"))


def latest_documents(rows: DataFrame) -> DataFrame:
    """The last version of each doc_id of rows(ingest_seq, doc_id, ...); doc_ord keeps the place of the first."""
    newest = Window.partitionBy("doc_id").orderBy(F.desc("ingest_seq"))
    placed = rows.withColumn("doc_ord", F.min("ingest_seq").over(Window.partitionBy("doc_id")))
    return placed.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "ingest_seq")


def latest_chunks(rows: DataFrame) -> DataFrame:
    """The last version of each chunk_id of rows(seq, chunk_id, ...); chunk_ord keeps the place of the first."""
    newest = Window.partitionBy("chunk_id").orderBy(F.desc("seq"))
    placed = rows.withColumn("chunk_ord", F.min("seq").over(Window.partitionBy("chunk_id")))
    return placed.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "seq")


def nest_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents with their chunks as an ordered array."""
    listed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_ord", "chunk_id", "content", "start_offset", "end_offset"))).alias("chunks"))
    return documents.join(listed, "doc_id", "left")


def remove_document_chunks(graph: Graph, doc_ids: DataFrame) -> Graph:
    """The graph without the chunks of doc_ids(doc_id) and without what only they proved.

    Mentions and context entries that name a removed chunk go. An entity or edge
    that had evidence and has none left goes, and so does an edge with a removed
    end. Entities and edges that never had evidence stay.
    """
    gone = graph.chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("chunk_id").alias("gone_id"))
    chunks = graph.chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")

    def scrub(table: DataFrame, key: list[str], column: str, chunk_of):
        cited = table.select(*key, F.posexplode(column).alias("_at", "_item")).withColumn("gone_id", chunk_of(F.col("_item")))
        kept = cited.join(gone, "gone_id", "left_anti").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_item"))), lambda x: x["_item"]).alias("_kept"))
        joined = table.join(kept, key, "left")
        had = F.coalesce(F.size(column), F.lit(0)) > 0
        return joined.withColumn("_lost", had & F.col("_kept").isNull()).withColumn(column, F.when(had, F.col("_kept")).otherwise(F.col(column))).drop("_kept")

    entities = scrub(graph.entities, ["entity_id"], "mentions", lambda x: x["chunk_id"])
    lost = entities.where("_lost").select("entity_id")
    relationships = scrub(graph.relationships, ["source", "target", "relation_type"], "context", lambda x: x).where("not _lost").drop("_lost")
    for end in ("source", "target"):
        relationships = relationships.join(lost.withColumnRenamed("entity_id", end), end, "left_anti")
    return replace(graph, entities=entities.where("not _lost").drop("_lost"), relationships=relationships, chunks=chunks)


def neighbours(relationships: DataFrame, merged: bool = False) -> DataFrame:
    """(node, neighbour, relation_type, position, rel_ord, source, target, confidence): both directions of every edge.

    Of parallel edges of one type the most confident stands for all, the earliest
    on ties; positions order a node's neighbours, outgoing edges first, those of equal rel_ord by name and type.
    merged relationships have at most one edge each way, so that plain numbers tell which stands, without a sort.
    """
    if merged:
        return _neighbours_of_merged(relationships)
    columns = ["rel_ord", "source", "target", "relation_type", "confidence"]
    out = relationships.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), F.lit(0).alias("way"), *columns)
    back = relationships.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), F.lit(1).alias("way"), *columns)
    place = F.struct("way", "rel_ord")
    best = F.min(F.struct((-F.col("confidence")).alias("less"), "way", "rel_ord", "source", "target", "confidence")).alias("edge")
    grouped = out.unionByName(back).groupBy("node", "neighbour", "relation_type").agg(F.min(place).alias("place"), best)
    position = F.row_number().over(Window.partitionBy("node").orderBy("place", "neighbour", "relation_type"))
    return grouped.select("node", "neighbour", "relation_type", position.alias("position"), "edge.rel_ord", "edge.source", "edge.target", "edge.confidence")


def _neighbours_of_merged(relationships: DataFrame) -> DataFrame:
    ends = [F.struct(F.col(a).alias("node"), F.col(b).alias("neighbour"), F.lit(way).alias("way")) for a, b, way in (("source", "target", 0), ("target", "source", 1))]
    sides = relationships.select(F.explode(F.array(*ends)).alias("e"), "relation_type", "rel_ord", "confidence").select("e.*", "relation_type", "rel_ord", "confidence")
    of = [(F.min(F.when(F.col("way") == w, F.col("rel_ord"))).alias(f"r{w}"), F.max(F.when(F.col("way") == w, F.col("confidence"))).alias(f"c{w}")) for w in (0, 1)]
    # one shuffle, by node, for the groups and for their positions
    grouped = sides.repartition("node").groupBy("node", "neighbour", "relation_type").agg(*of[0], *of[1])
    out = F.col("r0").isNotNull() & (F.col("r1").isNull() | F.col("c0").isNull() | F.coalesce(F.col("c0") >= F.col("c1"), F.lit(False)))
    place = F.when(F.col("r0").isNotNull(), 0).otherwise(1), F.coalesce("r0", "r1")
    position = F.row_number().over(Window.partitionBy("node").orderBy(*place, "neighbour", "relation_type"))

    def pick(a: str, b: str):
        return F.when(out, F.col(a)).otherwise(F.col(b))

    return grouped.select("node", "neighbour", "relation_type", position.alias("position"), pick("r0", "r1").alias("rel_ord"), pick("node", "neighbour").alias("source"), pick("neighbour", "node").alias("target"), pick("c0", "c1").alias("confidence"))


def entity_relationships(relationships: DataFrame, entity_id: str) -> DataFrame:
    """Outgoing, then incoming edges of an entity; a self-loop comes twice."""
    out = relationships.where(F.col("source") == entity_id).withColumn("way", F.lit(0))
    return out.unionByName(relationships.where(F.col("target") == entity_id).withColumn("way", F.lit(1)))


def degrees(graph: Graph) -> DataFrame:
    """(entity_id, out_degree, in_degree, degree) of every entity."""
    ends = graph.relationships.select(F.explode(F.array(F.struct(F.col("source").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    counted = ends.groupBy("entity_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = F.lit(0).cast("long")
    joined = graph.entities.select("entity_id").join(counted, "entity_id", "left")
    return joined.select("entity_id", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def find_by_name(entities: DataFrame, needle: str) -> DataFrame:
    """Entities whose name holds needle, whatever the case; an empty needle finds all."""
    return entities.where(F.contains(F.lower("name"), F.lower(F.lit(needle))))
