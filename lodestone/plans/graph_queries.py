"""Graph operators over graphs made of the tables, with their SQL.

"shipments" has parts and suppliers as nodes and an edge of type l_returnflag for
every lineitem; "markets" has regions, nations and customer segments as nodes
and stays small at every scale: it is for what needs all pairs of nodes.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import DualConfig, Merge, TraversalConfig
from lodestone.operators import analytics, communities, dual, extraction, graph_store, traversal
from lodestone.operators.graph_store import MENTION, Graph
from lodestone.plans.text_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


SHIPMENTS = """
ents as (
  select 2 * p_partkey as entity_ord, 'part_' || p_partkey as entity_id, p_name as name, 'PART' as entity_type from part
  union all select 2 * s_suppkey + 1, 'supplier_' || s_suppkey, s_name, 'SUPPLIER' from supplier),
raw as (
  select l_orderkey * 8 + l_linenumber as seq, 'part_' || l_partkey as source, 'supplier_' || l_suppkey as target, l_returnflag as relation_type, round(1 - 8 * l_discount, 2) as confidence, 'order_' || l_orderkey as chunk
  from lineitem),
rels as (
  select source, target, relation_type, min(seq) as rel_ord, max(confidence) as confidence from raw
  where source in (select entity_id from ents) and target in (select entity_id from ents) group by 1, 2, 3)
"""
MARKETS = """
ents as (
  select n_nationkey as entity_ord, 'nation_' || n_nationkey as entity_id, n_name as name, 'NATION' as entity_type from nation
  union all select 1000 + r_regionkey, 'region_' || r_regionkey, r_name, 'REGION' from region
  union all select 2000 + row_number() over (order by c_mktsegment), 'segment_' || c_mktsegment, c_mktsegment, 'SEGMENT' from (select distinct c_mktsegment from customer)),
share as (
  select c_nationkey, c_mktsegment, count(*) as n, sum(count(*)) over (partition by c_nationkey) as total from customer group by 1, 2),
rshare as (
  select c_mktsegment, n_regionkey, count(*) as n, sum(count(*)) over (partition by c_mktsegment) as total from customer join nation on c_nationkey = n_nationkey group by 1, 2),
rels as (
  select 'nation_' || n_nationkey as source, 'region_' || n_regionkey as target, 'LOCATED_IN' as relation_type, n_nationkey as rel_ord, 1.0::double as confidence from nation
  union all select 'nation_' || c_nationkey, 'segment_' || c_mktsegment, 'BUYS', 100 + row_number() over (order by c_nationkey, c_mktsegment), round(n / total, 2)::double from share
  union all select 'segment_' || c_mktsegment, 'region_' || n_regionkey, 'SERVES', 1000 + row_number() over (order by c_mktsegment, n_regionkey), round(n / total, 2)::double from rshare)
"""


def _raw_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("source"),
        F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("target"),
        F.col("l_returnflag").alias("relation_type"),
        F.round(1 - 8 * F.col("l_discount"), 2).alias("confidence"),
        F.array(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"))).alias("context"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> Graph:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    mentions = F.array().cast(f"array<{MENTION}>").alias("mentions")
    left = part.select((2 * F.col("p_partkey")).alias("entity_ord"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"), F.lit("PART").alias("entity_type"), mentions)
    right = supplier.select((2 * F.col("s_suppkey") + 1).alias("entity_ord"), F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("entity_type"), mentions)
    entities = left.unionByName(right)
    return Graph(entities, graph_store.merge_relationships(_raw_shipments(spark, sf_dir), entities), merged=True)


def markets(spark: SparkSession, sf_dir: str) -> Graph:
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))

    def name(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    segments = customer.select("c_mktsegment").distinct()
    kinds = [
        nation.select(F.col("n_nationkey").cast("long").alias("entity_ord"), name("nation_", "n_nationkey").alias("entity_id"), F.col("n_name").alias("name"), F.lit("NATION").alias("entity_type")),
        region.select((1000 + F.col("r_regionkey")).cast("long").alias("entity_ord"), name("region_", "r_regionkey").alias("entity_id"), F.col("r_name").alias("name"), F.lit("REGION").alias("entity_type")),
        segments.select((2000 + F.row_number().over(Window.orderBy("c_mktsegment"))).cast("long").alias("entity_ord"), name("segment_", "c_mktsegment").alias("entity_id"), F.col("c_mktsegment").alias("name"), F.lit("SEGMENT").alias("entity_type")),
    ]
    entities = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("mentions", F.array().cast(f"array<{MENTION}>"))

    def shares(rows, of, by, start):
        counted = rows.groupBy(of, by).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(of)))
        return counted.withColumn("rel_ord", (start + F.row_number().over(Window.orderBy(of, by))).cast("long")).withColumn("confidence", F.round(F.col("n") / F.col("total"), 2))

    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    edges = [
        nation.select(name("nation_", "n_nationkey").alias("source"), name("region_", "n_regionkey").alias("target"), F.lit("LOCATED_IN").alias("relation_type"), F.col("n_nationkey").cast("long").alias("rel_ord"), F.lit(1.0).alias("confidence")),
        shares(customer, "c_nationkey", "c_mktsegment", 100).select(name("nation_", "c_nationkey").alias("source"), name("segment_", "c_mktsegment").alias("target"), F.lit("BUYS").alias("relation_type"), "rel_ord", "confidence"),
        shares(placed, "c_mktsegment", "n_regionkey", 1000).select(name("segment_", "c_mktsegment").alias("source"), name("region_", "n_regionkey").alias("target"), F.lit("SERVES").alias("relation_type"), "rel_ord", "confidence"),
    ]
    relationships = edges[0].unionByName(edges[1]).unionByName(edges[2]).withColumn("context", F.array(F.concat(F.lit("chunk_"), (F.col("rel_ord") % 7).cast("string"))))
    return Graph(entities, relationships)


def _near(strong: bool = True) -> str:
    keep = " where confidence >= 0.5" if strong else ""
    return (
        "sides as (select source as node, target as neighbour, 0 as way, * from rels union all select target, source, 1, * from rels), "
        "best as (select *, row_number() over (partition by node, neighbour, relation_type order by confidence desc, way, rel_ord) as b, min(way * 1000000000000 + rel_ord) over (partition by node, neighbour, relation_type) as place from sides), "
        f"near as (select *, row_number() over (partition by node order by place, neighbour, relation_type) as position from best where b = 1), strong as (select * from near{keep})"
    )


@query(
    "with s as (select l_orderkey * 8 + l_linenumber as seq, 'supplier_' || l_suppkey as entity_id, 'name ' || l_linestatus as name, case when l_linenumber = 1 then '' else l_returnflag end as entity_type, round(1 - l_discount, 2) as confidence, 'order_' || l_orderkey as chunk from lineitem) "
    "select entity_id, min(seq) as entity_ord, arg_min(name, seq) as name, coalesce(arg_min(entity_type, seq) filter (where entity_type <> ''), '') as entity_type, max(confidence) as confidence, count(*) as mentions, arg_min(chunk, seq) as first_chunk, arg_max(chunk, seq) as last_chunk from s group by 1"
)
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("entity_id"),
        F.concat(F.lit("name "), "l_linestatus").alias("name"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_returnflag")).alias("entity_type"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.array(F.struct(chunk.alias("chunk_id"), F.lit(0).alias("start_offset"), F.lit(1).alias("end_offset"), F.lit(1.0).cast("float").alias("confidence"))).alias("mentions"),
    )
    merged = graph_store.merge_entities(rows)
    return merged.select("entity_id", "entity_ord", "name", "entity_type", "confidence", F.size("mentions").cast("long").alias("mentions"), F.element_at("mentions", 1)["chunk_id"].alias("first_chunk"), F.element_at("mentions", -1)["chunk_id"].alias("last_chunk"))


@query(
    f"with {SHIPMENTS}, ctx as (select source, target, relation_type, string_agg(chunk, ',' order by s) as context from (select source, target, relation_type, chunk, min(seq) as s from raw group by 1, 2, 3, 4) group by 1, 2, 3) "
    "select * from rels join ctx using (source, target, relation_type)"
)
def relationship_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipments(spark, sf_dir).relationships.select("source", "target", "relation_type", "rel_ord", "confidence", F.array_join("context", ",").alias("context"))


_VERSIONS = "select event_id as ingest_seq, 'user_' || user_id as doc_id, event_type as title, event_type || ' ' || value as content from events"


@query(f"with v as ({_VERSIONS}) select doc_id, min(ingest_seq) as doc_ord, arg_max(title, ingest_seq) as title from v group by 1")
def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ingest_seq"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("doc_id"), F.col("event_type").alias("title"))
    return graph_store.latest_documents(rows).select("doc_id", "doc_ord", "title")


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """Orders are documents of one chunk; customers are entities with mentions; edges link customers to clerks' priorities."""
    orders = table(spark, sf_dir, "orders")
    doc, customer, priority = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("order_", "o_orderkey"), ("customer_", "o_custkey"), ("priority_", "o_orderpriority")))
    chunks = orders.select(F.col("o_orderkey").alias("chunk_ord"), doc.alias("chunk_id"), doc.alias("doc_id"))
    mention = F.array(F.struct(doc.alias("chunk_id"), F.lit(0).alias("start_offset"), F.lit(1).alias("end_offset"), F.lit(1.0).cast("float").alias("confidence"))).alias("mentions")
    none = F.array().cast(f"array<{MENTION}>").alias("mentions")
    rows = orders.select(F.col("o_orderkey").alias("seq"), customer.alias("entity_id"), customer.alias("name"), F.lit("CUSTOMER").alias("entity_type"), F.lit(0.9).alias("confidence"), mention)
    rows = rows.unionByName(orders.select(F.col("o_orderkey").alias("seq"), priority.alias("entity_id"), priority.alias("name"), F.lit("PRIORITY").alias("entity_type"), F.lit(0.9).alias("confidence"), none))
    entities = graph_store.merge_entities(rows)
    edges = orders.select(F.col("o_orderkey").alias("seq"), customer.alias("source"), priority.alias("target"), F.lit("ORDERS").alias("relation_type"), F.lit(0.9).alias("confidence"), F.array(doc).alias("context"))
    gone = orders.where("o_orderstatus <> 'O'").select(doc.alias("doc_id"))
    return Graph(entities, graph_store.merge_relationships(edges, entities), chunks), gone


@query(
    "with kept as (select * from orders where o_orderstatus = 'O') "
    "select 'entity' as kind, 'customer_' || o_custkey as key, count(*) as evidence from kept group by 2 "
    "union all select distinct 'entity', 'priority_' || o_orderpriority, 0 from orders "
    "union all select 'edge', 'customer_' || o_custkey || '>priority_' || o_orderpriority, count(*) from kept group by 2"
)
def remove_doc_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, gone = _evidence(spark, sf_dir)
    left = graph_store.remove_document_chunks(graph, gone)
    entities = left.entities.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("key"), F.size("mentions").cast("long").alias("evidence"))
    return entities.unionByName(left.relationships.select(F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("key"), F.size("context").cast("long").alias("evidence")))


@query(f"with {SHIPMENTS}, {_near(False)} select node, neighbour, relation_type, cast(position as integer) as position, rel_ord, confidence from near")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_store.neighbours(shipments(spark, sf_dir).relationships).select("node", "neighbour", "relation_type", "position", "rel_ord", "confidence")


@query(
    f"with {SHIPMENTS}, o as (select source as entity_id, count(*) as o from rels group by 1), i as (select target as entity_id, count(*) as i from rels group by 1) "
    "select entity_id, coalesce(o, 0) as out_degree, coalesce(i, 0) as in_degree, coalesce(o, 0) + coalesce(i, 0) as degree from ents left join o using (entity_id) left join i using (entity_id)"
)
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_store.degrees(shipments(spark, sf_dir))


@query(f"with {SHIPMENTS} select source, target, relation_type, rel_ord, 0 as way from rels where source = 'supplier_1' union all select source, target, relation_type, rel_ord, 1 from rels where target = 'supplier_1'")
def entity_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_store.entity_relationships(shipments(spark, sf_dir).relationships, "supplier_1").select("source", "target", "relation_type", "rel_ord", "way")


@query(f"with {SHIPMENTS} select entity_id, name from ents where contains(lower(name), '7')")
def find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_store.find_by_name(shipments(spark, sf_dir).entities, "7").select("entity_id", "name")


def _walk_sql(graph: str, starts: list[str], depth: int, strong: bool = True) -> str:
    start = ", ".join(f"('{s}')" for s in starts)
    return (
        f"with recursive {graph}, {_near(strong)}, walk as (select entity_id, 0 as distance from ents where entity_id in (select * from (values {start}) t(x)) "
        f"union select neighbour, distance + 1 from walk join strong on node = entity_id where distance < {depth}), "
        "seen as (select entity_id, min(distance) as distance from walk group by 1) "
    )


_LEVELS = "select entity_id, cast(distance as integer) as distance from seen"


@query(_walk_sql(SHIPMENTS, ["supplier_1"], 3) + _LEVELS)
def bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.bfs(shipments(spark, sf_dir), ["supplier_1"])[0].select("entity_id", "distance")


@query(_walk_sql(SHIPMENTS, ["supplier_1", "part_2", "nobody"], 2) + _LEVELS)
def multi_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.bfs(shipments(spark, sf_dir), ["supplier_1", "part_2", "nobody"], TraversalConfig(max_depth=2))[0].select("entity_id", "distance")


@query(_walk_sql(SHIPMENTS, ["supplier_1"], 2) + _LEVELS)
def ego_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.ego_network(shipments(spark, sf_dir), "supplier_1", 2)[0].select("entity_id", "distance")


@query(_walk_sql(SHIPMENTS, ["supplier_1"], 2) + "select distinct source, target, relation_type from strong join seen on node = entity_id where distance < 2")
def ego_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.ego_network(shipments(spark, sf_dir), "supplier_1", 2)[1].select("source", "target", "relation_type")


@query(
    f"with recursive {MARKETS}, {_near(False)}, one as (select node, neighbour, min(position) as position from near where confidence >= 0.2 group by 1, 2), "
    "walk as (select 'nation_0' as last, ['nation_0'] as path, 0 as hops union all select neighbour, list_append(path, neighbour), hops + 1 from walk join one on node = last where hops < 3 and last <> 'region_1' and not list_contains(path, neighbour)) "
    "select array_to_string(path, '>') as path from walk where last = 'region_1'"
)
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traversal.all_paths(markets(spark, sf_dir), "nation_0", "region_1", TraversalConfig(max_paths=1_000_000, min_strength=0.2))
    return found.select(F.array_join("path", ">").alias("path"))


@query(_walk_sql(MARKETS, ["nation_0"], 5, False) + "select cast(distance as integer) as hops from seen where entity_id = 'region_1'")
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.shortest_path(markets(spark, sf_dir), "nation_0", "region_1").select((F.size("path") - 1).alias("hops"))


@query()
def dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.dfs(shipments(spark, sf_dir), ["supplier_1", "part_2"])


_APSP = (
    f"with recursive {MARKETS}, adj as (select source as node, target as neighbour from rels union select target, source from rels), "
    "walk as (select entity_id as root, entity_id as node, 0 as d from ents union select root, neighbour, d + 1 from walk join adj using (node) where d < 12), "
    "dist as (select root, node, min(d) as d from walk group by 1, 2) "
)


@query(_APSP + "select root as entity_id, round(case when sum(d) > 0 then (count(*) - 1) / cast(sum(d) as double) else 0 end, 6) as closeness from dist group by 1")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.closeness_centrality(markets(spark, sf_dir)).select("entity_id", F.round("closeness", 6).alias("closeness"))


@query(_APSP + "select cast(max(d) as integer) as diameter from dist")
def diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.diameter(markets(spark, sf_dir))


@query(_APSP + "select (select count(*) from ents) as node_count, (select count(*) from rels) as edge_count, round(2.0 * (select count(*) from rels) / (select count(*) from ents), 6)::double as average_degree, (select cast(max(d) as integer) from dist) as max_depth")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.graph_stats(markets(spark, sf_dir)).withColumn("average_degree", F.round("average_degree", 6))


@query(
    _APSP.replace("dist as", "dist0 as").rstrip() + ", dist as (select * from dist0), paths as (select root, node, 0 as d, 1.0::double as s from dist where d = 0 "
    "union all select p.root, a.neighbour, p.d + 1, p.s from paths p join adj a on a.node = p.node join dist e on e.root = p.root and e.node = a.neighbour and e.d = p.d + 1), "
    "sigma as (select root, node, any_value(d) as d, sum(s) as s from paths group by 1, 2), "
    "part as (select a.node, sum(a.s * b.s / c.s) as b from sigma a join sigma b on a.node = b.root join sigma c on c.root = a.root and c.node = b.node and c.d = a.d + b.d where a.node <> a.root and b.node <> a.node group by 1) "
    "select entity_id, round(coalesce(b, 0) / ((select count(*) from ents) - 1) / ((select count(*) from ents) - 2), 6) as betweenness from ents left join part on node = entity_id"
)
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.betweenness_centrality(markets(spark, sf_dir)).select("entity_id", F.round("betweenness", 6).alias("betweenness"))


_ADJ = "adj as (select source as node, target as neighbour from rels union select target, source from rels)"


@query(f"with {SHIPMENTS}, {_ADJ}, k as (select node, count(*) as k from adj group by 1) select entity_id, round(coalesce(k, 0) / cast((select count(*) from ents) - 1 as double), 6) as degree from ents left join k on node = entity_id")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.degree_centrality(shipments(spark, sf_dir)).select("entity_id", F.round("degree", 6).alias("degree"))


@query(f"with {SHIPMENTS}, {_ADJ} select round(2.0 * ((select count(*) from adj) // 2) / (n * (n - 1)), 6)::double as density from (select count(*) as n from ents)")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.density(shipments(spark, sf_dir)).select(F.round("density", 6).alias("density"))


@query(
    f"with {MARKETS}, {_ADJ}, k as (select node, count(*) as k from adj group by 1), closed as (select a.node, count(*) as c from adj a join adj b on a.node = b.node and a.neighbour < b.neighbour join adj e on e.node = a.neighbour and e.neighbour = b.neighbour group by 1) "
    "select entity_id, round(case when k > 1 then coalesce(c, 0) / (k * (k - 1) / 2.0) else 0 end, 6)::double as clustering from ents left join k on k.node = entity_id left join closed on closed.node = entity_id"
)
def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.clustering(markets(spark, sf_dir)).select("entity_id", F.round("clustering", 6).alias("clustering"))


@query(
    f"with recursive {SHIPMENTS}, e as (select a.entity_ord as x, b.entity_ord as y from rels join ents a on a.entity_id = source join ents b on b.entity_id = target), adj as (select x, y from e union select y, x from e), "
    "lab as (select entity_ord as x, entity_ord as c, 0 as k, true as moved from ents union all select x, fresh, k + 1, bool_or(fresh < c) over () from (select l.x, l.c, l.k, least(l.c, coalesce(m, l.c)) as fresh from lab l "
    "left join (select adj.x, min(p.c) as m from adj join lab p on p.x = adj.y group by 1) g using (x) where l.moved)) select entity_id, c as component from ents join lab on entity_ord = x where k = (select max(k) from lab)"
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.connected_components(shipments(spark, sf_dir))


_RANKS = (
    f"with recursive {SHIPMENTS}, outs as (select source, sum(confidence) as total from rels where confidence > 0 group by 1), nn as (select count(*) as n from ents), "
    "shares as (select source, target, confidence / total as share from rels join outs using (source) where confidence > 0), "
    "ranks as (select entity_id, 1.0::double / n as s, 0 as k, 1.0::double as moved from ents, nn union all "
    "select entity_id, fresh, k + 1, max(abs(fresh - s)) over () from (select r.entity_id, r.s, r.k, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(got, 0) as fresh from ranks r "
    "left join (select target as entity_id, sum(share * p.s) as got from ranks p join shares on source = p.entity_id group by 1) g using (entity_id), "
    "(select coalesce(sum(s) filter (where entity_id not in (select source from outs)), 0) as lost from ranks), nn where r.k < 100 and r.moved >= 1e-6)), "
    "scored as (select entity_id, round(s / sum(s) over (), 9) as score from ranks where k = (select max(k) from ranks)) "
)


@query(_RANKS + "select * from scored")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pagerank(shipments(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(_RANKS + "select * from scored order by score desc, entity_id limit 20")
def pagerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_entities(pagerank(spark, sf_dir), 20)


@query(f"with {SHIPMENTS} select least(a.entity_ord, b.entity_ord) as a, greatest(a.entity_ord, b.entity_ord) as b, round(sum(confidence), 6) as w from rels join ents a on a.entity_id = source join ents b on b.entity_id = target where confidence > 0 and source <> target group by 1, 2")
def leiden_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.undirected_weights(shipments(spark, sf_dir)).withColumn("w", F.round("w", 6))


_ASSIGNED = "asg as (select 'part_' || p_partkey as entity_id, p_size % 25 as community_id from part union all select 'supplier_' || s_suppkey, s_nationkey from supplier)"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    rows = part.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("entity_id"), (F.col("p_size") % 25).cast("int").alias("community_id"))
    return rows.unionByName(supplier.select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_nationkey").cast("int").alias("community_id")))


@query(
    f"with {SHIPMENTS}, {_ASSIGNED}, sides as (select source as x, target as y, confidence as w from rels where confidence > 0 union all select target, source, confidence from rels where confidence > 0), "
    "per as (select a.community_id as c, sum(w) as tot, sum(case when a.community_id = b.community_id then w else 0 end) as inn from sides join asg a on a.entity_id = x join asg b on b.entity_id = y group by 1), m as (select sum(tot) as m2 from per) "
    "select round(sum(inn / m2 - (tot / m2) * (tot / m2)), 6) as modularity from per, m"
)
def modularity_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = shipments(spark, sf_dir)
    placed = _assigned(spark, sf_dir).join(graph.entities.select("entity_id", F.col("entity_ord").alias("node")), "entity_id").select("node", F.col("community_id").alias("community"))
    return communities.modularity(communities.undirected_weights(graph), placed).withColumn("modularity", F.round("modularity", 6))


@query()
def detect_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.detect(shipments(spark, sf_dir))


@query(
    f"with {SHIPMENTS}, {_ASSIGNED}, names as (select community_id, string_agg(name, ', ' order by entity_ord) as names from asg join ents using (entity_id) group by 1), "
    "types as (select a.community_id, string_agg(distinct relation_type, ', ' order by relation_type) as types from rels join asg a on a.entity_id = source join asg b on b.entity_id = target where a.community_id = b.community_id group by 1) "
    "select cast(community_id as integer) as community_id, 'Entities: ' || names || coalesce('. Relationships: ' || types, '') as content from names left join types using (community_id)"
)
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.summaries(shipments(spark, sf_dir), _assigned(spark, sf_dir))


@query(
    f"with {SHIPMENTS}, {_ASSIGNED}, cited as (select source, target, relation_type, chunk, row_number() over (partition by source, target, relation_type order by min(seq)) as spot from raw group by 1, 2, 3, 4), "
    "c as (select a.community_id, chunk, min({'r': rel_ord, 's': spot}) as o from rels join cited using (source, target, relation_type) join asg a on a.entity_id = source join asg b on b.entity_id = target where a.community_id = b.community_id group by 1, 2) "
    "select cast(community_id as integer) as community_id, string_agg(chunk, ',' order by o) as source_chunks from c group by 1"
)
def community_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.source_chunks(shipments(spark, sf_dir), _assigned(spark, sf_dir)).withColumn("source_chunks", F.array_join("source_chunks", ","))


_LISTS = (
    "with u as (select event_type as query_id, 'user_' || user_id as id, count(*) as n, round(sum(value), 4) as v from events group by 1, 2), "
    "high as (select * from (select query_id, id, n::double as score, row_number() over (partition by query_id order by n desc, id) as rank from u) where rank <= 20), "
    "low as (select * from (select query_id, id, v as score, row_number() over (partition by query_id order by v desc, id) as rank from u) where rank <= 20), "
    "both_levels as (select 'h' as level, * from high union all select 'l', * from low) "
)
_MERGED = "select query_id, level, id, round(score, 4) as score, cast(position as integer) as position from m where position <= 25"


def _dual(spark: SparkSession, sf_dir: str, strategy: Merge) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("query_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("id")).agg(F.count("*").cast("double").alias("n"), F.round(F.sum("value"), 4).alias("v"))

    def ranked(column):
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return users.select("query_id", "id", F.col(column).alias("score")).withColumn("rank", F.row_number().over(order)).where("rank <= 20")

    merged = dual.merge_levels(ranked("n"), ranked("v"), 25, DualConfig(strategy=strategy))
    return merged.select("query_id", "level", "id", F.round("score", 4).alias("score"), "position")


for _name, _strategy, _order in (
    ("dual_interleave", Merge.INTERLEAVE, "rank, level"),
    ("dual_highfirst", Merge.HIGH_FIRST, "level, rank"),
    ("dual_lowfirst", Merge.LOW_FIRST, "level desc, rank"),
    ("dual_weighted", Merge.WEIGHTED, "score * case level when 'h' then 0.6 else 0.4 end desc, id, level"),
):
    QUERIES[_name] = partial(_dual, strategy=_strategy)
    ORACLES[_name] = _LISTS + f", m as (select *, row_number() over (partition by query_id order by {_order}) as position from both_levels) {_MERGED}"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks: their line items' suppliers as entities, neighbouring lines as relations."""
    lines = table(spark, sf_dir, "lineitem")
    supplier = F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string"))
    row = F.struct(F.col("l_linenumber").alias("n"), supplier.alias("s"), F.round(1 - 8 * F.col("l_discount"), 2).cast("float").alias("c"))
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    entities = F.transform("r", lambda x: F.struct(x["s"].alias("entity_id"), x["s"].alias("name"), F.lit("SUPPLIER").alias("entity_type"), x["c"].alias("confidence"), F.array().cast(f"array<{MENTION}>").alias("mentions")))
    edge = F.transform(F.filter("r", lambda x, i: i > 0), lambda x, i: F.struct(F.get("r", i)["s"].alias("source"), x["s"].alias("target"), F.lit("NEXT").alias("relation_type"), F.lit(0.6).cast("float").alias("confidence"), F.array(F.lit("c")).alias("context")))
    return grouped.select(F.col("l_orderkey").alias("chunk_ord"), F.col("l_orderkey").cast("string").alias("chunk_id"), entities.alias("entities"), edge.alias("relationships"))


_KEPT = (
    "with l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, 'supplier_' || l_suppkey, round(1 - 8 * l_discount, 2)) - 1 as spot, 'supplier_' || l_suppkey as entity_id, round(1 - 8 * l_discount, 2)::float as confidence from lineitem), "
    "kept as (select * from (select *, row_number() over (partition by l_orderkey order by confidence desc, spot) as r from l where confidence >= 0.5::float) where r <= 2) "
)


@query(_KEPT + "select cast(l_orderkey as varchar) as chunk_id, cast(spot as integer) as spot, entity_id from kept")
def chunk_entity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.cap_entities(_found(spark, sf_dir), 0.5, 2).select("chunk_id", F.col("at").alias("spot"), "entity_id")


@query(
    _KEPT + ", e as (select l_orderkey, spot - 1 as spot, lag(entity_id) over (partition by l_orderkey order by spot) as source, entity_id as target from l) "
    "select cast(l_orderkey as varchar) as chunk_id, cast(spot as integer) as spot, source, target from e where spot >= 0 and exists (select 1 from kept k where k.l_orderkey = e.l_orderkey and k.entity_id = source) and exists (select 1 from kept k where k.l_orderkey = e.l_orderkey and k.entity_id = target)"
)
def chunk_rel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    return extraction.gate_relationships(found, extraction.cap_entities(found, 0.5, 2)).select("chunk_id", F.col("at").alias("spot"), "source", "target")
