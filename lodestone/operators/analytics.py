"""Ranks, centralities and shape of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import PageRankConfig
from lodestone.operators.components import components
from lodestone.operators.graph_store import BROADCAST_ROWS, Graph, hashed
from lodestone.operators.traversal import distances
from lodestone.runtime import materialise, number_rows


def pagerank(graph: Graph, config: PageRankConfig = PageRankConfig(), iterations: int | None = None) -> DataFrame:
    """(entity_id, score): weighted PageRank with dangling mass spread evenly; scores sum to 1.

    Edges are written once, between numbers; names are joined to the scores.

    Runs until no score moves by the tolerance, or exactly `iterations` times. A
    round is one join and one aggregate over the edges; the dangling mass comes
    from a one-row aggregate inside the same plan.
    """
    damping = min(1.0, max(0.0, config.damping))
    n = graph.entities.count()
    if n == 0:
        return graph.entities.select("entity_id", F.lit(0.0).alias("score"))
    if n == 1:
        return graph.entities.select("entity_id", F.lit(1.0).alias("score"))
    known = materialise(number_rows(graph.entities.select("entity_id"), ["entity_id"], "node"), "numbers")
    ends = hashed(known.select(F.col("entity_id").alias("source"), F.col("node").alias("s"))), hashed(known.select(F.col("entity_id").alias("target"), F.col("node").alias("t")))
    held = graph.relationships.where("confidence > 0").select("source", "target", F.col("confidence").cast("double").alias("w"))
    # an edge from or to nothing known keeps its weight in its source's total
    held = materialise(held.join(ends[0], "source").join(ends[1], "target", "left").select("s", "t", "w"), "weighted")
    total = held.groupBy("s").agg(F.sum("w").alias("total"))
    edges = materialise(held.join(hashed(total), "s").where("t is not null").select("s", "t", (F.col("w") / F.col("total")).alias("share")), "edges")
    nodes = materialise(known.select("node").join(total.select(F.col("s").alias("node"), F.lit(False).alias("_out")), "node", "left").select("node", F.col("_out").isNull().alias("dangling")), "nodes")
    ranks = nodes.withColumn("score", F.lit(1.0 / n))
    small = F.broadcast if n <= BROADCAST_ROWS else lambda x: x.hint("shuffle_hash")
    for k in range(config.max_iterations if iterations is None else iterations):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("lost"))
        given = edges.join(small(ranks.select(F.col("node").alias("s"), "score")), "s").groupBy(F.col("t").alias("node")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        fresh = (1 - damping) / n + damping * F.col("lost") / n + damping * F.coalesce("got", F.lit(0.0))
        step = ranks.join(given, "node", "left").crossJoin(F.broadcast(lost)).select("node", "dangling", fresh.alias("score"), F.abs(fresh - F.col("score")).alias("moved"))
        if iterations is None or k % 5 == 4:
            step = materialise(step, "ranks")
        ranks = step.drop("moved")
        if iterations is None and step.agg(F.max("moved")).first()[0] < config.tolerance:
            break
    whole = ranks.agg(F.sum("score").alias("whole"))
    return ranks.join(known, "node").crossJoin(F.broadcast(whole)).select("entity_id", (F.col("score") / F.col("whole")).alias("score"))


def top_entities(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "entity_id").limit(max(0, k))


def adjacency(relationships: DataFrame) -> DataFrame:
    """(node, neighbour): undirected and distinct; a self-loop is its own neighbour."""
    return relationships.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).unionByName(relationships.select(F.col("target").alias("node"), F.col("source").alias("neighbour"))).distinct()


def _inner(graph: Graph) -> DataFrame:
    """Adjacency between known entities."""
    known = graph.entities.select("entity_id")
    near = adjacency(graph.relationships)
    return near.join(known.withColumnRenamed("entity_id", "node"), "node", "left_semi").join(known.withColumnRenamed("entity_id", "neighbour"), "neighbour", "left_semi").select("node", "neighbour")


def degree_centrality(graph: Graph) -> DataFrame:
    """(entity_id, degree): distinct neighbours over n - 1; 0 for a lone node."""
    n = graph.entities.agg(F.count("*").alias("n"))
    counted = adjacency(graph.relationships).groupBy(F.col("node").alias("entity_id")).agg(F.count("*").alias("k"))
    joined = graph.entities.select("entity_id").join(counted, "entity_id", "left").crossJoin(F.broadcast(n))
    return joined.select("entity_id", F.when(F.col("n") > 1, F.coalesce("k", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0).alias("degree"))


def closeness_from(reached: DataFrame) -> DataFrame:
    """(entity_id, closeness) of distances(): others reached over the sum of their distances; 0 for none."""
    return reached.groupBy(F.col("root").alias("entity_id")).agg(F.when(F.sum("distance") > 0, (F.count("*") - 1) / F.sum("distance")).otherwise(0.0).alias("closeness"))


def closeness_centrality(graph: Graph) -> DataFrame:
    return closeness_from(distances(graph.entities, _inner(graph)))


def betweenness_from(graph: Graph, reached: DataFrame, near: DataFrame) -> DataFrame:
    """(entity_id, betweenness): Brandes' accumulation over distances(), level by level from the farthest, over (n - 1)(n - 2)."""
    n = graph.entities.count()
    zero = graph.entities.select("entity_id", F.lit(0.0).alias("betweenness"))
    deepest = reached.agg(F.max("distance")).first()[0]
    if n <= 2 or not deepest or deepest < 2:
        return zero
    reached = materialise(reached, "distances")
    near = materialise(near, "adjacency")
    below, every = None, None
    for depth in range(deepest - 1, 0, -1):
        lower = reached.where(F.col("distance") == depth + 1).select("root", F.col("node").alias("low"), F.col("paths").alias("low_paths"))
        lower = lower.withColumn("owed", F.lit(0.0)) if below is None else lower.join(below, ["root", "low"], "left").withColumn("owed", F.coalesce("owed", F.lit(0.0)))
        upper = reached.where(F.col("distance") == depth).select("root", "node", "paths")
        met = upper.join(near, "node").join(lower, (F.col("neighbour") == F.col("low")) & (upper["root"] == lower["root"])).select(upper["root"], "node", (F.col("paths") / F.col("low_paths") * (1 + F.col("owed"))).alias("part"))
        level = materialise(met.groupBy("root", "node").agg(F.sum("part").alias("owed")), "owed")
        every = level if every is None else every.unionByName(level)
        below = level.withColumnRenamed("node", "low")
    total = every.groupBy(F.col("node").alias("entity_id")).agg((F.sum("owed") / ((n - 1) * (n - 2))).alias("b"))
    return zero.select("entity_id").join(total, "entity_id", "left").select("entity_id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def betweenness_centrality(graph: Graph) -> DataFrame:
    near = _inner(graph).where("node <> neighbour")
    return betweenness_from(graph, distances(graph.entities, near), near)


def centralities(graph: Graph) -> DataFrame:
    """(entity_id, degree, betweenness, closeness)."""
    near = materialise(_inner(graph).where("node <> neighbour"), "adjacency")
    reached = materialise(distances(graph.entities, near), "distances")
    return degree_centrality(graph).join(betweenness_from(graph, reached, near), "entity_id").join(closeness_from(reached), "entity_id")


def connected_components(graph: Graph) -> DataFrame:
    """(entity_id, component): the component is the least entity_ord in it."""
    numbers = graph.entities.select("entity_id", "entity_ord")
    ends = graph.relationships.join(numbers.select(F.col("entity_id").alias("source"), F.col("entity_ord").alias("a")), "source").join(numbers.select(F.col("entity_id").alias("target"), F.col("entity_ord").alias("b")), "target")
    labels = components(ends.select("a", "b"))
    return numbers.join(labels, F.col("entity_ord") == F.col("node"), "left").select("entity_id", F.coalesce("label", "entity_ord").alias("component"))


def connected_component(graph: Graph, entity_id: str) -> DataFrame:
    """The entities connected to one; none if it is unknown."""
    every = connected_components(graph)
    return every.join(every.where(F.col("entity_id") == entity_id).select("component"), "component", "left_semi").select("entity_id")


def density(graph: Graph) -> DataFrame:
    """One row (density): undirected pairs over all possible."""
    n = graph.entities.agg(F.count("*").alias("n"))
    pairs = adjacency(graph.relationships).agg(F.floor(F.count("*") / 2).alias("e"))
    return n.crossJoin(pairs).select(F.when(F.col("n") > 1, 2 * F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"))


def clustering(graph: Graph) -> DataFrame:
    """(entity_id, clustering): the share of an entity's neighbour pairs that are neighbours themselves.

    Edges point to the end with more neighbours, so no node has more than about
    the square root of twice the edges going out, hubs included, and each
    triangle is met once. A self-loop makes an entity its own neighbour, paired
    with each other one.
    """
    near = materialise(_inner(graph), "adjacency")
    k = near.groupBy("node").agg(F.count("*").alias("k"), F.max(F.col("node") == F.col("neighbour")).alias("loop"))
    other = k.select(F.col("node").alias("neighbour"), F.col("k").alias("nk"))
    placed = near.where("node <> neighbour").join(k.select("node", "k"), "node").join(other, "neighbour")
    up = materialise(placed.where("k < nk or (k = nk and node < neighbour)").select("node", "neighbour"), "oriented")
    a, b = up.select("node", F.col("neighbour").alias("x")), up.select("node", F.col("neighbour").alias("y"))
    triangles = a.join(b, "node").join(up.select(F.col("node").alias("x"), F.col("neighbour").alias("y")), ["x", "y"], "left_semi")
    corners = triangles.select(F.explode(F.array("node", "x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("met"))
    closed = k.join(corners, "node", "left").select("node", (F.coalesce("met", F.lit(0)) + F.when(F.col("loop"), F.col("k") - 1).otherwise(0)).alias("closed"))
    joined = graph.entities.select(F.col("entity_id").alias("node")).join(k, "node", "left").join(closed, "node", "left")
    return joined.select(F.col("node").alias("entity_id"), F.when(F.col("k") > 1, F.coalesce("closed", F.lit(0)) / (F.col("k") * (F.col("k") - 1) / 2)).otherwise(0.0).alias("clustering"))


def diameter(graph: Graph) -> DataFrame:
    """One row (diameter): the longest shortest path in hops."""
    return distances(graph.entities, _inner(graph)).agg(F.coalesce(F.max("distance"), F.lit(0)).alias("diameter"))


def graph_stats(graph: Graph) -> DataFrame:
    """One row (node_count, edge_count, average_degree, max_depth)."""
    n = graph.entities.agg(F.count("*").alias("node_count"))
    e = graph.relationships.agg(F.count("*").alias("edge_count"))
    mean = F.when(F.col("node_count") > 0, 2 * F.col("edge_count") / F.col("node_count")).otherwise(0.0)
    return n.crossJoin(e).withColumn("average_degree", mean).crossJoin(diameter(graph).withColumnRenamed("diameter", "max_depth"))
