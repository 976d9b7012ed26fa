"""Communities by modularity: deterministic local moving, then a split of what isn't connected."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.config import CommunityConfig
from lodestone.operators.adjacency import BLOCK, blocks, lists, pack
from lodestone.operators.components import components
from lodestone.operators.graph_store import Graph, hashed
from lodestone.runtime import materialise

EPSILON = 1e-12


def undirected_weights(graph: Graph) -> DataFrame:
    """(a, b, w) with a < b by entity_ord: parallel and reciprocal weights summed; self-loops and weights <= 0 left out."""
    numbers = hashed(graph.entities.select("entity_id", "entity_ord"))
    held = graph.relationships.where("source <> target and confidence > 0")
    ends = held.join(numbers.select(F.col("entity_id").alias("source"), F.col("entity_ord").alias("s")), "source").join(numbers.select(F.col("entity_id").alias("target"), F.col("entity_ord").alias("t")), "target")
    return ends.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.sum(F.col("confidence").cast("double")).alias("w"))


def modularity(weights: DataFrame, assignment: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of assignment(node, community) over weights(a, b, w); 0 without weight."""
    left = assignment.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    right = assignment.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    placed = weights.join(hashed(left), "a").join(hashed(right), "b")
    sides = F.explode(F.array(F.struct(F.col("ca").alias("community"), F.col("cb").alias("other"), "w"), F.struct(F.col("cb").alias("community"), F.col("ca").alias("other"), "w"))).alias("x")
    per = placed.select(sides).select("x.*").groupBy("community").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("community") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inside"))
    whole = per.agg(F.sum("all").alias("m2"))
    part = F.col("inside") / F.col("m2") - resolution * F.pow(F.col("all") / F.col("m2"), 2)
    return per.crossJoin(F.broadcast(whole)).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("modularity"))


def sweeps(starts: np.ndarray, near: np.ndarray, weight: np.ndarray, m2: float, config: CommunityConfig, alone: bool = False) -> Iterator[tuple[bool, float, np.ndarray, np.ndarray]]:
    """Per full pass over the nodes of one component (0 .. n - 1 in node order): (moved, its share of modularity, nodes with a new community, that community).

    Node i has the neighbours near[starts[i]:starts[i + 1]], in order. The first
    entry is the start: every node alone. Passes end when nothing moves, or, for
    a component that is alone, where the gain falls below min_gain. Neighbours
    are read block by block; what is held is a few numbers a node.
    """
    n = len(starts) - 1
    of, degree = array("q", range(n)), array("d")
    for a, b in blocks(starts):
        row, at = weight[starts[a] : starts[b]].tolist(), (starts[a : b + 1] - starts[a]).tolist()
        degree.extend(sum(row[p:e]) for p, e in zip(at, at[1:]))
    total = array("d", degree)

    def share() -> float:
        c, inside = np.array(of), np.empty(n)
        for a, b in blocks(starts):
            many = np.diff(starts[a : b + 1])
            same = c[near[starts[a] : starts[b]]] == np.repeat(c[a:b], many)
            inside[a:b] = np.add.reduceat(weight[starts[a] : starts[b]] * same, starts[a:b] - starts[a])
        held = np.bincount(c, minlength=n) > 0
        inside, tot = np.bincount(c, inside, n)[held], np.bincount(c, np.array(degree), n)[held]
        return float(np.sum(inside / m2 - config.resolution * (tot / m2) ** 2))

    before = share()
    yield True, before, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(max(0, config.max_iterations)):
        old, moved = np.array(of), False
        for a, b in blocks(starts):
            js, vs = near[starts[a] : starts[b]].tolist(), weight[starts[a] : starts[b]].tolist()
            p = 0
            for i, e in zip(range(a, b), (starts[a + 1 : b + 1] - starts[a]).tolist()):
                here, k = of[i], degree[i]
                total[here] -= k
                to: dict[int, float] = defaultdict(float)
                for j, v in zip(js[p:e], vs[p:e]):
                    to[of[j]] += v
                p = e
                best, score = here, to.get(here, 0.0) - config.resolution * k * total[here] / m2
                for c in sorted(to):
                    gain = to[c] - config.resolution * k * total[c] / m2
                    if c != here and gain > score + EPSILON:
                        best, score = c, gain
                of[i] = best
                total[best] += k
                moved |= best != here
        fresh, now = np.array(of), share()
        changed = np.flatnonzero(fresh != old)
        yield moved, now, changed, fresh[changed]
        if not moved or (alone and now - before < config.min_gain):
            break
        before = now


TRIED = "label long, pass int, moved boolean, share double, node long, community long"
FEW_PASSES = 16
"""So many passes are tried first; the stop rule seldom asks for more."""


def _try(placed: DataFrame, m2: float, config: CommunityConfig, alone: bool) -> DataFrame:
    """TRIED rows of packed(label as grp, node, neighbour, value): one per component and pass without a node, and one per node that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, nodes, starts, near, weight in lists(batches, True):
            for p, (moved, share, changed, to) in enumerate(sweeps(starts, near, weight, m2, config, alone)):
                head = [pa.array([label]), pa.array([p], pa.int32()), pa.array([moved]), pa.array([share]), pa.array([None], pa.int64()), pa.array([None], pa.int64())]
                yield pa.RecordBatch.from_arrays(head, names=names)
                for a in range(0, len(changed), BLOCK):
                    x, c = nodes[changed[a : a + BLOCK]], nodes[to[a : a + BLOCK]]
                    m = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, label)), pa.array(np.full(m, p, np.int32)), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.float64()), pa.array(x), pa.array(c)], names=names)

    names = [x.split()[0] for x in TRIED.split(", ")]
    return materialise(placed.repartition("grp").mapInArrow(run, TRIED), "passes")


def detect(graph: Graph, config: CommunityConfig = CommunityConfig()) -> DataFrame:
    """(entity_id, community_id): communities numbered by their first member in node order.

    A node only ever looks at its own component and at the total weight, so the
    components move side by side, one task each; the stop rule, which looks at
    the modularity of everything, is applied to the passes' summed shares. The
    task of a component keeps its neighbour lists in files.
    """
    nodes = graph.entities.select("entity_id", F.col("entity_ord").alias("node"))
    weights = materialise(undirected_weights(graph), "weights")
    m2 = 2 * (weights.agg(F.sum("w")).first()[0] or 0.0)
    if m2 <= 0:
        return number_communities(nodes.withColumn("label", F.col("node")))
    labels = components(weights.select("a", "b"))
    alone = labels.select("label").distinct().limit(2).count() < 2
    ways = F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("neighbour"), F.col("w").alias("value")), F.struct(F.col("b").alias("node"), F.col("a").alias("neighbour"), F.col("w").alias("value"))))
    placed = materialise(pack(weights.join(labels, F.col("a") == F.col("node")).select(F.col("label").alias("grp"), ways), ["neighbour"]), "lists")
    few = config if alone else replace(config, max_iterations=min(config.max_iterations, FEW_PASSES))
    while True:
        tried = _try(placed, m2, few, alone)
        heads = tried.where("node is null").select("label", "pass", "moved", "share")
        last = heads.groupBy("label").agg(F.max("pass").alias("last"))
        # one row per pass, at most max_iterations: each component counts with its own last pass once it has come to rest
        deepest = heads.agg(F.max("pass")).first()[0]
        asked = last.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumn("pass", F.least("at", "last"))
        sums = asked.join(heads, ["label", "pass"]).groupBy("at").agg(F.sum("share").alias("q"), F.max(F.col("moved") & (F.col("at") <= F.col("last"))).alias("moved"))
        trace = {r["at"]: (r["q"], r["moved"]) for r in sums.collect()}
        stop, rests = 0, False
        for p in range(1, deepest + 1):
            stop = p
            rests = not trace[p][1] or trace[p][0] - trace[p - 1][0] < config.min_gain
            if rests:
                break
        if rests or few.max_iterations >= config.max_iterations:
            break
        few = config
    moves = tried.where(F.col("node").isNotNull() & (F.col("pass") <= stop)).select("node", "community", "pass")
    chosen = labels.select("node", F.col("node").alias("community"), F.lit(0).alias("pass")).unionByName(moves).groupBy("node").agg(F.max_by("community", "pass").alias("community"))
    # split: components of the edges inside a community
    chosen = materialise(chosen, "chosen")
    left, right = (chosen.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    inner = weights.join(left, "a").join(right, "b").where("ca = cb").select("a", "b")
    split = components(inner)
    return number_communities(nodes.join(split.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("entity_id", "node", F.coalesce("label", "node").alias("label")))


def number_communities(labelled: DataFrame) -> DataFrame:
    """(entity_id, community_id) of (entity_id, node, label): ids 0, 1, ... in order of each label's least node.

    The numbering sorts one row per community.
    """
    first = labelled.groupBy("label").agg(F.min("node").alias("first"))
    numbered = first.withColumn("community_id", (F.row_number().over(Window.orderBy("first")) - 1).cast("int"))
    return labelled.join(numbered, "label").select("entity_id", "community_id")


def summaries(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(community_id, content): member names in node order and the sorted relation types among members."""
    members = assignment.join(graph.entities.select("entity_id", "entity_ord", "name"), "entity_id")
    names = members.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_ord", "name"))), lambda x: x["name"]), ", ").alias("names"))
    source, target = (assignment.select(F.col("entity_id").alias(x), F.col("community_id").alias(f"c_{x}")) for x in ("source", "target"))
    types = graph.relationships.join(source, "source").join(target, "target").where("c_source = c_target").groupBy(F.col("c_source").alias("community_id")).agg(F.array_join(F.array_sort(F.collect_set("relation_type")), ", ").alias("types"))
    parts = F.array_compact(F.array(F.concat(F.lit("Entities: "), "names"), F.concat(F.lit("Relationships: "), "types")))
    return names.join(types, "community_id", "left").select("community_id", F.array_join(parts, ". ").alias("content"))


def source_chunks(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(community_id, source_chunks): chunks annotated with a member, then members' mentions, then the context of inner edges; each once."""
    member = assignment.join(graph.entities.select("entity_id", "entity_ord", "mentions"), "entity_id")
    found = member.select("community_id", F.posexplode("mentions").alias("at", "m"), "entity_ord").select("community_id", F.lit(1).alias("phase"), F.col("entity_ord").cast("long").alias("o"), F.col("at").cast("long").alias("p"), F.col("m.chunk_id").alias("chunk_id"))
    if graph.chunks is not None and "entities" in graph.chunks.columns:
        noted = graph.chunks.select("chunk_id", "chunk_ord", F.explode("entities").alias("entity_id")).join(assignment, "entity_id")
        found = found.unionByName(noted.select("community_id", F.lit(0).alias("phase"), F.col("chunk_ord").cast("long").alias("o"), F.lit(0).cast("long").alias("p"), "chunk_id"))
    source, target = (assignment.select(F.col("entity_id").alias(x), F.col("community_id").alias(f"c_{x}")) for x in ("source", "target"))
    inner = graph.relationships.join(source, "source").join(target, "target").where("c_source = c_target").select(F.col("c_source").alias("community_id"), F.lit(2).alias("phase"), F.col("rel_ord").cast("long").alias("o"), F.posexplode("context").alias("at", "chunk_id"))
    found = found.unionByName(inner.select("community_id", "phase", "o", F.col("at").cast("long").alias("p"), "chunk_id"))
    first = found.groupBy("community_id", "chunk_id").agg(F.min(F.struct("phase", "o", "p")).alias("k"))
    return first.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunks"))
