"""Shortest ways from many sources at once, with the source that owns each node.

Nodes are dealt into blocks of consecutive ids.  A round settles whole blocks: every
block that was offered something better runs Dijkstra's method over its own edges, of
which it holds a bounded number of nodes, and what improved is offered along the edges
that leave the block.  So the rounds follow the number of blocks that a way crosses, not
its number of edges, and blocks that nothing reaches cost nothing.  A node takes the
least (distance, source) of all ways, which is one result whatever the order.

The state is kept between calls, so further sources only touch the nodes that they come
to own; landmarks are chosen so, each the farthest from all before.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquilt.functions.linalg import norm
from geoquilt.operators import graphs, meshes, skeletons
from geoquilt.operators.numbering import indexed
from geoquilt.operators.spatial import XYZ
from geoquilt.storage import discard, stored

BLOCK_NODES, MAX_ROUNDS = 1024, 100_000
FOUND = "block long, vid long, dist double, owner long"
KINDS = pa.schema([("block", pa.int64()), ("vid", pa.int64()), ("dist", pa.float64()), ("owner", pa.int64())])


@dataclass
class BlockGraph:
    """Stored arcs of a graph, both ways: within blocks (block, u, v, w), and between them (u, block, v, w); its nodes (vid, block)."""

    nodes: DataFrame
    inner: DataFrame
    outer: DataFrame


def block_graph(edges: DataFrame, block_nodes: int = BLOCK_NODES) -> BlockGraph:
    """The graph of ``edges(u, v, w)`` with positive lengths, dealt into blocks by the order of ids; loops go."""
    rows = edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    arcs = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    nodes = indexed(rows.select(F.explode(F.array("u", "v")).alias("vid")).distinct(), "vid", name="i")
    nodes = stored(nodes.select("vid", F.floor(F.col("i") / block_nodes).alias("block")), "block-nodes")
    at = lambda p: nodes.select(F.col("vid").alias(f"{p}_vid"), F.col("block").alias(f"{p}_block"))
    placed = arcs.join(at("u"), F.col("u") == F.col("u_vid")).join(at("v"), F.col("v") == F.col("v_vid"))
    placed = stored(placed.groupBy("u", "v", "u_block", "v_block").agg(F.min("w").alias("w")), "block-arcs")
    inner = placed.where("u_block = v_block").select(F.col("u_block").alias("block"), "u", "v", "w")
    return BlockGraph(nodes, inner, placed.where("u_block <> v_block").select("u", F.col("v_block").alias("block"), "v", "w"))


def _settle(key: tuple, arcs: pa.Table, rows: pa.Table) -> pa.Table:
    """The task of a block: what improves by its own edges, from known rows and fresh offers (vid, dist, owner, fresh)."""
    out = defaultdict(list)
    for u, v, w in zip(*(arcs.column(c).to_pylist() for c in "uvw"), strict=True):
        out[u].append((v, w))
    best, heap = {}, []
    for vid, dist, owner, fresh in zip(*(rows.column(c).to_pylist() for c in ("vid", "dist", "owner", "fresh")), strict=True):
        if fresh:
            heap.append((dist, owner, vid))
        else:
            best[vid] = (dist, owner)
    heapq.heapify(heap)
    improved = {}
    worst = (np.inf, 0)
    while heap:
        dist, owner, vid = heapq.heappop(heap)
        if (dist, owner) >= best.get(vid, worst):
            continue
        best[vid] = improved[vid] = (dist, owner)
        for v, w in out[vid]:
            if (dist + w, owner) < best.get(v, worst):
                heapq.heappush(heap, (dist + w, owner, v))
    found = [(key[0].as_py(), vid, dist, owner) for vid, (dist, owner) in improved.items()]
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.table([pa.array(c, k.type) for c, k in zip(columns, KINDS, strict=True)], schema=KINDS)


def spread(graph: BlockGraph, sources: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Stored (block, vid, dist, owner) of all nodes that ``sources(vid)``, or those of an earlier ``state``, reach, and the rounds.

    Sources that are no nodes of the graph reach nothing.
    """
    offers = sources.select("vid").distinct().join(graph.nodes, "vid").select("block", "vid", F.lit(0.0).alias("dist"), F.col("vid").alias("owner"))
    spark = sources.sparkSession
    state = spark.createDataFrame([], FOUND) if state is None else state
    offers = stored(offers, "offers")
    for rounds in range(MAX_ROUNDS):
        if offers.isEmpty():
            return state, rounds
        active = offers.select(F.col("block").alias("a_block")).distinct()
        in_active = lambda df: df.join(active, F.col("block") == F.col("a_block"), "left_semi")  # noqa: E731, B023
        rows = in_active(state).withColumn("fresh", F.lit(False)).unionByName(offers.withColumn("fresh", F.lit(True)))
        improved = stored(in_active(graph.inner).groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(_settle, FOUND), "improved")
        merged = state.unionByName(improved).groupBy("block", "vid").agg(F.min(F.struct("dist", "owner")).alias("b"))
        before, state = state, stored(merged.select("block", "vid", "b.dist", "b.owner"), "distances")
        sent = improved.select(F.col("vid").alias("i_vid"), "dist", "owner").join(graph.outer, F.col("i_vid") == F.col("u"))
        best = sent.groupBy("block", F.col("v").alias("vid")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), "owner")).alias("b"))
        known = state.select(F.col("vid").alias("k_vid"), F.struct("dist", "owner").alias("k"))
        better = best.join(known, F.col("vid") == F.col("k_vid"), "left").where(F.col("k").isNull() | (F.col("b") < F.col("k")))
        last, offers = offers, stored(better.select("block", "vid", "b.dist", "b.owner"), "offers")
        discard(before, last, improved)
    raise RuntimeError("the distances did not settle")


def with_parents(graph: BlockGraph, state: DataFrame) -> DataFrame:
    """(vid, dist, owner, parent): of the neighbours on a shortest way from the owner the least; -1 for a source."""
    arcs = graph.inner.select("u", "v", "w").unionByName(graph.outer.select("u", "v", "w"))
    to = state.select(F.col("vid").alias("t_vid"), F.col("dist").alias("t_dist"), F.col("owner").alias("t_owner"))
    steps = state.join(arcs, F.col("vid") == F.col("u")).join(to, F.col("v") == F.col("t_vid"))
    on_way = (F.col("dist") + F.col("w") == F.col("t_dist")) & (F.col("owner") == F.col("t_owner"))
    parents = steps.where(on_way).groupBy(F.col("v").alias("p_vid")).agg(F.min("u").alias("parent"))
    joined = state.join(parents, F.col("vid") == F.col("p_vid"), "left")
    return joined.select("vid", "dist", "owner", F.when(F.col("dist") == 0, -1).otherwise(F.col("parent")).cast("long").alias("parent"))


def geodesic_owners(edges: DataFrame, sources: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(vid, dist, owner, parent) of all nodes of ``edges(u, v, w)`` that a source of ``sources(vid)`` reaches.

    The owner is the nearest source, of equal ones the least, the parent the node before it on the shortest way.
    Lengths must be positive.  Repeated edges count as the shortest of them, without edges or sources the result is empty.
    """
    graph = block_graph(edges, block_nodes)
    return with_parents(graph, spread(graph, sources)[0])


def farthest_owners(graph: BlockGraph, first: int, n: int) -> tuple[list[int], DataFrame]:
    """Up to ``n`` landmarks from ``first`` on, each the node farthest from all before (ties by id), and the state of all of them."""
    spark = graph.nodes.sparkSession
    one = lambda v: spark.createDataFrame([(v,)], "vid long")
    chosen, state = [first], spread(graph, one(first))[0]
    while len(chosen) < n:
        far = state.where("dist > 0").agg(F.min(F.struct(-F.col("dist"), "vid"))["vid"].alias("vid")).first()["vid"]
        if far is None:
            break
        chosen.append(far)
        state = spread(graph, one(far), state)[0]
    return chosen, state


def landmark_tree(graph: BlockGraph, landmarks: list[int]) -> DataFrame:
    """Distinct edges (u, v) of the shortest ways from the first landmark to all others; unreachable ones have none."""
    spark = graph.nodes.sparkSession
    state, _ = spread(graph, spark.createDataFrame([(landmarks[0],)], "vid long"))
    paths = stored(with_parents(graph, state).select("vid", "parent"), "landmark-paths")
    wanted = paths.where(F.col("vid").isin(landmarks)).select("vid")
    on_way = graphs.backtrack(paths, wanted).select("vid").distinct()
    return graphs.canonical(paths.where("parent >= 0").join(on_way, "vid", "left_semi").select(F.col("vid").alias("u"), F.col("parent").alias("v")))


def geodesic_skeleton(vertices: DataFrame, edges: DataFrame, points: DataFrame, landmarks: int = 32, merge_radius: float = 0.01, expand: float = 1.10) -> tuple[DataFrame, DataFrame]:
    """Nodes (vid, x, y, z) and canonical edges of the skeleton of a surface ``vertices(vid, x, y, z)``, ``edges(u, v)``.

    The shortest ways between landmarks, each the farthest from all before, form a tree; its chains become edges between
    their ends, those whose middle lies outside the expanded box of ``points`` go, and ends closer than ``merge_radius`` become one.
    Edges are as long as their ends are apart, coincident ends at least 1e-12.  Without edges the result is empty.
    """
    at = lambda p: vertices.select(F.col("vid").alias(f"{p}_vid"), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
    placed = edges.join(at("a"), F.col("u") == F.col("a_vid")).join(at("b"), F.col("v") == F.col("b_vid"))
    length = norm([F.col(f"a{c}") - F.col(f"b{c}") for c in XYZ])
    graph = block_graph(placed.select("u", "v", F.greatest(length, F.lit(1e-12)).alias("w")))
    first = graph.nodes.agg(F.min("vid")).first()[0]
    if first is None:
        return vertices.limit(0).select("vid", *XYZ), edges.limit(0).select("u", "v")
    ids, _ = farthest_owners(graph, first, landmarks)
    tree = stored(landmark_tree(graph, ids), "landmark-tree")
    chain = skeletons.chains(tree).withColumn("line_id", F.xxhash64("start", "end"))
    lines = stored(chain.join(vertices.select(F.col("vid").alias("c_vid"), *XYZ), F.col("vid") == F.col("c_vid")).select("line_id", "start", "end", "seq", "vid", *XYZ), "chains")
    kept = meshes.prune_polylines(lines.select("line_id", "seq", *XYZ), points, expand).select(F.col("line_id").alias("k_line")).distinct()
    ends = skeletons.chain_graph(lines.join(kept, F.col("line_id") == F.col("k_line"), "left_semi"))
    ends = stored(ends, "chain-ends")
    nodes = vertices.select(F.col("vid").alias("pid"), *XYZ).join(ends.select(F.explode(F.array("u", "v")).alias("n")).distinct(), F.col("pid") == F.col("n"), "left_semi")
    near = graphs.radius_pairs(nodes, merge_radius)
    parts = stored(graphs.label_components(nodes.select(F.col("pid").alias("vid")), near), "merged-ends")
    merged = nodes.join(parts, F.col("pid") == F.col("vid")).groupBy(F.col("component").alias("vid")).agg(*[F.avg(c).alias(c) for c in XYZ])
    return merged, graphs.remap_edges(ends, parts.select("vid", F.col("component").alias("new_id")))
