"""Shortest ways by blocks against Dijkstra's method over the whole graph."""

from __future__ import annotations

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.operators import geodesic


def plain(edges, sources):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    best, heap = {}, [(0.0, s, s) for s in sources if s in near]
    heapq.heapify(heap)
    while heap:
        d, owner, u = heapq.heappop(heap)
        if (d, owner) >= best.get(u, (np.inf, 0)):
            continue
        best[u] = (d, owner)
        for v, w in near[u]:
            heapq.heappush(heap, (d + w, owner, v))
    return best


@pytest.mark.parametrize("block", [9, 1000])
def test_owners_equal_brute_force(spark, block):
    rng = np.random.default_rng(block)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 120, 200), rng.integers(0, 120, 200), rng.integers(1, 5, 200), strict=True)]
    edges += [(500, 501, 1.0), (3, 3, 1.0), (edges[0][0], edges[0][1], 9.0)]
    frame = spark.createDataFrame(edges, "u long, v long, w double")
    sources = spark.createDataFrame([(3,), (50,), (77,), (3,), (9999,)], "vid long")
    loops = [e for e in edges if e[0] != e[1]]
    want = plain(loops, [3, 50, 77])
    got = geodesic.geodesic_owners(frame, sources, block).collect()
    assert {r.vid: (r.dist, r.owner) for r in got} == want
    length = {}
    for u, v, w in loops:
        for a, b in ((u, v), (v, u)):
            length[a, b] = min(w, length.get((a, b), np.inf))
    for r in got:
        ways = [u for (u, v), w in length.items() if v == r.vid and u in want and want[u][0] + w == r.dist and want[u][1] == r.owner]
        assert r.parent == (-1 if r.dist == 0 else min(ways))
    assert geodesic.geodesic_owners(frame, sources.where("false"), block).count() == 0
    assert geodesic.geodesic_owners(frame.where("false"), sources, block).count() == 0


def test_a_long_path_takes_few_rounds(spark):
    path = spark.range(9_999).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("w"))
    graph = geodesic.block_graph(path, 2500)
    state, rounds = geodesic.spread(graph, spark.createDataFrame([(0,)], "vid long"))
    assert rounds < 20 and state.where("dist = vid AND owner = 0").count() == 10_000
    state, more = geodesic.spread(graph, spark.createDataFrame([(9_000,)], "vid long"), state)
    assert more < 20 and state.where("owner = 9000").count() == 9_999 - 4_500
    ids, _ = geodesic.farthest_owners(graph, 0, 3)
    assert ids == [0, 9_999, 4_999]


def test_the_skeleton_of_a_branching_surface(spark):
    """Three arms of a star: its skeleton joins the tips to one middle node."""
    rows, edges = [(0, 0.0, 0.0, 0.0)], []
    for arm in range(3):
        a = 2 * np.pi * arm / 3
        for k in range(1, 11):
            rows.append((arm * 10 + k, float(k * np.cos(a)), float(k * np.sin(a)), 0.0))
            edges.append((arm * 10 + k, 0 if k == 1 else arm * 10 + k - 1))
    vertices = spark.createDataFrame(rows, "vid long, x double, y double, z double")
    frame = spark.createDataFrame(edges, "u long, v long")
    nodes, found = geodesic.geodesic_skeleton(vertices, frame, vertices, 5, 0.5)
    assert sorted(map(tuple, found.select("u", "v").collect())) == [(0, 10), (0, 20), (0, 30)] and nodes.count() == 4
    nodes, found = geodesic.geodesic_skeleton(vertices, frame.where("false"), vertices)
    assert nodes.count() == 0 and found.count() == 0
