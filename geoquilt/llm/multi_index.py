"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut into halves, each half has a codebook of its own, and the
pairs of centroids form a grid of cells.  A vector lies in the cell of its two
nearest centroids.  A query visits cells in the order of its squared distance to
their centroids, by multi-sequence traversal, until the cell's excess over the
home cell passes a limit.  The limit is set so that of pairs at exactly the
wanted cosine - the hardest ones - the target share finds each other.  Every
vector is indexed and every vector is a query; cosines decide.

Equal vectors are one node with a weight.  The cells with one first centroid are
dealt into blocks of bounded size, a query is sent once to each block it has to
see, and a task streams its queries past one block.  It returns counts and a
spanning forest, never pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.llm.runs import runs
from geoquilt.operators.components import components
from geoquilt.storage import stored

COSINE, TARGET_RECALL = 0.95, 0.995
#: Rows that codebooks and limit are fitted on, at least and at most, and for each centroid.
SAMPLE, MAX_SAMPLE, PER_CENTROID = 8192, 65_536, 8
#: Vectors per cell and per block, and vectors that meet a block together.
PER_CELL, BLOCK, MEETING = 24, 2048, 512
NODE = "struct<a:bigint,b:bigint>"


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision; shorter ones are padded with zeros."""
    sizes = np.asarray(pc.list_value_length(column))
    values = np.asarray(column.flatten()).astype(np.float64)
    if (sizes == dim).all():
        x = values.reshape(-1, dim)
    else:
        x = np.zeros((len(sizes), dim))
        x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    x = x / np.abs(x).max(1, keepdims=True, initial=0.0)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows."""
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([_squared(x[i : i + 2048], centroids).argmin(1) for i in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[float, int, int]]:
    """Cells (distance, i, j) in the order of ``first[i] + second[j]`` while it is at most ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    while heap and heap[0][0] <= limit:
        d, p, q = heapq.heappop(heap)
        yield d, int(a[p]), int(b[q])
        if q + 1 < len(b):
            heapq.heappush(heap, (first[a[p]] + second[b[q + 1]], p, q + 1))
        if q == 0 and p + 1 < len(a):  # each row of the grid is entered once
            heapq.heappush(heap, (first[a[p + 1]] + second[b[0]], p + 1, 0))


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks and the traversal's limit."""

    dim: int
    first: np.ndarray
    second: np.ndarray
    excess: float

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.dim - self.dim // 2
        return _squared(units[:, :half], self.first), _squared(units[:, half:], self.second)

    def visits(self, units: np.ndarray) -> list[list[int]]:
        """The cells that each vector visits, its home first, as ``i * len(second) + j``."""
        k = len(self.second)
        return [
            [i * k + j for _, i, j in multi_sequence(a, b, a.min() + b.min() + self.excess)]
            for at in range(0, len(units), 1024)
            for a, b in zip(*self.distances(units[at : at + 1024]), strict=True)
        ]


def centroids_for(n_rows: int) -> int:
    """Centroids of a half so that cells hold about ``PER_CELL`` vectors."""
    return math.ceil((n_rows / PER_CELL) ** 0.5)


def fit_index(sample: np.ndarray, n_rows: int, cosine: float = COSINE, target: float = TARGET_RECALL, seed: int = 5) -> MultiIndex:
    """Codebooks from a sample of unit vectors, and the limit for the target recall.

    The limit is the ``target`` quantile of the excess that pairs at exactly
    ``cosine`` need; such pairs are made by turning sampled vectors in random
    directions.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    half = dim - dim // 2
    k = max(4, min(len(sample) // 4, centroids_for(n_rows)))
    books = [kmeans(h, k, rng) for h in (sample[:, :half], sample[:, half:])]
    index = MultiIndex(dim, *books, 0.0)
    x = sample[rng.integers(0, len(sample), 4000)]
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(1, keepdims=True) * x
    turn /= np.sqrt((turn * turn).sum(1, keepdims=True)) + 1e-300
    y = cosine * x + (1 - cosine * cosine) ** 0.5 * turn
    (a, b), (c, d) = index.distances(x), index.distances(y)
    rows = np.arange(len(x))
    need = a[rows, c.argmin(1)] + b[rows, d.argmin(1)] - a.min(1) - b.min(1)
    return MultiIndex(dim, *books, float(np.quantile(need, target)) + 1e-9)


def is_valid(embedding: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


ROW = pa.struct([("a", pa.int64()), ("b", pa.int64())])
FOUND = pa.schema([("u", ROW), ("v", ROW), ("n", pa.int64())])


class _Block:
    """The vectors of a block, met by the queries that visit one of its cells.

    Links are counted as matrices.  ``label`` is the component of each vector as
    far as the queries connected them; of a query with links only one edge to its
    component leaves, and an edge for each two components that it connects.
    """

    def __init__(self, ids: np.ndarray, units: np.ndarray, weight: np.ndarray, visits: tuple[np.ndarray, np.ndarray]) -> None:
        self.ids, self.units, self.weight = ids, units, weight.astype(float)
        owner, cells = visits
        self.cells, self.place = np.unique(cells[np.searchsorted(owner, np.arange(len(ids)))], return_inverse=True)
        order = np.argsort(cells, kind="stable")
        self.seen_cell, self.seen_by = cells[order], owner[order]
        self.by_a = np.argsort(ids[:, 0], kind="stable")
        self.label, self.extra = np.arange(len(ids)), np.zeros(len(ids))

    def meet(self, ids: np.ndarray, units: np.ndarray, weight: np.ndarray, visits: tuple[np.ndarray, np.ndarray], cosine: float) -> list[np.ndarray]:
        """Rows (u, v, n) of the queries with links: their links' weight, and edges that connect what they link."""
        owner, cells = visits
        local = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        here = self.cells[local] == cells
        visited = np.zeros((len(ids), len(self.cells)), bool)
        visited[owner[here], local[here]] = True
        hit = (units @ self.units.T >= cosine) & visited[:, self.place]
        own = self.by_a[np.minimum(np.searchsorted(self.ids[self.by_a, 0], ids[:, 0]), len(self.ids) - 1)]
        same = np.flatnonzero((self.ids[own] == ids).all(1))
        hit[same, own[same]] = False
        linked = np.flatnonzero(hit.any(1))
        if not len(linked):
            return []
        hit, ids = hit[linked], ids[linked]
        counts = hit @ self.weight
        homes, home = np.unique(cells[np.searchsorted(owner, linked)], return_inverse=True)
        mutual = np.zeros((len(homes), len(self.ids)), bool)
        for k, (low, high) in enumerate(zip(np.searchsorted(self.seen_cell, homes), np.searchsorted(self.seen_cell, homes, "right"), strict=True)):
            mutual[k, self.seen_by[low:high]] = True
        self.extra += weight[linked] @ (hit & ~mutual[home])  # the other way round they do not meet
        n, before = len(self.ids), self.label
        while True:
            query = np.where(hit, self.label, n).min(1)
            new = np.minimum(self.label, np.where(hit, query[:, None], n).min(0))
            if (new == self.label).all():
                break
            low = np.full(n, n)
            np.minimum.at(low, self.label, new)
            self.label = low[self.label]
        roots = np.flatnonzero((before == np.arange(n)) & (self.label != before))
        joined = np.column_stack([self.ids[roots], self.ids[self.label[roots]], np.zeros(len(roots), np.int64)])
        return [np.column_stack([ids, self.ids[query], counts.astype(np.int64)]), joined]

    def rest(self) -> np.ndarray:
        """What the block's own vectors did not count themselves."""
        more = np.flatnonzero(self.extra)
        return np.column_stack([self.ids[more], self.ids[more], self.extra[more].astype(np.int64)])


def _matched(dim: int, cosine: float):
    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (u, v, n) of each block: u has n links there, and is connected with v."""
        current, parts, block = None, [], None
        for batch in batches:
            ids = np.stack([np.asarray(c) for c in batch.column("node").flatten()], 1)
            weight = np.asarray(batch.column("weight"))
            lists = batch.column("visits")
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
            cells = np.asarray(lists.flatten())
            out = []

            def part(a: int, b: int, ids=ids, weight=weight, ends=ends, cells=cells, batch=batch) -> tuple:
                owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                return ids[a:b], _units(batch.column("embedding").slice(a, b - a), dim), weight[a:b], (owner, cells[ends[a] : ends[b]])

            for (i, number, query), a, b in runs(batch, ("i", "block", "query")):
                if (i, number) != current:
                    out += [block.rest()] if block else []
                    current, parts, block = (i, number), [], None
                if not query:  # a block's own vectors come first
                    parts.append(part(a, b))
                    continue
                if block is None:
                    if not parts:
                        continue  # no vector fell into this block
                    shift = np.cumsum([0] + [len(p[0]) for p in parts])
                    owners = np.concatenate([p[3][0] + s for p, s in zip(parts, shift, strict=False)])
                    block = _Block(*(np.concatenate([p[k] for p in parts]) for k in range(3)), (owners, np.concatenate([p[3][1] for p in parts])))
                for low in range(a, b, MEETING):
                    out += block.meet(*part(low, min(b, low + MEETING)), cosine)
            if out:
                yield _rows(np.concatenate(out))
        if block:
            yield _rows(block.rest())

    return match


def _rows(x: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(x[:, k]) for k in range(5)]
    nodes = [pa.StructArray.from_arrays(columns[k : k + 2], fields=list(ROW)) for k in (0, 2)]
    return pa.RecordBatch.from_arrays([*nodes, columns[4]], schema=FOUND)


def classes(
    vectors: DataFrame, cosine: float = COSINE, target: float = TARGET_RECALL, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding)``.

    Vectors whose cosine is ``cosine`` or more are linked, if the traversal lets
    one of them find the other; codebooks and limit are fitted on at most about
    ``sample`` distinct vectors, or eight for each centroid up to ``MAX_SAMPLE``, chosen by hash.  Vectors that are null, zero or
    hold null or non-finite components have no links and are their own component;
    shorter vectors count as padded with zeros.  Equal rows link with each other.
    A component's id is its smallest vec_id, null ids set aside.
    """
    node = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))
    rows = vectors.select("vec_id", "embedding")
    rows = rows.withColumn("node", F.when(is_valid(F.col("embedding")), node))
    nodes = stored(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count("*").alias("weight")
        ),
        "vector-nodes",
    )
    n, dim = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = min(MAX_SAMPLE, max(sample, PER_CENTROID * centroids_for(n)))
    share = min(1_000_000, -(-sample * 1_000_000 // n))
    picked = nodes.where(F.pmod(F.xxhash64(F.lit("fit"), "node"), F.lit(1_000_000)) < share).orderBy("node").select("embedding").collect()
    chosen = pa.array([r[0] for r in picked] or [nodes.select("embedding").first()[0]], pa.list_(pa.float64()))
    index = fit_index(_units(chosen, dim), n, cosine, target)

    @F.arrow_udf("array<int>")
    def visits(column: pa.Array) -> pa.Array:
        return pa.array(index.visits(_units(column, dim)), pa.list_(pa.int32()))

    k = len(index.second)
    placed = stored(nodes.select("node", "embedding", "weight", visits("embedding").alias("visits")), "placed")
    placed = placed.withColumn("i", F.floor(F.element_at("visits", 1) / k).cast("int"))
    blocks = F.broadcast(  # one row per first centroid, of which there are MAX_SAMPLE / 4 at most
        placed.groupBy(F.col("i").alias("bi")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    )
    base = placed.join(blocks, F.col("i") == F.col("bi")).select(
        "i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("query"),
        "node", "embedding", "weight", "visits",
    )
    seen = F.array_distinct(F.transform("visits", lambda c: F.floor(c / k).cast("int")))
    queries = placed.drop("i").withColumn("i", F.explode(seen)).join(blocks, F.col("i") == F.col("bi"))
    here = F.filter("visits", lambda c: F.floor(c / k) == F.col("i"))  # and the home, which stays in front
    queries = queries.withColumn("visits", F.concat(F.slice("visits", 1, 1), here))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "i", "block", F.lit(True).alias("query"), "node", "embedding", "weight", "visits"
    )
    tasks = base.unionByName(queries).repartition("i", "block").sortWithinPartitions("i", "block", "query", "node")
    found = stored(tasks.mapInArrow(_matched(dim, cosine), f"u {NODE}, v {NODE}, n bigint"), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("u").alias("counted")).agg(F.sum("n").alias("others"))
    parts = components(found.select("u", "v")).withColumnsRenamed({"node": "part", "component": "root"})
    known = nodes.select("node", "first_id", "weight").join(parts, F.col("node") == F.col("part"), "left")
    known = known.join(counts, F.col("node") == F.col("counted"), "left").select(
        F.col("node").alias("known"), "first_id", F.coalesce("root", "node").alias("root"),
        (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    least = known.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("least_id"))
    known = known.join(stored(least, "least-ids"), F.col("root") == F.col("r"))
    known = stored(known, "known-vectors")
    out = rows.drop("embedding").join(known, F.col("node") == F.col("known"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("known").isNull(), F.col("vec_id")).otherwise(F.col("least_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
