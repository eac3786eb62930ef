"""Feature matching for global registration: exact nearest features, mutual matches, triples of equal shape.

Nearest features are found by the triangle inequality.  Points are dealt to the
nearest of a bounded number of pivots and to rings around it; a probe knows its
distance to every pivot, so it knows which rings can hold anything nearer than
what it has.  Only those are compared, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.functions.linalg import squared_distance
from geoquilt.operators import registration
from geoquilt.operators.spatial import XYZ
from geoquilt.storage import discard, stored

#: Numbers of one matrix that a task holds at a time.
_SLICE = 1 << 21


def _stacked(part: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in part]) if len(part) else np.zeros((0, 0))


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, from differences, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _to_pivots(feature: Column, pivots: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(_gaps(_stacked(part), pivots)) if len(part) else [])

    return measure(feature)


def _promising(away: Column, reach: Column, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> Column:
    """Positions of the rings that can hold a point within ``reach``, with room for rounding."""

    @F.pandas_udf("array<int>")
    def choose(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, r in parts:
            d, r = (_stacked(d), r.to_numpy()[:, None] * (1 + 1e-9) + 1e-12) if len(d) else (np.zeros((0, 1)), r)
            found, step = [], max(1, _SLICE // max(1, len(cell)))
            for k in range(0, len(d), step):
                at, reach = d[k : k + step, cell], r[k : k + step]
                found += [np.flatnonzero(hit).astype(np.int32) for hit in (at - reach <= high) & (at + reach >= low)]
            yield pd.Series(found, dtype=object)

    return choose(away, reach)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    flat = pc.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and position of the nearest row of b for every row of a, of equal ones the first.

    Products of the two say which rows can be nearest, up to their rounding; only the
    differences of those are taken.  A slice of a few million products is held at a time.
    """
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    slack = 64 * np.finfo(float).eps * (a.shape[1] + 4) * (aa + bb.max())
    best, at = np.full(len(a), np.inf), np.zeros(len(a), np.int64)
    step = max(1, _SLICE // len(b))
    for start in range(0, len(a), step):
        some = slice(start, start + step)
        square = a[some] @ b.T
        square *= -2
        square += bb
        rows, columns = np.nonzero(square <= (np.fmin.reduce(square, axis=1) + slack[some])[:, None])
        for k in range(0, len(rows), _SLICE // 64):
            r, c = rows[k : k + _SLICE // 64] + start, columns[k : k + _SLICE // 64]
            gap = a[r] - b[c]
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            order = np.lexsort((c, d, r))
            first = order[np.unique(r[order], return_index=True)[1]]
            first = first[d[first] < best[r[first]]]  # positions go up from piece to piece
            best[r[first]], at[r[first]] = d[first], c[first]
    return best, at


def _compared(probes: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(i, d, j) of the nearest point of each block, ties by j, for the probes dealt to it."""

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"i": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "j": pa.array([], pa.int64())})
        right = right.sort_by("j")
        d, at = _nearest(_matrix(left["feature"]), _matrix(right["feature"]))
        return pa.table({"i": left["i"], "d": d, "j": right["j"].take(pa.array(at))})

    return probes.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(nearest, "i long, d double, j long")


def nearest_features(probes: DataFrame, points: DataFrame, pivots: int = 64, rings: int = 64, block: int = 8192) -> DataFrame:
    """(i, j, d): the nearest of ``points(pid, feature)`` of every one of ``probes(pid, feature)``; ties go by the least id.

    Exact.  Pivots are ``pivots`` points chosen by a hash, a bound that does not
    grow.  Equal features are one row, given back to their ids at the end, so
    copies cost nothing.  A first look into the ring where a probe itself would
    stand gives a bound, the second looks into all rings that the bound leaves.
    Neighbouring rings of a pivot are joined up to ``block`` points, a
    ring with more is split by hash into parts of about as many, and a
    ring with many probes sees its parts copied to chunks of as many, so a task
    holds two blocks and what is exchanged grows as probes times blocks.  Ring counts are at most pivots x (rings + 1) rows on the
    driver.  Null features match nothing; without points the result is empty.
    """
    single = all(df.schema["feature"].dataType.simpleString() == "array<float>" for df in (probes, points))
    as_numbers = F.col("feature").cast("array<float>" if single else "array<double>").alias("feature")  # told apart in doubles either way
    alike = lambda df, name: df.where(F.col("feature").isNotNull()).select("pid", as_numbers).groupBy("feature").agg(F.min("pid").alias(name))
    held = stored(alike(points, "j"), "features")
    asked = stored(alike(probes, "i"), "asked")
    first = held.orderBy(F.xxhash64("j"), "j").limit(pivots).select("feature").collect()
    if not first:
        return asked.select("i", F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("d")).limit(0)
    centres = np.array([r[0] for r in first], dtype=np.float64)
    away = held.withColumn("away", _to_pivots(F.col("feature"), centres))
    near = F.array_min("away")
    home = stored(away.select("j", "feature", (F.array_position("away", near) - 1).cast("int").alias("cell"), near.alias("near")), "homes")
    width = (home.agg(F.max("near")).first()[0] or 0.0) / rings or 1.0
    ring = F.floor(F.col("near") / width).cast("int")
    counts = home.groupBy("cell", ring.alias("ring")).agg(F.count("*").alias("n"), F.min("near").alias("low"), F.max("near").alias("high")).orderBy("cell", "ring").collect()
    cell, low, high = (np.array([r[c] for r in counts]) for c in ("cell", "low", "high"))
    spark = points.sparkSession
    starts, held_by = [], 0
    for k, r in enumerate(counts):
        held_by += r["n"]
        if not k or r["cell"] != counts[k - 1]["cell"] or held_by > block:
            starts.append(k)
            held_by = r["n"]
    cell, low, high = cell[starts], np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    group = np.searchsorted(starts, np.arange(len(counts)), side="right") - 1
    parts = -(-np.add.reduceat([r["n"] for r in counts], starts) // block)
    rows = [(r["cell"], r["ring"], int(g), int(parts[g])) for r, g in zip(counts, group, strict=True)]
    groups = F.broadcast(spark.createDataFrame(rows, "g_cell int, g_ring int, g int, parts long"))  # at most pivots x (rings + 1) rows
    dealt = home.withColumn("ring", ring).join(groups, (F.col("cell") == F.col("g_cell")) & (F.col("ring") == F.col("g_ring")))
    dealt = stored(dealt.select("j", "feature", "g", F.pmod(F.xxhash64("j"), "parts").cast("int").alias("part")), "blocks")
    sizes = F.broadcast(spark.createDataFrame(list(enumerate(parts.tolist())), "s int, parts long"))

    def look(wanted: DataFrame, every: bool) -> DataFrame:
        """The least of what ``wanted(i, feature, g)`` sees in the rings g, or in one part of them."""
        load = wanted.groupBy("g").agg(F.count("*").alias("n")).select(F.col("g").alias("l"), F.ceil(F.col("n") / block).cast("long").alias("chunks"))
        load = F.broadcast(stored(load, "ring-load"))  # one row a ring
        chunk = F.pmod(F.xxhash64("i", F.lit(7)), "chunks").cast("int")
        whole = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
        one = F.pmod(F.xxhash64("i"), "parts").cast("int")
        sent = wanted.join(sizes, F.col("g") == F.col("s")).join(load, F.col("g") == F.col("l")).select("i", "feature", "g", chunk.alias("chunk"), (whole if every else one).alias("part"))
        copied = dealt.join(load, F.col("g") == F.col("l")).select("j", "feature", "g", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("chunk"), "part")
        seen = _compared(sent, copied, ["g", "part", "chunk"])
        return seen.groupBy("i").agg(F.min(F.struct("d", "j")).alias("b"))

    measured = stored(asked.withColumn("away", _to_pivots(F.col("feature"), centres)), "measured")
    start = _closest_ring(F.col("away"), cell, low, high)
    bound = stored(look(measured.select("i", "feature", start.alias("g")), False).select(F.col("i").alias("bi"), "b.d"), "bounds")
    # parts may be empty of points: then the way over a pivot, which is a point itself, is the bound
    known = measured.join(bound, F.col("i") == F.col("bi"), "left").withColumn("reach", F.least(F.col("d"), F.array_min("away")))
    wanted = stored(known.select("i", "feature", _promising(F.col("away"), F.col("reach"), cell, low, high).alias("rings")), "wanted")
    best = stored(look(wanted.select("i", "feature", F.explode("rings").alias("g")), True).select(F.col("i").alias("rep"), "b.j", "b.d"), "nearest-features")
    discard(home, dealt, bound, measured, wanted)
    own = probes.where(F.col("feature").isNotNull()).select(F.col("pid").alias("i"), as_numbers)
    same = asked.select(F.col("i").alias("r"), F.col("feature").alias("f"))
    return own.join(same, F.col("feature") == F.col("f")).join(best, F.col("r") == F.col("rep")).select("i", "j", "d")


def _closest_ring(away: Column, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> Column:
    """Position of a ring in which, or next to which, a probe stands, around a pivot as near as can be."""

    @F.pandas_udf("int")
    def choose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            if len(part):
                at = _stacked(part)[:, cell]
                off = np.maximum(np.maximum(low - at, at - high), 0)
                off = off + at * 1e-3  # of rings that a probe could stand in, that of the nearest pivot
                yield pd.Series(off.argmin(axis=1).astype(np.int32))
            else:
                yield pd.Series([], dtype=np.int32)

    return choose(away)


def mutual_matches(source: DataFrame, target: DataFrame, **sizes: int) -> DataFrame:
    """(i, j, d): rows of ``source(pid, feature)`` and ``target`` that are each other's nearest; of equal features the least ids."""
    there = stored(nearest_features(source, target, **sizes), "there")
    met = there.select(F.col("j").alias("met")).distinct()  # only these can be somebody's mutual match
    back = nearest_features(target.join(met, F.col("pid") == F.col("met"), "left_semi"), source, **sizes).select(F.col("i").alias("bj"), F.col("j").alias("bi"))
    return there.join(back, (F.col("i") == F.col("bi")) & (F.col("j") == F.col("bj"))).select("i", "j", "d")


def alike_triples(matches: DataFrame, tolerance: float = 0.9, rounds: int = 8) -> DataFrame:
    """The rows of ``matches(i, j, p*, q*)`` that stand in a triple whose three sides are alike on both ends.

    In every round the matches are dealt by hash into groups of about eight, and
    each three that follow each other in a group are a triple; the shorter of two
    sides must be more than ``tolerance`` times the longer.
    """
    matches = stored(matches, "matched")
    groups = max(1, matches.count() // 8)
    turns = matches.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("h", F.xxhash64("i", "j", "turn"))
    w = Window.partitionBy("turn", F.pmod("h", F.lit(groups))).orderBy("h", "i", "j")  # about eight rows
    ends = F.struct(*[f"{k}{c}" for k in "pq" for c in XYZ])
    side = lambda a, b, k: F.sqrt(squared_distance([a[f"{k}{c}"] for c in XYZ], [b[f"{k}{c}"] for c in XYZ]))
    rows = turns.withColumns({"e0": ends, "e1": F.lag(ends, 1).over(w), "e2": F.lag(ends, 2).over(w)})
    passed = F.lit(True)
    for a, b in (("e0", "e1"), ("e1", "e2"), ("e0", "e2")):
        p, q = side(F.col(a), F.col(b), "p"), side(F.col(a), F.col(b), "q")
        passed = passed & (F.least(p, q) > tolerance * F.greatest(p, q))
    rows = rows.withColumn("passed", F.coalesce(F.col("e2").isNotNull() & passed, F.lit(False)))
    part = F.col("passed") | F.coalesce(F.lead("passed", 1).over(w), F.lit(False)) | F.coalesce(F.lead("passed", 2).over(w), F.lit(False))
    kept = rows.withColumn("part", part).where("part").select(F.col("i").alias("ki"), F.col("j").alias("kj")).distinct()
    return matches.join(kept, (F.col("i") == F.col("ki")) & (F.col("j") == F.col("kj")), "left_semi")


def register(source: DataFrame, target: DataFrame, radius: float, scale: float, rounds: int = 64, **sizes: int) -> np.ndarray:
    """4 x 4 transform of ``source(pid, x, y, z, nx, ny, nz)`` onto ``target`` without given matches.

    Pair features of ``radius``, mutual nearest ones, triples of equal shape, then
    graduated reweighting from ``scale`` on.  With fewer than three matches left the source stays.
    """
    features = lambda p: stored(registration.feature_histograms(p, radius).withColumnRenamed("fpfh", "feature"), "point-features")
    found = mutual_matches(features(source), features(target), **sizes)
    at = lambda p, k, n: p.select(F.col("pid").alias(n), *[F.col(c).alias(f"{k}{c}") for c in XYZ])
    pairs = found.join(at(source, "p", "a"), F.col("i") == F.col("a")).join(at(target, "q", "b"), F.col("j") == F.col("b"))
    kept = stored(alike_triples(pairs.select("i", "j", *[f"{k}{c}" for k in "pq" for c in XYZ])), "triples")
    return registration.global_registration(kept, scale, rounds) if kept.count() >= 3 else np.eye(4)
