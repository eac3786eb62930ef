"""Binary images and grey grids as sparse relations of cells (row, col).

Neighbourhoods are equality joins on shifted indices; no image is ever
materialised as an array, but for the strips of the distance transform.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.storage import stored

EIGHT = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0))
FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))


def shifted(cells: DataFrame, offsets: Iterable[tuple[int, int]]) -> DataFrame:
    """Every cell copied to each offset: (row, col) of the target, (dr, dc), and the source's other columns."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets])
    rest = [c for c in cells.columns if c not in ("row", "col")]
    out = cells.select("row", "col", *rest, F.inline(steps))
    return out.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "dr", "dc", *rest)


def square(r: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]


def dilate(cells: DataFrame, r: int = 1) -> DataFrame:
    """Cells within ``r`` rows and columns of a foreground cell; not clipped to an image."""
    return shifted(cells, square(r)).select("row", "col").distinct()


def erode(cells: DataFrame, r: int = 1) -> DataFrame:
    """Cells whose whole (2r+1)-square is foreground."""
    hits = shifted(cells, square(r)).groupBy("row", "col").count()
    return hits.where(F.col("count") == (2 * r + 1) ** 2).select("row", "col")


def opening(cells: DataFrame, r: int = 1) -> DataFrame:
    return dilate(erode(cells, r), r)


def closing(cells: DataFrame, r: int = 1) -> DataFrame:
    return erode(dilate(cells, r), r)


def dilate_ball(voxels: DataFrame, r: int = 1) -> DataFrame:
    """3-D dilation of (iz, iy, ix) by a ball of radius ``r``."""
    span = range(-r, r + 1)
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((a, b, c), ("dz", "dy", "dx"), strict=True)]) for a in span for b in span for c in span if a * a + b * b + c * c <= r * r])
    moved = voxels.select("iz", "iy", "ix", F.inline(steps))
    return moved.select(*[(F.col(f"i{c}") + F.col(f"d{c}")).alias(f"i{c}") for c in "zyx"]).distinct()


def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised weights of offsets -r..r with r = round(3 sigma)."""
    r = max(1, round(3 * sigma))
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian_blur(grid: DataFrame, sigma: float, rows: int, cols: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Separable blur of a dense grid (row, col, v) with its edge cells repeated.

    Each source cell is sent to the targets that read it; a target near the edge
    reads the edge cell for the offsets that fall outside.  Columns ``by`` keep
    several grids of that size apart.
    """
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    for axis, n in (("row", rows), ("col", cols)):
        weights = F.array(*[F.struct(F.lit(d - r).alias("d"), F.lit(w).alias("w")) for d, w in enumerate(kernel)])
        other = "col" if axis == "row" else "row"
        # a source at the edge also stands for the r cells beyond it
        at = F.col(axis)
        beyond = F.sequence(at - F.when(at == 0, r).otherwise(0), at + F.when(at == n - 1, r).otherwise(0))
        spread = grid.select(*by, other, "v", F.explode(beyond).alias("p")).select(*by, other, "v", "p", F.inline(weights))
        grid = (
            spread.select(*by, (F.col("p") + F.col("d")).alias(axis), other, (F.col("v") * F.col("w")).alias("v"))
            .where(F.col(axis).between(0, n - 1))
            .groupBy(*by, axis, other)
            .agg(F.sum("v").alias("v"))
        )
    return grid.select(*by, "row", "col", "v")


def otsu(values: DataFrame, bins: int = 256) -> DataFrame:
    """One row: the threshold between two classes of ``values(v)`` in [0, 1] with the largest variance between them.

    Empty bins take part; of equal splits the first is taken.
    """
    b = F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("b"))
    hist = every.join(counts, F.col("b") == F.col("bin"), "left").select("b", F.coalesce("n", F.lit(0)).alias("n"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # one row per bin
    whole = Window.partitionBy()
    s = hist.withColumns({
        "w": F.sum("n").over(upto), "m": F.sum(F.col("b") * F.col("n")).over(upto),
        "tw": F.sum("n").over(whole), "tm": F.sum(F.col("b") * F.col("n")).over(whole),
    })
    split = s.where((F.col("w") > 0) & (F.col("w") < F.col("tw")))
    gap = F.col("m") / F.col("w") - (F.col("tm") - F.col("m")) / (F.col("tw") - F.col("w"))
    between = split.withColumn("between", F.col("w").cast("double") * (F.col("tw") - F.col("w")) * gap * gap)
    return between.agg(((F.min_by("b", F.struct(-F.round("between", 6), "b")) + 1) / bins).alias("threshold"))


def contour(cells: DataFrame) -> DataFrame:
    """Foreground cells with a background cell among their four neighbours."""
    near = shifted(cells, FOUR).groupBy("row", "col").count()
    inner = near.where("count = 4").select("row", "col")
    return cells.select("row", "col").join(inner, ["row", "col"], "left_anti")


def contour_links(cells: DataFrame) -> DataFrame:
    """(row, col, row2, col2): contour cells that touch by a side or a corner, each pair once, from the first by row and column."""
    edge = stored(contour(cells), "contour")
    met = shifted(edge, ((0, 1), (1, -1), (1, 0), (1, 1))).join(edge, ["row", "col"], "left_semi")
    return met.select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), F.col("row").alias("row2"), F.col("col").alias("col2"))


def neighbours(cells: DataFrame) -> DataFrame:
    """Cells with p2..p9, their eight neighbours clockwise from above, as 0 or 1."""
    names = {(-1, 0): "p2", (-1, 1): "p3", (0, 1): "p4", (1, 1): "p5", (1, 0): "p6", (1, -1): "p7", (0, -1): "p8", (-1, -1): "p9"}
    seen = shifted(cells, EIGHT)  # a source at -offset of its target
    flags = [F.max(F.when((F.col("dr") == -r) & (F.col("dc") == -c), 1).otherwise(0)).alias(n) for (r, c), n in names.items()]
    own = seen.groupBy("row", "col").agg(*flags)
    joined = cells.select("row", "col").join(own, ["row", "col"], "left")
    return joined.select("row", "col", *[F.coalesce(n, F.lit(0)).alias(n) for n in names.values()])


def zhang_suen_pass(cells: DataFrame, second: bool) -> DataFrame:
    """The cells that one sub-pass of Zhang and Suen's thinning keeps."""
    p = [F.col(f"p{i}") for i in range(2, 10)]
    turns = sum((F.when((p[i] == 0) & (p[(i + 1) % 8] == 1), 1).otherwise(0) for i in range(1, 8)), F.when((p[0] == 0) & (p[1] == 1), 1).otherwise(0))
    total = sum(p[1:], p[0])
    p2, p4, p6, p8 = p[0], p[2], p[4], p[6]
    edge = (p2 * p4 * p8 == 0) & (p2 * p6 * p8 == 0) if second else (p2 * p4 * p6 == 0) & (p4 * p6 * p8 == 0)
    gone = (turns == 1) & total.between(2, 6) & edge
    return neighbours(cells).where(~gone).select("row", "col")


def thin(cells: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Skeleton: both sub-passes until nothing changes; every round is stored."""
    cells = stored(cells.select("row", "col"), "thin")
    n = cells.count()
    for _ in range(max_rounds):
        cells = stored(zhang_suen_pass(zhang_suen_pass(cells, False), True), "thin")
        if n == (n := cells.count()):
            return cells
    raise RuntimeError("thinning did not settle")


def skeleton_nodes(cells: DataFrame) -> DataFrame:
    """(row, col, degree) of cells whose number of foreground neighbours is not two."""
    total = sum((F.col(f"p{i}") for i in range(3, 10)), F.col("p2"))
    return neighbours(cells).select("row", "col", total.cast("long").alias("degree")).where("degree <> 2")


def lowest_parabolas(heights: np.ndarray, feet: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least of heights + (feet - x)^2 for every x of ``at``; feet and at ascend, all are whole numbers.

    The foot of the lowest parabola moves one way only, so the middle of a stretch of
    ``at`` bounds the feet of both halves: each level looks at every foot about once.
    """
    out = np.empty(len(at), dtype=np.int64)
    low, high = np.array([0]), np.array([len(at) - 1])  # open stretches of at, and the feet they may have
    left, right = np.array([0]), np.array([len(feet) - 1])
    while len(low):
        mid = (low + high) // 2
        sizes = right - left + 1
        starts = np.cumsum(sizes) - sizes
        foot = np.arange(sizes.sum()) - np.repeat(starts - left, sizes)
        gap = feet[foot] - np.repeat(at[mid], sizes)
        cost = heights[foot] + gap * gap
        out[mid] = np.minimum.reduceat(cost, starts)
        hits = np.flatnonzero(cost == np.repeat(out[mid], sizes))
        best = foot[hits[np.searchsorted(hits, starts)]]  # the first of equal ones
        low, high = np.concatenate([low, mid + 1]), np.concatenate([mid - 1, high])
        left, right = np.concatenate([left, best]), np.concatenate([best, right])
        some = low <= high
        low, high, left, right = low[some], high[some], left[some], right[some]
    return out


def distance_to(cells: DataFrame, targets: DataFrame, tile: int = 16) -> DataFrame:
    """(row, col, d2): squared distance to the nearest of ``targets``, null where there are none.

    Two passes over the box of rows with targets and columns with cells: each row
    measures the way to its nearest target for strips of ``tile`` columns, then
    each column takes the lowest of the parabolas that stand on its rows.  Work is
    the box's area times the logarithm of its height; a task holds one row, or a
    strip of the box.  A cell with a null index has a null distance.
    """
    cells = stored(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct(), "raster-cells")
    placed = cells.where("row IS NOT NULL AND col IS NOT NULL").withColumn("strip", F.floor(F.col("col") / tile))
    lines = targets.where("row IS NOT NULL AND col IS NOT NULL").groupBy(F.col("row").cast("long").alias("line")).agg(F.array_sort(F.collect_set(F.col("col").cast("long"))).alias("cols"))
    first, last = placed.agg(F.min("strip"), F.max("strip")).first()
    if first is None:
        return cells.select("row", "col", F.lit(None).cast("long").alias("d2"))

    def across(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.arange(first * tile, (last + 1) * tile)
        for part in parts:
            for line, cols in zip(part["line"], part["cols"], strict=True):
                cols = np.asarray(cols, dtype=np.int64)
                k = np.searchsorted(cols, at)
                gap = np.minimum(np.abs(cols[np.minimum(k, len(cols) - 1)] - at), np.abs(at - cols[np.maximum(k - 1, 0)]))
                yield pd.DataFrame({"strip": np.arange(first, last + 1), "line": line, "gaps": list(gap.reshape(-1, tile))})

    def down(key: tuple, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"row": [], "col": [], "d2": []}).astype("int64")
        own = own.sort_values(["col", "row"])[["row", "col"]].reset_index(drop=True)
        if not len(rows):
            return own.assign(d2=pd.Series(pd.NA, index=own.index, dtype="Int64"))
        rows = rows.sort_values("line")
        feet, gaps = rows["line"].to_numpy(), np.stack(rows["gaps"].to_list()).astype(np.int64)
        found = [lowest_parabolas(gaps[:, c - key[0] * tile] ** 2, feet, part["row"].to_numpy()) for c, part in own.groupby("col")]
        return own.assign(d2=np.concatenate(found))

    strips = lines.mapInPandas(across, "strip long, line long, gaps array<long>").join(placed.select("strip").distinct(), "strip", "left_semi")
    found = placed.groupBy("strip").cogroup(strips.groupBy("strip")).applyInPandas(down, "row long, col long, d2 long")
    return found.unionByName(cells.where("row IS NULL OR col IS NULL").withColumn("d2", F.lit(None).cast("long")))


def ridge_skeleton(cells: DataFrame) -> DataFrame:
    """Cells off the contour whose distance to it is no less than any neighbour's; distances are exact."""
    d = stored(distance_to(cells, contour(cells)), "ridge-distances")
    most = shifted(d, EIGHT).groupBy("row", "col").agg(F.max("d2").alias("most"))
    return d.join(most, ["row", "col"], "left").where((F.col("d2") > 0) & (F.col("d2") >= F.coalesce("most", F.lit(0)))).select("row", "col", F.col("d2").cast("long").alias("d2"))


def project_points(points: DataFrame, size: float, u: Column, v: Column) -> DataFrame:
    """Distinct pixels (row, col) of points on a plane with coordinates u and v, from the least on."""
    box = points.agg(F.min(u).alias("u0"), F.min(v).alias("v0"))
    placed = points.select(u.alias("u"), v.alias("v")).join(F.broadcast(box))  # one row
    return placed.select(F.floor((F.col("v") - F.col("v0")) / size).alias("row"), F.floor((F.col("u") - F.col("u0")) / size).alias("col")).distinct()


def splat(points: DataFrame, size: float, sigma: float) -> DataFrame:
    """(row, col, v): sum of Gaussians of (u, v) points over the cells within three sigma, largest 1."""
    r = max(1, math.ceil(3 * sigma))
    home = points.select(F.floor(F.col("v") / size).alias("row"), F.floor(F.col("u") / size).alias("col"), (F.col("u") / size).alias("pu"), (F.col("v") / size).alias("pv"))
    near = shifted(home, square(r))
    du, dv = F.col("col") + 0.5 - F.col("pu"), F.col("row") + 0.5 - F.col("pv")
    grid = near.groupBy("row", "col").agg(F.sum(F.exp(-(du * du + dv * dv) / (2 * sigma * sigma))).alias("v"))
    top = grid.agg(F.max("v").alias("top"))
    return grid.join(F.broadcast(top)).select("row", "col", (F.col("v") / F.col("top")).alias("v"))  # one row


def thresholded(grid: DataFrame, bins: int = 256) -> DataFrame:
    """Foreground cells of a grid with values in [0, 1]: those at least at Otsu's threshold."""
    return grid.join(F.broadcast(otsu(grid, bins))).where(F.col("v") >= F.col("threshold")).select("row", "col")  # one row
