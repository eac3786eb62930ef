"""What lies around every point, told in one task: no pair of points is exchanged or stored.

Probes are dealt into boxes of a bounded number of rows, crowded cells into halves of
halves.  A box gets copies of those points that its rows can reach, so what is exchanged
grows with boxes times their surroundings and not with the pairs.  Pairs arise inside the
task, a slice at a time, and leave it folded to a row a probe; where the pairs themselves
are wanted, Spark's join streams them, or tasks put them out in tiles, sorted so that files
of them are small.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquilt.functions.linalg import squared_distance
from geoquilt.operators.spatial import XYZ
from geoquilt.storage import discard, stored

MOST, SLICE, SLACK = 512, 1 << 20, 1 + 1e-9
#: Probes of a box whose pairs are put out, pairs that are sorted together, and those handed out at once.
WIDE, TILE, ROWS = 4096, 1 << 22, 1 << 16
_CELL, _SUB = tuple(f"c{c}" for c in XYZ), tuple(f"s{c}" for c in XYZ)
Columns = dict[str, np.ndarray]


@dataclass
class Dealt:
    """Probes (task, i, x, y, z, ...) and the boxes of their tasks."""

    homes: DataFrame
    boxes: DataFrame
    radius: float

    def near(self, points: DataFrame) -> DataFrame:
        """(task, ...): copies of ``points(x, y, z, ...)`` for every task that has one of its probes within the radius, and some more."""
        r = self.radius * SLACK
        around = self.boxes
        for c in XYZ:
            first, last = (F.floor(v / self.radius).cast("long") for v in (F.col(f"low_{c}") - r, F.col(f"high_{c}") + r))
            around = around.withColumn(f"g{c}", F.explode(F.sequence(first, last)))
        held = points.withColumns({f"h{c}": F.floor(F.col(c) / self.radius).cast("long") for c in XYZ})
        apart = F.lit(0.0)
        for c in XYZ:
            gap = F.greatest(F.col(f"low_{c}") - F.col(c), F.col(c) - F.col(f"high_{c}"), F.lit(0.0))
            apart = apart + gap * gap
        same = [F.col(f"g{c}") == F.col(f"h{c}") for c in XYZ]
        return around.join(held.hint("merge"), same).where(apart <= r * r).select("task", *points.columns)

    def fold(self, points: DataFrame, f: Callable[[Columns, Columns, np.ndarray, np.ndarray], Columns], schema: str) -> DataFrame:
        """Rows of ``schema`` that ``f(probes, points, d, within)`` makes of some probes and all points that they reach.

        ``d`` and ``within`` have a row for every probe and a column for every point.
        """
        radius = self.radius

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = _arrays(left), _arrays(right)
            step = max(1, SLICE // max(1, len(b["x"])))
            made = []
            for start in range(0, len(a["x"]), step):
                some = {k: v[start : start + step] for k, v in a.items()}
                d = _distances(some, b)
                made.append(pa.table(f(some, b, d, d <= radius)))
            return pa.concat_tables(made)

        return self.homes.groupBy("task").cogroup(self.near(points).groupBy("task")).applyInArrow(run, schema)

    def pairs(self, points: DataFrame) -> DataFrame:
        """Every probe's columns with those of each of the ``points(px, py, pz, ...)`` within the radius, and their distance d; nothing is exchanged after the join."""
        placed = points.withColumns({c: F.col(f"p{c}") for c in XYZ})
        near = self.near(placed).drop(*XYZ).withColumnRenamed("task", "near_task")
        apart = squared_distance([F.col(c) for c in XYZ], [F.col(f"p{c}") for c in XYZ])
        joined = self.homes.join(near.hint("merge"), F.col("task") == F.col("near_task")).withColumn("d", F.sqrt(apart))
        return joined.where(F.col("d") <= self.radius).drop("task", "near_task")

    def tiled(self, points: DataFrame, ids: np.ufunc | None = None, own: str | None = None) -> DataFrame:
        """(i, j, d) of the probes and all ``points(j, x, y, z)`` within the radius, or within what the column ``own`` has for a probe.

        Only pairs with ``ids(i, j)`` come, such as ``np.less``.  Rows come in tiles of about ``TILE`` that are sorted by d:
        equal distances are runs then and ids few, which a file keeps as a dictionary.
        A task holds the probes of one box and a tile.
        """
        reach = F.col(own) if own else F.lit(float(self.radius))
        left = self.homes.select("task", "i", *XYZ, reach.alias("reach"))
        if ids is not None:  # a null id is neither less than another nor other
            left, points = left.where("i IS NOT NULL"), points.where("j IS NOT NULL")
        both = left.unionByName(self.near(points.select("j", *XYZ)).withColumn("held", F.lit(True)), allowMissingColumns=True)
        both = both.withColumn("held", F.coalesce("held", F.lit(False))).repartition("task").sortWithinPartitions("task", "held")

        def tile(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
            a, b = _arrays(left.drop_columns(["j"])), _arrays(right.drop_columns(["i"]))
            i, j = left["i"].combine_chunks(), right["j"].combine_chunks()
            step = max(1, SLICE // len(b["x"]))
            for start in range(0, len(a["x"]), step):
                some = {k: v[start : start + step] for k, v in a.items()}
                d = _distances(some, b)
                within = d <= some["reach"][:, None]
                if ids is not None:
                    within &= ids(some["i"][:, None], b["j"][None, :])
                row, column = np.nonzero(within)
                yield pa.table({"i": i.take(pa.array(row + start)), "j": j.take(pa.array(column)), "d": d[row, column]})

        def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
            at, home = None, []
            for batch in batches:
                task, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "held"))
                ends = [0, *(np.flatnonzero((np.diff(task) != 0) | (held[1:] != held[:-1])) + 1), len(task)]
                for start, stop in zip(ends, ends[1:], strict=False):
                    if start == stop:
                        continue
                    if task[start] != at:
                        at, home = task[start], []
                    piece = pa.Table.from_batches([batch.slice(start, stop - start)])
                    if not held[start]:
                        home.append(piece)
                    elif home:
                        yield from tile(pa.concat_tables(home), piece)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some, n = [], 0
            for t in itertools.chain(tiles(batches), [None]):
                if t is not None:
                    some.append(t)
                    n += len(t)
                if some and (t is None or n >= TILE):
                    rows, some, n = pa.concat_tables(some).combine_chunks(), [], 0
                    yield from rows.take(pa.array(np.argsort(rows["d"].to_numpy()))).to_batches(ROWS)

        kind = {f.name: f.dataType.simpleString() for f in both.schema.fields}
        return both.mapInArrow(run, f"i {kind['i']}, j {kind['j']}, d double")


def _distances(a: Columns, b: Columns) -> np.ndarray:
    """A row for every row of ``a(x, y, z)``, a column for every row of ``b``."""
    d = np.zeros((len(a["x"]), len(b["x"])))
    for c in XYZ:
        gap = a[c][:, None] - b[c][None, :]
        gap *= gap
        d += gap
    return np.sqrt(d, out=d)


def dealt(probe: DataFrame, radius: float, most: int = MOST) -> Dealt:
    """``probe(i, x, y, z, ...)`` in boxes of about ``most`` rows, each inside a cell as wide as the radius.

    Rows with a null coordinate are left out.  Boxes of repeated points, which no halving parts, are parted by id.
    """
    cell = {k: F.floor(F.col(c) / radius).cast("long") for k, c in zip(_CELL, XYZ, strict=True)}
    rows = probe.where(" AND ".join(f"{c} IS NOT NULL" for c in XYZ)).withColumns(cell)
    halvings = F.least(F.greatest(F.ceil(F.log(F.count("*") / most) / F.log(F.lit(8.0))), F.lit(0)), F.lit(8)).cast("int")
    levels = rows.groupBy(*_CELL).agg(halvings.alias("level"))
    sub = {k: F.floor(F.col(c) / (radius / F.pow(F.lit(2.0), F.col("level")))).cast("long") for k, c in zip(_SUB, XYZ, strict=True)}
    rows = rows.join(levels, list(_CELL)).withColumns(sub).drop("level")
    parts = rows.groupBy(*_CELL, *_SUB).agg(F.ceil(F.count("*") / (2 * most)).alias("parts"))
    rows = rows.join(parts, [*_CELL, *_SUB]).withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts"))).drop("parts")
    rows = stored(rows, "placed")
    key = [*_CELL, *_SUB, "part"]
    ends = [v for c in XYZ for v in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))]
    boxes = stored(rows.groupBy(*key).agg(*ends).withColumn("task", F.monotonically_increasing_id()), "boxes")
    homes = stored(rows.join(boxes.select(*key, "task"), key).select("task", *probe.columns), "homes")
    discard(rows)
    return Dealt(homes, boxes.drop(*key), radius)


def near_pairs(points: DataFrame, radius: float, ids: np.ufunc = np.less) -> DataFrame:
    """Pairs (u, v, w) of ``points(pid, x, y, z)`` with ``ids(u, v)``, u < v if nothing else is said, and distance w up to ``radius``.

    The rows of ``spatial.radius_pairs`` as a result: no cell is one task, and files of them are small.
    """
    met = dealt(points.select(F.col("pid").alias("i"), *XYZ), radius, WIDE).tiled(points.withColumnRenamed("pid", "j"), ids)
    return met.toDF("u", "v", "w")


def near_pairs_own(probe: DataFrame, points: DataFrame, ids: np.ufunc | None = None) -> DataFrame:
    """(i, j, d) of all ``points(j, x, y, z)`` within the radius that each ``probe(i, x, y, z, radius)`` has of its own.

    The rows of ``spatial.radius_join_own`` as a result.  Probes are told apart by powers of four of the
    greatest radius; one with a null, negative or infinite radius meets nothing.
    """
    probe = probe.where((F.col("radius") >= 0) & (F.col("radius") < float("inf"))).select("i", *XYZ, "radius")
    most = probe.agg(F.max("radius")).first()[0] or 0.0
    if not most:
        return dealt(probe, 1.0, WIDE).tiled(points, ids, "radius")
    step = F.when(F.col("radius") > 0, F.least(F.floor(F.log2(F.lit(most) / F.col("radius")) / 2), F.lit(12))).otherwise(12)
    sizes = probe.groupBy(step.alias("step")).agg(F.max("radius").alias("size")).orderBy("step").collect()  # 13 at most
    met = [dealt(probe.where(step == r["step"]), max(r["size"], most / 4**13), WIDE).tiled(points, ids, "radius") for r in sizes]
    return reduce(DataFrame.unionByName, met)


def counts(points: DataFrame, radius: float) -> DataFrame:
    """(pid, n): how many ``points(pid, x, y, z)`` lie within ``radius`` of each, itself included."""
    places = points.select(F.col("pid").alias("i"), *XYZ)
    return dealt(places, radius).fold(places.select(*XYZ), lambda a, b, d, within: {"pid": a["i"], "n": within.sum(axis=1)}, "pid long, n long")


def listed(rows: np.ndarray) -> pa.Array:
    """A matrix as an array of lists."""
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def _arrays(table: pa.Table) -> Columns:
    """Columns as numpy arrays, lists of one length as matrices."""
    out = {}
    for name in table.column_names:
        column = table.column(name).combine_chunks()
        if pa.types.is_list(column.type):
            out[name] = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 1)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out
