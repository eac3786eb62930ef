"""Parts and holes of binary rasters by their horizontal runs.

A raster of ``cells(row, col)`` becomes runs, one row each for a stretch of neighbouring
cells, and so does what lies between them.  Runs of neighbouring rows that overlap are
found in one sweep over their starts: of two overlapping runs one begins within the
other, so looking back from every start to the last run of the other row finds each pair
once.  Components of runs then are parts, and components of the runs between that do not
reach the border are holes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoquilt.operators import graphs, raster
from geoquilt.storage import stored


def runs_of(cells: DataFrame) -> DataFrame:
    """(row, a, b): maximal runs of cells of a row, from column a to b."""
    place = F.col("col") - F.row_number().over(Window.partitionBy("row").orderBy("col"))
    return cells.select("row", "col").distinct().withColumn("k", place).groupBy("row", "k").agg(F.min("col").alias("a"), F.max("col").alias("b")).select("row", "a", "b")


def overlapping(runs: DataFrame, reach: int = 0) -> DataFrame:
    """(u, v): ids of runs (id, row, a, b) of neighbouring rows that share a column, or with a ``reach`` of 1 touch at a corner."""
    run = F.struct("id", "b")
    upper = runs.select(F.col("row").alias("pair"), F.col("a"), F.lit(0).alias("side"), run.alias("run"))
    lower = runs.select((F.col("row") - 1).alias("pair"), F.col("a"), F.lit(1).alias("side"), run.alias("run"))
    order = Window.partitionBy("pair").orderBy("a", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda side: F.last(F.when(F.col("side") == side, F.col("run")), ignorenulls=True).over(order)
    seen = upper.unionByName(lower).withColumn("other", F.when(F.col("side") == 0, last(1)).otherwise(last(0)))
    return seen.where(F.col("other.b") + reach >= F.col("a")).select(F.col("run.id").alias("u"), F.col("other.id").alias("v"))


def _spread(runs: DataFrame) -> DataFrame:
    return runs.select("row", F.explode(F.sequence("a", "b")).alias("col"))


def largest_part(cells: DataFrame) -> DataFrame:
    """The cells of the part, joined by sides and corners, that has most of them; of equal ones that with the first cell."""
    box = cells.agg(F.min("row").alias("r"), F.min("col").alias("c")).first()
    if box["r"] is None:
        return cells.select("row", "col")
    run_id = F.shiftleft((F.col("row") - box["r"]).cast("long"), 32) + (F.col("a") - box["c"])
    runs = stored(runs_of(cells).select(run_id.alias("id"), "row", "a", "b"), "runs")
    parts = stored(graphs.label_components(runs.select(F.col("id").alias("vid")), overlapping(runs, 1)), "run-parts")
    sized = runs.join(parts, F.col("id") == F.col("vid")).select("row", "a", "b", "component")
    top = sized.groupBy("component").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n")).orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("top"))
    return _spread(sized.join(F.broadcast(top), F.col("component") == F.col("top")))  # one row


def fill_holes(cells: DataFrame) -> DataFrame:
    """``cells(row, col)`` and all cells that no way along sides leads from the outside to; without cells there are none."""
    box = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if box["r0"] is None:
        return cells.select("row", "col")
    r0, r1, c0, c1 = (int(box[k]) for k in ("r0", "r1", "c0", "c1"))
    runs = stored(runs_of(cells), "runs")
    by_row = Window.partitionBy("row").orderBy("a")
    between = runs.select("row", (F.coalesce(F.lag("b").over(by_row), F.lit(c0 - 2)) + 1).alias("from"), (F.col("a") - 1).alias("to"))
    behind = runs.groupBy("row").agg((F.max("b") + 1).alias("from")).withColumn("to", F.lit(c1 + 1).cast("long"))
    rows = cells.sparkSession.range(r0 - 1, r1 + 2).select(F.col("id").alias("row"))
    free = rows.join(runs.select("row").distinct(), "row", "left_anti").select("row", F.lit(c0 - 1).cast("long").alias("from"), F.lit(c1 + 1).cast("long").alias("to"))
    gaps = between.unionByName(behind).unionByName(free).where(F.col("from") <= F.col("to"))
    gap_id = F.shiftleft((F.col("row") - (r0 - 1)).cast("long"), 32) + (F.col("from") - (c0 - 1))
    gaps = stored(gaps.select(gap_id.alias("id"), "row", F.col("from").alias("a"), F.col("to").alias("b")), "gaps")
    parts = graphs.label_components(gaps.select(F.col("id").alias("vid")), overlapping(gaps))
    # the row above the first is free and begins with the least id, which names the outside
    holes = gaps.join(parts.where("component <> 0"), F.col("id") == F.col("vid"), "left_semi")
    return cells.select("row", "col").distinct().unionByName(_spread(holes))


def part_contour(cells: DataFrame) -> DataFrame:
    """The boundary cells of the largest part with its holes filled."""
    return raster.contour(stored(fill_holes(stored(largest_part(cells), "largest-part")), "filled-part"))
