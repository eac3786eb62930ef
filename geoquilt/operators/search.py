"""Parameter search: grids, objectives and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoquilt.sources.views import hash_uniform

#: Weights of the objective: second Wasserstein distance, smoothness of both skeletons, boundedness, centeredness.
WEIGHTS = (0.7, 0.30, 0.45, 0.15, 0.15)


def objective(m: Mapping[str, Column] | None = None, weights: Sequence[float] = WEIGHTS) -> Column:
    """Loss of a trial from its metrics; NaN distances count 1, NaN scores 0."""
    col = lambda name, default: F.nanvl(m[name] if m else F.col(name), F.lit(default))
    w2, em, ct, bound, center = weights
    mean = lambda a, b: (col(a, 0.0) + col(b, 0.0)) / 2
    return (
        col("bottleneck", 1.0) + w2 * col("w2", 1.0)
        + em * (1 - F.least(col("em_smooth", 0.0), F.lit(1.0))) + ct * (1 - F.least(col("ct_smooth", 0.0), F.lit(1.0)))
        + bound * (1 - mean("em_bounded", "ct_bounded")) + center * (1 - mean("em_centered", "ct_centered"))
    )


def random_sample(draws: DataFrame, key: str, space: Mapping[str, tuple[float, float, bool]]) -> DataFrame:
    """``draws`` with a value of every parameter of ``space``, name -> (low, high, whole), hashed from ``key``.

    Whole parameters take both bounds, others [low, high); equal keys draw equal values, a null key nulls.
    """
    values = {}
    for i, (name, (low, high, whole)) in enumerate(space.items()):
        u = hash_uniform(F.col(key), i + 1)
        values[name] = (low + F.floor(u * (high - low + 1))).cast("long") if whole else low + u * (high - low)
    return draws.withColumns(values)


def top_trials(trials: DataFrame, k: int) -> DataFrame:
    """The ``k`` trials of least loss; ties go by trial."""
    return trials.withColumn("loss", objective()).orderBy("loss", "trial").limit(k)


def moving_average(trials: DataFrame, by: str, window: int = 20) -> DataFrame:
    """(trial, loss, average): mean loss of the last ``window`` trials of a series."""
    order = Window.partitionBy(by).orderBy("trial").rowsBetween(1 - window, 0)
    scored = trials.withColumn("loss", objective())
    return scored.select(by, "trial", "loss", F.avg("loss").over(order).alias("average"))


def parameter_grid(spark: SparkSession, axes: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every combination of the axes' values, numbered in the order of nested loops.

    The number is taken apart by division, so the product is computed where it is
    read and never joined.
    """
    total = int(np.prod([len(v) for v in axes.values()]))
    out, rest = spark.range(total).select(F.col("id").alias("combo")), F.col("combo")
    for name, values in reversed(list(axes.items())):
        pick = F.element_at(F.array(*map(F.lit, values)), (rest % len(values) + 1).cast("int"))
        out, rest = out.withColumn(name, pick), F.floor(rest / len(values))
    return out.select("combo", *axes)


def encode(column: Column, low: float, high: float) -> Column:
    """A parameter scaled to [0, 1], clipped."""
    return F.least(F.greatest((column - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def decode(column: Column, low: float, high: float, is_int: bool) -> Column:
    """The parameter of a number in [0, 1]; whole ones are rounded, halves to even."""
    value = low + F.least(F.greatest(column, F.lit(0.0)), F.lit(1.0)) * (high - low)
    return F.bround(value) if is_int else value
