"""Eigenvectors of batches of symmetric 3 x 3 matrices, in Arrow UDFs over numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _axes(m: pd.DataFrame) -> np.ndarray:
    """(n, 3, 3) eigenvectors in rows, by descending eigenvalue; the largest component of each is positive."""
    xx, yy, zz, xy, xz, yz = (m[c].fillna(0.0).to_numpy() for c in ("xx", "yy", "zz", "xy", "xz", "yz"))
    a = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
    _, v = np.linalg.eigh(a)
    v = v[:, :, ::-1].transpose(0, 2, 1)
    top = np.take_along_axis(v, np.abs(v).argmax(-1)[..., None], -1)
    return v * np.where(top < 0, -1.0, 1.0)


def principal_axes(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Nine numbers: the unit eigenvectors of a covariance, by descending eigenvalue, signs fixed."""

    @F.pandas_udf("array<double>")
    def axes(m: pd.DataFrame) -> pd.Series:
        return pd.Series(list(_axes(m).reshape(len(m), 9)))

    return axes(F.struct(*[c.alias(n) for c, n in zip((xx, yy, zz, xy, xz, yz), ("xx", "yy", "zz", "xy", "xz", "yz"), strict=True)]))
