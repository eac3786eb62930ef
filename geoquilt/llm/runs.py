"""Stretches of equal keys in sorted Arrow batches."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa


def runs(batch: pa.RecordBatch, keys: tuple[str, ...]) -> list[tuple[tuple, int, int]]:
    """(key, from, to) of the stretches of equal keys in a batch; struct keys count by their fields."""
    columns = [np.asarray(c) for k in keys for c in (batch.column(k).flatten() if pa.types.is_struct(batch.column(k).type) else [batch.column(k)])]
    change = np.zeros(batch.num_rows, bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    return [(tuple(int(c[a]) for c in columns), a, b) for a, b in itertools.pairwise(cuts) if a < b]
