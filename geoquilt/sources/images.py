"""Pairs of a color image (PNG) and a depth array (NPY), decoded where their bytes are."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "frame string, row long, col long, raw double, r double, g double, b double"


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG of 8 bits, gray or RGB, with or without alpha, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, head = 8, [], b""
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, color, interlaced = head[8], head[9], head[12]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("only 8-bit gray and RGB images without interlacing are read")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.uint8)
    for y in range(height):
        line, kind = lines[y, 1:].reshape(width, channels), lines[y, 0]
        if kind == 0:
            row = line
        elif kind == 1:
            row = np.cumsum(line, 0, dtype=np.uint8)
        elif kind == 2:
            row = line + above
        else:
            row = _paired(line.astype(int), above.astype(int), kind)
        out[y] = above = row
    return np.repeat(out[:, :, :1], 3, 2) if channels < 3 else out[:, :, :3]


def _paired(line: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """A line predicted from its left and upper neighbours, by their mean or the nearest of three."""
    row = np.zeros_like(line)
    left, corner = np.zeros(line.shape[1], int), np.zeros(line.shape[1], int)
    for x in range(len(line)):
        up = above[x]
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        row[x] = left = (line[x] + guess) % 256
        corner = up
    return row.astype(np.uint8)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for frame, color, depth in zip(*(batch.column(c) for c in ("frame", "color", "depth")), strict=True):
            raw = np.load(io.BytesIO(depth.as_py()), allow_pickle=False).astype(float)
            rgb = decode_png(color.as_py())
            if raw.shape != rgb.shape[:2]:
                raise ValueError(f"color and depth of frame {frame.as_py()} differ in size")
            row, col = np.indices(raw.shape).reshape(2, -1).astype(np.int64)
            raw = np.where(np.isfinite(raw), raw, 0.0)
            columns = [pa.array([frame.as_py()] * raw.size), row, col, raw.ravel(), *(rgb[:, :, k].ravel() / 255 for k in range(3))]
            names = ["frame", "row", "col", "raw", "r", "g", "b"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(frame, row, col, raw, r, g, b) of all pairs ``<frame>_rgb.png`` and ``<frame>_depth.npy`` of a folder; colors in [0, 1].

    A file without its partner is left out, values that are not finite are 0.  A
    task decodes one pair at a time.
    """
    listed = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    of = lambda end, what: listed.where(F.endswith(name, F.lit(end))).select(F.substring(name, F.lit(1), F.length(name) - len(end)).alias("frame"), F.col("content").alias(what))
    pairs = of("_rgb.png", "color").join(of("_depth.npy", "depth"), "frame")
    return pairs.mapInArrow(_decoded, PIXELS)
