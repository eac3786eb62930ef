"""Text and JSON sources and sinks, read by Spark and parsed in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.operators.clouds import decode_text, encode_text
from geoquilt.storage import listed

POSE = "x double, y double, z double, rx double, ry double, rz double"
#: Fallbacks of camera intrinsics, field by field: width, height, focal lengths, principal point.
INTRINSICS = {"width": 1280.0, "height": 720.0, "fx": 920.0, "fy": 920.0, "ppx": 640.0, "ppy": 360.0}


def read_text_cloud(spark: SparkSession, path: str) -> DataFrame:
    """A (gzipped) text cloud of nine fields a line.

    pid ascends with the lines of a file as they are read; it is unique, but has gaps
    between the files and may differ where Spark deals the files otherwise.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    return decode_text(lines.select(F.monotonically_increasing_id().alias("pid"), "value"))


def write_text_cloud(points: DataFrame, path: str) -> None:
    """Points with normals and colors as gzipped lines, one file per partition."""
    encode_text(points).select("value").write.option("compression", "gzip").text(path)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """(frame, x, y, z, rx, ry, rz) of a JSON object of poses by frame name; a missing file has none."""
    if not listed(spark, path):
        return spark.createDataFrame([], f"frame string, {POSE}")
    whole = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", f"map<string,struct<{POSE.replace(' ', ':')}>>".replace(",:", ","))).alias("frame", "pose")
    return whole.select(entries).select("frame", "pose.*")


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """One row of intrinsics; a missing file, and a missing, malformed or null field takes its fallback."""
    whole = spark.read.text(path, wholetext=True) if listed(spark, path) else spark.range(1).select(F.lit("{}").alias("value"))
    field = lambda k, paths: F.coalesce(*[F.expr(f"try_cast(get_json_object(value, '$.intrinsics.color.{p}') AS double)") for p in paths], F.lit(INTRINSICS[k])).alias(k)
    return whole.select(*[field(k, (k,)) for k in INTRINSICS])


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Every named relation as Parquet in a folder of its own."""
    for name, df in layers.items():
        df.write.parquet(f"{path.rstrip('/')}/layer={name}")
