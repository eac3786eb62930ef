"""The registry, and the queries against their SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from geoquilt.plans.oracles import ORACLES
from geoquilt.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SAMPLE = ("voxel_downsample", "knn", "surface_variation", "depth_bilateral", "autotune_extrinsics", "ransac_plane", "resample_polyline", "edt_ridge", "dbscan", "triangle_adjacency", "objective_all")
LATER = ("spacing_quantile", "index_selection", "weighted_adjacency", "largest_groups", "contour_links", "random_sample")
ADDED = ("ply_roundtrip", "pose_chain", "fused_capture", "pixel_edges", "filled_mask", "simple_voxels", "volume_nodes", "volume_parts", "feature_nearest", "feature_matches", "color_gradients")
#: Queries that stand beside one of a fixed share of the rows.
WHOLE = ("gaussian_blur_frames", "em_estep_all", "polyline_prune_all", "mesh_prune_points")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", WHOLE)
def test_query_over_whole_tables_equals_its_sql(spark, name):
    test_query_equals_its_sql(spark, name)


@pytest.mark.parametrize("name", SAMPLE + LATER + ADDED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    got = df.select(*sorted(df.columns)).collect()
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    key = lambda r: tuple("" if v is None else repr(v) if not isinstance(v, float) else f"{v:.6f}" for v in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or math.isclose(x, y, abs_tol=2e-6)
