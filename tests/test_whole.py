"""Queries on small made tables, against brute force: no window, cap or sample may cut the answer."""

from types import SimpleNamespace

import pandas as pd
import pytest

from plumbline.plans import registry  # first: it loads the query modules in their order
from plumbline.plans import queries_cloud, queries_join

from .compare import SMALL, duck, same


def test_terrain_under_a_wide_roof(spark):
    """The middle of the roof is eight cells from any ground; one cell has no point at all."""
    z = {(a, b): 10.0 if 12 <= a < 28 and 12 <= b < 28 else (a * 7 + b * 3) % 5 / 100 for a in range(40) for b in range(40)}
    del z[(19, 20)]
    cells = spark.createDataFrame([(a, b, x) for (a, b), x in z.items()], "rw long, cl long, zmin double")
    ground = {k: x for k, x in z.items() if x < 1}
    want = {(a, b): ground[min(ground, key=lambda k: ((k[0] - a) ** 2 + (k[1] - b) ** 2, k))] for a in range(40) for b in range(40)}
    got = {(r["rw"], r["cl"]): r["terrain"] for r in queries_cloud.terrain(SimpleNamespace(cells=cells)).collect()}
    assert got == want


def test_caps_are_those_of_the_reference(spark):
    """400 cameras on a line, 40 m apart: no pair is near in space, all strides of the 400 fit 3,000 pairs."""
    cameras = spark.range(400).selectExpr("id AS camera_id", "id * 40e0 AS cx", "0e0 AS cy")
    got = {(r["i"], r["j"]) for r in queries_join.e16_pair_graph(SimpleNamespace(cameras=cameras)).collect()}
    assert got == {(i, i + d) for d in (1, 2, 4, 8, 16) for i in range(400 - d)}
    points = spark.range(2500).selectExpr("id AS point_id", "id * 1e0 AS x", "0e0 AS y", "0e0 AS z")
    assert queries_join.h07_hash_sample(SimpleNamespace(points=points)).count() == 2500


@pytest.mark.parametrize("name", ["m13_verdicts", "m10_evidence"])
def test_views_of_cameras_missing_or_twice(spark, tmp_path, name):
    """Two cameras of ten are left in their table, one of them twice: a point's views are the cameras its observations name, as in the SQL."""
    for t in ("part", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    left = pd.read_parquet(f"{SMALL}/supplier.parquet").query("s_suppkey < 2")
    pd.concat([left, left[:1]]).to_parquet(tmp_path / "supplier.parquet")
    assert same(registry.QUERIES[name](spark, str(tmp_path)).toPandas(), duck(tmp_path).execute(registry.ORACLE_SQL[name]).df()) == ""
