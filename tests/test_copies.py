"""Steps that must not grow with the square of rows at one place, of one time or of one group."""

import io
import tracemalloc
from contextlib import redirect_stdout

import numpy as np
import pytest

from plumbline.operators import asof, order, solvers, spatial
from plumbline.plans import registry

from .compare import SMALL, duck, same


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def no_pairs(monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("rows were paired cell by cell")

    monkeypatch.setattr(spatial, "candidates", refuse)


def brute(points, k):
    out = {}
    for a, x in points.items():
        near = sorted((round(float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), 9), b) for b, y in points.items() if b != a)
        out[a] = [b for _, b in near[:k]]
    return out


def test_nearest_with_copies_and_far_points(spark, no_pairs):
    """Many rows at one place, lattice ties, and two points thousands of metres from all others."""
    rng = np.random.default_rng(3)
    at = {i: (1.0, 2.0, 3.0) for i in range(40)} | {100 + i: tuple(map(float, rng.integers(0, 4, 3))) for i in range(120)} | {300: (9000.0, 0.0, 0.0), 301: (0.0, -7000.0, 5.0)}
    p = spark.createDataFrame([(i, *x) for i, x in at.items()], "point_id long, x double, y double, z double")
    got = {}
    for r in spatial.nearest(p, p, "point_id", "point_id", ["x", "y", "z"], 3, 4.0, other=True).orderBy("rank").collect():
        got.setdefault(r["q"]["point_id"], []).append(r["p"]["point_id"])
    assert got == brute(at, 3)


def test_nearest_of_a_full_cell(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FULL", 20)
    rng = np.random.default_rng(4)
    at = {i: tuple(map(float, rng.integers(0, 6, 3))) for i in range(200)}
    p = spark.createDataFrame([(i, *x) for i, x in at.items()], "point_id long, x double, y double, z double")
    got = {}
    for r in spatial.nearest(p, p, "point_id", "point_id", ["x", "y", "z"], 4, 4.0, other=True).orderBy("rank").collect():
        got.setdefault(r["q"]["point_id"], []).append(r["p"]["point_id"])
    assert got == brute(at, 4)


@pytest.mark.parametrize("name", ["e07_lineage_lookup", "e09_dense_attribution", "m01_point_measure", "m24_freeze_questions", "f06_surface_accuracy", "d06_snap_tolerance", "k02_outlier_removal", "c23_depth_sigma"])
def test_no_rows_are_paired(spark, no_pairs, name):
    assert same(registry.QUERIES[name](spark, SMALL).toPandas(), duck().execute(registry.ORACLE_SQL[name]).df()) == ""


def test_bracket_looks_back_only(spark):
    l = spark.createDataFrame([(i, 0, i % 7 / 2) for i in range(50)], "id long, one int, t double")
    r = spark.createDataFrame([(0, t / 1.0, t * 10.0) for t in (1, 1, 2, 30)], "one int, t double, x double")
    b = asof.bracket(l, r, "one", "t", ["x"], 1.0)
    assert "unboundedfollowing" not in plan(b).lower()
    for row in b.collect():
        before, after = [t for t in (1, 1, 2, 30) if t < row["t"]], [t for t in (1, 1, 2, 30) if t >= row["t"]]
        assert (row["before"]["t"] if row["before"] else None) == (max(before) if before else None) and row["after"]["t"] == min(after)


def peak(f) -> float:
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_levelling_holds_no_square(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 100, (12_000, 3)) * [1, 1, 0.01]
    p[:, 2] += p[:, 1] * 0.2
    assert peak(lambda: solvers.level_rotation(p)) < 200


def test_similarity_tries_triples_in_blocks():
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 100, (20_000, 3))
    assert peak(lambda: solvers.robust_similarity(p, p + 0.5 + rng.normal(0, 0.02, p.shape), np.full(len(p), 0.03))) < 150


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_medians(spark, n):
    x = np.random.default_rng(n).choice([-2.0, 0.1, 0.10004, 0.2, 5.0], n)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)], "k string, v double")
    got = {r["k"]: r["median"] for r in order.medians(df, "k", "v", 1e-4).collect()}
    assert got == {"a": pytest.approx(float(np.median(x))), "b": 1.0}


def test_bands_and_votes_gather_no_values(spark):
    for name in ("f30_baseline_bands", "k28_verify_inferred"):
        text = plan(registry.QUERIES[name](spark, SMALL)).lower()
        assert "median(" not in text and "percentile(" not in text


def test_files_are_not_dealt_by_file(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "SortMergeJoin" not in plan(registry.QUERIES["a10_solution_forms"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_points_of_a_radius_join_are_not_broadcast(spark):
    text = plan(registry.QUERIES["e06_radius_join"](spark, SMALL))
    assert text.count("SortMergeJoin") == 1 and text.count("BroadcastHashJoin") == 2  # the two tables of full cells
