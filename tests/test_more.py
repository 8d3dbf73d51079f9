"""Streams, hot keys, files and readers on small made cases."""

import numpy as np
import pandas as pd
import pytest
from plumbline.operators import backends, graph, spatial
from plumbline.plans import registry  # noqa: F401  first: it loads the query modules in their order
from plumbline.plans import queries_more
from plumbline.sources import cloud_files, display_pack, telemetry
from plumbline.streaming import progress
from pyspark.sql import functions as F

RNG = np.random.default_rng(7)


def streamed(spark, tmp_path, batches, schema, plan, name):
    """Rows of `plan` over a stream that sees each of `batches` in a batch of its own."""
    (tmp_path / "in").mkdir()
    out = []
    stream = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    for k, rows in enumerate(batches):
        pd.DataFrame(rows).to_json(tmp_path / "in" / f"{k}.json", orient="records", lines=True)
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return out


def test_changes_of_state_across_batches(spark, tmp_path):
    rows = [("a", 1, "run"), ("a", 2, "run"), ("b", 3, "run"), ("a", 4, "done"), ("b", 5, "wait"), ("a", 6, "run"), ("b", 7, "wait"), ("b", 8, "failed"), ("b", 9, "run")]
    as_dicts = [{"job": j, "k": k, "state": s} for j, k, s in rows]
    got = streamed(spark, tmp_path, [as_dicts[:3], as_dicts[3:6], as_dicts[6:]], "job string, k long, state string", lambda s: progress.changes(s, "job", "k", "state", ("done", "failed")), "changes")
    assert sorted(got) == [("a", 1, "run"), ("a", 4, "done"), ("b", 3, "run"), ("b", 5, "wait"), ("b", 8, "failed")]


def test_newest_state_of_each_interval(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 400, 2), ("a", 500, 3), ("b", 10, 4)], "job string, ms long, state long")
    got = {(r["job"], r["slot"]): (r["newest"], r["seen"]) for r in progress.throttled(rows, "job", F.col("ms"), 500, "state").collect()}
    assert got == {("a", 0): (2, 2), ("a", 1): (3, 1), ("b", 0): (4, 1)}


def test_hot_cells_and_keys_change_nothing(spark, monkeypatch):
    p = pd.DataFrame(np.concatenate([RNG.uniform(0, 3, (150, 2)), RNG.uniform(0, 60, (50, 2))]), columns=["x", "y"]).assign(id=range(200))
    df = spark.createDataFrame(p)
    pairs = lambda: sorted((r["a"], r["b"]) for r in spatial.within(df, df, ["x", "y"], 2.0).select(F.col("q.id").alias("a"), F.col("p.id").alias("b")).collect())
    near = lambda: [tuple(r) for r in spatial.nearest(df, df, "id", "id", ["x", "y"], 3, 2.0, other=True).select(F.col("q.id").alias("a"), "rank", F.col("p.id").alias("b")).orderBy("a", "rank").collect()]
    before = pairs(), near()
    x = p[["x", "y"]].to_numpy()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert before[0] == sorted(zip(*map(list, np.nonzero(d <= 2.0))))
    np.fill_diagonal(d, np.inf)
    assert before[1] == [(i, k + 1, int(j)) for i in range(200) for k, j in enumerate(np.argsort(d[i])[:3])]
    monkeypatch.setattr(spatial, "HOT_ROWS", 10)
    monkeypatch.setattr(graph, "HOT_ROWS", 10)
    assert (pairs(), near()) == before
    edges = spark.createDataFrame([(0, k) for k in range(1, 80)] + [(100, 101), (79, 200)], "a long, b long")
    got = graph.components(spark.range(210).select(F.col("id").alias("n")), edges, "n", "a", "b").toPandas().set_index("node").label
    assert (got[list(range(80)) + [200]] == 0).all() and got[101] == 100 and got[150] == 150


def test_packs_stand_alone(spark):
    q, a = RNG.integers(0, 1 << 16, (1000, 3)), RNG.integers(0, 256, (1000, 4))
    first, back, attributes = display_pack.decode(display_pack.encode(17, q, a))
    assert first == 17 and (back == q).all() and (attributes == a).all()
    with pytest.raises(ValueError, match="not a display pack"):
        display_pack.decode(__import__("zlib").compress(b"other" * 20))


def test_registration_brings_a_turned_cloud_back(spark):
    x = RNG.uniform(0, 40, (400, 3))
    a = np.radians(2.0)
    rot = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    frame = lambda p: spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(id=range(len(p))))
    back, shift, rmse = queries_more.rigid_icp(frame((x - 20) @ rot.T + 20.1), frame(x), "id")
    assert rmse < 1e-6 and np.allclose(back @ rot, np.eye(3), atol=1e-6)


def test_geoid_grid_refuses_what_it_does_not_cover(spark):
    grid = spark.createDataFrame([(i, j, float(i + 2 * j)) for i in range(3) for j in range(3)], "i long, j long, n double")
    inside = spark.createDataFrame([(1, 0.5, 1.25, 100.0)], "id long, lat double, lon double, alt double")
    assert queries_more.orthometric(inside, grid, "id", 1.0).first()["height"] == pytest.approx(100 - (0.5 + 2.5))
    with pytest.raises(Exception, match="no geoid grid"):
        queries_more.orthometric(spark.createDataFrame([(1, 2.5, 1.0, 5.0)], inside.schema), grid, "id", 1.0).collect()


def test_backends_fall_back_and_refuse():
    with pytest.warns(UserWarning, match="network"):
        assert backends.available(backends.MASKS, ["network", "threshold"]) == ("threshold", ["network"])
    with pytest.raises(ValueError, match="no backend nothing"):
        backends.available(backends.MASKS, ["nothing"])


def test_solution_files_by_their_headers(spark):
    lines = [("a", "%  UTC  latitude(d'\") longitude(d'\") height(m) Q ns"), ("a", "2020/01/01 00:00:01.250 -0 30 0.0 10 15 36.0 7.5 1 9"), ("b", "% (lat/lon/height=WGS84/ellipsoidal)"), ("b", "2100 345600.0 1.5 2.5 30.0 4 8"), ("b", "2100 x 1.5 2.5 30.0 4 8")]
    got = telemetry.from_pos_files(spark.createDataFrame(lines, "file string, line string"), "file", lambda day: F.lit(18)).collect()
    rows = sorted((r["file"], r["utc"] or 0, r["latitude"], r["longitude"], r["altitude"], r["datum"]) for r in got)
    assert rows[0] == ("a", 1577836801.25, pytest.approx(-0.5), pytest.approx(10.26), 7.5, "unknown")
    assert rows[1][1] == 0 and rows[2] == ("b", 315964800 + 2100 * 604800 + 345600 - 18.0, 1.5, 2.5, 30.0, "ellipsoidal")


def test_binary_poses_and_raw_clouds(spark):
    poses = spark.createDataFrame([(5, 0.5, 0.5, 0.5, 0.5, 1.0, 2.0, 3.0)], "image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    r = cloud_files.from_binary_poses(cloud_files.to_binary_poses(poses)).first()
    # this turn maps x to y to z: its inverse of -t is (-2, -3, -1)
    assert (r["image_id"], r["name"]) == (5, "f5.jpg") and np.allclose([r["cx"], r["cy"], r["cz"]], [-2, -3, -1])
    raw = spark.createDataFrame([(1.5, 2.0, 3.0, 255, 0, 7, 2)], "x double, y double, z double, r long, g long, b long, provenance long")
    assert tuple(cloud_files.from_raw(cloud_files.to_raw(raw)).first()) == (1.5, 2.0, 3.0, 255, 0, 7, 2)
    assert len(cloud_files.to_raw(raw).first()["blob"]) == 16


def test_metrics_reach_the_callback(spark):
    df, told = backends.observed(spark.range(25).select((F.col("id") * 2).alias("x")), rows=F.count(F.lit(1)), most=F.max("x"))
    assert df.count() == 25 and told() == {"rows": 25, "most": 48}


def test_cell_normals_of_planes():
    from plumbline.operators import solvers

    n = np.array([[0.6, 0.0, 0.8], [0.0, 0.0, 1.0]])
    rows = []
    for k, up in enumerate(n):
        p = RNG.normal(size=(200, 3))
        p -= (p @ up)[:, None] * up
        cov = np.cov(p.T, bias=True)
        rows.append({"vx": k, "vy": 0, "n": 200} | {f"{a}{b}": cov[i, j] for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j})
    got = next(solvers.normals([pd.DataFrame(rows)]))
    assert np.allclose(got[["nx", "ny", "nz"]].to_numpy(), n, atol=1e-6) and (got.planarity > 0.999).all() and got.degenerate.all()


def test_keyframes_have_a_floor_and_a_cap(spark):
    from types import SimpleNamespace

    from plumbline.plans import queries_join, queries_rest

    still = [(k, 0.0, 0.0) for k in range(50)]  # nothing moves: few are chosen by the rule, thirty by the floor
    moving = [(50 + k, 5.0 * k, 0.0) for k in range(50)]
    short = [(100 + k, 0.0, 0.0) for k in range(7)]
    v = SimpleNamespace(cameras=spark.createDataFrame(still + moving + short, "camera_id long, cx double, cy double"))
    rule = {s: set(g.camera_id) for s, g in queries_join.d03_keyframes(v).toPandas().groupby("segment")}
    got = {s: set(g.camera_id) for s, g in queries_rest.d03_keyframes_between(v).toPandas().groupby("segment")}
    even = lambda xs, n: {xs[i * (len(xs) - 1) // (n - 1)] for i in range(n)}
    for s, run in ((0, range(50)), (1, range(50, 100)), (2, range(100, 107))):
        want = sorted(rule[s]) if len(rule[s]) >= min(len(run), 30) else sorted(rule[s] | even(list(run), min(len(run), 30)))
        assert got[s] == (even(want, 40) if len(want) > 40 else set(want))


def test_splats_by_brute_force(spark):
    from types import SimpleNamespace

    x = RNG.uniform(0, 30, (80, 3))
    df = pd.DataFrame(x, columns=list("xyz")).assign(point_id=range(80), r=100, confidence=0.5)
    got = queries_more.p11_splat_initialisation(SimpleNamespace(points=spark.createDataFrame(df))).toPandas().set_index("point_id")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(80):
        near = np.argsort(d[i])[:5]
        up = np.linalg.eigh(np.cov(x[near].T))[1][:, 0]
        up = up if up[2] >= 0 else -up
        q = got.loc[i, ["qw", "qx", "qy", "qz"]].to_numpy(float)
        axis = np.array([2 * (q[1] * q[3] + q[0] * q[2]), 2 * (q[2] * q[3] - q[0] * q[1]), 1 - 2 * (q[1] ** 2 + q[2] ** 2)])
        assert got.scale[i] == pytest.approx(np.log(d[i][near[1:]].mean()), abs=1e-5) and np.allclose(axis, up, atol=1e-3)


def test_a_hole_both_cameras_see_is_filled_from_its_bank(spark):
    from types import SimpleNamespace

    at = [(r, k) for r in range(30) for k in range(30) if not (12 <= r < 16 and 13 <= k < 17)]
    roof = {(11, k) for k in range(13, 17)}  # a wall of roofs along the bank counts as three metres over the ground
    cells = spark.createDataFrame([(r, k, 20.0 if (r, k) in roof else 1.0, 20.0 if (r, k) in roof else 1.0) for r, k in at], "rw long, cl long, zmin double, dsm double")
    dense = spark.createDataFrame([(k * 2.0 + 1, r * 2.0 + 1, 20.0 if (r, k) in roof else 1.0, 0) for r, k in at for _ in range(2)], "x double, y double, z double, provenance int")
    cameras = spark.createDataFrame([(1, 30.0, 30.0, 100.0), (2, 32.0, 30.0, 100.0)], "camera_id long, cx double, cy double, cz double")
    got = queries_more.k24_fill_holes(SimpleNamespace(cells=cells, dense=dense, cameras=cameras, spark=spark)).toPandas()
    assert {(r, k) for r, k in zip(got.rw, got.cl)} == {(r, k) for r in range(12, 16) for k in range(13, 17)} and got.hole.nunique() == 1
    assert got.z.between(1.0, 4.0).all() and got[got.rw == 12].z.min() > got[got.rw == 15].z.max()
    one = SimpleNamespace(cells=cells, dense=dense, cameras=cameras.where("camera_id = 1"), spark=spark)
    assert queries_more.k24_fill_holes(one).count() == 0
