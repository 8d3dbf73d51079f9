"""Operators against truth that can be written down."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators import asof, graph, raster, spatial, verdict
from plumbline.sources import cloud_files, synthetic, telemetry
from plumbline.streaming import progress


def test_ecef_of_known_places(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (90.0, 0.0, 10.0)], "lat double, lon double, alt double")
    got = [tuple(r) for r in rows.select(*geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))).collect()]
    assert np.allclose(got, [(6378137.0, 0, 0), (0, 0, 6356752.314245 + 10)], atol=1e-5)


def test_heading_goes_the_short_way(spark):
    one = spark.createDataFrame([(350.0, 10.0)], "a double, b double")
    assert one.select(geo.angle_between(F.col("a"), F.col("b"), F.lit(0.5))).first()[0] == pytest.approx(0.0)


def test_asof_clamps_and_brackets_over_buckets(spark):
    left = spark.createDataFrame([(1, "a", -5.0), (2, "a", 1.0), (3, "a", 250.0), (4, "a", 900.0), (5, "b", 1.0)], "id int, k string, t double")
    right = spark.createDataFrame([("a", 0.0, 10.0), ("a", 1.0, 11.0), ("a", 500.0, 15.0)], "k string, t double, v double")
    got = {r["id"]: (r["before"], r["after"]) for r in asof.bracket(left, right, "k", "t", ["v"], 100.0).collect()}
    value = lambda x: None if x is None else x["v"]
    assert {k: tuple(map(value, v)) for k, v in got.items()} == {1: (None, 10.0), 2: (10.0, 11.0), 3: (11.0, 15.0), 4: (15.0, None), 5: (None, None)}


def test_nearest_is_exact_far_from_everything(spark):
    rng = np.random.default_rng(1)
    pts = pd.DataFrame(rng.uniform(0, 50, (300, 3)), columns=list("xyz")).assign(id=range(300))
    q = pd.concat([pts.head(20), pd.DataFrame({"x": [400.0], "y": [0.0], "z": [0.0], "id": [999]})])
    got = spatial.nearest(spark.createDataFrame(q), spark.createDataFrame(pts), "id", "id", ["x", "y", "z"], 3, 2.0, other=True, reach=512.0).select(F.col("q.id").alias("q"), F.col("p.id").alias("p"), "rank").toPandas()
    for row in q.itertuples():
        d = np.linalg.norm(pts[["x", "y", "z"]].to_numpy() - [row.x, row.y, row.z], axis=1)
        d[pts.id == row.id] = np.inf
        assert got[got.q == row.id].sort_values("rank").p.tolist() == np.argsort(d)[:3].tolist()


def test_components_of_a_long_chain(spark):
    edges = spark.range(12).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(spark.range(15).select(F.col("id").alias("n")), edges, "n", "a", "b").toPandas().set_index("node").label
    assert (got.loc[0:12] == 0).all() and got.loc[14] == 14


def test_cone_on_a_ramp_is_ground_and_volume_is_close(spark):
    n, res = 160, 0.25
    rw, cl = np.mgrid[0:n, 0:n]
    x, y = (cl + 0.5) * res, (rw + 0.5) * res
    cone = np.maximum(0, 3 * (1 - np.hypot(x - 20, y - 20) / 5))
    assert (cone.sum() * res * res) == pytest.approx(math.pi * 25 * 3 / 3, rel=0.03)
    cells = spark.createDataFrame(pd.DataFrame({"rw": rw[:40, :40].ravel(), "cl": cl[:40, :40].ravel(), "zmin": (0.02 * x)[:40, :40].ravel()}))
    g = raster.ground(cells, res).where("zmin is not null").agg(F.avg(F.col("ground").cast("int"))).first()[0]
    assert g == 1.0


def test_polygon_rule_matches_area(spark):
    poly = [(10.0, 10.0), (80.0, 20.0), (70.0, 90.0), (20.0, 70.0)]
    grid = spark.range(400 * 400).select((F.col("id") % 400 / 4.0 + 0.125).alias("x"), (F.floor(F.col("id") / 400) / 4.0 + 0.125).alias("y"))
    assert grid.where(raster.inside(F.col("x"), F.col("y"), poly)).count() / 16 == pytest.approx(raster.area(poly), rel=0.01)


GOOD = {"observed": True, "covered": True, "inferred": False, "dynamic": False, "separation": 20.0, "views": 6, "basis": "triangulated", "scale": "telemetry", "scale_sigma": 0.001, "degenerate": False}
PROFILE = {"state": "released", "n": 40, "regime_ok": True, "factor": 1.6}


@pytest.mark.parametrize(
    ("change", "status", "reason"),
    [
        ({}, "meets_requirement", None),
        ({"observed": False}, "not_observable", "endpoint_not_observed"),
        ({"inferred": None}, "not_observable", "touches_inferred_geometry"),
        ({"sigma": None}, "not_observable", "uncertainty_undefined"),
        ({"views": None}, "estimated_only", "insufficient_views"),
        ({"separation": 1.0}, "estimated_only", "degenerate_view_geometry"),
        ({"state": None}, "estimated_only", "interval_not_calibrated"),
        ({"n": 12}, "estimated_only", "calibration_sample_too_small"),
        ({"regime_ok": False}, "estimated_only", "calibration_regime_mismatch"),
        ({"factor": None}, "needs_refinement", "interval_exceeds_tolerance"),
        ({"tolerance": 0.01}, "needs_refinement", "interval_exceeds_tolerance"),
        ({"tolerance": None}, "estimated_only", None),
        ({"dynamic": True}, "meets_requirement", "dynamic_contamination"),
        ({"scale_sigma": 0.5}, "estimated_only", "scale_uncertainty_dominates"),
        ({"value": None}, "not_observable", "endpoint_not_observed"),
    ],
)
def test_verdict_table(spark, change, status, reason):
    row = GOOD | PROFILE | {"value": 10.0, "sigma": 0.05, "tolerance": 0.3, "level": 95} | change
    kinds = {"observed": "boolean", "covered": "boolean", "inferred": "boolean", "dynamic": "boolean", "degenerate": "boolean", "regime_ok": "boolean", "views": "int", "n": "int", "level": "int", "basis": "string", "scale": "string", "state": "string"}
    c = {k: F.lit(v).cast(kinds.get(k, "double")) for k, v in row.items()}
    got = spark.range(1).select(*[x.alias(k) for k, x in verdict.evaluate(c["value"], c["sigma"], c["tolerance"], c["level"], c, c).items()]).first()
    assert got["status"] == status
    assert reason is None or reason in got["reasons"]


def test_unknown_level_is_refused(spark):
    with pytest.raises(Exception, match="no factor for level"):
        spark.range(1).select(verdict.z_factor(F.lit(97))).collect()


def test_headers_units_and_bad_rows(spark, tmp_path):
    assert telemetry.without_units("Altitude [m]") == "altitude" and telemetry.without_units("timestamp_ns") == "timestamp_ns"
    found, warnings = telemetry.resolve(["time", "t", "lat [deg]", "lon", "alt_m"])
    assert found["timestamp"] == "time" and found["latitude"] == "lat [deg]" and len(warnings) == 1
    (tmp_path / "a.csv").write_text("time,latitude [deg],lon,alt_m,fx,note\n0,22.5,114,50,800,x\n1,bad,114,50,800,y\n2,22.5,200,50,800,z\n")
    rows = telemetry.load(spark, str(tmp_path / "a.csv")).orderBy("timestamp").collect()
    assert [r["reject"] for r in rows] == [None, "position missing", "longitude out of range"]
    assert rows[0]["extra"] == {"note": "x"} and rows[0]["fx"] == 800
    with pytest.raises(ValueError, match="no telemetry reader"):
        telemetry.load(spark, "a.xyz")


def test_json_srt_pos_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"samples": [{"t": 1, "lat": 22.5, "lon": 114.0, "alt": 9}]}')
    assert telemetry.load(spark, str(tmp_path / "a.json")).first()["altitude"] == 9
    (tmp_path / "a.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\n[latitude: 22.5] [longitude: 114.0] [abs_alt: 51.5]\n\n2\n00:00:03,000 --> 00:00:04,000\n[latitude: 22.6] [longitude: 114.0]\n")
    rows = telemetry.load(spark, str(tmp_path / "a.srt")).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["altitude"], r["altitude_reference"]) for r in rows] == [(1.5, 51.5, "absolute"), (3.0, 0.0, "missing")]
    (tmp_path / "a.pos").write_text("% GPST  latitude(deg) longitude(deg) height(m) Q ns\n2024/01/01 00:00:00.500 22.5 114.0 50.0 1 12\n2300 100.0 22.5 114.0 50.0 4 9\n")
    rows = telemetry.load(spark, str(tmp_path / "a.pos")).collect()
    assert {(r["timestamp"], r["rtk_status"]) for r in rows} == {(1704067200.5, "fixed"), (315964800 + 2300 * 604800 + 100.0, "dgps")}


def test_ply_both_ways(spark, tmp_path):
    cols = {k: np.arange(5.0) + n for n, k in enumerate("xyz")}
    (tmp_path / "a.ply").write_bytes(cloud_files.encode_ply(cols))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    got = cloud_files.read_ply(spark, str(tmp_path)).toPandas()
    assert len(got) == 7 and got.z.sum() == cols["z"].sum() + 9


def test_synthetic_noise_repeats(spark):
    a = synthetic.gps(synthetic.trajectory(spark, "orbit", 50)).toPandas()
    b = synthetic.gps(synthetic.trajectory(spark, "orbit", 50)).toPandas()
    assert a.equals(b) and 1 < (a.e - 40 * np.cos(2 * np.pi * a.frame / 50)).std() < 4


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('noise\n@progress {"event_id": 1, "stage": "s", "f": 0.5}\n@progress {"event_id": 2, "stage": "s", "f": 0.25}\n')
    q = progress.job_states(spark, str(tmp_path / "in"), {"s": (0.2, 0.4)}).writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table("states").first()
    assert (r["stage"], r["events"]) == ("s", 2) and r["fraction"] == pytest.approx(0.4)
