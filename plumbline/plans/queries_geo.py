"""Coordinates, attitudes and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial
from .registry import query

c = F.col


def r(x, n=6):
    return F.round(x, n)


_ECEF = """n AS (SELECT *, radians(lat) AS la, radians(lon) AS lo, 6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sin(radians(lat)) ^ 2) AS nn FROM telemetry),
ecef AS (SELECT *, (nn + alt) * cos(la) * cos(lo) AS ex, (nn + alt) * cos(la) * sin(lo) AS ey, (nn * (1 - 0.0066943799901413165::DOUBLE) + alt) * sin(la) AS ez FROM n)"""


@query("C01", f"WITH {_ECEF} SELECT event_id, round(ex, 4) AS ex, round(ey, 4) AS ey, round(ez, 4) AS ez FROM ecef")
def c01_geodetic_to_ecef(v):
    x, y, z = geo.geodetic_to_ecef(c("lat"), c("lon"), c("alt"))
    return v.telemetry.select("event_id", r(x, 4).alias("ex"), r(y, 4).alias("ey"), r(z, 4).alias("ez"))


@query("C02", "SELECT event_id, round(lat, 7) AS lat, round(lon, 7) AS lon, round(alt, 4) AS alt FROM telemetry")
def c02_ecef_round_trip(v):
    """The way back must give the input: the oracle is the input itself."""
    e = v.telemetry.select("event_id", *(x.alias(n) for x, n in zip(geo.geodetic_to_ecef(c("lat"), c("lon"), c("alt")), "xyz")))
    la, lo, h = geo.ecef_to_geodetic(c("x"), c("y"), c("z"))
    return e.select("event_id", r(la, 7).alias("lat"), r(lo, 7).alias("lon"), r(h, 4).alias("alt"))


_ORIGIN = "o AS (SELECT avg(lat) AS lat0, avg(lon) AS lon0, avg(alt) AS alt0 FROM telemetry)"
_ENU = f"""{_ECEF}, {_ORIGIN},
oe AS (SELECT *, radians(lat0) AS a0, radians(lon0) AS b0, 6378137.0::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sin(radians(lat0)) ^ 2) AS n0 FROM o),
d AS (SELECT event_id, a0, b0, ex - (n0 + alt0) * cos(a0) * cos(b0) AS dx, ey - (n0 + alt0) * cos(a0) * sin(b0) AS dy, ez - (n0 * (1 - 0.0066943799901413165::DOUBLE) + alt0) * sin(a0) AS dz FROM ecef, oe),
enu AS (SELECT event_id, -sin(b0) * dx + cos(b0) * dy AS e, -sin(a0) * cos(b0) * dx - sin(a0) * sin(b0) * dy + cos(a0) * dz AS nn, cos(a0) * cos(b0) * dx + cos(a0) * sin(b0) * dy + sin(a0) * dz AS u FROM d)"""


def _with_origin(v):
    o = v.telemetry.agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"), F.avg("alt").alias("alt0"))
    return v.telemetry.crossJoin(F.broadcast(o))  # one row


@query("C03 C04", f"WITH {_ENU} SELECT event_id, round(e, 4) AS e, round(nn, 4) AS n, round(u, 4) AS u FROM enu")
def c04_geodetic_to_enu(v):
    e, n, u = geo.geodetic_to_enu(*map(c, ("lat", "lon", "alt", "lat0", "lon0", "alt0")))
    return _with_origin(v).select("event_id", r(e, 4).alias("e"), r(n, 4).alias("n"), r(u, 4).alias("u"))


@query("C04", "SELECT event_id, round(lat, 7) AS lat, round(lon, 7) AS lon, round(alt, 3) AS alt FROM telemetry")
def c04_enu_to_geodetic(v):
    o = tuple(map(c, ("lat0", "lon0", "alt0")))
    t = _with_origin(v).select("event_id", *o, *(x.alias(n) for x, n in zip(geo.geodetic_to_enu(c("lat"), c("lon"), c("alt"), *o), "enu")))
    t = t.select("event_id", *(x.alias(n) for x, n in zip(geo.enu_to_ecef(c("e"), c("n"), c("u"), *o), "xyz")))
    la, lo, h = geo.ecef_to_geodetic(c("x"), c("y"), c("z"))
    return t.select("event_id", r(la, 7).alias("lat"), r(lo, 7).alias("lon"), r(h, 3).alias("alt"))


@query("C05", "SELECT event_id, (CASE WHEN lat - 22.2 >= 0 THEN 32600 ELSE 32700 END + least(greatest(floor((lon * 3 - 342 + 180) / 6) + 1, 1), 60))::BIGINT AS epsg FROM telemetry")
def c05_utm_zone(v):
    return v.telemetry.select("event_id", geo.utm_epsg(c("lat") - 22.2, c("lon") * 3 - 342).cast("long").alias("epsg"))


_N = 0.0016792203863837047
_A1, _A2, _A3 = geo._ALPHA


@query(
    "C06",
    f"""WITH p AS (SELECT event_id, radians(lat) AS la, radians(lon - 114.3) AS lo FROM telemetry),
q AS (SELECT *, sin(la) AS s, {2 * geo._N**0.5 / (1 + geo._N)!r}::DOUBLE AS k FROM p),
q2 AS (SELECT *, sinh(atanh(s) - k * atanh(k * s)) AS tt FROM q),
q3 AS (SELECT *, atan2(tt, cos(lo)) AS xi, atanh(sin(lo) / sqrt(1 + tt * tt)) AS eta FROM q2)
SELECT event_id, round(500000 + 0.9996::DOUBLE * {geo._RADIUS!r}::DOUBLE * (eta + {_A1!r}::DOUBLE * cos(2 * xi) * sinh(2 * eta) + {_A2!r}::DOUBLE * cos(4 * xi) * sinh(4 * eta) + {_A3!r}::DOUBLE * cos(6 * xi) * sinh(6 * eta)), 3) AS easting,
round(0.9996::DOUBLE * {geo._RADIUS!r}::DOUBLE * (xi + {_A1!r}::DOUBLE * sin(2 * xi) * cosh(2 * eta) + {_A2!r}::DOUBLE * sin(4 * xi) * cosh(4 * eta) + {_A3!r}::DOUBLE * sin(6 * xi) * cosh(6 * eta)), 3) AS northing FROM q3""",
)
def c06_utm(v):
    e, n = geo.utm(c("lat"), c("lon"), F.lit(114.3))
    return v.telemetry.select("event_id", r(e, 3).alias("easting"), r(n, 3).alias("northing"))


@query(
    "C07",
    """SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE fix WHEN 'view' THEN round(alt, 3) END AS ellipsoidal_m, CASE fix WHEN 'click' THEN round(alt, 3) END AS orthometric_m,
CASE WHEN fix = 'view' THEN NULL WHEN fix = 'click' THEN NULL ELSE 'height withheld: vertical datum unknown' END AS note FROM telemetry""",
)
def c07_describe_point(v):
    """Heights only under the datum they are in; otherwise a note says why there is none."""
    datum = F.when(c("fix") == "view", "ellipsoidal").when(c("fix") == "click", "orthometric").otherwise("unknown")
    t = v.telemetry.withColumn("datum", datum)
    return t.select(
        "event_id",
        r(c("lat")).alias("lat"),
        r(c("lon")).alias("lon"),
        F.when(c("datum") == "ellipsoidal", r(c("alt"), 3)).alias("ellipsoidal_m"),
        F.when(c("datum") == "orthometric", r(c("alt"), 3)).alias("orthometric_m"),
        F.when(c("datum") == "unknown", "height withheld: vertical datum unknown").alias("note"),
    )


_SIM = (0.36, 0.48, -0.8), (-0.8, 0.6, 0.0), (0.48, 0.64, 0.6)


@query("C09", "SELECT point_id, round(2.5 * (0.36 * x + 0.48 * y - 0.8 * z) + 10, 6) AS x, round(2.5 * (-0.8 * x + 0.6 * y) - 20, 6) AS y, round(2.5 * (0.48 * x + 0.64 * y + 0.6 * z) + 5, 6) AS z FROM points")
def c09_similarity(v):
    out = geo.apply([[F.lit(a) for a in row] for row in _SIM], (c("x"), c("y"), c("z")))
    return v.points.select("point_id", *(r(2.5 * o + t).alias(n) for o, t, n in zip(out, (10, -20, 5), "xyz")))


@query(
    "C10",
    """WITH s AS (SELECT point_id, sigma * sigma AS a, sigma_major * sigma_major AS b, sigma * sigma_major / 4 AS d FROM points WHERE sigma IS NOT NULL)
SELECT point_id, round(6.25 * (0.36 * (0.36 * a + 0.48 * d) + 0.48 * (0.36 * d + 0.48 * b) + 0.64 * a), 9) AS cxx, round(6.25 * (-0.8 * (0.36 * a + 0.48 * d) + 0.6 * (0.36 * d + 0.48 * b)), 9) AS cxy FROM s""",
)
def c10_covariance_through_similarity(v):
    s = v.points.where("sigma is not null").select("point_id", (c("sigma") * c("sigma")).alias("a"), (c("sigma_major") * c("sigma_major")).alias("b"), (c("sigma") * c("sigma_major") / 4).alias("d"))
    cov = [[c("a"), c("d"), F.lit(0.0)], [c("d"), c("b"), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), c("a")]]
    rot = [[F.lit(a) for a in row] for row in _SIM]
    out = geo.matmul(geo.matmul(rot, cov), [[rot[j][i] for j in range(3)] for i in range(3)])
    return s.select("point_id", r(6.25 * out[0][0], 9).alias("cxx"), r(6.25 * out[0][1], 9).alias("cxy"))


_F, _CX, _CY, _K1, _K2, _P1, _P2 = 800.0, 640.0, 360.0, -0.05, 0.01, 0.001, -0.0005
_PROJ = """o AS (SELECT DISTINCT ob.point_id, ob.camera_id, p.x - k.cx AS dx, k.cy - p.y AS dy, k.cz - p.z AS dz FROM observations ob JOIN points p USING (point_id) JOIN cameras k USING (camera_id)),
n AS (SELECT *, dx / dz AS a, dy / dz AS b, (dx / dz) ^ 2 + (dy / dz) ^ 2 AS rr FROM o WHERE dz > 1e-6)"""


def _seen(v):
    """Each point in each camera that observed it, in the camera's frame (nadir view)."""
    o = v.observations.select("point_id", "camera_id").distinct()
    return o.join(v.points, "point_id").join(v.cameras, "camera_id").select("point_id", "camera_id", (c("x") - c("cx")).alias("dx"), (c("cy") - c("y")).alias("dy"), (c("cz") - c("z")).alias("dz")).where("dz > 1e-6")


def project(dx, dy, dz):
    a, b = dx / dz, dy / dz
    rr = a * a + b * b
    radial = 1 + _K1 * rr + _K2 * rr * rr
    u = a * radial + 2 * _P1 * a * b + _P2 * (rr + 2 * a * a)
    w = b * radial + _P1 * (rr + 2 * b * b) + 2 * _P2 * a * b
    return _F * u + _CX, _F * w + _CY


@query(
    "C11 C16 D09",
    f"""WITH {_PROJ}, q AS (SELECT point_id, camera_id, 800 * (a * (1 - 0.05 * rr + 0.01 * rr * rr) + 0.002 * a * b - 0.0005 * (rr + 2 * a * a)) + 640 AS u, 800 * (b * (1 - 0.05 * rr + 0.01 * rr * rr) + 0.001 * (rr + 2 * b * b) - 0.001 * a * b) + 360 AS w FROM n)
SELECT point_id, camera_id, round(u, 5) AS u, round(w, 5) AS v, u >= 0 AND u < 1280 AND w >= 0 AND w < 720 AS visible FROM q""",
)
def c11_project_with_distortion(v):
    u, w = project(c("dx"), c("dy"), c("dz"))
    return _seen(v).withColumns({"u": u, "w": w}).select("point_id", "camera_id", r(c("u"), 5).alias("u"), r(c("w"), 5).alias("v"), ((c("u") >= 0) & (c("u") < 1280) & (c("w") >= 0) & (c("w") < 720)).alias("visible"))


@query("C12", f"WITH {_PROJ} SELECT point_id, camera_id, round(800 / dz, 8) AS du_dx, round(-800 * dx / (dz * dz), 8) AS du_dz, round(800 / dz, 8) AS dv_dy, round(-800 * dy / (dz * dz), 8) AS dv_dz FROM n")
def c12_projection_jacobian(v):
    return _seen(v).select("point_id", "camera_id", r(_F / c("dz"), 8).alias("du_dx"), r(-_F * c("dx") / (c("dz") * c("dz")), 8).alias("du_dz"), r(_F / c("dz"), 8).alias("dv_dy"), r(-_F * c("dy") / (c("dz") * c("dz")), 8).alias("dv_dz"))


@query(
    "C13",
    """SELECT o.point_id, round(avg(sqrt((800 * (p.x - k.cx) / (k.cz - p.z) + 640 - o.u) ^ 2 + (800 * (k.cy - p.y) / (k.cz - p.z) + 360 - o.v) ^ 2)), 5) AS mean_error, count(*) AS n
FROM observations o JOIN points p USING (point_id) JOIN cameras k USING (camera_id) GROUP BY 1""",
)
def c13_reprojection_error(v):
    o = v.observations.join(v.cameras, "camera_id").join(v.points, "point_id")
    dz = c("cz") - c("z")
    e = F.hypot(_F * (c("x") - c("cx")) / dz + _CX - c("u"), _F * (c("cy") - c("y")) / dz + _CY - c("v"))
    return o.groupBy("point_id").agg(r(F.avg(e), 5).alias("mean_error"), F.count(F.lit(1)).alias("n"))


_ATT = "SELECT *, cos(radians(yaw)) AS cy_, sin(radians(yaw)) AS sy, cos(radians(pitch)) AS cp, sin(radians(pitch)) AS sp, cos(radians(roll)) AS cr, sin(radians(roll)) AS sr FROM cameras"


@query(
    "C14 C15",
    f"""WITH t AS ({_ATT}) SELECT camera_id, round(cx - (0.1 * sy * cp + 0.02 * (sy * sp * sr + cy_ * cr) - 0.3 * (sy * sp * cr - cy_ * sr)), 6) AS e, round(cy - (0.1 * cy_ * cp + 0.02 * (cy_ * sp * sr - sy * cr) - 0.3 * (cy_ * sp * cr + sy * sr)), 6) AS n,
round(cz + (-0.1 * sp + 0.02 * cp * sr - 0.3 * cp * cr), 6) AS u FROM t""",
)
def c15_lever_arm(v):
    """Optical centre from the antenna's place: the body-frame arm rotated to north-east-down, taken off in ENU."""
    north, east, down = geo.apply(geo.rotation_zyx(c("yaw"), c("pitch"), c("roll")), (0.1, 0.02, -0.3))
    return v.cameras.select("camera_id", r(c("cx") - east).alias("e"), r(c("cy") - north).alias("n"), r(c("cz") + down).alias("u"))


@query("C17", f"""WITH t AS (SELECT camera_id, radians(yaw) / 2 AS y, radians(pitch) / 2 AS p, radians(roll) / 2 AS q FROM cameras),
w AS (SELECT camera_id, cos(q)*cos(p)*cos(y) + sin(q)*sin(p)*sin(y) AS w, sin(q)*cos(p)*cos(y) - cos(q)*sin(p)*sin(y) AS x, cos(q)*sin(p)*cos(y) + sin(q)*cos(p)*sin(y) AS yy, cos(q)*cos(p)*sin(y) - sin(q)*sin(p)*cos(y) AS z FROM t)
SELECT camera_id, round(abs(w), 6) AS w, round(x * w, 6) AS xw, round(yy * w, 6) AS yw, round(z * w, 6) AS zw FROM w""")
def c17_matrix_to_quaternion(v):
    """Held against half-angle products, up to the common sign a quaternion leaves open."""
    q = v.cameras.select("camera_id", *(x.alias(n) for x, n in zip(geo.quaternion(geo.rotation_zyx(c("yaw"), c("pitch"), c("roll"))), "wxyz")))
    return q.select("camera_id", r(F.abs("w")).alias("w"), *(r(c(k) * c("w")).alias(f"{k}w") for k in "xyz"))


@query("C18", """SELECT camera_id, round(abs(cos(radians(yaw) / 2 * s)), 6) AS w, round(abs(sin(radians(yaw) / 2 * s)), 6) AS z FROM (SELECT camera_id, CASE WHEN yaw > 180 THEN 360 - yaw ELSE yaw END AS yaw, (camera_id % 11) / 1e1 AS s FROM cameras)""")
def c18_slerp(v):
    """From the identity to a turn about one axis: the shorter way, at constant speed."""
    one = (F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    to = (F.cos(F.radians("yaw") / 2), F.lit(0.0), F.lit(0.0), F.sin(F.radians("yaw") / 2))
    q = geo.slerp(one, to, c("camera_id") % 11 / 10.0)
    return v.cameras.select("camera_id", r(F.abs(q[0])).alias("w"), r(F.abs(q[3])).alias("z"))


@query("C19", """WITH d AS (SELECT event_id, yaw AS a0, CASE WHEN event_id % 9 <> 0 THEN (yaw * 7 + 40) % 360 END AS a1, (event_id % 10) / 1e1 AS w FROM telemetry),
e AS (SELECT *, ((a1 - a0 + 180) % 360 + 360) % 360 - 180 AS dd FROM d) SELECT event_id, round(coalesce(((a0 + w * dd) % 360 + 360) % 360, a0, a1), 6) AS yaw FROM e""")
def c19_heading_interpolation(v):
    a1 = F.when(c("event_id") % 9 != 0, (c("yaw") * 7 + 40) % 360)
    return v.telemetry.select("event_id", r(geo.angle_between(c("yaw"), a1, c("event_id") % 10 / 10.0)).alias("yaw"))


@query(
    "C20 C21 C22 D12",
    """SELECT point_id, CASE WHEN confidence >= 0.6 THEN 'high' ELSE 'low' END AS class, round(0.4 * least(1, (n_views - 2) / 4) + 0.35 * greatest(0, 1 - reproj / 4) + 0.25 * least(1, angle / 10), 6) AS sparse_confidence,
round(least(greatest((n_views - 2) / 4, 0), 1) * 0.4 + 0.45, 6) AS dense_confidence, CASE WHEN confidence >= 0.6 AND coalesce(sigma_major, 'inf'::DOUBLE) > 0.12 THEN 'low' WHEN confidence >= 0.6 THEN 'high' ELSE 'low' END AS demoted FROM points""",
)
def c20_confidence_classes(v):
    high = c("confidence") >= 0.6
    n = (c("n_views") - 2) / 4.0
    return v.points.select(
        "point_id",
        F.when(high, "high").otherwise("low").alias("class"),
        r(0.4 * F.least(F.lit(1.0), n) + 0.35 * F.greatest(F.lit(0.0), 1 - c("reproj") / 4) + 0.25 * F.least(F.lit(1.0), c("angle") / 10)).alias("sparse_confidence"),
        r(F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0)) * 0.4 + 0.45).alias("dense_confidence"),
        F.when(high & (F.coalesce("sigma_major", F.lit(float("inf"))) > 0.12), "low").when(high, "high").otherwise("low").alias("demoted"),
    )


@query(
    "C23",
    """WITH d AS (SELECT p.point_id, p.angle, p.n_views, min(sqrt((p.x - k.cx) ^ 2 + (p.y - k.cy) ^ 2 + (p.z - k.cz) ^ 2)) AS near FROM points p, cameras k GROUP BY ALL)
SELECT point_id, CASE WHEN angle < 0.5 THEN 'inf'::DOUBLE ELSE round(sqrt((near / 800 / sqrt(least(greatest(n_views, 2), 4)) / sin(radians(angle))) ^ 2 + 0.01 ^ 2), 8) END AS sigma FROM d""",
)
def c23_depth_sigma(v):
    """Range noise over the sine of the parallax; unobservable below half a degree."""
    k = v.cameras.select("camera_id", c("cx").alias("x"), c("cy").alias("y"), c("cz").alias("z"))
    near = spatial.nearest(v.points.select("point_id", "x", "y", "z", "n_views", "angle"), k, "point_id", "camera_id", ["x", "y", "z"], 1, 64.0)
    dist = c("d")
    n = F.least(F.greatest(c("n_views"), F.lit(2)), F.lit(4))
    s = F.hypot(dist / 800 / F.sqrt(n) / F.sin(F.radians("angle")), F.lit(0.01))
    return near.select(c("q.*"), "d").select("point_id", F.when(c("angle") < 0.5, float("inf")).otherwise(r(s, 8)).alias("sigma"))


@query("C24", """SELECT camera_id, coalesce(CASE WHEN camera_id % 3 = 0 THEN 900e0 END, CASE WHEN camera_id % 3 = 1 THEN 800e0 END, 0.9 * 1280) AS fx, CASE WHEN camera_id % 3 = 0 THEN 'override' WHEN camera_id % 3 = 1 THEN 'telemetry' ELSE 'estimate' END AS source,
abs(1280 / 720 - (1280 + camera_id % 50) / 720) > 0.02 * 1280 / 720 AS aspect_warning FROM cameras""")
def c24_intrinsics_cascade(v):
    k = c("camera_id")
    return v.cameras.select(
        "camera_id",
        F.coalesce(F.when(k % 3 == 0, 900.0), F.when(k % 3 == 1, 800.0), F.lit(0.9 * 1280)).alias("fx"),
        F.when(k % 3 == 0, "override").when(k % 3 == 1, "telemetry").otherwise("estimate").alias("source"),
        (F.abs(F.lit(1280 / 720) - (k % 50 + 1280) / 720.0) > 0.02 * 1280 / 720).alias("aspect_warning"),
    )


@query("C25", "SELECT point_id, round((r / 255 - 0.5) / 0.28209479177387814, 6) AS dc, CASE WHEN confidence > 0 THEN round(ln(least(confidence, 0.99) / (1 - least(confidence, 0.99))), 6) END AS logit FROM points")
def c25_splat_colour(v):
    p = F.least("confidence", F.lit(0.99))
    return v.points.select("point_id", r((c("r") / 255.0 - 0.5) / 0.28209479177387814).alias("dc"), F.when(c("confidence") > 0, r(F.log(p / (1 - p)))).alias("logit"))


_TRUST = """t AS (SELECT point_id, least(n_views / 24, 1) AS o, CASE WHEN reproj > 0 THEN exp(-reproj / 0.45) END AS n, least(angle / 35, 1) AS e, CASE WHEN provenance IN (0, 1) THEN 1e0 WHEN provenance = 4 THEN NULL ELSE 0e0 END AS p FROM points)"""


@query("C26 C27", f"""WITH {_TRUST} SELECT point_id, round((0.25 * o + 0.15 * coalesce(n, 0) + 0.25 * e + 0.35 * coalesce(p, 0)) / (0.5 + CASE WHEN n IS NULL THEN 0 ELSE 0.15 END + CASE WHEN p IS NULL THEN 0 ELSE 0.35 END), 6) AS trust FROM t""")
def c27_trust_score(v):
    """Weights of absent terms go to the present ones."""
    terms = {
        "o": F.least(c("n_views") / 24.0, F.lit(1.0)),
        "n": F.when(c("reproj") > 0, F.exp(-c("reproj") / 0.45)),
        "e": F.least(c("angle") / 35, F.lit(1.0)),
        "p": F.when(c("provenance").isin(0, 1), 1.0).when(c("provenance") == 4, None).otherwise(0.0),
    }
    w = {"o": 0.25, "n": 0.15, "e": 0.25, "p": 0.35}
    t = v.points.withColumns(terms)
    top = sum((w[k] * F.coalesce(k, F.lit(0.0)) for k in "nep"), w["o"] * F.coalesce("o", F.lit(0.0)))
    mass = sum((F.when(c(k).isNull(), 0.0).otherwise(w[k]) for k in "nep"), F.when(c("o").isNull(), 0.0).otherwise(w["o"]))
    return t.select("point_id", r(F.when(mass > 0, top / mass).otherwise(F.raise_error(F.lit("no trust term is present")))).alias("trust"))


# First UTC day of each leap second count of GPS minus UTC.
LEAPS = [("1981-07-01", 1), ("1982-07-01", 2), ("1983-07-01", 3), ("1985-07-01", 4), ("1988-01-01", 5), ("1990-01-01", 6), ("1991-01-01", 7), ("1992-07-01", 8), ("1993-07-01", 9),
         ("1994-07-01", 10), ("1996-01-01", 11), ("1997-07-01", 12), ("1999-01-01", 13), ("2006-01-01", 14), ("2009-01-01", 15), ("2012-07-01", 16), ("2015-07-01", 17), ("2017-01-01", 18)]


def gps_minus_utc(day):
    """Seconds by a chain over the table, latest first."""
    out = F.lit(0)
    for d, n in LEAPS:
        out = F.when(day >= F.lit(d), n).otherwise(out)
    return out


@query(
    "C29",
    "SELECT o_orderkey, (CASE " + " ".join(f"WHEN strftime(o_orderdate, '%Y-%m-%d') >= '{d}' THEN {n}" for d, n in reversed(LEAPS)) + """ ELSE 0 END)::INTEGER AS leap,
floor((epoch_us(o_orderdate) / 1000000 - 315964800) / 604800)::BIGINT AS week, ((epoch_us(o_orderdate) // 1000000 - 315964800) % 604800)::BIGINT AS tow FROM orders""",
)
def c29_gps_time(v):
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)") - 315964800
    return v.orders.select("o_orderkey", gps_minus_utc(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("leap"), F.floor(s / 604800).alias("week"), F.pmod(s, F.lit(604800)).alias("tow"))


@query("C30", "SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END * (event_id % 90 + (event_id % 60) / 6e1 + (event_id * 7 % 600) / 1e1 / 3600), 8) AS deg FROM telemetry")
def c30_dms(v):
    """The sign of the degree token holds for minutes and seconds too, '-0' included."""
    e = c("event_id")
    d = F.concat(F.when(e % 4 == 0, "-").otherwise(""), (e % 90).cast("string"))
    return v.telemetry.select("event_id", r(dms(d, (e % 60).cast("double"), e * 7 % 600 / 10.0), 8).alias("deg"))


def dms(deg, minutes, seconds):
    sign = F.when(F.trim(deg).startswith("-"), -1.0).otherwise(1.0)
    return sign * (F.abs(F.expr("try_cast(NULL as double)") if deg is None else deg.try_cast("double")) + minutes / 60 + seconds / 3600)


@query("C32", "SELECT point_id, round(22 + degrees(y / 6378137), 9) AS lat, round(114 + degrees(x / (6378137 * cos(radians(22)))), 9) AS lon FROM points")
def c32_spherical_lat_lon(v):
    la, lo = geo.spherical_lat_lon(c("x"), c("y"), F.lit(22.0), F.lit(114.0))
    return v.points.select("point_id", r(la, 9).alias("lat"), r(lo, 9).alias("lon"))


@query("C31", "SELECT point_id, round((r * 4 - 640) * z / 800, 6) AS x, round((g * 2 - 360) * z / 800, 6) AS y, z FROM points")
def c31_depth_back_projection(v):
    """Pixels with their depth, back in the camera's frame."""
    return v.points.select("point_id", r((c("r") * 4 - _CX) * c("z") / _F).alias("x"), r((c("g") * 2 - _CY) * c("z") / _F).alias("y"), "z")
