"""Options of the readers, lookups, statistics and stores that the plain queries leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import asof, graph, order, raster, spatial
from ..sources import cloud_files, synthetic, telemetry
from .queries_geo import LEAPS, gps_minus_utc
from .registry import query

c = F.col
INF = float("inf")


def r(x, n=6):
    return F.round(x, n)


# Readers
@query("A08 J01", "SELECT event_id, yaw AS gimbal_yaw, (event_id * 3 % 90 - 45)::DOUBLE AS gimbal_pitch, (event_id % 30 - 15)::DOUBLE AS gimbal_roll, CASE WHEN event_id % 2 = 0 THEN (event_id % 360)::DOUBLE END AS flight_yaw, CASE WHEN event_id % 3 = 0 THEN (20 + event_id % 10)::DOUBLE END AS focal FROM telemetry")
def a08_attitudes(v):
    """Camera and airframe attitude and focal length out of subtitle blocks; what a block hasn't is null."""
    e = c("event_id")
    text = lambda name, x: F.concat(F.lit(f"[{name}: "), x.cast("double").cast("string"), F.lit("]"))
    block = F.concat_ws(" ", F.lit("[latitude: 22.5] [longitude: 114.0]"), text("gb_yaw", c("yaw")), text("gb_pitch", e * 3 % 90 - 45), text("gimbal_roll", e % 30 - 15), F.when(e % 2 == 0, text("drone_yaw", e % 360)), F.when(e % 3 == 0, text("focal_len", e % 10 + 20)))
    return telemetry.attitudes(v.telemetry.select(e, block.alias("block"))).select(e, "gimbal_yaw", "gimbal_pitch", "gimbal_roll", "flight_yaw", "focal")


_T = "1704067200 + event_id % 86400"


@query("A10 A11 J03 J04 C29 C30", f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN ({_T} - 18)::DOUBLE WHEN 1 THEN ({_T})::DOUBLE ELSE ({_T} - 32400)::DOUBLE END AS utc, round(CASE WHEN event_id % 3 = 1 THEN floor(lat) + 30 / 6e1 + 15 / 3.6e3 ELSE lat END, 6) AS latitude, round(lon, 6) AS longitude, round(alt, 3) AS altitude,
CASE event_id % 3 WHEN 0 THEN 'ellipsoidal' WHEN 1 THEN 'msl' ELSE 'unknown' END AS datum FROM (SELECT event_id, lat, CASE WHEN event_id % 3 = 1 THEN floor(lon) + 12 / 6e1 ELSE lon END AS lon, alt FROM telemetry)""")
def a10_solution_forms(v):
    """Three files at once: degrees by GPS time, degrees-minutes-seconds by UTC, geocentric by JST; each file's header says which it is."""
    e = c("event_id")
    k = e % 3
    num = lambda x, f="%.9f": F.format_string(f, x)
    stamp = F.date_format(F.timestamp_seconds(1704067200 + e % 86400), "yyyy/MM/dd HH:mm:ss.000")
    xyz = geo.geodetic_to_ecef(c("lat"), c("lon"), c("alt"))
    deg = F.concat_ws(" ", num(c("lat")), num(c("lon")), num(c("alt")))
    dms = F.concat_ws(" ", F.floor("lat").cast("string"), F.lit("30"), F.lit("15.0"), F.floor("lon").cast("string"), F.lit("12"), F.lit("0.0"), num(c("alt")))
    body = F.when(k == 0, deg).when(k == 1, dms).otherwise(F.concat_ws(" ", *[num(a, "%.6f") for a in xyz]))
    rows = v.telemetry.select(k.alias("file"), e, F.concat_ws(" ", stamp, body, F.lit("1 12")).alias("line"))
    heads = ("% (lat/lon/height=WGS84/ellipsoidal)", "%  GPST  latitude(deg) longitude(deg) height(m) Q ns"), ("% (lat/lon/height=WGS84/geodetic)", "%  UTC  latitude(d'\") longitude(d'\") height(m) Q ns"), ("%  JST  x-ecef(m) y-ecef(m) z-ecef(m) Q ns",)
    names = F.array(*[F.struct(F.lit(n).cast("long").alias("file"), F.lit(x).alias("line")) for n, lines in enumerate(heads) for x in lines])
    head = v.spark.range(1).select(F.explode(names).alias("h")).select("h.file", F.lit(None).cast("long").alias("event_id"), "h.line")
    out = telemetry.from_pos_files(rows.unionByName(head), "file", gps_minus_utc)
    return out.select("event_id", "utc", r(c("latitude")).alias("latitude"), r(c("longitude")).alias("longitude"), r(c("altitude"), 3).alias("altitude"), "datum")


@query("A12 F19 F20", "SELECT CASE WHEN fix IN ('view', 'click') THEN 'fixed' WHEN fix = 'signup' THEN 'float' ELSE 'other' END AS bucket, count(*) AS n, min(t) AS first, max(t) AS last FROM telemetry GROUP BY 1")
def a12_load_summary(v):
    """What loading tells besides the samples: counts by fix quality, and the time each spans."""
    b = F.when(c("fix").isin("view", "click"), "fixed").when(c("fix") == "signup", "float").otherwise("other")
    return v.telemetry.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


_REGIMES = """SELECT 'orbit' AS regime, i AS frame, 40 * cos(i * 2 * pi() / 120) AS e, 40 * sin(i * 2 * pi() / 120) AS n, 60e0 AS u FROM range(0, 120) t(i) UNION ALL SELECT 'nadir_grid', i, (i % 10) * 8e0 - 36, floor(i / 10) * 8e0 - 36, 70e0 FROM range(0, 120) t(i)
UNION ALL SELECT 'oblique_pass', i, -60 + i, -40e0, 50e0 FROM range(0, 120) t(i) UNION ALL SELECT 'low_parallax', i, i / 12e1, 0e0, 60e0 FROM range(0, 120) t(i)"""


@query("A24 A25", f"SELECT regime, frame, round(e, 6) AS e, round(n, 6) AS n, u FROM ({_REGIMES})")
def a25_regimes(v):
    """The four capture regimes in closed form."""
    out = None
    for name in ("orbit", "nadir_grid", "oblique_pass", "low_parallax"):
        t = synthetic.trajectory(v.spark, name, 120).select(F.lit(name).alias("regime"), "frame", r(c("e")).alias("e"), r(c("n")).alias("n"), "u")
        out = t if out is None else out.unionByName(t)
    return out


@query("A24 A28", "SELECT 'within three sigmas' AS what, true AS e, true AS n, true AS u, true AS again")
def a28_noisy_positions(v):
    """Noise from hashes: its spread is the asked one, and the same flight comes back each time."""
    t = synthetic.trajectory(v.spark, "orbit", 4000)
    g = synthetic.gps(t)
    d = g.join(t.select("frame", *[c(k).alias(f"t{k}") for k in "enu"]), "frame").join(synthetic.gps(t).select("frame", c("e").alias("e2")), "frame")
    near = lambda k, s: (F.abs(F.stddev(c(k) - c(f"t{k}")) - s) < 0.1 * s).alias(k)
    return d.agg(F.lit("within three sigmas").alias("what"), near("e", 2.5), near("n", 2.5), near("u", 4.0), F.bool_and(c("e") == c("e2")).alias("again"))


@query("A26 J11", "SELECT p_brand AS dir, count(*) AS n_files, sum(length(p_name))::BIGINT AS bytes, count(*) FILTER (WHERE p_partkey % 9 = 0) AS pointers, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT *, 'f' || p_partkey || ':' || sha256(CASE WHEN p_partkey % 9 = 0 THEN 'version https://git-lfs' || chr(10) || p_name ELSE p_name END) AS line FROM part) GROUP BY 1")
def a26_file_inventory(v):
    """Files by folder: count, bytes, how many are mere pointers to a large file, and a digest over their sorted name:hash lines."""
    pointer = c("p_partkey") % 9 == 0
    content = F.when(pointer, F.concat(F.lit("version https://git-lfs\n"), c("p_name"))).otherwise(c("p_name"))
    files = v.part.select(c("p_brand").alias("dir"), F.concat(F.lit("f"), c("p_partkey").cast("string")).alias("name"), F.encode(content, "UTF-8").alias("content"), F.length("p_name").alias("size"))
    return cloud_files.inventory(files).select("dir", "n_files", "bytes", "pointers", "digest")


@query("A27 C17", "SELECT camera_id AS image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM cameras")
def a27_binary_poses(v):
    """Poses in the binary layout, by yaw, pitch and roll: written, parsed, and the centres come back."""
    m = geo.rotation_zyx(c("yaw"), c("pitch"), c("roll"))
    q = geo.quaternion(m)
    t = [-(row[0] * c("cx") + row[1] * c("cy") + row[2] * c("cz")) for row in m]
    poses = v.cameras.select(c("camera_id").alias("image_id"), *[x.alias(f"q{k}") for x, k in zip(q, "wxyz")], *[x.alias(f"t{k}") for x, k in zip(t, "xyz")])
    return cloud_files.from_binary_poses(cloud_files.to_binary_poses(poses)).select("image_id", *[r(c(k)).alias(k) for k in ("cx", "cy", "cz")])


@query("C17", "SELECT camera_id, round(abs(sin(radians(pitch))), 6) AS sine, true AS unit, true AS back FROM cameras")
def c17_quaternion_and_back(v):
    """A matrix to a quaternion and back is the matrix again, and the viewer's axes are the rows turned over."""
    m = geo.rotation_zyx(c("yaw"), c("pitch"), c("roll"))
    q = v.cameras.select("camera_id", *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)], *[x.alias(f"q{k}") for x, k in zip(geo.quaternion(m), "wxyz")])
    back = geo.matrix(tuple(c(f"q{k}") for k in "wxyz"))
    off = F.greatest(*[F.abs(back[i][j] - c(f"m{i}{j}")) for i in range(3) for j in range(3)])
    three = geo.viewer_axes([[c(f"m{i}{j}") for j in range(3)] for i in range(3)])
    size = sum((c(f"q{k}") * c(f"q{k}") for k in "xyz"), c("qw") * c("qw"))
    return q.select("camera_id", r(F.abs(three[0][2])).alias("sine"), (F.abs(size - 1) < 1e-9).alias("unit"), (off < 1e-9).alias("back"))


# Coordinates
_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"  # fixed values: the letters grid squares go by
_BANDS = "CDEFGHJKLMNPQRSTUVWX"


@query("C07 C05 C06", f"""WITH z AS (SELECT event_id, lat, lon, least(floor((lon + 180) / 6)::BIGINT + 1, 60) AS zone FROM telemetry), p AS (SELECT *, radians(lat) AS la, radians(lon - (zone * 6 - 183)) AS lo FROM z),
q AS (SELECT *, sinh(atanh(sin(la)) - {2 * geo._N**0.5 / (1 + geo._N)!r}::DOUBLE * atanh({2 * geo._N**0.5 / (1 + geo._N)!r}::DOUBLE * sin(la))) AS tt FROM p), w AS (SELECT *, atan2(tt, cos(lo)) AS xi, atanh(sin(lo) / sqrt(1 + tt * tt)) AS eta FROM q),
u AS (SELECT *, 500000 + 0.9996::DOUBLE * {geo._RADIUS!r}::DOUBLE * (eta + {geo._ALPHA[0]!r}::DOUBLE * cos(2 * xi) * sinh(2 * eta) + {geo._ALPHA[1]!r}::DOUBLE * cos(4 * xi) * sinh(4 * eta) + {geo._ALPHA[2]!r}::DOUBLE * cos(6 * xi) * sinh(6 * eta)) AS e,
0.9996::DOUBLE * {geo._RADIUS!r}::DOUBLE * (xi + {geo._ALPHA[0]!r}::DOUBLE * sin(2 * xi) * cosh(2 * eta) + {geo._ALPHA[1]!r}::DOUBLE * sin(4 * xi) * cosh(4 * eta) + {geo._ALPHA[2]!r}::DOUBLE * sin(6 * xi) * cosh(6 * eta)) AS n FROM w)
SELECT event_id, zone || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS zone, round(e, 3) AS easting, round(n, 3) AS northing, zone || substr('{_BANDS}', floor((lat + 80) / 8)::INTEGER + 1, 1) || substr('{_LETTERS}', ((zone - 1) % 3 * 8 + floor(e / 100000)::BIGINT - 1)::INTEGER + 1, 1) || substr('{_LETTERS[:20]}', ((floor(n / 100000)::BIGINT + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20)::INTEGER + 1, 1) || lpad((floor(e)::BIGINT % 100000)::VARCHAR, 5, '0') || lpad((floor(n)::BIGINT % 100000)::VARCHAR, 5, '0') AS grid_reference FROM u""")
def c07_grid_reference(v):
    """A point's zone, easting and northing, and its grid reference to a metre (northern half)."""
    zone = F.least(F.floor((c("lon") + 180) / 6) + 1, F.lit(60).cast("long"))
    t = v.telemetry.select("event_id", "lat", "lon", zone.alias("z"))
    e, n = geo.utm(c("lat"), c("lon"), (c("z") * 6 - 183).cast("double"))
    u = t.withColumns({"e": e, "n": n})
    letter = lambda letters, k: F.substring(F.lit(letters), (k + 1).cast("int"), F.lit(1))
    digits = lambda x: F.lpad((F.floor(x) % 100000).cast("string"), 5, "0")
    square = letter(_LETTERS, (c("z") - 1) % 3 * 8 + F.floor(c("e") / 100000) - 1), letter(_LETTERS[:20], (F.floor(c("n") / 100000) + F.when(c("z") % 2 == 0, 5).otherwise(0)) % 20)
    return u.select("event_id", F.concat(c("z").cast("string"), F.when(c("lat") >= 0, "N").otherwise("S")).alias("zone"), r(c("e"), 3).alias("easting"), r(c("n"), 3).alias("northing"), F.concat(c("z").cast("string"), letter(_BANDS, F.floor((c("lat") + 80) / 8)), *square, digits(c("e")), digits(c("n"))).alias("grid_reference"))


# Lookups and windows
@query("E15", """WITH RECURSIVE e AS (SELECT i AS a, j AS b FROM edges UNION SELECT j, i FROM edges), n AS (SELECT DISTINCT a AS node FROM e), walk AS (SELECT node, node AS reach FROM n UNION SELECT w.node, e.b FROM walk w JOIN e ON w.reach = e.a), l AS (SELECT node, min(reach) AS track FROM walk GROUP BY 1),
f AS (SELECT track, node % 10 AS frame, max(node) AS feature FROM l GROUP BY 1, 2) SELECT track, frame, feature FROM f WHERE track IN (SELECT track FROM f GROUP BY 1 HAVING count(*) >= 2)""")
def e15_tracks(v):
    """Tracks from components of matched features: one feature a frame, and two frames at least."""
    e = v.edges.select("i", "j").distinct()
    label = graph.components(e.select(c("i").alias("node")).union(e.select("j")).distinct(), e, "node", "i", "j")
    f = label.groupBy(c("label").alias("track"), (c("node") % 10).alias("frame")).agg(F.max("node").alias("feature"))
    many = f.groupBy("track").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("track")
    return f.join(many, "track", "left_semi")


@query("E16 H08", """WITH d AS (SELECT a.camera_id AS i, b.camera_id AS j, sqrt((a.cx - b.cx) ^ 2 + (a.cy - b.cy) ^ 2) AS d FROM cameras a JOIN cameras b ON a.camera_id <> b.camera_id), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS rk FROM d WHERE d <= 20)
SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM k WHERE rk <= 10""")
def e16_space_neighbours(v):
    """Pairs near in space: each camera brings at most its ten nearest within reach."""
    q = v.cameras.select("camera_id", "cx", "cy")
    g = spatial.within(q, q, ["cx", "cy"], 20.0).where("q.camera_id <> p.camera_id")
    rank = F.row_number().over(Window.partitionBy("q.camera_id").orderBy(F.round("d", 9), "p.camera_id"))
    k = g.withColumn("rk", rank).where("rk <= 10")
    return k.select(F.least("q.camera_id", "p.camera_id").alias("i"), F.greatest("q.camera_id", "p.camera_id").alias("j")).distinct()


@query("E21", """WITH q AS (SELECT point_id, x + 0.1 AS x, y, z, point_id * 2.5e-1 - 18 AS t FROM points), n AS (SELECT q.point_id, q.t, p.point_id * 2.5e-1 AS ts, sqrt((q.x - p.x) ^ 2 + (q.y - p.y) ^ 2 + (q.z - p.z) ^ 2) AS d, row_number() OVER (PARTITION BY q.point_id ORDER BY round(sqrt((q.x - p.x) ^ 2 + (q.y - p.y) ^ 2 + (q.z - p.z) ^ 2), 9), p.point_id) AS rk FROM q, points p)
SELECT round(median(ts - t), 6) AS "offset", round(median(d), 6) AS distance, quantile_cont(ts - t, 0.9) - quantile_cont(ts - t, 0.1) > 1 OR median(d) > 5 AS refused FROM n WHERE rk = 1""")
def e21_time_basis(v):
    """The shift between two clocks from where both were: refused if it varies by over a second, or the places are over five metres apart."""
    q = v.points.select("point_id", (c("x") + 0.1).alias("x"), "y", "z", (c("point_id") * 0.25 - 18).alias("t"))
    p = v.points.select("point_id", "x", "y", "z", (c("point_id") * 0.25).alias("t"))
    n = spatial.nearest(q, p, "point_id", "point_id", ["x", "y", "z"], 1, 4.0).select((c("p.t") - c("q.t")).alias("s"), "d")
    wide = F.percentile("s", F.lit(0.9)) - F.percentile("s", F.lit(0.1))
    return n.agg(r(F.median("s")).alias("offset"), r(F.median("d")).alias("distance"), ((wide > 1) | (F.median("d") > 5)).alias("refused"))


@query("D03 H06", None)
def d03_keyframes_between(v):
    """Keyframes with a floor of 30 evenly spread frames of a run and a cap of 40."""
    from .queries_join import d03_keyframes

    run = v.cameras.select(F.floor(c("camera_id") / 50).alias("segment"), "camera_id")
    place = run.withColumn("k", F.row_number().over(Window.partitionBy("segment").orderBy("camera_id")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("segment")))  # runs of 50 frames
    least = F.least(c("n"), F.lit(30))
    slot = F.floor(c("i") * (c("n") - 1) / F.greatest(least - 1, F.lit(1)))
    floor = place.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), least - 1))).where(c("k") == slot).select("segment", "camera_id").distinct()
    chosen = d03_keyframes(v)
    few = chosen.groupBy("segment").agg(F.count(F.lit(1)).alias("m")).join(place.groupBy("segment").agg(F.first("n").alias("n")), "segment").where("m < least(n, 30)").select("segment")
    every = chosen.unionByName(floor.join(few, "segment", "left_semi")).distinct()
    w = Window.partitionBy("segment")
    ranked = every.withColumn("k", F.row_number().over(w.orderBy("camera_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    kept = ranked.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(c("n"), F.lit(40)) - 1))).where(c("k") == F.floor(c("i") * (c("n") - 1) / F.greatest(F.least(c("n"), F.lit(40)) - 1, F.lit(1))))
    return kept.select("segment", "camera_id").distinct()


@query("G17 H06", "WITH p AS (SELECT o_orderkey AS id, o_orderkey % 60 AS a, o_orderkey % 60 + 5 + o_orderkey % 35 AS b FROM orders), f AS (SELECT id, camera_id, row_number() OVER (PARTITION BY id ORDER BY camera_id) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM p JOIN cameras ON camera_id > a AND camera_id < b) SELECT DISTINCT id, camera_id FROM f, range(6) t(i) WHERE CASE WHEN n <= 6 THEN true ELSE k = floor(i * (n - 1) / 5) END")
def g17_chain_path(v):
    """The frames between two others, at most six, evenly spread."""
    k = c("o_orderkey")
    p = v.orders.select(k.alias("id"), F.explode(F.sequence(k % 60 + 1, k % 60 + 4 + k % 35)).alias("camera_id"))
    w = Window.partitionBy("id")
    f = p.join(v.cameras.select("camera_id"), "camera_id", "left_semi").withColumn("k", F.row_number().over(w.orderBy("camera_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    slots = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.floor(i * (c("n") - 1) / 5))
    return f.where((c("n") <= 6) | F.array_contains(slots, c("k").cast("long"))).select("id", "camera_id")


@query("G02 G03", """WITH s AS (SELECT track, (t + lag(t) OVER w) / 2 AS m, (lat - lag(lat) OVER w) / (t - lag(t) OVER w) AS speed FROM telemetry WINDOW w AS (PARTITION BY track ORDER BY t, event_id) QUALIFY t > lag(t) OVER w),
g AS (SELECT track, unnest(range((floor(min(m) / 86400) + 1)::BIGINT, floor(max(m) / 86400)::BIGINT + 1)) * 86400e0 AS t FROM s GROUP BY 1), b AS (SELECT g.track, g.t, p.m AS m0, p.speed AS s0, n.m AS m1, n.speed AS s1 FROM g ASOF JOIN s p ON g.track = p.track AND g.t > p.m ASOF JOIN s n ON g.track = n.track AND g.t <= n.m)
SELECT track, t, round((s0 + (s1 - s0) * (t - m0) / (m1 - m0)) * 1e6, 4) AS speed FROM b""")
def g02_uniform_speed(v):
    """Speeds at the middles between samples, interpolated onto a uniform grid of days."""
    w = Window.partitionBy("track").orderBy("t", "event_id")
    s = v.telemetry.select("track", ((c("t") + F.lag("t").over(w)) / 2).alias("m"), (c("lat") - F.lag("lat").over(w)).alias("d"), (c("t") - F.lag("t").over(w)).alias("dt")).where("dt > 0").select("track", c("m").alias("t"), (c("d") / c("dt")).alias("speed"))
    s = graph.cut(s)
    day = 86400.0
    g = s.groupBy("track").agg(F.min("t").alias("a"), F.max("t").alias("b")).where(F.floor(c("a") / day) + 1 <= F.floor(c("b") / day)).select("track", F.explode(F.sequence(F.floor(c("a") / day) + 1, F.floor(c("b") / day))).alias("k")).select("track", (c("k") * day).alias("t"))
    b = asof.bracket(g, s, "track", "t", ["speed"], width=10 * day)
    return b.select("track", "t", r(asof.between("speed", asof.share(c("t"))) * 1e6, 4).alias("speed"))


# Statistics
_JAC = "j AS (SELECT o.point_id, 800 / (k.cz - p.z) AS a, -800 * (p.x - k.cx) / (k.cz - p.z) ^ 2 AS b, -800 * (k.cy - p.y) / (k.cz - p.z) ^ 2 AS d FROM observations o JOIN points p USING (point_id) JOIN cameras k USING (camera_id)), m AS (SELECT point_id, count(*) AS n, sum(a * a) AS xx, sum(a * b) AS xz, sum(a * d) AS yz, sum(b * b + d * d) AS zz FROM j GROUP BY 1)"


@query("F09", f"""WITH {_JAC}, l AS (SELECT *, (xx + zz) / 2 - sqrt(((xx - zz) / 2) ^ 2 + xz ^ 2 + yz ^ 2) AS least, (xx + zz) / 2 + sqrt(((xx - zz) / 2) ^ 2 + xz ^ 2 + yz ^ 2) AS most FROM m)
SELECT point_id, round(1 / sqrt(least), 6) AS sigma_major, round(sqrt(most / least), 4) AS condition, n >= 2 AND 1 / sqrt(least) <= 1000 AS observable FROM l WHERE least > most * 1e-12""")
def f09_worst_axis(v):
    """The worst axis's sigma and the condition of each point, from the eigenvalues of its information matrix, which are closed for level cameras."""
    o = v.observations.join(v.cameras, "camera_id").join(v.points, "point_id")
    dz = c("cz") - c("z")
    j = o.select("point_id", (800 / dz).alias("a"), (-800 * (c("x") - c("cx")) / (dz * dz)).alias("b"), (-800 * (c("cy") - c("y")) / (dz * dz)).alias("d"))
    m = j.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.sum(c("a") * c("a")).alias("xx"), F.sum(c("a") * c("b")).alias("xz"), F.sum(c("a") * c("d")).alias("yz"), F.sum(c("b") * c("b") + c("d") * c("d")).alias("zz"))
    half, gap = (c("xx") + c("zz")) / 2, F.sqrt(F.pow((c("xx") - c("zz")) / 2, F.lit(2.0)) + c("xz") * c("xz") + c("yz") * c("yz"))
    e = m.select("point_id", "n", (half - gap).alias("least"), (half + gap).alias("most")).where("least > most * 1e-12")
    s = 1 / F.sqrt("least")
    return e.select("point_id", r(s).alias("sigma_major"), r(F.sqrt(c("most") / c("least")), 4).alias("condition"), ((c("n") >= 2) & (s <= 1000)).alias("observable"))


@query("F29", "SELECT regime, mission, round(avg(abs(error)), 8) AS mean, round(quantile_cont(abs(error), 0.9), 8) AS p90, round(quantile_cont(abs(error), 0.99), 8) AS p99, round(median(error), 8) AS bias, round(avg(CASE WHEN abs(error) <= sigma THEN 1 ELSE 0 END), 6) AS within_1, round(avg(CASE WHEN abs(error) <= 2 * sigma THEN 1 ELSE 0 END), 6) AS within_2 FROM errors GROUP BY 1, 2")
def f29_distance_statistics(v):
    """Spread and bias of signed errors, and how many lie within one and two of their sigmas."""
    e = F.abs("error")
    p = lambda q, n: r(F.percentile(e, F.lit(q)), 8).alias(n)
    share = lambda k, n: r(F.avg((e <= k * c("sigma")).cast("int"))).alias(n)
    return v.errors.groupBy("regime", "mission").agg(r(F.avg(e), 8).alias("mean"), p(0.9, "p90"), p(0.99, "p99"), r(F.median("error"), 8).alias("bias"), share(1, "within_1"), share(2, "within_2"))


@query("F32 K20", """WITH fp AS (SELECT rw, cl FROM cells WHERE rw % 8 < 5 AND cl % 8 < 5), grown AS (SELECT DISTINCT rw + a AS rw, cl + b AS cl FROM fp, range(-1, 2) p(a), range(-1, 2) q(b)), core AS (SELECT a.rw, a.cl FROM fp a JOIN fp b ON abs(a.rw - b.rw) <= 1 AND abs(a.cl - b.cl) <= 1 GROUP BY 1, 2 HAVING count(*) = 9)
SELECT round(avg(CASE WHEN g.rw IS NOT NULL THEN 1 ELSE 0 END) FILTER (WHERE dsm > 9.5), 6) AS precision, round(avg(CASE WHEN dsm > 9.5 THEN 1 ELSE 0 END) FILTER (WHERE k2.rw IS NOT NULL), 6) AS recall, round(avg(CASE WHEN dsm <= 5 THEN 1 ELSE 0 END) FILTER (WHERE k2.rw IS NOT NULL), 6) AS roof_as_ground FROM cells k LEFT JOIN grown g USING (rw, cl) LEFT JOIN core k2 USING (rw, cl)""")
def f32_tolerant_score(v):
    """Precision against grown footprints, recall against their cores, and how much of a core is called ground."""
    fp = v.cells.where("rw % 8 < 5 and cl % 8 < 5").select("rw", "cl")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in raster.SQUARE])
    grown = fp.withColumn("s", F.explode(around)).select((c("rw") + c("s.a")).alias("rw"), (c("cl") + c("s.b")).alias("cl")).distinct().withColumn("grown", F.lit(True))
    core = raster.neighbours(fp, [], raster.SQUARE).groupBy("rw", "cl").count().where("count = 9").select("rw", "cl", F.lit(True).alias("core"))
    k = v.cells.select("rw", "cl", "dsm").join(grown, ["rw", "cl"], "left").join(core, ["rw", "cl"], "left")
    share = lambda x, of: r(F.avg(F.when(of, x.cast("int"))))
    return k.agg(share(c("grown").isNotNull(), c("dsm") > 9.5).alias("precision"), share(c("dsm") > 9.5, c("core").isNotNull()).alias("recall"), share(c("dsm") <= 5, c("core").isNotNull()).alias("roof_as_ground"))


@query("F33", """WITH s AS (SELECT track, t, event_id, lat, lon, acc, sqrt((lat - lag(lat) OVER w) ^ 2 + (lon - lag(lon) OVER w) ^ 2) AS d FROM telemetry WINDOW w AS (PARTITION BY track ORDER BY t, event_id)), e AS (SELECT track, acc, row_number() OVER (PARTITION BY track ORDER BY acc) AS rk, count(*) OVER (PARTITION BY track) AS n FROM s)
SELECT a.track, round(path, 6) AS path, round(sqrt((la1 - la0) ^ 2 + (lo1 - lo0) ^ 2), 6) AS net, e.acc AS eph FROM (SELECT track, coalesce(sum(d), 0) AS path, arg_min(lat, struct_pack(t := t, k := event_id)) AS la0, arg_max(lat, struct_pack(t := t, k := event_id)) AS la1, arg_min(lon, struct_pack(t := t, k := event_id)) AS lo0, arg_max(lon, struct_pack(t := t, k := event_id)) AS lo1 FROM s GROUP BY 1) a JOIN e ON e.track = a.track AND e.rk = n // 2 + 1""")
def f33_displacement(v):
    """Path, net displacement and the upper-middle accuracy of each track, an element by counts of distinct values."""
    w = Window.partitionBy("track").orderBy("t", "event_id")
    d = F.hypot(c("lat") - F.lag("lat").over(w), c("lon") - F.lag("lon").over(w))
    end = F.struct("t", "event_id", "lat", "lon")
    a = v.telemetry.select("track", "t", "event_id", "lat", "lon", d.alias("d")).groupBy("track").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("path"), F.min(end).alias("a"), F.max(end).alias("b"))
    k = v.telemetry.groupBy("track", "acc").agg(F.count(F.lit(1)).alias("m"))
    by = Window.partitionBy("track")
    mid = k.withColumn("upto", F.sum("m").over(by.orderBy("acc"))).withColumn("n", F.sum("m").over(by)).where(c("upto") >= F.floor(c("n") / 2) + 1).groupBy("track").agg(F.min("acc").alias("eph"))
    return a.join(mid, "track").select("track", r(c("path")).alias("path"), r(F.hypot(c("b.lat") - c("a.lat"), c("b.lon") - c("a.lon"))).alias("net"), "eph")


@query("F38", "SELECT round(greatest(quantile_cont(n_views, 0.95), 2), 6) AS views, round(greatest(quantile_cont(reproj, 0.95), 1e-3), 6) AS residual, round(greatest(quantile_cont(angle, 0.95), 1), 6) AS parallax FROM points")
def f38_saturation(v):
    """Where each evidence term saturates: its 95th percentile, floored."""
    top = lambda k, low: r(F.greatest(F.percentile(k, F.lit(0.95)), F.lit(float(low))))
    return v.points.agg(top("n_views", 2).alias("views"), top("reproj", 1e-3).alias("residual"), top("angle", 1).alias("parallax"))


@query("L07", """WITH ry AS (SELECT o.point_id, k.cx, k.cy, k.cz, (p.x - k.cx) / l AS a, (p.y - k.cy) / l AS b, (p.z - k.cz) / l AS d, 1 / (0.01 + o.camera_id % 5 / 1e2) ^ 2 AS w FROM (SELECT DISTINCT point_id, camera_id FROM observations) o JOIN points p USING (point_id) JOIN cameras k USING (camera_id), LATERAL (SELECT sqrt((p.x - k.cx) ^ 2 + (p.y - k.cy) ^ 2 + (p.z - k.cz) ^ 2) AS l)),
m AS (SELECT point_id, count(*) AS n, sum(w * (1 - a * a)) AS xx, sum(-w * a * b) AS xy, sum(-w * a * d) AS xz, sum(w * (1 - b * b)) AS yy, sum(-w * b * d) AS yz, sum(w * (1 - d * d)) AS zz FROM ry GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM m)
SELECT point_id, n, round((yy * zz - yz * yz) / det, 9) AS cxx, round((xx * zz - xz * xz) / det, 9) AS cyy, round((xx * yy - xy * xy) / det, 9) AS czz FROM t""")
def l07_weighted_covariance(v):
    """Covariance of the meeting point of rays weighed by their sigmas: the inverse of the weighted normal matrix."""
    o = v.observations.select("point_id", "camera_id").distinct().join(v.cameras, "camera_id").join(v.points, "point_id")
    size = F.sqrt((c("x") - c("cx")) ** 2 + (c("y") - c("cy")) ** 2 + (c("z") - c("cz")) ** 2)
    d = [(c(p) - c(k)) / size for p, k in zip("xyz", ("cx", "cy", "cz"))]
    w = 1 / F.pow(0.01 + c("camera_id") % 5 / 100.0, F.lit(2.0))
    at = {"xx": (0, 0), "xy": (0, 1), "xz": (0, 2), "yy": (1, 1), "yz": (1, 2), "zz": (2, 2)}
    m = o.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(w * ((1.0 if i == j else 0.0) - d[i] * d[j])).alias(k) for k, (i, j) in at.items()]).where("n >= 3")
    xx, xy, xz, yy, yz, zz = (c(k) for k in at)
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    return m.select("point_id", "n", r((yy * zz - yz * yz) / det, 9).alias("cxx"), r((xx * zz - xz * xz) / det, 9).alias("cyy"), r((xx * yy - xy * xy) / det, 9).alias("czz"))


# Life cycles and stores
@query("M16 I05", """WITH f AS (SELECT s_suppkey AS profile, s_suppkey % 5 AS fit, (s_suppkey * 3 + 1) % 7 AS held, 15 + s_suppkey % 10 AS n, CASE WHEN s_suppkey % 3 <> 0 THEN 'chief' END AS approver FROM supplier), e AS (SELECT *, fit <> held AS disjoint FROM f)
SELECT profile, CASE WHEN NOT disjoint THEN 'fitted' WHEN approver IS NULL THEN 'evaluated' ELSE 'released' END AS state, disjoint AND approver IS NOT NULL AND n >= 20 AS usable FROM e""")
def m16_profile_lifecycle(v):
    """Fitted, evaluated on missions it wasn't fitted to, released by a name: only then, and with twenty samples, it may be used."""
    k = c("s_suppkey")
    f = v.supplier.select(k.alias("profile"), F.array(k % 5).alias("fit"), F.array((k * 3 + 1) % 7).alias("held"), (k % 10 + 15).alias("n"), F.when(k % 3 != 0, "chief").alias("approver"))
    evaluated = ~F.arrays_overlap("fit", "held") & (F.size("held") > 0)
    state = F.when(~evaluated, "fitted").when(c("approver").isNull(), "evaluated").otherwise("released")
    return f.withColumn("state", state).select("profile", "state", ((c("state") == "released") & (c("n") >= 20)).alias("usable"))


@query("M18", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'measured again' WHEN o_orderkey % 4 = 0 THEN 'decided again' ELSE 'unchanged' END AS what, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 7 + 1 ELSE o_orderkey % 7 END AS version FROM orders")
def m18_what_an_update_needs(v):
    """A new tolerance alone is decided on what was measured; a newer artifact means measuring again, on its version."""
    k = c("o_orderkey")
    q = v.orders.select(k.alias("id"), (k % 7).alias("measured_on"), F.when(k % 6 == 0, k % 7 + 1).otherwise(k % 7).alias("artifact"), (k % 4 == 0).alias("new_tolerance"))
    stale = c("artifact") > c("measured_on")
    return q.select("id", F.when(stale, "measured again").when(c("new_tolerance"), "decided again").otherwise("unchanged").alias("what"), F.when(stale, c("artifact")).otherwise(c("measured_on")).alias("version"))


@query("N01", "SELECT user_id AS job, event_id, event_type AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, min(event_id) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id) AS ended FROM events) WHERE (before IS NULL OR before <> event_type) AND (ended IS NULL OR event_id <= ended)")
def n01_job_events(v):
    """What a client of a job's events gets: each change of state once, nothing after the job ended; tests hold the stateful stream against it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = v.events.select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("before"))
    end = v.events.where("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("ended"))
    return e.join(end, "user_id", "left").where("(before is null or before <> event_type) and (ended is null or event_id <= ended)").select(c("user_id").alias("job"), "event_id", c("event_type").alias("state"))


@query("Q03 Q04", "WITH p AS (SELECT p_brand AS project, count(*) AS parts FROM part GROUP BY 1), gone AS (SELECT p_brand AS project FROM part GROUP BY 1 HAVING min(p_partkey) % 4 = 0) SELECT a.p_partkey AS id, a.p_brand AS project, NULL::VARCHAR AS note FROM part a WHERE a.p_brand NOT IN (SELECT project FROM gone)")
def q03_cascade_and_migration(v):
    """A deleted project's rows go with it; rows written before a column was added have null there."""
    from ..sources.store import ArtifactStore

    store = ArtifactStore.temporary(v.spark)
    rows = v.part.select(c("p_partkey").alias("id"), c("p_brand").alias("project"))
    store.write("rows", rows)
    rows.limit(0).withColumn("note", F.lit(None).cast("string")).write.mode("append").parquet(f"{store.path}/rows")  # a later version's empty file
    gone = v.part.groupBy(c("p_brand").alias("project")).agg(F.min("p_partkey").alias("k")).where("k % 4 = 0").select("project")
    return store.read("rows").join(gone, "project", "left_anti").select("id", "project", "note")


@query("A14 B08 B09", "SELECT product, count(*) AS cells, count(value) AS known, round(sum(value), 3) AS total, 2e0 AS res, 'EPSG:32650' AS crs FROM (SELECT 'dsm' AS product, dsm AS value FROM cells UNION ALL SELECT 'zmean', zmean FROM cells UNION ALL SELECT 'sigma', sigma FROM cells UNION ALL SELECT 'count', n::DOUBLE FROM cells UNION ALL SELECT 'zmin', zmin FROM cells UNION ALL SELECT 'dense', CASE WHEN n >= 20 THEN dsm END FROM cells) GROUP BY 1")
def b09_raster_bundle(v):
    """Every product of the raster as a table of its own with a header row, written, and read back with what the header says."""
    from ..sources.store import ArtifactStore

    store = ArtifactStore.temporary(v.spark)
    products = {"dsm": c("dsm"), "zmean": c("zmean"), "zmin": c("zmin"), "sigma": c("sigma"), "count": c("n").cast("double"), "dense": F.when(c("n") >= 20, c("dsm"))}
    out = None
    for name, value in products.items():
        store.write_raster(name, v.cells.select("rw", "cl", value.alias("value")), res=2.0, crs="EPSG:32650")
        cells, head = store.read_raster(name)
        one = cells.agg(F.lit(name).alias("product"), F.count(F.lit(1)).alias("cells"), F.count("value").alias("known"), r(F.sum("value"), 3).alias("total")).crossJoin(head.select("res", "crs"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("B06", """SELECT camera_id // 20 AS track, 'Feature' AS type, count(*) AS n, 'LineString' AS kind, round(sum(cx), 4) AS sx FROM cameras GROUP BY 1""")
def b06_geojson_feature(v):
    """A track as a GeoJSON feature, made, written as text and parsed again."""
    at = F.struct("camera_id", F.array("cx", "cy", "cz").alias("p"))
    g = v.cameras.groupBy(F.floor(c("camera_id") / 20).alias("track")).agg(F.array_sort(F.collect_list(at)).alias("a"))  # twenty places a track
    line = F.struct(F.lit("LineString").alias("type"), F.transform("a", lambda x: x["p"]).alias("coordinates"))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("track").alias("properties"), line.alias("geometry")))
    back = F.from_json(text, "type string, properties struct<track:long>, geometry struct<type:string, coordinates:array<array<double>>>")
    f = g.select(back.alias("f"))
    sx = F.aggregate("f.geometry.coordinates", F.lit(0.0), lambda s, p: s + p[0])
    return f.select("f.properties.track", "f.type", F.size("f.geometry.coordinates").cast("long").alias("n"), c("f.geometry.type").alias("kind"), r(sx, 4).alias("sx"))


@query("I03 I02", "SELECT kind, count(*) AS n FROM (SELECT 'sparse' AS kind FROM observations WHERE kind = 0 UNION ALL SELECT 'dense' FROM dense) GROUP BY 1")
def i03_append_dense(v):
    """Dense observations behind the sparse ones, told apart by a kind."""
    sparse = v.observations.where("kind = 0").select("point_id", "camera_id", F.lit("sparse").alias("kind"))
    dense = v.dense.select(c("l_partkey").alias("point_id"), c("l_suppkey").alias("camera_id"), F.lit("dense").alias("kind"))
    return sparse.unionByName(dense).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("D20", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'extension' WHEN p_size = 1 THEN 'empty' WHEN p_size > 40 THEN 'too large' END AS reject FROM part")
def d20_upload_rules(v):
    """Uploads by extension, emptiness and size, the first rule that fails named."""
    name = F.concat(F.lit("clip."), F.when(c("p_partkey") % 6 == 0, "exe").otherwise("mp4"))
    size = c("p_size") - 1
    ok = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).isin("mp4", "mov", "csv", "srt", "json")
    return v.part.select("p_partkey", F.when(~ok, "extension").when(size <= 0, "empty").when(size >= 40, "too large").alias("reject"))


@query("O01 O02", "SELECT point_id, confidence >= (SELECT avg(confidence) FROM points) AS kept, round((confidence - (SELECT avg(confidence) FROM points)) / (SELECT stddev_pop(confidence) FROM points), 6) AS feature, 'threshold' AS backend FROM points")
def o02_backend_choice(v):
    """The mask backend that can run is taken: one without its weights falls back and says so, an unknown name is refused."""
    from ..operators import backends

    name, _ = backends.available(backends.MASKS, ["network", "threshold"])
    stats = v.points.agg(F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("spread"))  # one row
    p = v.points.select("point_id", "confidence").crossJoin(F.broadcast(stats))
    scaled = (c("confidence") - c("mean")) / c("spread")
    kept = backends.create(backends.MASKS, name)(c("confidence") - c("mean")) > 0
    return p.select("point_id", kept.alias("kept"), r(backends.create(backends.FEATURES, "identity")(scaled)).alias("feature"), F.lit(name).alias("backend"))
