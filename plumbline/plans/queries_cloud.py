"""Voxels, rasters, terrain and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, order, raster, spatial
from .registry import query

c = F.col


def r(x, n=6):
    return F.round(x, n)


RES = 2.0


@query("K01", "SELECT floor(x / 5)::BIGINT AS vx, floor(y / 5)::BIGINT AS vy, floor(z / 5)::BIGINT AS vz, min(point_id) AS first_id, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM points GROUP BY 1, 2, 3")
def k01_voxel_downsample(v):
    """The first point of each voxel by id, and its centroid."""
    keys = [F.floor(c(a) / 5).alias(f"v{a}") for a in "xyz"]
    return v.points.groupBy(*keys).agg(F.min("point_id").alias("first_id"), F.count(F.lit(1)).alias("n"), *[r(F.avg(a)).alias(f"c{a}") for a in "xyz"])


@query("K02", """WITH d AS (SELECT a.point_id, b.point_id AS o, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2) AS d FROM points a JOIN points b ON a.point_id <> b.point_id),
n AS (SELECT point_id, d, row_number() OVER (PARTITION BY point_id ORDER BY round(d, 9), o) AS rk FROM d), m AS (SELECT point_id, avg(d) AS md FROM n WHERE rk <= 12 GROUP BY 1)
SELECT point_id FROM m WHERE md < (SELECT avg(md) + 2 * stddev_pop(md) FROM m)""")
def k02_outlier_removal(v):
    p = v.points.select("point_id", "x", "y", "z")
    m = spatial.nearest(p, p, "point_id", "point_id", ["x", "y", "z"], 12, 16.0, other=True).groupBy(c("q.point_id").alias("point_id")).agg(F.avg("d").alias("md"))
    limit = m.agg((F.avg("md") + 2 * F.stddev_pop("md")).alias("limit"))
    return m.crossJoin(F.broadcast(limit)).where("md < limit").select("point_id")


@query("K03", """WITH l AS (SELECT unnest([0.1, 0.15, 0.25, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0]::DOUBLE[]) AS res), foot AS (SELECT count(*) AS f FROM (SELECT DISTINCT floor(x / 5), floor(y / 5) FROM dense)),
o AS (SELECT res, count(*) AS cells FROM (SELECT DISTINCT res, floor(x / res), floor(y / res) FROM dense, l) GROUP BY 1)
SELECT res, cells, round(cells / (f * (5 / res) ^ 2), 6) AS share, cells / (f * (5 / res) ^ 2) >= 0.75 AS enough FROM o, foot""")
def k03_choose_resolution(v):
    """Occupancy of each ladder size; the smallest with `enough` is the choice."""
    ladder = F.array(*map(F.lit, (0.1, 0.15, 0.25, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0)))
    foot = v.dense.select(F.floor(c("x") / 5), F.floor(c("y") / 5)).distinct().agg(F.count(F.lit(1)).alias("f"))
    o = v.dense.select("x", "y", F.explode(ladder).alias("res")).select("res", F.floor(c("x") / c("res")).alias("a"), F.floor(c("y") / c("res")).alias("b")).distinct().groupBy("res").agg(F.count(F.lit(1)).alias("cells"))
    share = c("cells") / (c("f") * (5 / c("res")) ** 2)
    return o.crossJoin(F.broadcast(foot)).select("res", "cells", r(share).alias("share"), (share >= 0.75).alias("enough"))


@query("K04 G09", """SELECT floor(y / 2)::BIGINT AS rw, floor(x / 2)::BIGINT AS cl, max(z) AS dsm, min(z) AS zmin, round(avg(z), 6) AS zmean, count(*) AS n, round(avg(sigma), 8) AS sigma,
arg_max(l_partkey, struct_pack(z := z, k := -l_partkey)) AS top FROM dense WHERE provenance = 0 GROUP BY 1, 2""")
def k04_rasterize(v):
    """Highest, lowest and mean height per cell of observed points only; the top point's key, ties by the smaller."""
    d = v.dense.where("provenance = 0")
    g = d.groupBy(F.floor(c("y") / RES).alias("rw"), F.floor(c("x") / RES).alias("cl"))
    return g.agg(F.max("z").alias("dsm"), F.min("z").alias("zmin"), r(F.avg("z")).alias("zmean"), F.count(F.lit(1)).alias("n"), r(F.avg("sigma"), 8).alias("sigma"), (-F.max(F.struct("z", -c("l_partkey")))["col2"]).alias("top"))


def _sweep_sql(src: str, dst: str, half: int) -> str:
    w = f"ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING"
    parts, last = [], src
    for n, f in (("a", "min"), ("b", "max")):
        parts.append(f"{dst}{n}1 AS (SELECT * REPLACE ({f}(s) OVER (PARTITION BY rw ORDER BY cl {w}) AS s) FROM {last})")
        parts.append(f"{dst}{n}2 AS (SELECT * REPLACE ({f}(s) OVER (PARTITION BY cl ORDER BY rw {w}) AS s) FROM {dst}{n}1)")
        last = f"{dst}{n}2"
    return ", ".join(parts), last


def _ground_sql() -> str:
    out = ["""box AS (SELECT min(rw) AS r0, max(rw) AS r1, min(cl) AS c0, max(cl) AS c1, max(zmin) AS top FROM cells)""",
           """g0 AS (SELECT a.rw, b.cl, k.zmin, coalesce(k.zmin, top) AS z, coalesce(k.zmin, top) AS s, false AS off FROM box, LATERAL (SELECT unnest(range(r0, r1 + 1)) AS rw) a, LATERAL (SELECT unnest(range(c0, c1 + 1)) AS cl) b LEFT JOIN cells k ON k.rw = a.rw AND k.cl = b.cl)"""]
    last, before = "g0", 1
    for k in range(4):
        size = 2 * 2**k + 1
        dh = 0.3 if k == 0 else min(0.3 + 0.15 * (size - before) * RES, 2.5)
        sql, end = _sweep_sql(last, f"o{k}", size // 2)
        out += [sql, f"g{k + 1} AS (SELECT * REPLACE (off OR z - s > {dh} AS off) FROM {end})"]
        last, before = f"g{k + 1}", size
    return ", ".join(out) + f", ground AS (SELECT rw, cl, zmin, zmin IS NOT NULL AND NOT off AS ground FROM {last})"


@query("K06", f"WITH {_ground_sql()} SELECT rw, cl, zmin, ground FROM ground")
def k06_ground_filter(v):
    return raster.ground(v.cells, RES)


_FILL = """near AS (SELECT e.rw, e.cl, k.zmin, row_number() OVER (PARTITION BY e.rw, e.cl ORDER BY (e.rw - k.rw) ^ 2 + (e.cl - k.cl) ^ 2, k.rw, k.cl) AS rk
FROM (SELECT * FROM ground WHERE NOT ground) e JOIN ground k ON k.ground AND abs(k.rw - e.rw) <= 6 AND abs(k.cl - e.cl) <= 6),
dtm AS (SELECT rw, cl, zmin AS terrain FROM ground WHERE ground UNION ALL SELECT rw, cl, zmin FROM near WHERE rk = 1)"""


def terrain(v):
    """Ground cells, and for all others of the grid the nearest ground cell, however far; ties by row, then column."""
    g = raster.ground(v.cells, RES).withColumn("at", F.struct("rw", "cl"))
    have = graph.cut(g.where("ground").select("at", "rw", "cl", "zmin"))  # the search would run the filter again each round
    known = have.select("rw", "cl", c("zmin").alias("terrain"))
    if have.isEmpty():  # nothing to fill from
        return known
    near = spatial.nearest(g.where("not ground").select("at", "rw", "cl"), have, "at", "at", ["rw", "cl"], 1, 6.0)
    return known.unionByName(near.select("q.rw", "q.cl", c("p.zmin").alias("terrain")))


@query("K08", f"WITH {_ground_sql()}, {_FILL} SELECT rw, cl, terrain FROM dtm")
def k08_fill_nearest(v):
    return terrain(v)


@query("K09", "SELECT a.rw, a.cl, count(*) AS n, round(sqrt(greatest(avg(b.dsm * b.dsm) - avg(b.dsm) ^ 2, 0)), 6) AS std FROM cells a JOIN cells b ON abs(a.rw - b.rw) <= 1 AND abs(a.cl - b.cl) <= 1 GROUP BY 1, 2")
def k09_local_std(v):
    n = raster.neighbours(v.cells, ["dsm"], raster.SQUARE)
    x = c("n_dsm")
    return n.groupBy("rw", "cl").agg(F.count(F.lit(1)).alias("n"), r(F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0)))).alias("std"))


_PATCH = """m AS (SELECT rw, cl, rw * 100000 + cl AS id, dsm FROM cells WHERE dsm > 9.5), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.rw - b.rw) + abs(a.cl - b.cl) = 1),
walk AS (SELECT id, id AS reach FROM m UNION SELECT w.id, e.b FROM walk w JOIN e ON w.reach = e.a), patch AS (SELECT id, min(reach) AS label FROM walk GROUP BY 1)"""


def _patches(v):
    m = v.cells.where("dsm > 9.5").withColumn("id", c("rw") * 100000 + c("cl"))
    e = raster.neighbours(m, ["id"], raster.CROSS).select((c("rw") * 100000 + c("cl")).alias("a"), c("n_id").alias("b"))
    return m, graph.components(m.select("id"), e, "id", "a", "b")


@query("K10", f"WITH RECURSIVE {_PATCH} SELECT id AS node, label FROM patch")
def k10_patches(v):
    """4-connected components of a cell mask."""
    return _patches(v)[1]


@query("K11 F34", f"""WITH RECURSIVE {_PATCH}, edge AS (SELECT m.id, m.rw, m.cl, m.dsm FROM m LEFT JOIN e ON e.a = m.id GROUP BY ALL HAVING count(e.b) < 4),
drop_ AS (SELECT edge.id, max(CASE WHEN edge.dsm - k.dsm > 2 THEN 1 ELSE 0 END) AS wall FROM edge JOIN cells k ON abs(k.rw - edge.rw) <= 3 AND abs(k.cl - edge.cl) <= 3 GROUP BY 1)
SELECT label, count(*) AS edge_cells, round(avg(wall), 6) AS share FROM drop_ JOIN patch USING (id) GROUP BY 1""")
def k11_wall_share(v):
    """Share of a patch's edge cells with a drop of over 2 m within three cells."""
    m, patch = _patches(v)
    inner = raster.neighbours(m, ["id"], raster.CROSS).groupBy("rw", "cl").count().where("count = 4").select("rw", "cl")
    edge = m.join(inner, ["rw", "cl"], "left_anti").select("rw", "cl", "id", "dsm")
    pairs = spatial.candidates(edge, v.cells.select("rw", "cl", "dsm"), ["rw", "cl"], 3.0, []).where((F.abs(c("q.rw") - c("p.rw")) <= 3) & (F.abs(c("q.cl") - c("p.cl")) <= 3))
    wall = pairs.groupBy(c("q.id").alias("node")).agg(F.max((c("q.dsm") - c("p.dsm") > 2).cast("int")).alias("wall"))
    return wall.join(patch, "node").groupBy("label").agg(F.count(F.lit(1)).alias("edge_cells"), r(F.avg("wall")).alias("share"))


@query("K12", f"""WITH {_ground_sql()}, {_FILL}, rough AS (SELECT a.rw, a.cl, sqrt(greatest(avg(b.dsm * b.dsm) - avg(b.dsm) ^ 2, 0)) AS s FROM cells a JOIN cells b ON abs(a.rw - b.rw) <= 1 AND abs(a.cl - b.cl) <= 1 GROUP BY 1, 2)
SELECT k.rw, k.cl, CASE WHEN terrain IS NULL THEN 0 WHEN dsm - terrain > 2.5 AND s > 3 THEN 5 WHEN dsm - terrain > 2.5 THEN 6 WHEN dsm - terrain <= 0.5 THEN 2 ELSE 1 END AS class FROM cells k LEFT JOIN dtm USING (rw, cl) LEFT JOIN rough USING (rw, cl)""")
def k12_land_cover(v):
    """0 no data, 1 between, 2 ground, 5 rough and high, 6 smooth and high."""
    x = c("n_dsm")
    rough = raster.neighbours(v.cells, ["dsm"], raster.SQUARE).groupBy("rw", "cl").agg(F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0))).alias("s"))
    h = c("dsm") - c("terrain")
    cls = F.when(c("terrain").isNull(), 0).when((h > 2.5) & (c("s") > 3), 5).when(h > 2.5, 6).when(h <= 0.5, 2).otherwise(1)
    return v.cells.select("rw", "cl", "dsm").join(terrain(v), ["rw", "cl"], "left").join(rough, ["rw", "cl"], "left").select("rw", "cl", cls.alias("class"))


@query("K13", "SELECT CASE WHEN d.z - k.zmin <= 0.5 THEN 2 WHEN d.z - k.zmin > 9 THEN 6 ELSE 1 END AS class, count(*) AS n FROM dense d JOIN cells k ON k.rw = floor(d.y / 2) AND k.cl = floor(d.x / 2) GROUP BY 1")
def k13_point_classes(v):
    h = c("z") - c("zmin")
    d = v.dense.select("z", F.floor(c("y") / 2).alias("rw"), F.floor(c("x") / 2).alias("cl")).join(v.cells.select("rw", "cl", "zmin"), ["rw", "cl"])
    return d.groupBy(F.when(h <= 0.5, 2).when(h > 9, 6).otherwise(1).alias("class")).agg(F.count(F.lit(1)).alias("n"))


POLY = [(10.0, 10.0), (80.0, 20.0), (70.0, 90.0), (20.0, 70.0)]


def _inside_sql(x: str, y: str) -> str:
    terms = [f"CASE WHEN ({y0} > {y}) <> ({y1} > {y}) AND {x} < ({x1} - {x0}) * ({y} - {y0}) / ({y1} - {y0}) + {x0} THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in zip(POLY, POLY[1:] + POLY[:1])]
    return f"(({' + '.join(terms)}) % 2 = 1)"


_IN = _inside_sql("(cl * 2e0 + 1)", "(rw * 2e0 + 1)")


def _poly_cells(v):
    return v.cells.where(raster.inside(c("cl") * 2.0 + 1, c("rw") * 2.0 + 1, POLY))


@query("K14 K15", f"SELECT count(*) AS cells, {raster.area(POLY)}::DOUBLE AS area FROM cells WHERE {_IN}")
def k14_polygon_mask(v):
    return _poly_cells(v).agg(F.count(F.lit(1)).alias("cells"), F.lit(raster.area(POLY)).alias("area"))


_ALLIN = f"""frame AS (SELECT rw, cl FROM (SELECT unnest(range(0, 50)) AS rw), (SELECT unnest(range(0, 50)) AS cl) WHERE {_IN})"""


@query(
    "K16 L15 D14 M23",
    f"""WITH {_ALLIN}, o AS (SELECT f.rw, f.cl, k.zmean AS z, k.sigma, k.n FROM frame f LEFT JOIN cells k USING (rw, cl)),
edge AS (SELECT a.rw, a.cl, a.z FROM o a LEFT JOIN frame b ON abs(a.rw - b.rw) + abs(a.cl - b.cl) = 1 WHERE a.z IS NOT NULL GROUP BY ALL HAVING count(b.rw) < 4),
s AS (SELECT count(*)::DOUBLE AS n, sum(cl)::DOUBLE AS sx, sum(rw)::DOUBLE AS sy, sum(cl * cl)::DOUBLE AS sxx, sum(cl * rw)::DOUBLE AS sxy, sum(rw * rw)::DOUBLE AS syy, sum(z) AS sz, sum(cl * z) AS sxz, sum(rw * z) AS syz FROM edge),
det AS (SELECT *, n * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy) AS d FROM s),
pl AS (SELECT (sz * (sxx * syy - sxy * sxy) - sx * (sxz * syy - sxy * syz) + sy * (sxz * sxy - sxx * syz)) / d AS a, (n * (sxz * syy - sxy * syz) - sz * (sx * syy - sxy * sy) + sy * (sx * syz - sxz * sy)) / d AS b,
(n * (sxx * syz - sxz * sxy) - sx * (sx * syz - sxz * sy) + sz * (sx * sxy - sxx * sy)) / d AS g FROM det),
q AS (SELECT o.*, z - (a + b * cl + g * rw) AS dz FROM o, pl)
SELECT count(z) / count(*) AS coverage, CASE WHEN count(z) / count(*) < 0.8 THEN 'refused' ELSE 'ok' END AS status, round(sum(CASE WHEN dz > 0 THEN dz ELSE 0 END) * 4 * count(*) / count(z), 3) AS cut, round(sum(CASE WHEN dz < 0 THEN -dz ELSE 0 END) * 4 * count(*) / count(z), 3) AS fill,
round(4 * sqrt(sum(sigma ^ 2)) * count(*) / count(z), 6) AS sigma_independent, round(4 * sum(sigma) * count(*) / count(z), 6) AS sigma_correlated FROM q""",
)
def k16_volume(v):
    """Cut and fill over the plane through the polygon's edge cells; refused below 0.8 coverage."""
    rows = v.spark.range(50).select(c("id").alias("rw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("cl"))
    frame = rows.where(raster.inside(c("cl") * 2.0 + 1, c("rw") * 2.0 + 1, POLY))
    o = frame.join(v.cells.select("rw", "cl", c("zmean").alias("z"), "sigma"), ["rw", "cl"], "left")
    inner = raster.neighbours(frame, [], raster.CROSS).groupBy("rw", "cl").count().where("count = 4").select("rw", "cl")
    edge = o.where("z is not null").join(inner, ["rw", "cl"], "left_anti")
    x, y, z = c("cl").cast("double"), c("rw").cast("double"), c("z")
    s = edge.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(e).alias(k) for k, e in {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y, "sz": z, "sxz": x * z, "syz": y * z}.items()])
    m = [[c("n"), c("sx"), c("sy")], [c("sx"), c("sxx"), c("sxy")], [c("sy"), c("sxy"), c("syy")]]
    rhs = [c("sz"), c("sxz"), c("syz")]
    plane = s.select(*(x.alias(k) for x, k in zip(cramer(m, rhs), "abg")))
    q = o.crossJoin(F.broadcast(plane)).withColumn("dz", z - (c("a") + c("b") * x + c("g") * y))
    scale = F.count(F.lit(1)) / F.count("z")
    return q.agg(
        (F.count("z") / F.count(F.lit(1))).alias("coverage"),
        F.when(F.count("z") / F.count(F.lit(1)) < 0.8, "refused").otherwise("ok").alias("status"),
        r(F.sum(F.when(c("dz") > 0, c("dz")).otherwise(0.0)) * 4 * scale, 3).alias("cut"),
        r(F.sum(F.when(c("dz") < 0, -c("dz")).otherwise(0.0)) * 4 * scale, 3).alias("fill"),
        r(4 * F.sqrt(F.sum(c("sigma") * c("sigma"))) * scale).alias("sigma_independent"),
        r(4 * F.sum("sigma") * scale).alias("sigma_correlated"),
    )


def det3(m):
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def cramer(m, rhs):
    """Solution of a 3 x 3 system as Columns."""
    d = det3(m)
    return [det3([[rhs[i] if k == j else m[i][j] for j in range(3)] for i in range(3)]) / d for k in range(3)]


_SLOPE = "sl AS (SELECT a.rw, a.cl, sqrt(((e.zmean - w.zmean) / 4) ^ 2 + ((n.zmean - s.zmean) / 4) ^ 2) AS slope FROM cells a JOIN cells e ON e.rw = a.rw AND e.cl = a.cl + 1 JOIN cells w ON w.rw = a.rw AND w.cl = a.cl - 1 JOIN cells n ON n.cl = a.cl AND n.rw = a.rw + 1 JOIN cells s ON s.cl = a.cl AND s.rw = a.rw - 1)"


def _slopes(v):
    """Central differences; no value where a neighbour is missing."""
    n = raster.neighbours(v.cells, ["zmean"], raster.CROSS).groupBy("rw", "cl").agg(
        F.count(F.lit(1)).alias("k"), F.sum(c("dc") * c("n_zmean")).alias("gx"), F.sum(c("dr") * c("n_zmean")).alias("gy")
    )
    return n.where("k = 4").select("rw", "cl", F.hypot(c("gx") / 4, c("gy") / 4).alias("slope"))


@query("K17", f"WITH {_SLOPE} SELECT rw, cl, round(slope, 6) AS slope, round(cos(atan(slope)), 6) AS shade FROM sl")
def k17_slope_grid(v):
    return _slopes(v).select("rw", "cl", r(c("slope")).alias("slope"), r(F.cos(F.atan("slope"))).alias("shade"))


@query("K18", f"WITH {_SLOPE} SELECT round(avg(slope), 6) AS mean, round(median(slope), 6) AS median, round(quantile_cont(slope, 0.9), 6) AS p90, round(max(slope), 6) AS max FROM sl WHERE {_IN}")
def k18_slope_statistics(v):
    s = _slopes(v).where(raster.inside(c("cl") * 2.0 + 1, c("rw") * 2.0 + 1, POLY))
    return s.agg(r(F.avg("slope")).alias("mean"), r(F.median("slope")).alias("median"), r(F.percentile("slope", F.lit(0.9))).alias("p90"), r(F.max("slope")).alias("max"))


_LOS = """ray AS (SELECT a.point_id, i / 4e1 AS w, a.x + (b.x - a.x) * i / 4e1 AS x, a.y + (b.y - a.y) * i / 4e1 AS y, 20 + (12 - 20) * i / 4e1 AS z, sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2) AS len
FROM points a JOIN points b ON b.point_id = a.point_id + 1, range(41) t(i)),
hit AS (SELECT ray.point_id, ray.w, ray.z, k.dsm, k.sigma FROM ray LEFT JOIN cells k ON k.rw = floor(ray.y / 2) AND k.cl = floor(ray.x / 2) WHERE ray.w * len > 3 AND (1 - ray.w) * len > 3)"""


@query("K19 G12", f"""WITH {_LOS} SELECT point_id, CASE WHEN bool_or(dsm - 2 * coalesce(sigma, 0) > z) THEN 'blocked' WHEN bool_or(dsm IS NULL) THEN 'unknown' ELSE 'visible' END AS status, min(w) FILTER (WHERE dsm - 2 * coalesce(sigma, 0) > z) AS first_block FROM hit GROUP BY 1""")
def k19_line_of_sight(v):
    """Blocked beyond two sigma, unknown over unobserved cells, the ends of one and a half cells left out."""
    a = v.points.select("point_id", c("x").alias("ax"), c("y").alias("ay"), (c("point_id") + 1).alias("j"))
    b = v.points.select(c("point_id").alias("j"), c("x").alias("bx"), c("y").alias("by"))
    ray = a.join(b, "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(40)))).withColumn("w", c("i") / 40.0)
    ray = ray.withColumn("len", F.hypot(c("bx") - c("ax"), c("by") - c("ay"))).where((c("w") * c("len") > 3) & ((1 - c("w")) * c("len") > 3))
    ray = ray.select("point_id", "w", (20 - 8 * c("i") / 40.0).alias("z"), F.floor((c("ay") + (c("by") - c("ay")) * c("i") / 40.0) / 2).alias("rw"), F.floor((c("ax") + (c("bx") - c("ax")) * c("i") / 40.0) / 2).alias("cl"))
    hit = ray.join(v.cells.select("rw", "cl", "dsm", "sigma"), ["rw", "cl"], "left")
    block = c("dsm") - 2 * F.coalesce("sigma", F.lit(0.0)) > c("z")
    return hit.groupBy("point_id").agg(F.when(F.coalesce(F.bool_or(block), F.lit(False)), "blocked").when(F.bool_or(c("dsm").isNull()), "unknown").otherwise("visible").alias("status"), F.min(F.when(block, c("w"))).alias("first_block"))


@query("K20", "SELECT a.rw, a.cl, count(b.rw) = 9 AS eroded FROM cells a JOIN cells b ON abs(a.rw - b.rw) <= 1 AND abs(a.cl - b.cl) <= 1 GROUP BY 1, 2")
def k20_binary_erosion(v):
    return raster.neighbours(v.cells, ["n"], raster.SQUARE).groupBy("rw", "cl").agg((F.count(F.lit(1)) == 9).alias("eroded"))


@query("K22", """SELECT g.rw, g.cl, count(*) AS views FROM (SELECT a.rw, b.cl FROM range(0, 50) a(rw), range(0, 55) b(cl)) g JOIN cameras k ON abs(g.cl * 2 + 1 - k.cx) <= 640 / 800e0 * (k.cz - 5) AND abs(g.rw * 2 + 1 - k.cy) <= 360 / 800e0 * (k.cz - 5) GROUP BY 1, 2 HAVING count(*) >= 2""")
def k22_view_domain(v):
    """Cells of the ground that at least two nadir footprints cover: each camera makes its own cells, no pair of all with all."""
    hx, hy = 0.8 * (c("cz") - 5), 0.45 * (c("cz") - 5)

    def span(mid, half, top):
        lo, hi = F.greatest(F.ceil((mid - half - 1) / 2), F.lit(0).cast("long")), F.least(F.floor((mid + half - 1) / 2), F.lit(top).cast("long"))
        return F.when(lo <= hi, F.sequence(lo, hi))

    rows = v.cameras.select(F.explode(span(c("cy"), hy, 49)).alias("rw"), span(c("cx"), hx, 54).alias("cs"))
    return rows.select("rw", F.explode("cs").alias("cl")).groupBy("rw", "cl").agg(F.count(F.lit(1)).alias("views")).where("views >= 2")


_FRAME = "px >= 0 AND px < 128 AND py >= 0 AND py < 72"
_ZB = f"""pr AS (SELECT * FROM (SELECT k.camera_id, p.point_id, p.provenance, p.r, p.g, p.b, floor(80 * (p.x - k.cx) / (k.cz - p.z) + 64)::BIGINT AS px, floor(80 * (k.cy - p.y) / (k.cz - p.z) + 36)::BIGINT AS py, k.cz - p.z AS dz FROM points p, cameras k WHERE k.cz - p.z > 1e-6) WHERE {_FRAME}),
zb AS (SELECT camera_id, px, py, min(dz) AS dz FROM pr WHERE provenance IN (0, 1) GROUP BY ALL),
zd AS (SELECT camera_id, px, py, min(dz) AS dz FROM (SELECT camera_id, px + dx AS px, py + dy AS py, dz FROM zb, range(-2, 3) a(dx), range(-2, 3) b(dy)) WHERE {_FRAME} GROUP BY ALL)"""
SIDE = 10.0  # of the ground cells that bring cameras and what they may see together


def footprints(cameras, low):
    """(camera, ix, iy): the ground cells under each nadir camera's view at height `low`; nothing lower is in the cell otherwise."""
    hx, hy = 0.8 * (c("cz") - low), 0.45 * (c("cz") - low)
    span = lambda mid, half: F.sequence(F.floor((c(mid) - half) / SIDE), F.floor((c(mid) + half) / SIDE))
    rows = cameras.where(c("cz") > low).withColumn("ix", F.explode(span("cx", hx))).withColumn("iy", span("cy", hy))
    return rows.select("camera_id", "cx", "cy", "cz", "ix", F.explode("iy").alias("iy"))


_IN_FRAME = "px >= 0 and px < 128 and py >= 0 and py < 72"


def _projected(v):
    """Points in the low-resolution image of each camera that has them in view: met by ground cells, never all with all."""
    return _into(v, v.points.select("point_id", "provenance", "x", "y", "z", "r", "g", "b"))


def _into(v, points):
    """`points` as the cameras see them, with px, py and dz for their coordinates."""
    low = v.points.agg(F.min("z").alias("low"))  # one row
    k = footprints(v.cameras.crossJoin(F.broadcast(low)), c("low"))
    dz = c("cz") - c("z")
    seen = points.withColumns({"ix": F.floor(c("x") / SIDE), "iy": F.floor(c("y") / SIDE)}).join(k, ["ix", "iy"]).where(dz > 1e-6)
    rest = [x for x in points.columns if x not in ("x", "y", "z")]
    return seen.select("camera_id", *rest, F.floor(80 * (c("x") - c("cx")) / dz + 64).alias("px"), F.floor(80 * (c("cy") - c("y")) / dz + 36).alias("py"), dz.alias("dz")).where(_IN_FRAME)


def _zbuffer(projected):
    """Nearest depth of observed points per pixel, spread by two pixels within the image."""
    zb = projected.where("provenance in (0, 1)").groupBy("camera_id", "px", "py").agg(F.min("dz").alias("dz"))
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-2, 3) for b in range(-2, 3)])
    spread = zb.withColumn("s", F.explode(around)).select("camera_id", (c("px") + c("s.dx")).alias("px"), (c("py") + c("s.dy")).alias("py"), "dz").where(_IN_FRAME)
    return spread.groupBy("camera_id", "px", "py").agg(F.min("dz").alias("depth"))


@query("K27", f"WITH {_ZB} SELECT camera_id, px, py, round(dz, 6) AS depth FROM zd")
def k27_z_buffer(v):
    return _zbuffer(_projected(v)).select("camera_id", "px", "py", r(c("depth")).alias("depth"))


@query("K28 F39", f"""WITH {_ZB}, cl AS (SELECT camera_id, px, py, arg_min(struct_pack(r := r, g := g, b := b), struct_pack(dz := dz, k := point_id)) AS o FROM pr WHERE provenance IN (0, 1) GROUP BY ALL),
vt AS (SELECT p.point_id, abs(p.dz - zd.dz) AS res, abs(p.dz - zd.dz) <= 1 + 0.05 * zd.dz AS near, coalesce(o.r + o.g + o.b = 0 OR (abs(o.r - p.r) + abs(o.g - p.g) + abs(o.b - p.b)) / 3e0 <= 60, true) AS colour
FROM pr p JOIN zd USING (camera_id, px, py) LEFT JOIN cl USING (camera_id, px, py) WHERE p.provenance = 2)
SELECT q.point_id, count(res) AS votes, count(*) FILTER (WHERE near AND colour) AS agree, count(*) FILTER (WHERE near AND colour) >= 2 AS verified, round(median(res), 6) AS residual FROM points q LEFT JOIN vt USING (point_id) WHERE q.provenance = 2 GROUP BY 1""")
def k28_verify_inferred(v):
    """Inferred points against what cameras see there: depth within 1 m and 5 %, colour of the nearest observed point within 60, two views or more."""
    at = ["x", "y", "z"]  # points at one place are seen alike: each place is projected once
    first = F.min(F.struct("point_id", "r", "g", "b"))
    seen = graph.cut(_into(v, v.points.where("provenance in (0, 1)").groupBy(*at).agg(first.alias("o"), F.lit(0).alias("provenance"))))  # read twice below
    colour = seen.groupBy("camera_id", "px", "py").agg(F.min(F.struct("dz", "o")).alias("m")).select("camera_id", "px", "py", c("m.o").alias("o"))
    inferred = v.points.where("provenance = 2")
    spots = graph.cut(inferred.groupBy(*at).agg(F.count(F.lit(1)).alias("n")))
    sights = _into(v, spots.select(*at, F.struct(*at).alias("at"))).join(_zbuffer(seen), ["camera_id", "px", "py"]).join(colour, ["camera_id", "px", "py"], "left")
    res = F.abs(c("dz") - c("depth"))
    near = F.when(res <= 1 + 0.05 * c("depth"), F.struct(*[c(f"o.{k}").alias(k) for k in "rgb"]))
    votes = sights.groupBy("at").agg(F.array_sort(F.collect_list(res)).alias("res"), F.collect_list(near).alias("near"))  # one entry for each camera that sees the place
    found = spots.join(votes.select("at.*", "res", "near"), at, "left")
    middle = (F.get("res", F.floor((F.size("res") - 1) / 2).cast("int")) + F.get("res", F.floor(F.size("res") / 2).cast("int"))) / 2
    found = found.select(*at, "n", F.when(c("res").isNull(), 0).otherwise(F.size("res")).cast("long").alias("votes"), r(middle).alias("residual"), "near")
    every = graph.hot_join(inferred.select("point_id", *at, "r", "g", "b"), found, at, "n", "point_id")
    off = lambda o: (F.abs(o["r"] - c("r")) + F.abs(o["g"] - c("g")) + F.abs(o["b"] - c("b"))) / 3.0
    fits = lambda o: F.coalesce((o["r"] + o["g"] + o["b"] == 0) | (off(o) <= 60), F.lit(True))
    agree = F.when(c("near").isNull(), 0).otherwise(F.size(F.filter("near", fits))).cast("long")
    return every.select("point_id", "votes", agree.alias("agree"), (agree >= 2).alias("verified"), "residual")


_COV = f"""{_ZB}, vx AS (SELECT a.ix, b.iy, d.iz FROM range(0, 10) a(ix), range(0, 10) b(iy), range(0, 3) d(iz)), sf AS (SELECT DISTINCT floor(x / 10)::BIGINT AS ix, floor(y / 10)::BIGINT AS iy, floor(z / 5)::BIGINT AS iz FROM points),
pv AS (SELECT *, (camera_id + px // 32 + py // 24) % 11 = 0 AS masked FROM (SELECT ix, iy, iz, camera_id, cz - (iz * 5 + 2.5) AS dz, floor(80 * (ix * 10 + 5 - cx) / (cz - (iz * 5 + 2.5)) + 64)::BIGINT AS px, floor(80 * (cy - iy * 10 - 5) / (cz - (iz * 5 + 2.5)) + 36)::BIGINT AS py, degrees(atan2(sqrt((ix * 10 + 5 - cx) ^ 2 + (iy * 10 + 5 - cy) ^ 2), cz - (iz * 5 + 2.5))) AS inc FROM vx, cameras) WHERE {_FRAME}),
ct AS (SELECT vx.ix, vx.iy, vx.iz, count(pv.camera_id) AS frustum, count(*) FILTER (WHERE masked) AS dynamic, count(*) FILTER (WHERE NOT masked AND pv.dz <= zd.dz + 1.5) AS views, count(*) FILTER (WHERE NOT masked AND pv.dz < zd.dz - 1.5) AS free, min(inc) FILTER (WHERE NOT masked AND pv.dz <= zd.dz + 1.5) AS inc
FROM vx LEFT JOIN pv ON pv.ix = vx.ix AND pv.iy = vx.iy AND pv.iz = vx.iz LEFT JOIN zd ON zd.camera_id = pv.camera_id AND zd.px = pv.px AND zd.py = pv.py GROUP BY ALL),
st AS (SELECT ct.*, CASE WHEN dynamic > 0 AND views = 0 AND sf.ix IS NULL THEN 'dynamic_excluded' WHEN sf.ix IS NOT NULL AND views = 0 THEN 'occluded' WHEN sf.ix IS NOT NULL AND views >= 2 AND (inc <= 75 OR inc >= 179) THEN 'observed' WHEN sf.ix IS NOT NULL AND views >= 1 THEN 'weak' WHEN frustum > 0 AND free > 0 THEN 'empty' WHEN frustum > 0 THEN 'occluded' ELSE 'unseen' END AS status FROM ct LEFT JOIN sf USING (ix, iy, iz))"""


def coverage(v):
    """Seven-class coverage of a voxel field: the rules of the specification in reverse order, as one chain.  A ray through a masked pixel counts as dynamic and as nothing else."""
    z = F.sequence(F.lit(0), F.lit(2))
    nine = F.sequence(F.lit(0), F.lit(9))
    vox = v.spark.range(10).select(c("id").alias("ix"), F.explode(nine).alias("iy")).select("ix", c("iy").cast("long").alias("iy"), F.explode(z).alias("iz")).withColumn("iz", c("iz").cast("long"))
    surface = v.points.select(F.floor(c("x") / 10).alias("ix"), F.floor(c("y") / 10).alias("iy"), F.floor(c("z") / 5).alias("iz")).distinct().withColumn("surface", F.lit(True))
    dz = c("cz") - (c("iz") * 5 + 2.5)
    dx, dy = c("ix") * 10 + 5 - c("cx"), c("iy") * 10 + 5 - c("cy")
    seen = vox.join(footprints(v.cameras, F.lit(2.5)), ["ix", "iy"]).select(
        "ix", "iy", "iz", "camera_id", dz.alias("dz"), F.floor(80 * dx / dz + 64).alias("px"), F.floor(-80 * dy / dz + 36).alias("py"), F.degrees(F.atan2(F.hypot(dx, dy), dz)).alias("inc")
    ).where(_IN_FRAME)
    masked = (c("camera_id") + F.floor(c("px") / 32) + F.floor(c("py") / 24)) % 11 == 0
    joined = seen.join(_zbuffer(_projected(v)), ["camera_id", "px", "py"], "left")
    vis, free = ~masked & (c("dz") <= c("depth") + 1.5), ~masked & (c("dz") < c("depth") - 1.5)
    counts = joined.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("frustum"), F.count_if(masked).alias("dynamic"), F.count_if(vis).alias("views"), F.count_if(free).alias("free"), F.min(F.when(vis, c("inc"))).alias("inc"))
    all_ = vox.join(counts, ["ix", "iy", "iz"], "left").fillna(0, ["frustum", "dynamic", "views", "free"]).join(surface, ["ix", "iy", "iz"], "left")
    s = c("surface").isNotNull()
    status = (
        F.when((c("dynamic") > 0) & (c("views") == 0) & ~s, "dynamic_excluded")
        .when(s & (c("views") == 0), "occluded")
        .when(s & (c("views") >= 2) & ((c("inc") <= 75) | (c("inc") >= 179)), "observed")
        .when(s & (c("views") >= 1), "weak")
        .when((c("frustum") > 0) & (c("free") > 0), "empty")
        .when(c("frustum") > 0, "occluded")
        .otherwise("unseen")
    )
    return all_.withColumn("status", status)


@query("K26", f"WITH {_COV} SELECT ix, iy, iz, dynamic, views, free, status FROM st")
def k26_coverage(v):
    return coverage(v).select("ix", "iy", "iz", "dynamic", "views", "free", "status")


@query("F03", f"WITH {_COV} SELECT status, count(*) AS n, round(count(*) / 300, 6) AS share FROM st GROUP BY 1")
def f03_coverage_summary(v):
    return coverage(v).groupBy("status").agg(F.count(F.lit(1)).alias("n"), r(F.count(F.lit(1)) / 300).alias("share"))


_TRUTH = "CASE (ix * 7 + iy * 3 + iz) % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'empty' ELSE 'unknown' END"
_GUESS = "CASE WHEN status IN ('observed', 'weak') THEN 'observed' WHEN status = 'empty' THEN 'empty' ELSE 'unknown' END"


@query("F25", f"WITH {_COV}, l AS (SELECT status, (ix * 7 + iy * 3 + iz) % 3 > 0 AS truth FROM st), a AS (SELECT *, status = 'observed' AS accept FROM l) SELECT round(avg(CASE WHEN accept THEN 1 ELSE 0 END) FILTER (WHERE truth), 6) AS tar, round(avg(CASE WHEN accept THEN 0 ELSE 1 END) FILTER (WHERE NOT truth), 6) AS trr, round(avg(CASE WHEN accept THEN 1 ELSE 0 END) FILTER (WHERE NOT truth), 6) AS far, round(avg(CASE WHEN accept THEN 0 ELSE 1 END) FILTER (WHERE truth), 6) AS frr FROM a")
def f25_refusal_rates(v):
    a = coverage(v).select(((c("ix") * 7 + c("iy") * 3 + c("iz")) % 3 > 0).alias("truth"), (c("status") == "observed").cast("int").alias("accept"))
    yes, no = F.when(c("truth"), c("accept")), F.when(~c("truth"), c("accept"))
    return a.agg(r(F.avg(yes)).alias("tar"), r(F.avg(1 - no)).alias("trr"), r(F.avg(no)).alias("far"), r(F.avg(1 - yes)).alias("frr"))


@query("F26", f"""WITH {_COV}, l AS (SELECT {_TRUTH} AS truth, {_GUESS} AS guess FROM st), m AS (SELECT truth, count(*) FILTER (WHERE guess = 'observed') AS as_observed, count(*) FILTER (WHERE guess = 'empty') AS as_empty, count(*) FILTER (WHERE guess = 'unknown') AS as_unknown, count(*) FILTER (WHERE guess = truth) AS hit, count(*) AS n FROM l GROUP BY 1)
SELECT truth, as_observed, as_empty, as_unknown, round(hit / n, 6) AS recall, round((SELECT sum(hit) / sum(n) FROM m), 6) AS accuracy FROM m""")
def f26_confusion(v):
    """Confusion of the six classes folded to three with a truth, recall by class and accuracy of all."""
    k = (c("ix") * 7 + c("iy") * 3 + c("iz")) % 4
    truth = F.when(k == 0, "observed").when(k == 1, "empty").otherwise("unknown")
    guess = F.when(c("status").isin("observed", "weak"), "observed").when(c("status") == "empty", "empty").otherwise("unknown")
    m = coverage(v).select(truth.alias("truth"), guess.alias("guess")).groupBy("truth").agg(*[F.count_if(c("guess") == g).alias(f"as_{g}") for g in ("observed", "empty", "unknown")], F.count_if(c("guess") == c("truth")).alias("hit"), F.count(F.lit(1)).alias("n"))
    total = m.agg((F.sum("hit") / F.sum("n")).alias("accuracy"))  # one row
    return m.crossJoin(F.broadcast(total)).select("truth", "as_observed", "as_empty", "as_unknown", r(c("hit") / c("n")).alias("recall"), r(c("accuracy")).alias("accuracy"))


@query("K29", "WITH RECURSIVE w(voxel, n) AS (SELECT 1e-2::DOUBLE, ceil(100 / 1e-2) ^ 3 UNION ALL SELECT voxel * 1.5, ceil(100 / (voxel * 1.5)) ^ 3 FROM w WHERE n > 4e6) SELECT round(max(voxel), 9) AS voxel FROM w")
def k29_grid_coarsening(v):
    """Voxel times 1.5 until the box holds at most four million cells: a scalar decision before the job."""
    import math

    voxel = 0.01
    while math.ceil(100 / voxel) ** 3 > 4_000_000:
        voxel *= 1.5
    return v.spark.range(1).select(r(F.lit(voxel), 9).alias("voxel"))


@query("G10 G11", "WITH k AS (SELECT floor(x / 10)::BIGINT AS b, z, row_number() OVER (PARTITION BY floor(x / 10) ORDER BY z) AS rk, count(*) OVER (PARTITION BY floor(x / 10)) AS n FROM dense) SELECT b, max(z) FILTER (WHERE rk = floor((n - 1) * 0.2) + 1) AS p20, max(z) FILTER (WHERE rk = floor((n - 1) * 0.05) + 1) AS p05 FROM k WHERE n >= 20 GROUP BY 1")
def g10_rank_percentiles(v):
    """Percentiles that are values of the data, by counts of distinct heights rather than a sort of the block."""
    b = v.dense.groupBy(F.floor(c("x") / 10).alias("b"), "z").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("b").orderBy("z")
    k = b.withColumn("upto", F.sum("m").over(w)).withColumn("n", F.sum("m").over(Window.partitionBy("b"))).where("n >= 20")
    return k.groupBy("b").agg(*[F.min(F.when(c("upto") >= F.floor((c("n") - 1) * p) + 1, c("z"))).alias(f"p{int(p * 100):02d}") for p in (0.2, 0.05)])


@query("G13", "WITH s AS (SELECT i, 5 + i * 0.45 AS x, 8 + i * 0.4 AS y FROM range(0, 200) t(i)) SELECT i, k.zmean, last_value(k.zmean IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM s LEFT JOIN cells k ON k.rw = floor(y / 2) AND k.cl = floor(x / 2)")
def g13_profile(v):
    """A profile with its gaps kept, and the last value before each."""
    s = v.spark.range(200).select(c("id").alias("i"), F.floor((8 + c("id") * 0.4) / 2).alias("rw"), F.floor((5 + c("id") * 0.45) / 2).alias("cl"))
    p = s.join(v.cells.select("rw", "cl", "zmean"), ["rw", "cl"], "left")
    return p.select("i", "zmean", F.last("zmean", True).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("held"))


_MORTON = {"32": 0x1F00000000FFFF, "16": 0x1F0000FF0000FF, "8": 0x100F00F00F00F00F, "4": 0x10C30C30C30C30C3, "2": 0x1249249249249249}  # fixed values


def spread(x):
    """The bits of a 16-bit number, two zeros between each."""
    for n, mask in _MORTON.items():
        x = x.bitwiseOR(F.shiftleft(x, int(n))).bitwiseAND(F.lit(mask))
    return x


_STEPS = ", ".join(f"m{k} AS (SELECT * REPLACE ((sx | (sx << {n})) & {m} AS sx, (sy | (sy << {n})) & {m} AS sy, (sz | (sz << {n})) & {m} AS sz) FROM {'q' if not k else f'm{k - 1}'})" for k, (n, m) in enumerate(_MORTON.items()))
_PACK = f"""box AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 65535 AS step FROM points),
q0 AS (SELECT point_id, r, g, b, provenance, round_even((x - x0) / step, 0)::BIGINT AS qx, round_even((y - y0) / step, 0)::BIGINT AS qy, round_even((z - z0) / step, 0)::BIGINT AS qz FROM points, box),
q AS (SELECT *, qx AS sx, qy AS sy, qz AS sz FROM q0), {_STEPS},
o AS (SELECT point_id, r, g, b, provenance, qx, qy, qz, sx | (sy << 1) | (sz << 2) AS morton, row_number() OVER (ORDER BY sx | (sy << 1) | (sz << 2), point_id) - 1 AS place FROM m4)"""


def _quantised(v):
    """Points on 65,536 steps of the longest side, in Morton order."""
    side = [F.max(k) - F.min(k) for k in "xyz"]
    box = v.points.agg(*[F.min(k).alias(f"{k}0") for k in "xyz"], F.greatest(*side).alias("side")).withColumn("step", F.when(c("side") > 0, c("side") / 65535).otherwise(1e-6))  # one row
    at = lambda k: F.least(F.greatest(F.bround((c(k) - c(f"{k}0")) / c("step"), 0).cast("long"), F.lit(0)), F.lit(65535))
    q = v.points.crossJoin(F.broadcast(box)).select("point_id", "r", "g", "b", "provenance", *[at(k).alias(f"q{k}") for k in "xyz"])
    code = spread(c("qx")).bitwiseOR(F.shiftleft(spread(c("qy")), 1)).bitwiseOR(F.shiftleft(spread(c("qz")), 2))
    return q.withColumn("morton", code)


@query("G08 J14", f"WITH {_PACK} SELECT point_id, place, morton, ((qx - lag(qx, 1, 0) OVER w) % 65536 + 65536) % 65536 AS dx, ((qy - lag(qy, 1, 0) OVER w) % 65536 + 65536) % 65536 AS dy, ((qz - lag(qz, 1, 0) OVER w) % 65536 + 65536) % 65536 AS dz FROM o WINDOW w AS (ORDER BY place)")
def g08_morton_delta(v):
    """Morton order, and each axis's difference to the point before modulo 2^16."""
    return _deltas(v).select("point_id", "place", "morton", "dx", "dy", "dz")


def _deltas(v):
    rows = order.with_previous(order.indexed(_quantised(v), ["morton", "point_id"], "place"), "place", ["qx", "qy", "qz"])
    return rows.withColumns({f"d{k}": F.pmod(c(f"q{k}") - F.coalesce(f"prev_q{k}", F.lit(0)), F.lit(65536)) for k in "xyz"})


@query("B14", f"WITH {_PACK} SELECT point_id, place, qx, qy, qz FROM o")
def b14_decode_deltas(v):
    """A running sum of the differences modulo 2^16 gives every coordinate back."""
    d = _deltas(v).select("place", "point_id", "dx", "dy", "dz")
    sums = order.indexed(d, ["place"], "again", carry={f"s{k}": c(f"d{k}") for k in "xyz"})
    return sums.select("point_id", "place", *[(c(f"s{k}") + c(f"d{k}")).bitwiseAND(F.lit(65535)).alias(f"q{k}") for k in "xyz"])


@query("B13 B14", f"WITH {_PACK} SELECT place, qx, qy, qz, r, g, b, provenance::BIGINT AS provenance FROM o")
def b13_pack_and_decode(v):
    """Display packs: Morton order, differences as byte planes, compressed, one self-contained piece per chunk of places; then read back."""
    from ..sources import display_pack

    rows = order.indexed(_quantised(v), ["morton", "point_id"], "place").select("place", "qx", "qy", "qz", "r", "g", "b", "provenance")
    return display_pack.unpack(display_pack.pack(rows, chunk=512))
