"""Further operators: terrain and holes, registration, selection, plans and reports, exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph, order, raster, solvers, spatial
from .queries_cloud import _IN, _patches, _poly_cells, cramer  # noqa: F401
from .queries_stats import CAPTURE_WEIGHTS, _CAP
from .registry import query

c = F.col


def r(x, n=6):
    return F.round(x, n)


# Terrain
@query("K16 D14", f"""WITH o AS (SELECT zmean AS z, (SELECT min(zmean) FROM cells WHERE {_IN}) AS low FROM cells WHERE {_IN}), b AS (SELECT 'lowest' AS base, z - low AS dz FROM o UNION ALL SELECT 'fixed', z - 5 FROM o)
SELECT base, count(*) AS cells, round(4 * sum(CASE WHEN dz > 0 THEN dz ELSE 0 END), 3) AS cut, round(4 * sum(CASE WHEN dz < 0 THEN -dz ELSE 0 END), 3) AS fill FROM b GROUP BY 1""")
def k16_other_bases(v):
    """Cut and fill over the lowest observed mean height, and over a fixed height."""
    o = _poly_cells(v).select(c("zmean").alias("z"))
    low = o.agg(F.min("z").alias("low"))  # one row
    b = o.crossJoin(F.broadcast(low)).select("z", F.explode(F.array(F.struct(F.lit("lowest").alias("base"), c("low").alias("at")), F.struct(F.lit("fixed").alias("base"), F.lit(5.0).alias("at")))).alias("b")).select("b.base", (c("z") - c("b.at")).alias("dz"))
    return b.groupBy("base").agg(F.count(F.lit(1)).alias("cells"), r(4 * F.sum(F.greatest(c("dz"), F.lit(0.0))), 3).alias("cut"), r(4 * F.sum(F.greatest(-c("dz"), F.lit(0.0))), 3).alias("fill"))


_GRID = "gr AS (SELECT a.rw, b.cl, k.dsm FROM (SELECT unnest(range(min(rw), max(rw) + 1)) AS rw FROM cells) a, (SELECT unnest(range(min(cl), max(cl) + 1)) AS cl FROM cells) b LEFT JOIN cells k ON k.rw = a.rw AND k.cl = b.cl)"
_FILLED = f"""{_GRID}, nr AS (SELECT e.rw, e.cl, k.dsm, row_number() OVER (PARTITION BY e.rw, e.cl ORDER BY round(sqrt((e.rw - k.rw) ^ 2 + (e.cl - k.cl) ^ 2), 9), k.rw, k.cl) AS rk FROM gr e, cells k WHERE e.dsm IS NULL),
fl AS (SELECT rw, cl, dsm, true AS seen FROM gr WHERE dsm IS NOT NULL UNION ALL SELECT rw, cl, dsm, false FROM nr WHERE rk = 1)"""


def _filled(v):
    """The surface on its whole bounding box: empty cells take their nearest cell's height."""
    have = graph.cut(v.cells.select(F.struct("rw", "cl").alias("at"), "rw", "cl", "dsm"))
    empty = raster.grid(v.cells).join(have.select("rw", "cl"), ["rw", "cl"], "left_anti").select(F.struct("rw", "cl").alias("at"), "rw", "cl")
    near = spatial.nearest(empty, have, "at", "at", ["rw", "cl"], 1, 4.0).select("q.rw", "q.cl", "p.dsm", F.lit(False).alias("seen"))
    return have.select("rw", "cl", "dsm", F.lit(True).alias("seen")).unionByName(near)


@query("C28", f"""WITH {_FILLED}, gd AS (SELECT rw, cl, seen, CASE WHEN lag(dsm) OVER x IS NULL THEN (lead(dsm) OVER x - dsm) / 2 WHEN lead(dsm) OVER x IS NULL THEN (dsm - lag(dsm) OVER x) / 2 ELSE (lead(dsm) OVER x - lag(dsm) OVER x) / 4 END AS gx,
CASE WHEN lag(dsm) OVER y IS NULL THEN (lead(dsm) OVER y - dsm) / 2 WHEN lead(dsm) OVER y IS NULL THEN (dsm - lag(dsm) OVER y) / 2 ELSE (lead(dsm) OVER y - lag(dsm) OVER y) / 4 END AS gy FROM fl WINDOW x AS (PARTITION BY rw ORDER BY cl), y AS (PARTITION BY cl ORDER BY rw))
SELECT rw, cl, round(least(greatest(sin(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + cos(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(315) - atan2(-gx, gy)), 0), 1), 6) AS shade FROM gd WHERE seen""")
def c28_hillshade(v):
    """Shaded relief, light from 315 degrees at 45: central differences, one-sided at the border, on the filled surface."""
    f = graph.cut(_filled(v))
    n = raster.neighbours(f, ["dsm"], raster.CROSS)
    at = lambda a, b: F.max(F.when((c("dr") == a) & (c("dc") == b), c("n_dsm")))
    g = f.join(n.groupBy("rw", "cl").agg(at(0, -1).alias("w"), at(0, 1).alias("e"), at(-1, 0).alias("s"), at(1, 0).alias("t")), ["rw", "cl"], "left")
    slope = lambda a, b: F.when(c(a).isNull(), (c(b) - c("dsm")) / 2).when(c(b).isNull(), (c("dsm") - c(a)) / 2).otherwise((c(b) - c(a)) / 4)
    g = g.select("rw", "cl", "seen", slope("w", "e").alias("gx"), slope("s", "t").alias("gy")).where("seen")
    steep, aspect = F.atan(F.sqrt(c("gx") * c("gx") + c("gy") * c("gy"))), F.atan2(-c("gx"), c("gy"))
    low, high = F.radians(F.lit(45.0)), F.radians(F.lit(315.0))
    shade = F.sin(low) * F.cos(steep) + F.cos(low) * F.sin(steep) * F.cos(high - aspect)
    return g.select("rw", "cl", r(F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0))).alias("shade"))


@query("K20", "SELECT DISTINCT k.rw + a AS rw, k.cl + b AS cl FROM cells k, range(-1, 2) p(a), range(-1, 2) q(b) WHERE k.n >= 20")
def k20_binary_dilation(v):
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in raster.SQUARE])
    return v.cells.where("n >= 20").select("rw", "cl", F.explode(around).alias("s")).select((c("rw") + c("s.a")).alias("rw"), (c("cl") + c("s.b")).alias("cl")).distinct()


_HOLES = f"""{_GRID}, em AS (SELECT rw, cl, rw * 100000 + cl AS id FROM gr WHERE dsm IS NULL), ed AS (SELECT a.id AS a, b.id AS b FROM em a JOIN em b ON abs(a.rw - b.rw) <= 1 AND abs(a.cl - b.cl) <= 1 AND a.id <> b.id),
walk AS (SELECT id, id AS reach FROM em UNION SELECT w.id, ed.b FROM walk w JOIN ed ON w.reach = ed.a), lb AS (SELECT id, min(reach) AS hole FROM walk GROUP BY 1)"""


def _holes(v):
    """(hole, rw, cl): empty cells of the bounding box by 8-connected component."""
    em = raster.grid(v.cells).join(v.cells.select("rw", "cl"), ["rw", "cl"], "left_anti").withColumn("id", c("rw") * 100000 + c("cl"))
    em = graph.cut(em)
    ring = [s for s in raster.SQUARE if s != (0, 0)]
    e = raster.neighbours(em, ["id"], ring).select((c("rw") * 100000 + c("cl")).alias("a"), c("n_id").alias("b"))
    return em.join(graph.components(em.select("id"), e, "id", "a", "b"), c("id") == c("node")).select(c("label").alias("hole"), "rw", "cl")


@query("F34 K10", f"""WITH RECURSIVE {_HOLES}, h AS (SELECT hole, em.rw, em.cl FROM lb JOIN em USING (id)), rim AS (SELECT DISTINCT h.hole, k.rw, k.cl, k.zmin FROM h JOIN cells k ON abs(k.rw - h.rw) <= 2 AND abs(k.cl - h.cl) <= 2)
SELECT h.hole, count(*) * 4 AS area, round(avg(h.cl * 2 + 1), 6) AS x, round(avg(h.rw * 2 + 1), 6) AS y, any_value(q.n) AS rim_cells, round(any_value(q.spread), 6) AS rim_spread, any_value(q.z0) AS z0, any_value(q.z1) AS z1 FROM h JOIN (SELECT hole, count(*) AS n, quantile_cont(zmin, 0.9) - quantile_cont(zmin, 0.1) AS spread, min(zmin) AS z0, max(zmin) AS z1 FROM rim GROUP BY 1 HAVING count(*) >= 3) q USING (hole) GROUP BY 1""")
def f34_hole_summary(v):
    """Each hole's area, centroid, rim cells within two cells, how much the rim disagrees with itself, and its height range."""
    h = graph.cut(_holes(v))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)])
    near = h.withColumn("s", F.explode(around)).select("hole", (c("rw") + c("s.a")).alias("rw"), (c("cl") + c("s.b")).alias("cl")).distinct()
    rim = near.join(v.cells.select("rw", "cl", "zmin"), ["rw", "cl"]).groupBy("hole").agg(F.count(F.lit(1)).alias("rim_cells"), r(F.percentile("zmin", F.lit(0.9)) - F.percentile("zmin", F.lit(0.1))).alias("rim_spread"), F.min("zmin").alias("z0"), F.max("zmin").alias("z1")).where("rim_cells >= 3")
    size = h.groupBy("hole").agg((F.count(F.lit(1)) * 4).alias("area"), r(F.avg(c("cl") * 2 + 1)).alias("x"), r(F.avg(c("rw") * 2 + 1)).alias("y"))
    return size.join(rim, "hole")


BLOCK = 10.0  # metres; a block is five cells


_REG = f"""bk AS (SELECT floor(y / 10)::BIGINT AS br, floor(x / 10)::BIGINT AS bc, z, row_number() OVER (PARTITION BY floor(y / 10), floor(x / 10) ORDER BY z) AS rk, count(*) OVER (PARTITION BY floor(y / 10), floor(x / 10)) AS n FROM dense WHERE provenance = 0),
lo AS (SELECT br, bc, min(z) AS z FROM bk WHERE n >= 20 AND rk = floor(n * 0.05) + 1 GROUP BY 1, 2),
bg AS (SELECT a.br, b.bc, lo.z FROM (SELECT unnest(range(min(br), max(br) + 1)) AS br FROM lo) a, (SELECT unnest(range(min(bc), max(bc) + 1)) AS bc FROM lo) b LEFT JOIN lo ON lo.br = a.br AND lo.bc = b.bc),
bn AS (SELECT e.br, e.bc, k.z, row_number() OVER (PARTITION BY e.br, e.bc ORDER BY round(sqrt((e.br - k.br) ^ 2 + (e.bc - k.bc) ^ 2), 9), k.br, k.bc) AS rk FROM bg e, lo k WHERE e.z IS NULL),
b0 AS (SELECT * FROM bg WHERE z IS NOT NULL UNION ALL SELECT br, bc, z FROM bn WHERE rk = 1),
b1 AS (SELECT a.br, a.bc, min(b.z) AS z FROM b0 a JOIN b0 b ON abs(a.br - b.br) <= 1 AND abs(a.bc - b.bc) <= 1 GROUP BY 1, 2), b2 AS (SELECT a.br, a.bc, max(b.z) AS z FROM b1 a JOIN b1 b ON abs(a.br - b.br) <= 1 AND abs(a.bc - b.bc) <= 1 GROUP BY 1, 2),
bx AS (SELECT min(br) AS r0, max(br) AS r1, min(bc) AS c0, max(bc) AS c1 FROM b2),
fp AS (SELECT k.rw, k.cl, least(greatest((k.rw * 2 + 1) / 1e1 - 0.5, r0), r1) AS fy, least(greatest((k.cl * 2 + 1) / 1e1 - 0.5, c0), c1) AS fx, r1, c1 FROM cells k, bx)"""


def _regional(v):
    """A coarse ground surface under every cell: low block heights, isolated high blocks removed, bilinear between block centres."""
    b = v.dense.where("provenance = 0").groupBy(F.floor(c("y") / BLOCK).alias("br"), F.floor(c("x") / BLOCK).alias("bc"), "z").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("br", "bc")
    k = b.withColumn("upto", F.sum("m").over(w.orderBy("z"))).withColumn("n", F.sum("m").over(w)).where("n >= 20")
    low = graph.cut(k.groupBy("br", "bc").agg(F.min(F.when(c("upto") >= F.floor(c("n") * 0.05) + 1, c("z"))).alias("z")))
    have = low.select(F.struct("br", "bc").alias("at"), "br", "bc", "z")
    box = raster.grid(low.select(c("br").alias("rw"), c("bc").alias("cl"))).select(c("rw").alias("br"), c("cl").alias("bc"))
    empty = box.join(low, ["br", "bc"], "left_anti").select(F.struct("br", "bc").alias("at"), "br", "bc")
    near = spatial.nearest(empty, have, "at", "at", ["br", "bc"], 1, 4.0).select("q.br", "q.bc", "p.z")
    full = low.unionByName(near).select(c("br").alias("rw"), c("bc").alias("cl"), "z")

    def opened(arrays, own):
        import numpy as np

        z = arrays["z"]
        return {"z": raster.swept(raster.swept(z, 1, np.minimum), 1, np.maximum)[own]}

    return graph.cut(raster.tiled(full, ["z"], 2, opened, "rw long, cl long, z double").select(c("rw").alias("br"), c("cl").alias("bc"), "z"))


@query("K21", f"""WITH {_REG} SELECT rw, cl, round(sum(z * (CASE WHEN br = floor(fy) THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN bc = floor(fx) THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END)), 6) AS ground FROM fp JOIN b2 ON br IN (floor(fy), least(floor(fy) + 1, r1)) AND bc IN (floor(fx), least(floor(fx) + 1, c1)) GROUP BY 1, 2""")
def k21_regional_ground(v):
    return regional_ground(v).select("rw", "cl", r(c("ground")).alias("ground"))


def regional_ground(v):
    b = _regional(v)
    box = b.agg(F.min("br").alias("r0"), F.max("br").alias("r1"), F.min("bc").alias("c0"), F.max("bc").alias("c1"))  # one row
    inside = lambda x, lo, hi: F.least(F.greatest(x, c(lo).cast("double")), c(hi).cast("double"))
    p = v.cells.crossJoin(F.broadcast(box)).select("rw", "cl", inside((c("rw") * 2 + 1) / BLOCK - 0.5, "r0", "r1").alias("fy"), inside((c("cl") * 2 + 1) / BLOCK - 0.5, "c0", "c1").alias("fx"), "r1", "c1")
    ty, tx = c("fy") - F.floor("fy"), c("fx") - F.floor("fx")
    corner = lambda a, d: F.struct((F.floor("fy") + a).alias("br"), (F.floor("fx") + d).alias("bc"), ((ty if a else 1 - ty) * (tx if d else 1 - tx)).alias("w"))
    four = p.select("rw", "cl", F.explode(F.array(*[corner(a, d) for a in (0, 1) for d in (0, 1)])).alias("k")).select("rw", "cl", "k.*").where("w > 0")
    return four.join(b, ["br", "bc"]).groupBy("rw", "cl").agg(F.sum(c("w") * c("z")).alias("ground"))


@query("K24", "SELECT round(least(greatest(sqrt(8 / (n / area)), 0.5), 5), 6) AS cell FROM (SELECT count(*)::DOUBLE AS n, greatest(greatest(quantile_cont(x, 0.99) - quantile_cont(x, 0.01), 1) * greatest(quantile_cont(y, 0.99) - quantile_cont(y, 0.01), 1), 1) AS area FROM points)")
def k24_auto_cell(v):
    """A cell so large that observed ground hardly ever reads as empty."""
    wide = lambda k: F.greatest(F.percentile(k, F.lit(0.99)) - F.percentile(k, F.lit(0.01)), F.lit(1.0))
    a = v.points.agg(F.count(F.lit(1)).cast("double").alias("n"), F.greatest(wide("x") * wide("y"), F.lit(1.0)).alias("area"))
    return a.select(r(F.least(F.greatest(F.sqrt(8 / (c("n") / c("area"))), F.lit(0.5)), F.lit(5.0))).alias("cell"))


@query("K24 K23 I08", None)
def k24_fill_holes(v):
    """Empty cells that two cameras or more cover, filled as a membrane from the bank: low cell heights, capped 3 m over the regional ground."""
    from .queries_cloud import k22_view_domain
    from .queries_source import membrane_fill

    bank = v.cells.join(regional_ground(v), ["rw", "cl"]).select("rw", "cl", F.least("zmin", c("ground") + 3).alias("bank"))
    filled = membrane_fill(bank, "bank").where("filled")
    return filled.join(k22_view_domain(v).select("rw", "cl"), ["rw", "cl"], "left_semi").join(_holes(v), ["rw", "cl"]).select("hole", "rw", "cl", r(c("value"), 3).alias("z"))


# Registration
@query("L06", "SELECT p.point_id, count(DISTINCT o.camera_id) AS n, round(p.x, 4) AS x, round(p.y, 4) AS y, round(p.z, 4) AS z FROM observations o JOIN points p USING (point_id) GROUP BY ALL HAVING count(DISTINCT o.camera_id) >= 2")
def l06_triangulate(v):
    """Linear triangulation: each ray's two equations summed into a 4 x 4 matrix per point, its least eigenvector the point."""
    o = v.observations.select("point_id", "camera_id").distinct().join(v.points.select("point_id", "x", "y", "z"), "point_id").join(v.cameras.select("camera_id", "cx", "cy", "cz"), "camera_id")
    dz = c("cz") - c("z")
    o = o.select("point_id", ((c("x") - c("cx")) / dz).alias("u"), ((c("cy") - c("y")) / dz).alias("w"), "cx", "cy", "cz")
    one, zero = F.lit(1.0), F.lit(0.0)
    rows = [[-one, zero, -c("u"), c("u") * c("cz") + c("cx")], [zero, one, -c("w"), c("w") * c("cz") - c("cy")]]
    sums = o.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j]).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)]).where("n >= 2")
    out = sums.mapInPandas(solvers.least_eigenvectors, "point_id long, n long, x double, y double, z double")
    return out.select("point_id", "n", *[r(c(k), 4).alias(k) for k in "xyz"])


def rigid_icp(moving, fixed, key: str, rounds: int = 25, trim: float = 0.8, cell: float = 2.0):
    """(rotation, shift, rmse): trimmed point-to-point registration; matches are a neighbour join, the fit one row of sums."""
    import numpy as np

    rot, shift, rmse = np.eye(3), np.zeros(3), float("inf")
    held = spatial.places(fixed.select(key, "x", "y", "z"), key, ["x", "y", "z"], 1).drop("_ps")
    moving = graph.cut(moving.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n")))  # rows at one place go the same way
    for _ in range(rounds):
        at = [sum((F.lit(float(rot[i, k])) * c("xyz"[k]) for k in (1, 2)), F.lit(float(rot[i, 0])) * c("x")) + F.lit(float(shift[i])) for i in range(3)]
        here = graph.cut(moving.select(*[a.alias(f"_x{i}") for i, a in enumerate(at)], "n").groupBy("_x0", "_x1", "_x2").agg(F.sum("n").alias("n")))
        near = spatial.near_places(here.drop("n"), held, 1, cell)
        pair = graph.cut(near.join(here.toDF("_q0", "_q1", "_q2", "n"), ["_q0", "_q1", "_q2"]).withColumn("d", F.sqrt("dd")))
        limit = pair.agg(F.percentile("d", F.lit(trim), c("n"))).first()[0]
        q, p = [c(f"_q{i}") for i in range(3)], [c(f"_x{i}") for i in range(3)]
        terms = {"n": F.lit(1.0), "e": c("d") * c("d")} | {f"q{i}": q[i] for i in range(3)} | {f"p{i}": p[i] for i in range(3)} | {f"m{i}{j}": p[i] * q[j] for i in range(3) for j in range(3)}
        s = pair.where(c("d") <= limit).agg(*[F.sum(x * c("n")).alias(k) for k, x in terms.items()]).first()
        mq, mp = (np.array([s[f"{k}{i}"] for i in range(3)]) / s["n"] for k in "qp")
        u, _, vt = np.linalg.svd(np.array([[s[f"m{i}{j}"] for j in range(3)] for i in range(3)]) / s["n"] - np.outer(mp, mq))
        step = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        rot, shift, before, rmse = step @ rot, step @ shift + mp - step @ mq, rmse, float(np.sqrt(s["e"] / s["n"]))
        if abs(before - rmse) < 1e-7:
            break
    return rot, shift, rmse


@query("L11", "SELECT 0.3 AS degrees, 0.0 AS rmse")
def l11_trimmed_icp(v):
    """The cloud turned by 0.3 degrees and shifted: registration must bring it back."""
    import numpy as np

    a = F.radians(F.lit(0.3))
    x, y = c("x") - 50, c("y") - 50
    p = v.points.select("point_id", (F.cos(a) * x - F.sin(a) * y + 50.1).alias("x"), (F.sin(a) * x + F.cos(a) * y + 49.95).alias("y"), (c("z") + 0.05).alias("z"))
    rot, _, rmse = rigid_icp(p, v.points, "point_id")
    turn = float(np.degrees(np.arccos(np.clip((np.trace(rot) - 1) / 2, -1, 1))))
    return v.spark.range(1).select(F.lit(round(turn, 4)).alias("degrees"), F.lit(round(rmse, 4)).alias("rmse"))


_NRM = "nm AS (SELECT a.rw, a.cl, a.zmean, -(e.zmean - w.zmean) / 4 / sqrt(1 + ((e.zmean - w.zmean) / 4) ^ 2 + ((n.zmean - s.zmean) / 4) ^ 2) AS nx, -(n.zmean - s.zmean) / 4 / sqrt(1 + ((e.zmean - w.zmean) / 4) ^ 2 + ((n.zmean - s.zmean) / 4) ^ 2) AS ny, 1 / sqrt(1 + ((e.zmean - w.zmean) / 4) ^ 2 + ((n.zmean - s.zmean) / 4) ^ 2) AS nz FROM cells a JOIN cells e ON e.rw = a.rw AND e.cl = a.cl + 1 JOIN cells w ON w.rw = a.rw AND w.cl = a.cl - 1 JOIN cells n ON n.cl = a.cl AND n.rw = a.rw + 1 JOIN cells s ON s.cl = a.cl AND s.rw = a.rw - 1)"
_HUBER = (1.0, 0.85, 0.7225, 0.6141)  # the scale of each round


def _plane_sql() -> str:
    out, last = [_NRM, "t0 AS (SELECT 0e0 AS tx, 0e0 AS ty, 0e0 AS tz)"], "t0"
    for k, scale in enumerate(_HUBER):
        out.append(f"r{k} AS (SELECT nx, ny, nz, nx * (x + tx - (cl * 2 + 1)) + ny * (y + ty - (rw * 2 + 1)) + nz * (z + tz - zmean) AS e FROM points, {last} JOIN nm ON rw = floor((y + ty) / 2) AND cl = floor((x + tx) / 2))")
        out.append(f"s{k} AS (SELECT sum(w * nx * nx) AS xx, sum(w * nx * ny) AS xy, sum(w * nx * nz) AS xz, sum(w * ny * ny) AS yy, sum(w * ny * nz) AS yz, sum(w * nz * nz) AS zz, -sum(w * nx * e) AS bx, -sum(w * ny * e) AS b_y, -sum(w * nz * e) AS bz FROM (SELECT *, least(1, {scale} / greatest(abs(e), 1e-12)) ^ 2 AS w FROM r{k}))")
        out.append(f"d{k} AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM s{k})")
        out.append(f"t{k + 1} AS (SELECT tx + (bx * (yy * zz - yz * yz) - xy * (b_y * zz - yz * bz) + xz * (b_y * yz - yy * bz)) / det AS tx, ty + (xx * (b_y * zz - yz * bz) - bx * (xy * zz - yz * xz) + xz * (xy * bz - b_y * xz)) / det AS ty, tz + (xx * (yy * bz - b_y * yz) - xy * (xy * bz - b_y * xz) + bx * (xy * yz - yy * xz)) / det AS tz FROM d{k}, {last})")
        last = f"t{k + 1}"
    return ", ".join(out)


@query("L12", f"WITH {_plane_sql()} SELECT round(tx, 5) AS tx, round(ty, 5) AS ty, round(tz, 5) AS tz FROM t{len(_HUBER)}")
def l12_point_to_plane(v):
    """Translation that brings points onto the planes of the cells they fall in; a Huber weight whose scale tightens each round."""
    n = raster.neighbours(v.cells, ["zmean"], raster.CROSS).groupBy("rw", "cl").agg(F.count(F.lit(1)).alias("k"), F.sum(c("dc") * c("n_zmean") / 4).alias("gx"), F.sum(c("dr") * c("n_zmean") / 4).alias("gy")).where("k = 4")
    long = F.sqrt(1 + c("gx") * c("gx") + c("gy") * c("gy"))
    planes = graph.cut(n.join(v.cells.select("rw", "cl", "zmean"), ["rw", "cl"]).select("rw", "cl", "zmean", (-c("gx") / long).alias("nx"), (-c("gy") / long).alias("ny"), (1 / long).alias("nz")))
    t = [0.0, 0.0, 0.0]
    for scale in _HUBER:
        x, y, z = (c(k) + F.lit(s) for k, s in zip("xyz", t))
        p = v.points.select(x.alias("x"), y.alias("y"), z.alias("z"), F.floor(y / 2).alias("rw"), F.floor(x / 2).alias("cl")).join(planes, ["rw", "cl"])
        e = c("nx") * (c("x") - (c("cl") * 2 + 1)) + c("ny") * (c("y") - (c("rw") * 2 + 1)) + c("nz") * (c("z") - c("zmean"))
        w = F.pow(F.least(F.lit(1.0), F.lit(scale) / F.greatest(F.abs(c("e")), F.lit(1e-12))), F.lit(2.0))
        q, axes = p.withColumn("e", e).withColumn("w", w), ("nx", "ny", "nz")
        s = q.agg(*[F.sum(c("w") * c(axes[i]) * c(axes[j])).alias(f"m{i}{j}") for i in range(3) for j in range(3)], *[(-F.sum(c("w") * c(a) * c("e"))).alias(f"b{i}") for i, a in enumerate(axes)])
        d = s.select(*[x.alias(f"d{i}") for i, x in enumerate(cramer([[c(f"m{i}{j}") for j in range(3)] for i in range(3)], [c(f"b{i}") for i in range(3)]))]).first()
        t = [a + d[f"d{i}"] for i, a in enumerate(t)]  # three numbers a round
    return v.spark.range(1).select(*[F.lit(round(a, 5)).alias(k) for a, k in zip(t, ("tx", "ty", "tz"))])


@query("G15", """WITH e AS (SELECT camera_id // 50 AS segment, camera_id, ((yaw - lag(yaw, 1, yaw) OVER w + 180) % 360 + 360) % 360 - 180 AS turn, cx - lag(cx, 1, cx) OVER w AS dx, cy - lag(cy, 1, cy) OVER w AS dy, first_value(yaw) OVER w AS y0 FROM cameras WINDOW w AS (PARTITION BY camera_id // 50 ORDER BY camera_id))
SELECT segment, camera_id, round(((sum(turn) OVER w) % 360 + 360) % 360, 6) AS yaw, round(sum(dx) OVER w, 6) AS x, round(sum(dy) OVER w, 6) AS y FROM e WINDOW w AS (PARTITION BY segment ORDER BY camera_id)""")
def g15_chain_motion(v):
    """Poses composed from consecutive motions: headings add up, and each step is turned by the heading it starts at."""
    w = Window.partitionBy("segment").orderBy("camera_id")
    k = v.cameras.select(F.floor(c("camera_id") / 50).alias("segment"), "camera_id", "yaw", "cx", "cy")
    prev = lambda x: F.coalesce(F.lag(x).over(w), c(x))
    turn = F.pmod(c("yaw") - prev("yaw") + 180, F.lit(360.0)) - 180
    # the motion as a camera sees it: its step in its own frame
    a = F.radians(prev("yaw"))
    dx, dy = c("cx") - prev("cx"), c("cy") - prev("cy")
    m = k.select("segment", "camera_id", turn.alias("turn"), (F.cos(a) * dx + F.sin(a) * dy).alias("fx"), (-F.sin(a) * dx + F.cos(a) * dy).alias("fy"), F.first("yaw").over(w).alias("y0"))
    h = m.withColumn("yaw", F.sum("turn").over(w)).withColumn("b", F.radians(c("yaw") - c("turn") + c("y0")))
    return h.select("segment", "camera_id", r(F.pmod("yaw", F.lit(360.0))).alias("yaw"), r(F.sum(F.cos("b") * c("fx") - F.sin("b") * c("fy")).over(w)).alias("x"), r(F.sum(F.sin("b") * c("fx") + F.cos("b") * c("fy")).over(w)).alias("y"))


@query("E26", None)
def e26_orientation_forest(v):
    """Heaviest spanning tree of each component of verified pairs, orientations carried along it in quarter turns."""
    e = v.edges.groupBy("i", "j").agg(F.max("inliers").alias("weight")).withColumn("turn", F.pmod(F.xxhash64("i", "j"), F.lit(4)) * 90)
    nodes = e.select(c("i").alias("node")).union(e.select("j")).distinct()
    part = graph.components(nodes, e, "node", "i", "j").select(c("node").alias("i"), c("label").alias("component"))
    return e.join(part, "i").groupBy("component").applyInPandas(lambda key, g: solvers.spanning_forest(key, g), "component long, node long, orientation long, degree long")


# Selection
@query("E24", "WITH s AS (SELECT DISTINCT point_id, camera_id FROM observations), d AS (SELECT point_id, camera_id, sqrt((x - cx) ^ 2 + (y - cy) ^ 2 + (z - cz) ^ 2) AS d FROM s JOIN points USING (point_id) JOIN cameras USING (camera_id)) SELECT point_id, camera_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(d, 9), camera_id) AS rank FROM d) WHERE rank <= 4")
def e24_endpoint_anchors(v):
    """Of the frames that measured an endpoint the four nearest."""
    s = v.observations.select("point_id", "camera_id").distinct().join(v.points.select("point_id", "x", "y", "z"), "point_id").join(v.cameras.select("camera_id", "cx", "cy", "cz"), "camera_id")
    d = F.sqrt((c("x") - c("cx")) ** 2 + (c("y") - c("cy")) ** 2 + (c("z") - c("cz")) ** 2)
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy(F.round(d, 9), "camera_id"))
    return s.withColumn("rank", rank).where("rank <= 4").select("point_id", "camera_id", "rank")


@query("H04", "WITH o AS (SELECT DISTINCT point_id, camera_id FROM observations), k AS (SELECT point_id FROM o WHERE camera_id % 3 = 0 GROUP BY 1 HAVING count(*) >= 2) SELECT camera_id, count(*) AS support FROM o JOIN k USING (point_id) WHERE camera_id % 3 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def h04_next_best_view(v):
    """The camera not registered yet that sees most points two registered ones share."""
    o = v.observations.select("point_id", "camera_id").distinct()
    known = o.where("camera_id % 3 = 0").groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("point_id")
    return o.where("camera_id % 3 <> 0").join(known, "point_id").groupBy("camera_id").agg(F.count(F.lit(1)).alias("support")).orderBy(F.desc("support"), "camera_id").limit(1)


@query("H11", """WITH b AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges), p AS (SELECT i, j, max(inliers) AS inliers FROM edges GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY j - i ORDER BY inliers DESC, i, j) AS rk FROM p),
n AS (SELECT q.i, q.j, any_value(q.inliers) AS inliers, count(y.i) AS conn FROM q LEFT JOIN b x ON x.i = q.i LEFT JOIN b y ON y.i = q.j AND y.j = x.j WHERE rk <= 4 GROUP BY 1, 2)
SELECT i, j, round(inliers * (0.25 + 0.75 * conn / greatest((SELECT max(conn) FROM n), 1)), 6) AS score FROM n ORDER BY 3 DESC, 1, 2 LIMIT 1""")
def h11_best_seed_pair(v):
    """Of the best four pairs of each separation the one with most support, weighed by how much else attaches to it."""
    from .queries_join import e17_common_neighbours, h05_best_per_separation

    best = v.edges.groupBy("i", "j").agg(F.max("inliers").alias("inliers")).join(h05_best_per_separation(v).select("i", "j"), ["i", "j"])
    n = best.join(e17_common_neighbours(v), ["i", "j"], "left").select("i", "j", "inliers", F.coalesce("common", F.lit(0)).alias("conn"))
    most = n.agg(F.greatest(F.max("conn"), F.lit(1)).alias("most"))  # one row
    score = c("inliers") * (0.25 + 0.75 * c("conn") / c("most"))
    return n.crossJoin(F.broadcast(most)).select("i", "j", r(score).alias("score")).orderBy(F.desc("score"), "i", "j").limit(1)


@query("D04", "SELECT track, count(*) AS n, round(median(motion) * 100, 6) AS shift, median(motion) * 100 >= 0.15 AS sparse, median(motion) * 100 >= 0.15 AND count(*) BETWEEN 2 AND 80 AS keep_all FROM frames GROUP BY 1")
def d04_sparse_capture(v):
    """A capture whose frames hardly overlap keeps all of its frames, if they are few."""
    s = F.median("motion") * 100
    n = F.count(F.lit(1))
    return v.frames.groupBy("track").agg(n.alias("n"), r(s).alias("shift"), (s >= 0.15).alias("sparse"), ((s >= 0.15) & n.between(2, 80)).alias("keep_all"))


# Reports and plans
ADVICE = {"parallax": (0.5, "fly a second pass at another angle"), "coverage": (0.5, "extend the flight over what no camera saw"), "registration": (0.8, "more overlap between frames"), "redundancy": (0.5, "add a repeat pass"), "image_quality": (0.6, "other camera settings, not another flight")}


@query("F18", f"""WITH {_CAP}, s AS (SELECT *, least({', '.join(CAPTURE_WEIGHTS)}) AS low FROM f) SELECT mission, array_to_string(list_filter([{', '.join(f"CASE WHEN coalesce({k}, 1) < {at} THEN '{text}' END" for k, (at, text) in ADVICE.items() if k != 'image_quality')}], lambda x: x IS NOT NULL), '; ') AS actions,
CASE WHEN coalesce(image_quality, 1) < 0.6 THEN '{ADVICE['image_quality'][1]}' ELSE '' END AS unfixable, coalesce(parallax, 1) < 0.5 OR coalesce(coverage, 1) < 0.5 OR coalesce(registration, 1) < 0.8 OR coalesce(redundancy, 1) < 0.5 AS refly FROM s""")
def f18_recapture_plan(v):
    """What another flight should do: advice for each factor that is deficient, apart from what no flight mends."""
    k = c("s_suppkey")
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    f = {"parallax": F.when(k % 9 != 0, unit((k % 12 - 1) / 9.0)), "coverage": unit(k % 10 / 10.0 / 0.6), "registration": F.when(k % 11 != 0, k % 21 / 20.0), "redundancy": unit((k % 8 - 2) / 4.0), "image_quality": k % 5 / 4.0}
    low = lambda n: F.coalesce(f[n], F.lit(1.0)) < ADVICE[n][0]
    todo = F.array_compact(F.array(*[F.when(low(n), ADVICE[n][1]) for n in ADVICE if n != "image_quality"]))
    return v.supplier.select(k.alias("mission"), F.array_join(todo, "; ").alias("actions"), F.when(low("image_quality"), ADVICE["image_quality"][1]).otherwise("").alias("unfixable"), (F.size(todo) > 0).alias("refly"))


@query("F16 B07", """SELECT (SELECT count(*) FROM frames) AS frames, (SELECT count(*) FROM frames WHERE blur >= 40) AS accepted, (SELECT count(*) FROM points) AS points, round((SELECT avg(CASE WHEN provenance IN (0, 1) THEN 1 ELSE 0 END) FROM points), 6) AS observed, round((SELECT quantile_cont(sigma_major, 0.9) FROM points), 6) AS p90, (SELECT count(*) FROM cameras) AS cameras,
'<tr><td>points</td><td>' || (SELECT count(*) FROM points) || '</td></tr>' AS row""")
def f16_quality_report(v):
    """The quality report as one nested record, written as JSON and read back, with a row of its page."""
    from ..sources.store import ArtifactStore

    f = v.frames.agg(F.struct(F.count(F.lit(1)).alias("analyzed"), F.count_if(c("blur") >= 40).alias("accepted")).alias("frames"))
    p = v.points.agg(F.struct(F.count(F.lit(1)).alias("points"), F.avg(c("provenance").isin(0, 1).cast("int")).alias("observed")).alias("cloud"), F.struct(F.percentile("sigma_major", F.lit(0.9)).alias("p90")).alias("uncertainty"))
    k = v.cameras.agg(F.struct(F.count(F.lit(1)).alias("cameras")).alias("reconstruction"))
    report = f.crossJoin(p).crossJoin(k)  # one row each
    store = ArtifactStore.temporary(v.spark)
    store.write_json("report", report)
    back = store.read_json("report", report.schema)
    page = F.concat(F.lit("<tr><td>points</td><td>"), c("cloud.points").cast("string"), F.lit("</td></tr>"))
    return back.select(c("frames.analyzed").alias("frames"), "frames.accepted", "cloud.points", r(c("cloud.observed")).alias("observed"), r(c("uncertainty.p90")).alias("p90"), "reconstruction.cameras", page.alias("row"))


# Exports
_DATUMS = {"ellipsoidal": "WGS84 ellipsoidal height", "msl": "height above mean sea level, geoid as recorded", "relative": "height above the take-off point", "unknown": "not stated by the telemetry"}


@query("B03", "SELECT round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, 'EPSG:' || (32600 + floor((avg(lon) + 180) / 6)::BIGINT + 1) AS crs, 'unknown' AS datum, 'not stated by the telemetry' AS reference FROM telemetry")
def b03_georeference_sidecar(v):
    """What a local export needs to be placed on the earth, as one JSON record written and read back."""
    from ..sources.store import ArtifactStore

    o = v.telemetry.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("alt").alias("alt"))
    crs = F.concat(F.lit("EPSG:"), geo.utm_epsg(c("lat"), c("lon")).cast("string"))
    doc = o.select(F.lit("local metres, with a georeferenced twin").alias("frame"), F.struct("lat", "lon", "alt").alias("origin"), crs.alias("crs"), F.lit("unknown").alias("datum"), F.lit(_DATUMS["unknown"]).alias("reference"))
    store = ArtifactStore.temporary(v.spark)
    store.write_json("georeference", doc)
    return store.read_json("georeference", doc.schema).select(r(c("origin.lat"), 9).alias("lat"), r(c("origin.lon"), 9).alias("lon"), "crs", "datum", "reference")


@query("Q10", f"SELECT s_suppkey AS mission, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'msl' END AS datum, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '{_DATUMS['msl']}' END AS reference, s_suppkey % 4 = 0 AS refused, s_suppkey * 7 AS revision FROM supplier")
def q10_relabel_datum(v):
    """A mission's heights get another label; one without a place on the earth is refused, and revisions stay as they are."""
    k = c("s_suppkey")
    head = v.supplier.select(k.alias("mission"), (k % 4 != 0).alias("georeferenced"), F.lit("unknown").alias("datum"), (k * 7).alias("revision"))
    ok = c("georeferenced")
    return head.select("mission", F.when(ok, "msl").alias("datum"), F.when(ok, _DATUMS["msl"]).alias("reference"), (~ok).alias("refused"), "revision")


@query("B15", "SELECT count(*) AS n, round(sum(x::FLOAT::DOUBLE), 2) AS sx, round(sum(z::FLOAT::DOUBLE), 2) AS sz, sum(r)::BIGINT AS sr, sum(provenance)::BIGINT AS sp FROM points")
def b15_raw_cloud(v):
    """Sixteen bytes a point: three floats, three colours, a class; made per task, and read back."""
    from ..sources import cloud_files

    blobs = cloud_files.to_raw(v.points.select("x", "y", "z", "r", "g", "b", "provenance"))
    return cloud_files.from_raw(blobs).agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 2).alias("sx"), r(F.sum("z"), 2).alias("sz"), F.sum("r").alias("sr"), F.sum("provenance").alias("sp"))


@query("B18", "SELECT p_brand AS name, count(*) AS files, sum(p_size)::BIGINT AS bytes, '| ' || p_brand || ' | ' || count(*) || ' | ' || sum(p_size) || ' |' AS line FROM part GROUP BY 1")
def b18_catalog(v):
    """The inventory as a CSV file, read back, and as lines of a markdown table."""
    from ..sources.store import ArtifactStore

    g = v.part.groupBy(c("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("p_size").alias("bytes"))
    store = ArtifactStore.temporary(v.spark)
    g.write.option("header", True).csv(f"{store.path}/catalog")
    back = v.spark.read.schema(g.schema).option("header", True).csv(f"{store.path}/catalog")
    return back.select("name", "files", "bytes", F.concat_ws(" ", F.lit("|"), "name", F.lit("|"), c("files").cast("string"), F.lit("|"), c("bytes").cast("string"), F.lit("|")).alias("line"))


@query("B19 J10", "SELECT p_brand AS mission, count(*) AS files, substr(sha256(string_agg(p_partkey || ':' || p_size, chr(10) ORDER BY p_partkey)), 1, 16) AS revision, sum(p_size)::BIGINT AS bytes, 'EPSG:32650' AS crs FROM part GROUP BY 1")
def b19_evidence_package(v):
    """What an answer rests on: files, their sizes, and a revision over sorted name:size lines, by mission."""
    line = F.struct("p_partkey", F.concat_ws(":", c("p_partkey").cast("string"), c("p_size").cast("string")).alias("s"))
    g = v.part.groupBy(c("p_brand").alias("mission")).agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list(line)).alias("l"), F.sum("p_size").alias("bytes"))  # one line a file of a mission
    return g.select("mission", "files", F.substring(F.sha2(F.array_join(c("l.s"), "\n"), 256), 1, 16).alias("revision"), "bytes", F.lit("EPSG:32650").alias("crs"))


# Heights, throttles, previews
_GEOID = "gd AS (SELECT a.i, b.j, (a.i * 37 + b.j * 11) % 50 / 1e1 - 30 AS n FROM range(2190, 2330) a(i), range(11390, 11510) b(j))"


@query("C08", f"""WITH {_GEOID}, p AS (SELECT event_id, lat * 100 AS y, lon * 100 AS x, alt FROM telemetry)
SELECT p.event_id, round(p.alt - ((1 - (y - floor(y))) * ((1 - (x - floor(x))) * a.n + (x - floor(x)) * b.n) + (y - floor(y)) * ((1 - (x - floor(x))) * d.n + (x - floor(x)) * e.n)), 6) AS height
FROM p JOIN gd a ON a.i = floor(y) AND a.j = floor(x) JOIN gd b ON b.i = floor(y) AND b.j = floor(x) + 1 JOIN gd d ON d.i = floor(y) + 1 AND d.j = floor(x) JOIN gd e ON e.i = floor(y) + 1 AND e.j = floor(x) + 1""")
def c08_orthometric_height(v):
    """Height above the geoid, bilinear in a grid of geoid heights; a place the grid doesn't cover is refused, never guessed."""
    grid = v.spark.range(2190, 2330).select(c("id").alias("i"), F.explode(F.sequence(F.lit(11390).cast("long"), F.lit(11509).cast("long"))).alias("j")).withColumn("n", (c("i") * 37 + c("j") * 11) % 50 / 10.0 - 30)
    return orthometric(v.telemetry.select("event_id", "lat", "lon", "alt"), grid, "event_id", 100.0).select("event_id", r(c("height")).alias("height"))


def orthometric(points, grid, key: str, per_degree: float):
    y, x = c("lat") * per_degree, c("lon") * per_degree
    p = points.select(key, "alt", F.floor(y).alias("i0"), F.floor(x).alias("j0"), (y - F.floor(y)).alias("ty"), (x - F.floor(x)).alias("tx"))
    corner = lambda a, b: F.struct((c("i0") + a).alias("i"), (c("j0") + b).alias("j"), ((c("ty") if a else 1 - c("ty")) * (c("tx") if b else 1 - c("tx"))).alias("w"))
    four = p.select(key, "alt", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("k")).select(key, "alt", "k.*")
    n = four.join(grid, ["i", "j"], "left").groupBy(key).agg(F.first("alt").alias("alt"), F.sum(c("w") * c("n")).alias("n"), F.count("n").alias("known"))
    return n.select(key, F.when(c("known") == 4, c("alt") - c("n")).otherwise(F.raise_error(F.lit("no geoid grid at this place"))).alias("height"))


@query("N03", "SELECT user_id, floor(epoch_us(ts) / 36e8)::BIGINT AS slot, max(event_id) AS saved, count(*) AS seen FROM events GROUP BY 1, 2")
def n03_throttled_state(v):
    """Of a stream of states one per job and interval is persisted, the newest; tests run the same plan on a stream."""
    from ..streaming import progress

    e = v.events.select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("us"))
    return progress.throttled(e, "user_id", c("us"), 3_600_000_000, "event_id").withColumnRenamed("newest", "saved")


@query("N06", "WITH p AS (SELECT floor(x / 10)::BIGINT AS b, z, point_id FROM points) SELECT b, count(*) AS n, round(avg(z), 6) AS full_mean, count(*) FILTER (WHERE point_id % 16 = 0) AS n_preview, round(avg(z) FILTER (WHERE point_id % 16 = 0), 6) AS preview FROM p GROUP BY 1")
def n06_preview_then_full(v):
    """The same query first on a sixteenth of the points, then on all: both answers side by side."""
    p = v.points.select(F.floor(c("x") / 10).alias("b"), "z", "point_id")
    first = c("point_id") % 16 == 0
    return p.groupBy("b").agg(F.count(F.lit(1)).alias("n"), r(F.avg("z")).alias("full_mean"), F.count_if(first).alias("n_preview"), r(F.avg(F.when(first, c("z")))).alias("preview"))


def quaternion_from_normal(x, y, z):
    """(w, x, y, z) of the turn that brings the third axis onto a unit normal."""
    size = F.sqrt(x * x + y * y)
    half = F.atan2(size, z) / 2
    flat = size <= 1e-9
    return (
        F.when(flat, F.when(z < 0, 0.0).otherwise(1.0)).otherwise(F.cos(half)),
        F.when(flat, F.when(z < 0, 1.0).otherwise(0.0)).otherwise(-y / size * F.sin(half)),
        F.when(flat, 0.0).otherwise(x / size * F.sin(half)),
        F.lit(0.0),
    )


@query("C25", "SELECT point_id, round(cos(acos(nz) / 2), 6) AS w, round(CASE WHEN nx = 0 AND ny = 0 THEN 0 ELSE -ny / sqrt(nx * nx + ny * ny) * sin(acos(nz) / 2) END, 6) AS qx, round(CASE WHEN nx = 0 AND ny = 0 THEN 0 ELSE nx / sqrt(nx * nx + ny * ny) * sin(acos(nz) / 2) END, 6) AS qy FROM (SELECT point_id, a / l AS nx, b / l AS ny, d / l AS nz FROM (SELECT *, sqrt(a * a + b * b + d * d) AS l FROM (SELECT point_id, (point_id % 7 - 3)::DOUBLE AS a, (point_id % 5 - 2)::DOUBLE AS b, 1e0 + point_id % 3 AS d FROM points)))")
def c25_quaternion_from_normal(v):
    k = c("point_id")
    n = v.points.select(k, (k % 7 - 3).cast("double").alias("a"), (k % 5 - 2).cast("double").alias("b"), (k % 3 + 1).cast("double").alias("d"))
    size = F.sqrt(c("a") * c("a") + c("b") * c("b") + c("d") * c("d"))
    q = quaternion_from_normal(c("a") / size, c("b") / size, c("d") / size)
    return n.select("point_id", r(q[0]).alias("w"), r(q[1]).alias("qx"), r(q[2]).alias("qy"))


@query("P11 C25", None)
def p11_splat_initialisation(v):
    """Initial splats: scale from the spacing of four neighbours, orientation from their plane, colour and opacity from the point."""
    p = v.points.select("point_id", "x", "y", "z")
    near = spatial.nearest(p, p, "point_id", "point_id", ["x", "y", "z"], 4, 8.0, other=True).select(c("q.point_id").alias("point_id"), "p.x", "p.y", "p.z", "d")
    around = near.unionByName(p.withColumn("d", F.lit(None).cast("double")))
    pairs = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
    s = around.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("spacing"), *[F.covar_pop(a, b).alias(a + b) for a, b in pairs])
    s = s.select(c("point_id").alias("vx"), F.lit(0).cast("long").alias("vy"), "n", *[a + b for a, b in pairs], "spacing")
    flat = graph.cut(s)
    n = flat.drop("spacing").mapInPandas(solvers.normals, "vx long, vy long, n long, nx double, ny double, nz double, planarity double, degenerate boolean")
    q = quaternion_from_normal(c("nx"), c("ny"), c("nz"))
    o = 0.1 + c("confidence") * 0.89
    size = F.greatest("spacing", F.lit(1e-6))
    return n.join(flat.select("vx", "spacing"), "vx").join(v.points.select(c("point_id").alias("vx"), "r", "confidence"), "vx").select(
        c("vx").alias("point_id"), r(F.log(size)).alias("scale"), r(F.log(F.greatest(size * 0.1, F.lit(1e-7)))).alias("thickness"), *[r(x, 5).alias(f"q{k}") for x, k in zip(q, "wxyz")], r((c("r") / 255.0 - 0.5) / 0.28209479177387814).alias("dc"), r(F.log(o / (1 - o))).alias("logit")
    )
