"""Corrections fitted to surveyed points, and what is left of the error after them.

A correction is fitted from sums (means, cross products, spread), so a mission
of any size is one row to the solver, and leaving a point out is taking its part
off the sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
COLLINEAR = 0.05  # fixed value: least ratio of the horizontal spreads for a similarity
MEASURED, TRUTH = ("me", "mn", "mu"), ("te", "tn", "tu")
CROSS = [f"x{i}{j}" for i in range(3) for j in range(3)]  # truth i times measured j
PARAMETERS = "kind string, n_points long, scale double, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", t0 double, t1 double, t2 double"


def fit(n, measured, truth, cross, total, vxx, vxy, vyy):
    """Corrections of many sets at once from their sums over points; arrays of k, k x 3, k x 3, k x 3 x 3, k, k, k, k.

    (kind, scale, rotation, shift): a similarity for three points or more that
    aren't nearly on a line, a translation for fewer, none without a point.
    """
    some = np.maximum(n, 1)[:, None]
    mm, mt = measured / some, truth / some
    cov = cross / some[:, :, None] - mt[:, :, None] * mm[:, None, :]
    spread = total / some[:, 0] - (mm * mm).sum(1)
    a, b, d = vxx / some[:, 0] - mm[:, 0] ** 2, vxy / some[:, 0] - mm[:, 0] * mm[:, 1], vyy / some[:, 0] - mm[:, 1] ** 2
    middle, half = (a + d) / 2, np.hypot((a - d) / 2, b)
    ratio = np.sqrt(np.maximum(middle - half, 0) / np.maximum(middle + half, 1e-300))
    whole = (n >= 3) & (middle + half > 0) & (ratio >= COLLINEAR)
    u, s, vt = np.linalg.svd(np.where(whole[:, None, None], cov, np.eye(3)))
    turn = np.ones_like(s)
    turn[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
    rotation = np.where(whole[:, None, None], (u * turn[:, None, :]) @ vt, np.eye(3))
    scale = np.where(whole, (s * turn).sum(1) / np.maximum(spread, 1e-300), 1.0)
    shift = np.where((n > 0)[:, None], mt - scale[:, None] * np.einsum("kij,kj->ki", rotation, mm), 0.0)
    kind = np.where(whole, "similarity", np.where(n > 0, "translation", "none"))
    return kind, scale, rotation, shift


def _from_frame(t: pd.DataFrame):
    get = lambda names: t[list(names)].to_numpy(float)
    return fit(t["n"].to_numpy(float), get(f"s_{k}" for k in MEASURED), get(f"s_{k}" for k in TRUTH), get(CROSS).reshape(-1, 3, 3), t["total"].to_numpy(float), t["vxx"].to_numpy(float), t["vxy"].to_numpy(float), t["vyy"].to_numpy(float))


def centred(points: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(points less their group's means, sums per group): differences keep their digits whatever the coordinates' size."""
    means = points.groupBy(by).agg(*[F.avg(k).alias(f"m_{k}") for k in MEASURED + TRUTH])
    rows = points.join(means, by).select("*", *[(c(k) - c(f"m_{k}")).alias(f"d_{k}") for k in MEASURED + TRUTH])
    terms = {"n": F.lit(1), **{f"s_{k}": c(f"d_{k}") for k in MEASURED + TRUTH}, **_products()}
    sums = rows.groupBy(by).agg(*[F.sum(e).alias(k) for k, e in terms.items()], *[F.first(f"m_{k}").alias(f"m_{k}") for k in MEASURED + TRUTH])
    return rows, sums


def _products() -> dict:
    m, t = [c(f"d_{k}") for k in MEASURED], [c(f"d_{k}") for k in TRUTH]
    return {f"x{i}{j}": t[i] * m[j] for i in range(3) for j in range(3)} | {"total": m[0] * m[0] + m[1] * m[1] + m[2] * m[2], "vxx": m[0] * m[0], "vxy": m[0] * m[1], "vyy": m[1] * m[1]}


def corrections(sums: DataFrame, by: str) -> DataFrame:
    """One correction per row of `sums`, in the points' own coordinates."""
    key = sums.schema[by].dataType.simpleString()

    def run(batches):
        for t in batches:
            kind, scale, rotation, shift = _from_frame(t)
            mm, mt = (t[[f"m_{k}" for k in names]].to_numpy(float) for names in (MEASURED, TRUTH))
            shift = shift + mt - scale[:, None] * np.einsum("kij,kj->ki", rotation, mm)
            out = {by: t[by], "kind": kind, "n_points": t["n"].astype(np.int64), "scale": scale}
            yield pd.DataFrame(out | {f"r{i}{j}": rotation[:, i, j] for i in range(3) for j in range(3)} | {f"t{i}": shift[:, i] for i in range(3)})

    return sums.mapInPandas(run, f"{by} {key}, {PARAMETERS}")


def applied(points: DataFrame, fitted: DataFrame, by: str) -> DataFrame:
    """`points` with the errors e, n, u (corrected less true) and the correction's kind; a group without one is taken as it is."""
    j = points.join(fitted, by, "left")
    out = {}
    for i, (name, truth) in enumerate(zip("enu", TRUTH)):
        moved = c("scale") * sum((c(f"r{i}{k}") * c(MEASURED[k]) for k in (1, 2)), c(f"r{i}0") * c(MEASURED[0])) + c(f"t{i}")
        out[name] = F.coalesce(moved, c(MEASURED[i])) - c(truth)
    return j.withColumns(out).select(*points.columns, "e", "n", "u", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("n_points", F.lit(0)).alias("n_points"))


def left_out(points: DataFrame, by: str) -> DataFrame:
    """(by, id, e, n, u, kind): each point of a group of two or more under the correction of all others."""
    rows, sums = centred(points, by)
    names = [*CROSS, "total", "vxx", "vxy", "vyy"]
    both = rows.select(by, "id", *[f"d_{k}" for k in MEASURED + TRUTH], *[e.alias(f"own_{k}") for k, e in _products().items()]).join(sums.select(by, "n", *[f"s_{k}" for k in MEASURED + TRUTH], *names), by).where("n >= 2")
    rest = both.select(by, "id", (c("n") - 1).alias("n"), *[f"d_{k}" for k in MEASURED + TRUTH], *[(c(f"s_{k}") - c(f"d_{k}")).alias(f"s_{k}") for k in MEASURED + TRUTH], *[(c(k) - c(f"own_{k}")).alias(k) for k in names])
    key = points.schema[by].dataType.simpleString()

    def run(batches):
        for t in batches:
            kind, scale, rotation, shift = _from_frame(t)
            m, true = (t[[f"d_{k}" for k in names]].to_numpy(float) for names in (MEASURED, TRUTH))
            off = scale[:, None] * np.einsum("kij,kj->ki", rotation, m) + shift - true
            yield pd.DataFrame({by: t[by], "id": t["id"], "e": off[:, 0], "n": off[:, 1], "u": off[:, 2], "kind": kind})

    return rest.mapInPandas(run, f"{by} {key}, id long, e double, n double, u double, kind string")


def headline(horizontal, vertical, ce90, le90, n, kind, n_points):
    """The one sentence of an accuracy report."""
    text = F.format_string("RMSE horizontal %.3f m, vertical %.3f m, CE90 %.3f m, LE90 %.3f m over %d point(s)", horizontal, vertical, ce90, le90, n)
    return F.when(kind != "none", F.concat(text, F.format_string(", after a %s correction on %d GCP(s)", kind, n_points))).otherwise(text)
