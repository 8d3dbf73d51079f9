"""Coordinates as Column expressions: WGS84, ENU, UTM, similarities, attitudes, quaternions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of WGS84.
A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
B = A * (1 - FLAT)


def geodetic_to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - E2) + alt) * F.sin(la)


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 2) -> tuple[Column, Column, Column]:
    """Latitude by the reduced latitude, whose error a round shrinks a million times; each round names its angle only twice, so the expression stays small."""
    p = F.hypot(x, y)
    reduced = F.atan2(z * A, p * B)
    for k in range(rounds):
        sin, cos = F.sin(reduced), F.cos(reduced)
        up, out = z + (A * A / (B * B) - 1) * B * F.pow(sin, F.lit(3.0)), p - E2 * A * F.pow(cos, F.lit(3.0))
        reduced = F.atan2(up * (B / A), out)
    lat = F.atan2(up, out)
    n = F.lit(A) / F.sqrt(1 - E2 * F.pow(F.sin(lat), F.lit(2.0)))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p * F.cos(lat) + z * F.sin(lat) - A * A / n


def enu_basis(lat0: Column, lon0: Column) -> list[list[Column]]:
    la, lo = F.radians(lat0), F.radians(lon0)
    return [
        [-F.sin(lo), F.cos(lo), F.lit(0.0)],
        [-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la)],
        [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)],
    ]


def geodetic_to_enu(lat, lon, alt, lat0, lon0, alt0) -> tuple[Column, ...]:
    d = [a - b for a, b in zip(geodetic_to_ecef(lat, lon, alt), geodetic_to_ecef(lat0, lon0, alt0))]
    return tuple(r[0] * d[0] + r[1] * d[1] + r[2] * d[2] for r in enu_basis(lat0, lon0))


def enu_to_ecef(e, n, u, lat0, lon0, alt0) -> tuple[Column, ...]:
    r, o = enu_basis(lat0, lon0), geodetic_to_ecef(lat0, lon0, alt0)
    return tuple(o[k] + r[0][k] * e + r[1][k] * n + r[2][k] * u for k in range(3))


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return F.when(lat >= 0, F.lit(32600)).otherwise(32700) + zone


# Third-order coefficients of the Krueger series in the third flattening.
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def utm(lat: Column, lon: Column, lon0: Column) -> tuple[Column, Column]:
    """Easting and northing about the central meridian lon0 (northern false origin)."""
    la, lo = F.radians(lat), F.radians(lon - lon0)
    k = 2 * _N**0.5 / (1 + _N)
    s = F.sin(la)
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(lo)), F.atanh(F.sin(lo) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + 0.9996 * _RADIUS * east, 0.9996 * _RADIUS * north


def spherical_lat_lon(e: Column, n: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return lat0 + F.degrees(n / A), lon0 + F.degrees(e / (A * F.cos(F.radians(lat0))))


def rotation_zyx(yaw: Column, pitch: Column, roll: Column) -> list[list[Column]]:
    """Body to north-east-down by yaw, pitch and roll in degrees."""
    y, p, r = F.radians(yaw), F.radians(pitch), F.radians(roll)
    cy, sy, cp, sp, cr, sr = F.cos(y), F.sin(y), F.cos(p), F.sin(p), F.cos(r), F.sin(r)
    return [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]


def matmul(a: list[list], b: list[list]) -> list[list]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def apply(r: list[list], v: tuple) -> tuple:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in r)


def quaternion(r: list[list]) -> tuple[Column, ...]:
    """(w, x, y, z) of a rotation matrix by the largest of four pivots."""
    trace = r[0][0] + r[1][1] + r[2][2]
    big = [F.sqrt(F.greatest(F.lit(0.0), s)) * 2 for s in (trace + 1, 1 + r[0][0] - r[1][1] - r[2][2], 1 - r[0][0] + r[1][1] - r[2][2], 1 - r[0][0] - r[1][1] + r[2][2])]
    a, b, c = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
    d, e, f = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
    rows = [(big[0] / 4, a / big[0], b / big[0], c / big[0]), (a / big[1], big[1] / 4, d / big[1], e / big[1]), (b / big[2], d / big[2], big[2] / 4, f / big[2]), (c / big[3], e / big[3], f / big[3], big[3] / 4)]
    first = (r[0][0] > r[1][1]) & (r[0][0] > r[2][2])
    return tuple(F.when(trace > 0, rows[0][k]).when(first, rows[1][k]).when(r[1][1] > r[2][2], rows[2][k]).otherwise(rows[3][k]) for k in range(4))


def matrix(q: tuple) -> list[list]:
    """Rotation matrix of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def viewer_axes(r: list[list]) -> list[list]:
    """World-to-camera with y down and z ahead, to camera-to-world with y up and z back."""
    return [[r[0][k], -r[1][k], -r[2][k]] for k in range(3)]


def slerp(q0: tuple, q1: tuple, t: Column) -> tuple[Column, ...]:
    """Shorter way round; straight interpolation beyond a cosine of 0.9995."""
    dot = sum((a * b for a, b in zip(q0[1:], q1[1:])), q0[0] * q1[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    cos = F.abs(dot)
    angle = F.acos(F.least(cos, F.lit(1.0)))
    lerp = [a + (sign * b - a) * t for a, b in zip(q0, q1)]
    norm = F.sqrt(sum((x * x for x in lerp[1:]), lerp[0] * lerp[0]))
    w0, w1 = F.sin((1 - t) * angle) / F.sin(angle), F.sin(t * angle) / F.sin(angle) * sign
    return tuple(F.when(cos > 0.9995, x / norm).otherwise(a * w0 + b * w1) for x, a, b in zip(lerp, q0, q1))


def angle_between(a0: Column, a1: Column, w: Column) -> Column:
    """Heading at share w of the shorter way from a0 to a1; where one is null, the other."""
    d = F.pmod(a1 - a0 + 180, F.lit(360.0)) - 180
    return F.coalesce(F.pmod(a0 + w * d, F.lit(360.0)), a0, a1)
