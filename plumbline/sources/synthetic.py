"""Synthetic flights in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def noise(key: Column, salt: str, sigma: float) -> Column:
    """A normal deviate that depends on the key alone (two hashes, Box-Muller)."""
    u = [(F.pmod(F.xxhash64(key, F.lit(f"{salt}{k}")), F.lit(1 << 40)) + 1) / float(1 << 40) for k in (0, 1)]
    return sigma * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def trajectory(spark: SparkSession, regime: str, n: int) -> DataFrame:
    i = F.col("id")
    s = i / float(n)
    forms = {
        "orbit": (40 * F.cos(2 * math.pi * s), 40 * F.sin(2 * math.pi * s), F.lit(60.0)),
        "nadir_grid": ((i % 10) * 8.0 - 36, F.floor(i / 10) * 8.0 - 36, F.lit(70.0)),
        "oblique_pass": (-60 + 120 * s, F.lit(-40.0), F.lit(50.0)),
        "low_parallax": (s * 1.0, F.lit(0.0), F.lit(60.0)),
    }
    if regime not in forms:
        raise ValueError(f"no regime {regime}; there are {', '.join(forms)}")
    e, north, u = forms[regime]
    return spark.range(n).select(i.alias("frame"), e.alias("e"), north.alias("n"), u.alias("u"))


def gps(track: DataFrame, horizontal: float = 2.5, vertical: float = 4.0) -> DataFrame:
    """Measured positions of a track, the same each time."""
    k = F.col("frame")
    return track.select("frame", *[(F.col(a) + noise(k, a, s)).alias(a) for a, s in (("e", horizontal), ("n", horizontal), ("u", vertical))])
