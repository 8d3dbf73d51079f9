"""Domain views over the star-schema tables: one SQL text each, used by Spark and, as common table expressions, by DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

# Doubles are written with an exponent: a plain decimal literal would be DECIMAL.
VIEWS = {
    "points": """SELECT p_partkey AS point_id, (p_partkey * 7919 % 1000) / 1e1 AS x, (p_partkey * 104729 % 1000) / 1e1 AS y, p_size / 5e0 AS z,
 p_partkey * 31 % 256 AS r, p_partkey * 57 % 256 AS g, p_partkey * 91 % 256 AS b, (p_partkey * 13 % 100) / 1e2 AS confidence,
 CASE WHEN p_partkey % 20 = 0 THEN 2 WHEN p_partkey % 10 = 1 THEN 1 WHEN p_partkey % 17 = 3 THEN 4 ELSE 0 END AS provenance,
 CASE WHEN p_partkey % 23 <> 0 THEN 2e-2 + p_size / 5e2 END AS sigma_major, CASE WHEN p_partkey % 23 <> 0 THEN (2e-2 + p_size / 5e2) / 2e0 END AS sigma,
 2 + p_partkey % 7 AS n_views, (p_partkey % 50) / 1e1 AS reproj, (p_partkey * 3 % 200) / 1e1 AS angle FROM {part}""",
    "cameras": """SELECT s_suppkey AS camera_id, s_suppkey * 3 AS frame_index, 1e1 * (s_suppkey % 10) AS cx, 1e1 * floor(s_suppkey / 1e1) AS cy, 6e1 + s_acctbal / 1e3 AS cz,
 s_suppkey * 37 % 360 * 1e0 AS yaw, (s_suppkey * 11 % 60) - 3e1 AS pitch, (s_suppkey * 7 % 40) - 2e1 AS roll, s_suppkey * 5e-1 AS t FROM {supplier}""",
    "observations": """SELECT l_partkey AS point_id, l_suppkey AS camera_id, l_orderkey, l_linenumber, l_extendedprice / 1e2 AS u, l_quantity * 1e1 AS v,
 CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS kind, l_quantity AS quantity FROM {lineitem}""",
    "dense": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1e3 AS x, l_quantity * 2 + (l_partkey % 100) / 1e2 AS y, 1e2 * l_discount + 1e1 * l_tax AS z,
 CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END AS provenance, 1e-2 + l_discount / 5 AS sigma FROM {lineitem}""",
    "telemetry": """SELECT event_id, user_id AS track, EPOCH(ts) AS t, 22 + value / 1e3 AS lat, 114 + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 1e3 AS lon,
 5e1 + (event_id * 7 % 100) / 1e1 AS alt, event_id * 37 % 360 * 1e0 AS yaw, 1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 1e2 AS acc, event_type AS fix FROM {events}""",
    "frames": """SELECT event_id AS frame_index, track, t + (event_id * 13 % 600) * 1e1 - 3e3 AS t, (event_id * 17 % 1200) / 1e1 AS blur, (event_id * 29 % 256) * 1e0 AS brightness,
 (event_id * 7 % 100) / 1e2 AS dark_frac, (event_id * 3 % 80) / 1e2 AS bright_frac, (event_id * 11 % 1000) / 1e5 AS motion FROM {telemetry}""",
    "errors": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS regime, l_linestatus AS mission, l_tax - 4e-2 AS error, 1e-2 + l_discount / 5 AS sigma FROM {lineitem}""",
    "survey": """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'gcp' ELSE 'check' END AS role, p_partkey % 25 AS mission, (p_partkey * 7919 % 1000) / 1e1 AS te, (p_partkey * 104729 % 1000) / 1e1 AS tn, p_size / 5e0 AS tu,
 (p_partkey * 7919 % 1000) / 1e1 + 3e-1 + (p_partkey % 11 - 5) / 1e2 AS me, (p_partkey * 104729 % 1000) / 1e1 - 2e-1 + (p_partkey % 7 - 3) / 1e2 AS mn, p_size / 5e0 + 5e-1 + (p_partkey % 13 - 6) / 1e2 AS mu
 FROM {part}""",
    "cells": """SELECT CAST(floor(y / 2e0) AS BIGINT) AS rw, CAST(floor(x / 2e0) AS BIGINT) AS cl, max(z) AS dsm, min(z) AS zmin, round(avg(z), 9) AS zmean, count(*) AS n, round(avg(sigma), 9) AS sigma
 FROM {dense} WHERE provenance = 0 GROUP BY 1, 2""",
    "bench": """SELECT l_returnflag AS variant, l_linestatus AS regime, l_linenumber AS seed, l_extendedprice / 1e5 AS ate, l_quantity AS seconds, l_discount > 95e-3 AS failed FROM {lineitem}""",
    "edges": """SELECT DISTINCT l_suppkey AS i, (l_suppkey + 1 + l_partkey % 7) AS j, l_partkey % 50 + 10 AS inliers FROM {lineitem}""",
}


class Views:
    """Attribute access to tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                text = VIEWS[name].replace("EPOCH(ts)", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1e6")
                self._made[name] = self.spark.sql(text, **{k: getattr(self, k) for k in re.findall(r"\{(\w+)\}", text)})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def _needed(sql: str, found: dict) -> None:
    for name, text in VIEWS.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(text, found)
            found[name] = text


def duck(sql: str) -> str:
    """`sql` for DuckDB with the views it names in front."""
    found: dict[str, str] = {}
    _needed(sql, found)
    parts = [f"{n} AS ({re.sub(r'[{}]', '', t).replace('EPOCH(ts)', 'epoch_us(ts) / 1e6')})" for n, t in found.items()]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        body, word = body[5:].strip(), "WITH "
        if body[:10].upper() == "RECURSIVE ":
            body, word = body[10:], "WITH RECURSIVE "
        return word + ",\n".join([*parts, body])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
