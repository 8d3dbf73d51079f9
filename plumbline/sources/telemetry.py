"""Telemetry readers as DataFrame plans: CSV by header aliases, JSON, subtitle blocks, solution files.

Bad rows are kept apart with their reason, never dropped in silence; columns
without a meaning here go to `extra`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The header names each field goes by, and unit words that may follow one.  Nanoseconds, milliseconds and microseconds are other fields, not units.
ALIASES = {
    "timestamp": ("timestamp", "time", "t", "ts", "seconds", "frame_time"),
    "latitude": ("latitude", "lat", "gps_lat"),
    "longitude": ("longitude", "lon", "lng", "long", "gps_lon"),
    "altitude": ("altitude", "alt", "height", "gps_alt", "ellipsoidal_altitude"),
    "roll": ("roll",),
    "pitch": ("pitch", "gimbal_pitch"),
    "yaw": ("yaw", "heading", "compass_heading"),
    "velocity": ("velocity", "speed", "ground_speed"),
    "gps_accuracy": ("gps_accuracy", "hdop", "accuracy", "hacc"),
    "rtk_status": ("rtk_status", "rtk", "fix_type"),
}
UNITS = (
    "m", "meter", "meters", "metre", "metres", "ft", "feet", "deg", "degree", "degrees", "rad", "radian", "radians", "s", "sec", "secs", "second", "seconds", "mps", "kmh", "kph", "mph", "knots", "msl", "agl", "wgs84", "ellipsoidal", "orthometric",
)
INTRINSICS = ("fx", "fy", "cx", "cy")


def plain(header: str) -> str:
    """Lower case, words joined by underscores."""
    return re.sub(r"[^a-z0-9]+", "_", header.strip().lower()).strip("_")


def without_units(header: str) -> str:
    """The name without bracketed units and trailing unit words."""
    words = plain(re.sub(r"[\[({][^\])}]*[\])}]", " ", header)).split("_")
    while len(words) > 1 and words[-1] in UNITS:
        words.pop()
    return "_".join(words)


def resolve(headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """(field -> header, warnings): an exact alias beats one found without its unit; a second match is reported."""
    found: dict[str, str] = {}
    warnings = []
    for how in (plain, without_units):
        for field, names in ALIASES.items():
            for h in headers:
                if how(h) in names and h not in found.values():
                    if field in found:
                        if how is plain:
                            warnings.append(f"{field}: {h} ignored, {found[field]} is used")
                    else:
                        found[field] = h
    return found, warnings


def number(x: Column) -> Column:
    """A finite number, or null."""
    v = F.trim(x).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def from_columns(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Typed telemetry of string columns with any headers; a missing timestamp becomes the row's number by `order`."""
    found, _ = resolve(rows.columns)
    out = {}
    for field in ALIASES:
        src = F.col(f"`{found[field]}`") if field in found else F.lit(None).cast("string")
        out[field] = src if field == "rtk_status" else number(src)
    taken = set(found.values())
    lifted = {k: number(F.col(f"`{h}`")) for k in INTRINSICS for h in rows.columns if plain(h) == k and h not in taken}
    rest = [h for h in rows.columns if h not in taken and plain(h) not in INTRINSICS and h != order]
    extra = F.create_map(*[x for h in rest for x in (F.lit(h), F.col(f"`{h}`").cast("string"))]) if rest else F.create_map().cast("map<string,string>")
    if "timestamp" not in found and order:
        out["timestamp"] = F.col(order).cast("double")
    return rows.select(*[e.alias(k) for k, e in (out | lifted).items()], extra.alias("extra"), *([F.col(order)] if order else [])).withColumn("reject", reject_reason())


def reject_reason() -> Column:
    lat, lon, alt = (F.col(k) for k in ("latitude", "longitude", "altitude"))
    return (
        F.when(lat.isNull() | lon.isNull(), "position missing")
        .when(~lat.between(-90, 90), "latitude out of range")
        .when(~lon.between(-180, 180), "longitude out of range")
        .when(alt.isNull(), "altitude missing")
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return from_columns(rows.withColumn("_row", F.monotonically_increasing_id()), "_row")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of samples, or an object with `samples`."""
    rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if rows.columns == ["samples"] or "samples" in rows.columns:
        rows = rows.select(F.explode("samples").alias("s")).select("s.*")
    return from_columns(rows)


SRT = {
    "latitude": r"lat(?:itude)?\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)",
    "longitude": r"lon(?:g|gitude)?\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)",
    "abs_alt": r"abs_alt\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)",
    "rel_alt": r"rel_alt\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)",
    "bare_alt": r"(?<![a-z_])altitude\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)",
    "yaw": r"gb_yaw\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)",
}
_START = r"([0-9]{2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})\s*-->"


def from_srt_blocks(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Fields of subtitle blocks; which altitude there was is told, and none is flagged rather than made zero in silence."""
    b = F.col(block)
    got = {k: number(F.nullif(F.regexp_extract(b, p, 1), F.lit(""))) for k, p in SRT.items()}
    part = [F.regexp_extract(b, _START, k).try_cast("double") for k in range(1, 5)]
    rest = [F.col(x) for x in blocks.columns if x != block]
    alt = F.coalesce(got["abs_alt"], got["rel_alt"], got["bare_alt"])
    reference = F.when(got["abs_alt"].isNotNull(), "absolute").when(got["rel_alt"].isNotNull(), "relative").when(got["bare_alt"].isNotNull(), "unknown").otherwise("missing")
    return blocks.select(*rest, (part[0] * 3600 + part[1] * 60 + part[2] + part[3] / 1000).alias("timestamp"), got["latitude"].alias("latitude"), got["longitude"].alias("longitude"), F.coalesce(alt, F.lit(0.0)).alias("altitude"), reference.alias("altitude_reference"), got["yaw"].alias("yaw"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return from_srt_blocks(spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "block"))


def from_pos_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Epoch lines of a solution file: date and time, or week and time of week; then position, quality, satellites."""
    tok = F.split(F.trim(F.col(line)), r"\s+")
    dated = tok[0].contains("/")
    stamp = F.try_to_timestamp(F.concat_ws(" ", tok[0], F.substring_index(tok[1], ".", 1)), F.lit("yyyy/MM/dd HH:mm:ss"))
    frac = F.coalesce(F.concat(F.lit("0."), F.nullif(F.regexp_extract(tok[1], r"\.([0-9]+)$", 1), F.lit(""))).try_cast("double"), F.lit(0.0))
    t = F.when(dated, F.unix_timestamp(stamp) + frac).otherwise(315964800 + tok[0].try_cast("double") * 604800 + tok[1].try_cast("double"))
    q = tok[5].try_cast("int")
    names = {1: "fixed", 2: "float", 3: "sbas", 4: "dgps", 5: "single", 6: "ppp"}
    rest = [F.col(x) for x in lines.columns if x != line]
    rows = lines.where(~F.col(line).startswith("%"))
    return rows.select(*rest, t.alias("timestamp"), number(tok[2]).alias("latitude"), number(tok[3]).alias("longitude"), number(tok[4]).alias("altitude"), F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), q).alias("rtk_status"))


def pos_header(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row: time system, coordinate form and height datum that the % lines tell."""
    h = lines.where(F.col(line).startswith("%"))
    has = lambda p: F.coalesce(F.bool_or(F.col(line).rlike(p)), F.lit(False))
    return h.agg(
        F.when(has("(?i)UTC"), "utc").when(has("(?i)JST"), "jst").otherwise("gpst").alias("time_system"),
        F.when(has("x-ecef"), "ecef").when(has("d'\""), "dms").otherwise("deg").alias("form"),
        F.when(has("(?i)geodetic"), "orthometric").when(has("(?i)ellipsoidal"), "ellipsoidal").otherwise("unknown").alias("height"),
    )


ATTITUDES = {"gimbal": "gb|gimbal", "flight": "fl|flight|drone"}


def attitudes(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Camera (gimbal_*) and airframe (flight_*) attitude in degrees and the focal length of subtitle blocks."""
    b = F.col(block)
    value = lambda name: number(F.nullif(F.regexp_extract(b, rf"(?i)\b(?:{name})\s*[:=]?\s*(-?[0-9]+\.?[0-9]*)", 1), F.lit("")))
    out = {f"{what}_{axis}": value(rf"(?:{names})_?{axis}") for what, names in ATTITUDES.items() for axis in ("yaw", "pitch", "roll")}
    rest = [F.col(x) for x in blocks.columns if x != block]
    return blocks.select(*rest, *[x.alias(k) for k, x in out.items()], value(r"focal_?len[a-z]*").alias("focal"))


def from_pos_files(lines: DataFrame, file: str, gps_minus_utc, line: str = "line") -> DataFrame:
    """Epoch lines of many solution files, each read as its own header says: clock, coordinate form, height datum.

    utc: seconds; latitude, longitude, altitude in degrees and metres; other
    columns stay.  A line that can't be read has nulls; header lines go.
    """
    head = lines.where(F.col(line).startswith("%")).groupBy(file)
    has = lambda p: F.coalesce(F.bool_or(F.col(line).rlike(p)), F.lit(False))
    told = head.agg(
        F.when(has(r"(?i)^%\s*UTC"), "utc").when(has(r"(?i)^%\s*JST"), "jst").otherwise("gpst").alias("_clock"),
        F.when(has("x-ecef"), "xyz").when(has("""latitude\\(d'"\\)|\\(dms\\)"""), "dms").otherwise("deg").alias("_form"),
        F.when(has("(?i)height=.*geodetic"), "msl").when(has("(?i)height=.*ellipsoidal"), "ellipsoidal").otherwise("unknown").alias("datum"),
    )
    rows = lines.where(~F.col(line).startswith("%"))
    tok = F.split(F.trim(F.col(line)), r"\s+")
    # numbers become columns first: what follows names each of them many times; `told` is one short row a file, and dealing lines by file would put a file into one task
    rows = rows.withColumns({f"_n{k}": number(F.get(tok, F.lit(k))) for k in range(9)}).join(F.broadcast(told), file, "left").withColumns({"_clock": F.coalesce("_clock", F.lit("gpst")), "_form": F.coalesce("_form", F.lit("deg")), "datum": F.coalesce("datum", F.lit("unknown"))})
    n = lambda k: F.col(f"_n{k}")
    dated = tok[0].contains("/")
    stamp = F.try_to_timestamp(F.concat_ws(" ", tok[0], F.substring_index(tok[1], ".", 1)), F.lit("yyyy/MM/dd HH:mm:ss"))
    frac = F.coalesce(F.concat(F.lit("0."), F.nullif(F.regexp_extract(tok[1], r"\.([0-9]+)$", 1), F.lit(""))).try_cast("double"), F.lit(0.0))
    t = F.when(dated, F.unix_timestamp(stamp) + frac).otherwise(315964800 + n(0) * 604800 + n(1))
    day = F.date_format(F.timestamp_seconds(t.cast("long")), "yyyy-MM-dd")
    utc = F.when(F.col("_clock") == "utc", t).when(F.col("_clock") == "jst", t - 32400).otherwise(t - gps_minus_utc(day))
    sign = lambda k: F.when(F.get(tok, F.lit(k)).startswith("-"), -1.0).otherwise(1.0)
    dms = lambda k: sign(k) * (F.abs(n(k)) + n(k + 1) / 60 + n(k + 2) / 3600)
    from ..functions import geo

    world = geo.ecef_to_geodetic(n(2), n(3), n(4))
    pick = lambda deg, minutes, xyz: F.when(F.col("_form") == "dms", minutes).when(F.col("_form") == "xyz", xyz).otherwise(deg)
    rest = [F.col(x) for x in lines.columns if x not in (line, file)]
    return rows.select(file, *rest, utc.alias("utc"), pick(n(2), dms(2), world[0]).alias("latitude"), pick(n(3), dms(5), world[1]).alias("longitude"), pick(n(4), n(8), world[2]).alias("altitude"), "datum")


def read_pos(spark: SparkSession, path: str) -> DataFrame:
    return from_pos_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """By extension; other kinds are refused by name."""
    kinds = {"csv": read_csv, "json": read_json, "srt": read_srt, "pos": read_pos}
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in kinds:
        raise ValueError(f"no telemetry reader for .{kind}; there are {', '.join(sorted(kinds))}")
    return kinds[kind](spark, path)
