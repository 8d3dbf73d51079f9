"""Point cloud files: PLY both ways, raw display records, COLMAP text poses."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}


def parse_ply(content: bytes) -> np.ndarray:
    """The vertices of an ascii or little-endian binary file as a record array."""
    head, _, body = content.partition(b"end_header\n")
    lines = head.decode("ascii").split("\n")
    form = next(x.split()[1] for x in lines if x.startswith("format"))
    count, props, now = 0, [], ""
    for line in lines:
        w = line.split()
        if w[:1] == ["element"]:
            now = w[1]
            count = int(w[2]) if now == "vertex" else count
        elif w[:1] == ["property"] and now == "vertex":
            props.append((w[2], _TYPES[w[1]]))
    kind = np.dtype(props)
    if form == "binary_little_endian":
        return np.frombuffer(body, kind, count)
    if form != "ascii":
        raise ValueError(f"PLY format {form} isn't read")
    rows = [tuple(r.split()) for r in body.decode("ascii").split("\n")[:count]]
    return np.array([tuple(float(x) for x in r) for r in rows], kind)


def encode_ply(columns: dict[str, np.ndarray]) -> bytes:
    kinds = {k: ("double" if a.dtype == np.float64 else "float" if a.dtype.kind == "f" else "uchar") for k, a in columns.items()}
    n = len(next(iter(columns.values())))
    rec = np.empty(n, [(k, _TYPES[kinds[k]]) for k in columns])
    for k, a in columns.items():
        rec[k] = a
    head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property {kinds[k]} {k}\n" for k in columns) + "end_header\n"
    return head.encode() + rec.tobytes()


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, x, y, z) of every vertex; a file is one task's work."""

    def parse(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1)):
                v = parse_ply(data.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(v)), pa.array(np.arange(len(v))), *(pa.array(v[k].astype(np.float64)) for k in "xyz")], ["path", "point_id", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "path string, point_id long, x double, y double, z double")


def to_ply(points: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, content): one binary file per group with unknown sigma as NaN.  A group is a file, so its size is a file's."""

    def pack(key, t):
        t = t.sort_by("point_id")
        cols = {k: t[k].to_numpy().astype(np.float64) for k in columns}
        return pa.table({by: pa.array([key[0].as_py()], pa.int64()), "content": pa.array([encode_ply(cols)], pa.binary())})

    return points.select(F.col(by).cast("long").alias(by), "point_id", *columns).groupBy(by).applyInArrow(pack, f"{by} long, content binary")


def colmap_centres(lines: DataFrame, line: str = "line") -> DataFrame:
    """Camera centres -R^T t of the pose lines of images.txt: id, quaternion, translation, camera, name."""
    t = F.split(F.col(line), " ")
    qw, qx, qy, qz, tx, ty, tz = (t[k].cast("double") for k in range(1, 8))
    r = [
        [1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qw * qz), 2 * (qx * qz + qw * qy)],
        [2 * (qx * qy + qw * qz), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qw * qx)],
        [2 * (qx * qz - qw * qy), 2 * (qy * qz + qw * qx), 1 - 2 * (qx * qx + qy * qy)],
    ]
    centre = [-(r[0][j] * tx + r[1][j] * ty + r[2][j] * tz) for j in range(3)]
    return lines.where(F.size(t) == 10).select(t[0].cast("long").alias("image_id"), t[9].alias("name"), *[x.alias(k) for x, k in zip(centre, ("cx", "cy", "cz"))])


def safe_stem(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", name)


RAW = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("provenance", "u1")])  # sixteen bytes


def to_raw(points: DataFrame) -> DataFrame:
    """(blob): the points of each batch as raw records."""

    def run(batches):
        for batch in batches:
            rec = np.empty(batch.num_rows, RAW)
            for k in RAW.names:
                rec[k] = batch.column(k).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([rec.tobytes()], pa.binary())], ["blob"])

    return points.select(*RAW.names).mapInArrow(run, "blob binary")


def from_raw(blobs: DataFrame) -> DataFrame:
    kinds = {k: (pa.float64() if RAW[k].kind == "f" else pa.int64()) for k in RAW.names}

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                rec = np.frombuffer(blob.as_buffer(), RAW)
                yield pa.RecordBatch.from_arrays([pa.array(rec[k].astype("f8" if RAW[k].kind == "f" else "i8")) for k in RAW.names], schema=pa.schema(list(kinds.items())))

    return blobs.mapInArrow(run, ", ".join(f"{k} {'double' if RAW[k].kind == 'f' else 'long'}" for k in RAW.names))


POSE = np.dtype([("image_id", "<i4"), ("q", "<f8", 4), ("t", "<f8", 3), ("camera", "<i4")])  # the fixed part of a record; a name with a zero byte and the image points follow


def to_binary_poses(poses: DataFrame) -> DataFrame:
    """(blob): world-to-camera poses (image_id, qw..qz, tx..tz) in the binary layout, a file a batch."""

    def run(batches):
        for b in batches:
            col = lambda k: b.column(k).to_numpy(zero_copy_only=False)
            rec = np.zeros(b.num_rows, POSE)
            rec["image_id"], rec["camera"] = col("image_id"), 1
            rec["q"], rec["t"] = np.stack([col(f"q{k}") for k in "wxyz"], 1), np.stack([col(f"t{k}") for k in "xyz"], 1)
            body = b"".join(r.tobytes() + f"f{r['image_id']}.jpg".encode() + bytes(1) + bytes(8) for r in rec)
            yield pa.RecordBatch.from_arrays([pa.array([np.uint64(len(rec)).tobytes() + body], pa.binary())], ["blob"])

    return poses.mapInArrow(run, "blob binary")


def from_binary_poses(blobs: DataFrame) -> DataFrame:
    """(image_id, name, cx, cy, cz): centres of the poses of binary files."""

    def run(batches):
        for b in batches:
            for blob in b.column(0):
                raw = blob.as_buffer().to_pybytes()
                at, rows, names = 8, [], []
                for _ in range(int(np.frombuffer(raw, "<u8", 1)[0])):
                    rows.append(np.frombuffer(raw, POSE, 1, at)[0])
                    end = raw.index(0, at + POSE.itemsize)
                    names.append(raw[at + POSE.itemsize : end].decode())
                    at = end + 9 + 24 * int(np.frombuffer(raw, "<u8", 1, end + 1)[0])
                rec = np.array(rows, POSE)
                w, v = rec["q"][:, :1], -rec["q"][:, 1:]  # the inverse turn of -t
                x = -rec["t"]
                c = x + 2 * np.cross(v, np.cross(v, x) + w * x)
                yield pa.RecordBatch.from_arrays([pa.array(rec["image_id"].astype(np.int64)), pa.array(names), *(pa.array(c[:, k]) for k in range(3))], ["image_id", "name", "cx", "cy", "cz"])

    return blobs.mapInArrow(run, "image_id long, name string, cx double, cy double, cz double")


POINTER = b"version https://git-lfs"  # fixed value: how the stand-in of a large file begins


def inventory(files: DataFrame) -> DataFrame:
    """(dir, n_files, bytes, pointers, digest) of files (dir, name, content, size); the digest is of the sorted name:hash lines of a folder."""
    line = F.concat_ws(":", "name", F.sha2("content", 256))
    pointer = F.substring("content", 1, len(POINTER)) == F.lit(POINTER)
    rows = files.select("dir", "size", line.alias("line"), pointer.alias("pointer"))
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("bytes"), F.count_if("pointer").alias("pointers"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("digest"))  # one line a file of a folder
