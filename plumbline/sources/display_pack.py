"""Compact display packs of quantised points: differences as byte planes, compressed, in pieces that stand alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC, HEAD = b"PLPK", struct.Struct("<4sIq")  # magic, points, place of the first
BYTES = ("r", "g", "b", "provenance")
ROW = "place long, qx long, qy long, qz long, r long, g long, b long, provenance long"


def encode(first: int, q: np.ndarray, attributes: np.ndarray, level: int = 6) -> bytes:
    """q: n x 3 numbers below 2^16 in order, attributes: n x 4 bytes."""
    steps = (np.diff(q.astype(np.int64), axis=0, prepend=0) & 0xFFFF).astype("<u2")
    planes = [steps.T.copy().view(np.uint8).reshape(3, -1, 2).transpose(0, 2, 1).tobytes(), np.ascontiguousarray(attributes.astype(np.uint8).T).tobytes()]
    return zlib.compress(HEAD.pack(MAGIC, len(q), first) + b"".join(planes), level)


def decode(blob: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    magic, n, first = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a display pack")
    body = np.frombuffer(raw, np.uint8, offset=HEAD.size)
    low_high = body[: 6 * n].reshape(3, 2, n).astype(np.uint64)
    q = np.cumsum(low_high[:, 0] | low_high[:, 1] << np.uint64(8), axis=1) & np.uint64(0xFFFF)
    return first, q.T.astype(np.int64), body[6 * n :].reshape(4, n).T.astype(np.int64)


def pack(rows: DataFrame, chunk: int = 65536) -> DataFrame:
    """(chunk, blob) of rows as ROW; each chunk of places is one blob."""

    def run(key, t):
        by = np.argsort(t["place"].to_numpy(), kind="stable")
        col = lambda k: t[k].to_numpy()[by]
        blob = encode(int(col("place")[0]), np.stack([col(k) for k in ("qx", "qy", "qz")], 1), np.stack([col(k) for k in BYTES], 1))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    return rows.withColumn("chunk", F.floor(F.col("place") / chunk)).groupBy("chunk").applyInArrow(run, "chunk long, blob binary")


def unpack(packs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for blob in b.column(0):
                first, q, a = decode(blob.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(q))), *(pa.array(q[:, k]) for k in range(3)), *(pa.array(a[:, k]) for k in range(4))], ["place", "qx", "qy", "qz", *BYTES])

    return packs.select("blob").mapInArrow(run, ROW)
