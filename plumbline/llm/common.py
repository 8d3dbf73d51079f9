"""Shared parts of the corpus operators: table access, split rule, checkpoints, character streams."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows no model may learn from; a null id counts as the text ''."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds)) == 0, F.lit(True))


def unit_hash(key: Column) -> Column:
    """A uniform number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, as `spark.checkpoint.dir` names it; a temporary one only where the master is this machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: what follows survives a lost executor without running the past again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


HOT_ROWS = 100_000  # of one key; beyond that its join is dealt over several tasks


def hot_join(rows: DataFrame, table: DataFrame, key: str, n: str, deal: str) -> DataFrame:
    """`rows` with the one row of `table` (key, n: how many rows have it, other columns) that has their key, inner.

    A key of more than HOT_ROWS rows is dealt by a hash of the column `deal` over
    enough salts.  Only such keys are broadcast, at most one for HOT_ROWS rows.
    """
    salts = F.ceil(F.col(n) / F.lit(float(HOT_ROWS))).cast("long")
    hot = table.where(F.col(n) > HOT_ROWS).select(F.col(key), salts.alias("_salts"))
    every = table.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts - 1, F.lit(0).cast("long"))))).drop(n)
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64(deal, F.lit(5)), F.col("_salts")), F.lit(0).cast("long")))
    return salted.join(every, [key, "_s"]).drop("_s", "_salts")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or it with as many underscores before it as no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def texts_of(column, step: int = 256):
    """A column's texts one after another, a few hundred at a time as Python strings, so a batch is never held twice."""
    for a in range(0, len(column), step):
        yield from column.slice(a, step).to_pylist()


def byte_parts(texts, limit: int = 2_000_000):
    """Runs of texts of at most about `limit` characters, so that arrays stay small whatever a batch holds."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


_ALNUM = None


def char_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text number of each): lower case, every run of other signs than letters and digits one space, a space at both ends."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.array([chr(c).isalnum() for c in range(0x10000)] + [True])
    pieces = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    cps = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces])
    cps = np.where(_ALNUM[np.minimum(cps, 0x10000)], cps, np.uint32(32))
    keep = np.ones(len(cps), bool)
    keep[1:] = (cps[1:] != 32) | (cps[:-1] != 32) | (doc[1:] != doc[:-1])
    return cps[keep], doc[keep]


def gram_hashes(cps: np.ndarray, sizes, bits: int):
    """For each n of `sizes` (ascending), a bucket per position of the n-gram that begins there."""
    h = np.zeros(len(cps), np.uint32)
    c = cps.astype(np.uint32)
    done = 0
    for n in sizes:
        while done < n:
            m = len(cps) - done
            if m <= 0:
                return
            h = h[:m] * np.uint32(0x01000193) + (c[done:] + np.uint32(1)) * np.uint32(0x9E3779B1)
            done += 1
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
        yield n, ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, and no loss of an executor repeats its past."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit_in_task(sample: DataFrame, fit):
    """fit(all rows of a bounded sample) in one task, so the driver holds neither texts nor training arrays; None if there is no row."""

    def run(batches):
        got = list(batches)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(got)), 5)], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else None
