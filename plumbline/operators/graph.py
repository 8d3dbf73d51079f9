"""Checkpoints, joins over hot keys, and connected components by stars, written down every round."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: what follows survives a lost executor without running the past again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


HOT_ROWS = 100_000  # of one key; beyond that its join is dealt over several tasks


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, deal: str, many: bool = False) -> DataFrame:
    """`rows` joined with `table` (keys, n: how many rows of the other side a key has, other columns), inner.

    A key of more than HOT_ROWS rows is dealt by a hash of the column `deal` over
    enough salts, and its row of `table` goes to each.  Only such keys are
    broadcast, at most one for HOT_ROWS rows.
    """
    salts = F.ceil(F.col(n) / F.lit(float(HOT_ROWS))).cast("long")
    hot = table.where(F.col(n) > HOT_ROWS).select(*keys, salts.alias("_salts"))
    every = table.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts - 1, F.lit(0).cast("long"))))).drop(n)
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64(deal, F.lit(5)), F.col("_salts")), F.lit(0).cast("long")))
    return salted.join(every, [*keys, "_s"]).drop("_s", "_salts")


def _joined_up(batches):
    """The edges of a partition as stars around the least node of each of its components."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    names, at = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
    u, v = at[: t.num_rows], at[t.num_rows :]
    label = np.arange(len(names))
    while True:
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    off = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[off]), pa.array(names[label[off]])], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return hot_join(both, least, ["u"], "n", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hang = hot_join(down, least, ["u"], "n", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hang.union(least.select("u", "m"))


def components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the least node reachable.

    Each partition joins up its own edges; large and small stars then link what
    partitions share, in about as many rounds as the logarithm of the nodes.
    """
    up = lambda e: e.mapInArrow(_joined_up, "u long, v long")
    now = cut(up(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()))
    mark = None
    for _ in range(max_rounds):
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state[0] == 0 or state == mark:
            break
        mark = state
        now = cut(up(_small_star(_large_star(now)).distinct()))
    else:
        raise RuntimeError("components did not settle")
    ids = nodes.select(F.col(node).cast("long").alias("node"))
    return ids.join(now, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("label"))
