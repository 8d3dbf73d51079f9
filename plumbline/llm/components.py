"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two grouped minima and is written to the shared folder; no
vertex's neighbours are ever held in memory together.  While no node has more
than HOT_ROWS edges, a minimum is a window over one exchange, so a round is
three exchanges in a row; beyond that the minima are grouped and joined to the
edges, with the edges of such a node dealt over several tasks.  Before each
round one count over the nodes tells which, and whether the edges are stars
already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import hot_join, materialize


def _with_least(edges: DataFrame, hot: bool) -> DataFrame:
    """`edges` (u, v) with m, the least v of their u."""
    if not hot:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return hot_join(edges, least, "u", "n", "v")


def _large_star(edges: DataFrame, hot: bool) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    return _with_least(both, hot).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, hot: bool) -> DataFrame:
    """`edges` with u > v: the other ends of a node hang on the least of them, and so does the node."""
    return _with_least(edges, hot).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of `edges` (u, v long) the smallest node it is linked to, roots included."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
        nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
        # In a star a node has one edge up and none down, or none up.
        most, loose = nodes.agg(F.max("n"), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()
        if not loose:
            break
        hot = most > common.HOT_ROWS
        now = materialize(_small_star(_large_star(now, hot), hot).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
