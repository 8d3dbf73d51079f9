"""Nearest neighbours by largest inner product with one vantage-point tree per shard.

Adding the coordinate sqrt(M^2 - |x|^2), M the largest norm, to candidates and 0
to queries turns the largest inner product into the smallest Euclidean
distance, to which the triangle inequality applies.  A subtree is skipped if
its lower bound times `factor` is above the query's k-th distance so far;
factor 1 is exact, larger ones skip more.

Shards are the regions of a small vantage-point tree over a bounded sample; a
region with too many vectors is dealt over several shards by a hash, so no
shard grows with the table.  Queries travel in packed blocks: first to the
shards of their own region, then, with the k-th score found there, to those
other shards that the same bound doesn't rule out.  Only the k best per query
and shard are shuffled on.  Equal rows are counted before they are dealt, and
equal vectors of a shard are stored once with their ids.

Scores are sums over the original components, first to last, in double
precision; distances only choose what is scored, with a margin for rounding, so
ties go to the smaller id whether vectors are equal or not.  The search works on
vectors scaled by a power of two, so norms of any size stay finite; scores that
overflow rank by the scaled ones.  Vectors that are null, zero, of another
length than the table's most common one, or hold null or non-finite components
take no part; rows that repeat an id count as candidates each, but a query never
meets its own id; an id with several vectors is one query with the best pairs of
them all; an empty table has an empty result; other columns don't matter.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fit_in_task, materialize, unit_hash

LEAF = 256
MARGIN = 1e-9  # of scaled inner products, all within [-1, 1]
SAMPLE = 8192  # vectors the tree over the regions is fitted on, about
RESULT = "query_id long, rank int, vec_id long, score double"


def _choose(x: np.ndarray, rng) -> np.ndarray:
    """Of eight rows the one from which the distances to the others spread most."""
    tries = x[rng.choice(len(x), min(8, len(x)), replace=False)]
    sample = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    return tries[int(np.argmax([np.linalg.norm(sample - t, axis=1).std() for t in tries]))].copy()


class Regions:
    """Vantage-point tree whose leaves are numbered regions of the whole space."""

    def __init__(self, x: np.ndarray, wanted: int, seed: int = 7):
        self.nodes: list[tuple] = []  # (vantage, radius, inner, outer) or (region,)
        self.count = 0
        self._build(x, wanted, np.random.default_rng(seed))

    def _build(self, x: np.ndarray, wanted: int, rng) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if wanted > 1 and len(x) > 1:
            vantage = _choose(x, rng)
            d = np.linalg.norm(x - vantage, axis=1)
            radius = float(np.median(d))
            if radius == d.max():  # most lie on the rim: the rim goes outside
                radius = float(d[d < radius].max(initial=-1.0))
            if radius >= 0 and (d > radius).any():
                inner, outer = self._build(x[d <= radius], wanted // 2, rng), self._build(x[d > radius], wanted - wanted // 2, rng)
                self.nodes[me] = (vantage, radius, inner, outer)
                return me
        self.nodes[me] = (self.count,)
        self.count += 1
        return me

    def of(self, x: np.ndarray) -> np.ndarray:
        """The region of each row."""
        out = np.zeros(len(x), np.int64)

        def down(node: int, rows: np.ndarray) -> None:
            what = self.nodes[node]
            if len(what) == 1:
                out[rows] = what[0]
            elif len(rows):
                near = np.linalg.norm(x[rows] - what[0], axis=1) <= what[1]
                down(what[2], rows[near])
                down(what[3], rows[~near])

        down(0, np.arange(len(x)))
        return out

    def lower(self, q: np.ndarray) -> np.ndarray:
        """[queries, regions]: no vector of the region is nearer."""
        out = np.zeros((len(q), self.count))

        def down(node: int, low: np.ndarray) -> None:
            what = self.nodes[node]
            if len(what) == 1:
                out[:, what[0]] = low
                return
            d = np.linalg.norm(q - what[0], axis=1)
            down(what[2], np.maximum(low, d - what[1] - MARGIN))
            down(what[3], np.maximum(low, what[1] - d - MARGIN))

        down(0, np.zeros(len(q)))
        return out


class VpTree:
    """Nodes as arrays: vantage vector, inner maximum, outer minimum, children; leaves are ranges of rows of `order`."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []  # (vantage, inner max, outer min, inner, outer) or (begin, end)
        self._build(x, 0, len(x), np.random.default_rng(seed))

    def _build(self, x: np.ndarray, a: int, b: int, rng) -> int:
        me = len(self.nodes)
        if b - a <= LEAF:
            self.nodes.append((a, b))
            return me
        rows = self.order[a:b]
        vantage = _choose(x[rows], rng)
        d = np.linalg.norm(x[rows] - vantage, axis=1)
        half = (b - a) // 2
        split = np.argpartition(d, half)
        self.order[a:b], d = rows[split], d[split]
        self.nodes.append(())
        bounds = (d[:half].max(), d[half:].min())
        inner, outer = self._build(x, a, a + half, rng), self._build(x, a + half, b, rng)
        self.nodes[me] = (vantage, *bounds, inner, outer)
        return me


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            out += a[:, k] * b[:, k]
    return out


class Shard:
    """The different vectors of a shard with their ids, and the tree over them."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, x: np.ndarray, shift: int, top: float, k: int):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, times, x = ids[order], times[order], x[order]
        begin = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(1)]))
        nth = np.arange(len(ids)) - np.repeat(begin, np.diff(begin, append=len(ids)))
        group = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(ids)))
        keep = nth <= k  # a query leaves out its own id and can use k others at most
        self.shift, self.top = shift, top
        tree = VpTree(lifted(np.ldexp(x[begin], -shift), top))
        self.nodes, x = tree.nodes, x[begin][tree.order]
        with np.errstate(over="ignore"):
            narrow = x.astype(np.float32)
        self.x = narrow if (narrow == x).all() else x
        place = np.empty(len(begin), np.int64)
        place[tree.order] = np.arange(len(begin))
        ids, times, group = ids[keep], times[keep], place[group[keep]]
        by = np.argsort(group, kind="stable")
        self.ids = np.repeat(ids[by], times[by])  # ids of row r: ids[first[r] : first[r + 1]]
        n = np.bincount(group, times, len(begin)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(n)])
        alone = np.bincount(group, minlength=len(begin)) == 1
        self.only, self.alone = self.ids[self.first[:-1]], alone  # rows of one id alone are nothing to that id's query

    def opened(self) -> Shard:
        """As after loading: what can be derived isn't stored."""
        self.x = self.x.astype(np.float64)
        self.scaled = np.ldexp(self.x, -self.shift)
        return self

    def search(self, qid: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray):
        """(query number, id, score, scaled score) of the k best per query by score, then id; what scores below `floor` isn't wanted."""
        n, scaled_q = len(queries), np.ldexp(queries, -self.shift)
        wide = np.concatenate([scaled_q, np.zeros((n, 1))], 1)
        q2 = (scaled_q * scaled_q).sum(1)
        score, scaled, vid = np.full((n, k), -np.inf), np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        least = floor.copy()

        def offer(at, row):
            s = inner_products(queries[at], self.x[row])
            t = np.ldexp(s, -2 * self.shift)
            over = np.flatnonzero(~np.isfinite(s))
            if len(over):
                t[over] = inner_products(scaled_q[at[over]], self.scaled[row[over]])
                s[over] = np.copysign(np.inf, t[over])
            reps = self.first[row + 1] - self.first[row]
            v = self.ids[np.repeat(self.first[row], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
            at, s, t = np.repeat(at, reps), np.repeat(s, reps), np.repeat(t, reps)
            other = v != qid[at]
            who = np.unique(at[other])
            at, s, t, v = (np.concatenate([old, new[other]]) for old, new in ((np.repeat(who, k), at), (score[who].ravel(), s), (scaled[who].ravel(), t), (vid[who].ravel(), v)))
            order = np.lexsort((v, np.where(np.isinf(s), -t, 0), -s, at))
            at = at[order]
            best = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
            score[who], scaled[who], vid[who] = (c[best].reshape(len(who), k) for c in (s, t, v))
            least[who] = np.maximum(least[who], scaled[who, -1])

        def visit(node, q, low):
            far = np.sqrt(np.maximum(q2[q] + self.top - 2 * (least[q] - MARGIN), 0))
            q = q[low * factor <= far]
            if not len(q):
                return
            what = self.nodes[node]
            if len(what) == 2:
                a, b = what
                s = scaled_q[q] @ self.scaled[a:b].T
                s[self.alone[a:b] & (self.only[a:b] == qid[q][:, None])] = -np.inf
                enough = least[q]
                if b - a > k:
                    enough = np.maximum(enough, np.partition(s, b - a - k, 1)[:, b - a - k])
                at, row = np.nonzero((s >= (enough - MARGIN)[:, None]) & (s > -np.inf))
                if len(at):
                    offer(q[at], a + row)
                return
            vantage, inner_max, outer_min, inner, outer = what
            d = np.linalg.norm(wide[q] - vantage, axis=1)
            to_inner, to_outer = np.maximum(np.maximum(d - inner_max, 0) - MARGIN, 0), np.maximum(np.maximum(outer_min - d, 0) - MARGIN, 0)
            near = to_inner <= to_outer
            for first, second, lows, mask in ((inner, outer, (to_inner, to_outer), near), (outer, inner, (to_outer, to_inner), ~near)):
                if mask.any():
                    visit(first, q[mask], lows[0][mask])
                    visit(second, q[mask], lows[1][mask])

        visit(0, np.arange(n), np.zeros(n))
        at, nth = np.nonzero(scaled > -np.inf)
        return at, vid[at, nth], score[at, nth], scaled[at, nth]


def lifted(scaled: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([scaled, np.sqrt(np.maximum(top - (scaled * scaled).sum(1), 0))[:, None]], 1)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    kept = F.col(vector) if vectors.schema[vector].dataType.simpleString() == "array<float>" else v
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), kept.alias("v"), F.coalesce(good, F.lit(False)).alias("good")).where("good").drop("good")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0, per_shard: int = 16384, per_block: int = 512, shards_at_least: int = 12, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    kind = rows.schema["v"].dataType.simpleString()
    big = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    log_norm = F.log2(big) + F.log2(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / big) * (x / big))) / 2
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(log_norm).alias("log")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], RESULT)
    dim, total = dims["d"], dims["n"]
    shift = int(np.ceil(dims["log"]))
    top = float(2.0 ** (2 * (dims["log"] - shift))) * (1 + 1e-9)
    goal = min(per_shard, max(LEAF, -(-total // shards_at_least)))  # vectors to a shard
    rows = rows.where(F.size("v") == dim)

    def fit(t: pa.Table) -> Regions:
        by = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        return Regions(lifted(np.ldexp(_matrix(t["v"], dim), -shift)[by], top), max(1, -(-total // goal)))

    regions = fit_in_task(rows.where(unit_hash(F.col("vec_id")) < min(1.0, SAMPLE / total)), fit) or Regions(np.zeros((0, dim + 1)), 1)

    def place(batches):
        for b in batches:
            x = _matrix(b.column("v"), dim)
            found = regions.of(lifted(np.ldexp(x, -shift), top))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("times"), pa.array(found)], ["vec_id", "v", "times", "region"])

    # Equal rows are one with a count; no result can use more than k of them.
    counted = rows.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    placed = materialize(counted.mapInArrow(place, f"vec_id long, v {kind}, times long, region long"), "regions")
    size = np.zeros(regions.count, np.int64)
    for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["region"]] = r["n"]
    parts = np.maximum(1, -(-size // (2 * goal)))
    start = np.concatenate([[0], np.cumsum(parts)])  # shards of region r: start[r] to start[r + 1]
    shards = int(start[-1])
    blocks = np.maximum(1, -(-size // (every * per_block)))

    def deal(batches):
        for b in batches:
            region, h = b.column("region").to_numpy(), b.column("h").to_numpy()
            found = [b.column("vec_id"), b.column("v"), b.column("times"), b.column("region"), pa.array(start[region] + h % parts[region]), pa.array((h >> 8) % blocks[region])]
            yield pa.RecordBatch.from_arrays(found, ["vec_id", "v", "times", "region", "shard", "block"])

    def plant(key, t):
        made = Shard(t["vec_id"].to_numpy(), t["times"].to_numpy(), _matrix(t["v"], dim), shift, top, k)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(made, 5)], pa.binary())})

    dealt = placed.withColumn("h", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 31))).mapInArrow(deal, f"vec_id long, v {kind}, times long, region long, shard long, block long")
    trees = materialize(dealt.groupBy("shard").applyInArrow(plant, "shard long, tree binary"), "trees")

    def bundle(first: bool):
        def run(key, t):
            qid, x, floor = t["vec_id"].to_numpy(), _matrix(t["v"], dim), t["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
            home = np.unique(t["region"].to_numpy())
            if first:
                wanted = home
            else:
                scaled = np.ldexp(x, -shift)
                far = np.sqrt(np.maximum((scaled * scaled).sum(1) + top - 2 * (floor - MARGIN), 0))
                low = regions.lower(np.concatenate([scaled, np.zeros((len(x), 1))], 1))
                wanted = np.setdiff1d(np.flatnonzero((low * factor <= far[:, None]).any(0)), home)
            to = np.concatenate([np.arange(start[r], start[r + 1]) for r in wanted] or [np.zeros(0, np.int64)])
            return pa.table({"shard": pa.array(to, pa.int64()), "queries": pa.array([pickle.dumps((qid, x, floor), 5)] * len(to), pa.binary())})

        return run

    def find(batches):
        now, tree = None, None
        for batch in batches:
            for shard, blob, asked in zip(batch.column("shard").to_pylist(), batch.column("tree"), batch.column("queries")):
                if blob.is_valid:  # a shard's tree comes before its query blocks
                    now, tree = shard, pickle.loads(blob.as_buffer()).opened()
                elif shard == now:  # else no vector is in this shard
                    qid, x, floor = pickle.loads(asked.as_buffer())
                    at, vid, score, scaled = tree.search(qid, x, k, factor, floor)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(vid), pa.array(score), pa.array(scaled)], ["query_id", "vec_id", "score", "scaled"])

    order = [F.desc("score"), F.when(F.abs("score") == float("inf"), -F.col("scaled")).otherwise(0.0), F.col("vec_id")]

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)

    def look(blocks: DataFrame) -> DataFrame:
        both = trees.select("shard", "tree", F.lit(None).cast("binary").alias("queries")).unionByName(blocks.select("shard", F.lit(None).cast("binary").alias("tree"), "queries"))
        found = both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("tree").isNull())
        return best(found.mapInArrow(find, "query_id long, vec_id long, score double, scaled double"))

    # Blocks keep to a region: their queries want about the same shards.
    asked = dealt.where(F.col("vec_id") % every == 0).select("vec_id", "v", "region", "block")
    home = materialize(look(asked.withColumn("floor", F.lit(float("-inf"))).groupBy("region", "block").applyInArrow(bundle(True), "shard long, queries binary")).drop("rank"), "home")
    floor = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("scaled")).otherwise(float("-inf")).alias("floor"))
    again = asked.join(floor, asked["vec_id"] == floor["query_id"], "left").select("vec_id", "v", "region", "block", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    away = look(again.groupBy("region", "block").applyInArrow(bundle(False), "shard long, queries binary")).drop("rank")
    return best(home.unionByName(away)).select("query_id", "rank", "vec_id", "score")
