"""Nearest neighbours against brute force: ties, copies, rows that take no part, sizes of any order."""

import numpy as np
import pytest

from plumbline.llm import common, vp_ann

from ..compare import SMALL


def slow(ids, x, every, k):
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            score = vp_ann.inner_products(np.broadcast_to(x[q], x.shape), x)
            out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
    return out


def found(df, **how):
    got = vp_ann.nearest(df, **how).toPandas().sort_values(["query_id", "rank"])
    assert all(g["rank"].tolist() == list(range(1, len(g) + 1)) for _, g in got.groupby("query_id"))
    return {q: list(zip(g.vec_id.tolist(), g.score.tolist())) for q, g in got.groupby("query_id")}


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


RNG = np.random.default_rng(4)
UNIT = RNG.normal(size=(64, 16))
UNIT /= np.linalg.norm(UNIT, axis=1, keepdims=True)


@pytest.mark.parametrize(
    ("x", "k", "per_shard"),
    [
        (UNIT[RNG.integers(0, 64, 400)], 20, 16384),  # many equal vectors
        (RNG.integers(-2, 3, (900, 6)).astype(float) + [0.0, 0, 0, 0, 0, 5], 7, 100),  # equal scores of different vectors, no zero vector
        (RNG.normal(size=(700, 8)), 10, 300),
        (RNG.normal(size=(200, 4)) * 1e150, 5, 300),  # squares near the end of the range
        (RNG.normal(size=(15, 3)), 20, 300),  # fewer candidates than wanted
    ],
)
def test_exact_with_factor_one(spark, x, k, per_shard):
    assert found(frame(spark, x), k=k, per_shard=per_shard, per_block=8) == slow(np.arange(len(x)), x, 20, k)


def test_scores_that_overflow_keep_their_order(spark):
    x = np.array([[1e200, 0.0], [3e200, 0.0], [2e200, 1.0], [-1e200, 0.0]])
    got = found(frame(spark, x), k=3)
    assert [i for i, _ in got[0]] == [1, 2, 3] and [s for _, s in got[0]] == [np.inf, np.inf, -np.inf]


def test_hot_vector_repeated_rows_and_rows_that_take_no_part(spark):
    x = RNG.normal(size=(900, 8)).round(2)
    x[100:400] = x[100]  # a third of all rows are copies
    ids = np.arange(900)
    more = [(20, x[20].tolist())] * 30 + [(33, x[33].tolist())] * 2  # a query's own rows never are its neighbours; others count each
    odd = [(901, None), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0, None] + [0.0] * 6), (920, [1.0]), (None, [1.0] * 8), (905, [float("inf")] + [0.0] * 7)]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + more + odd
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, shard string, score double")
    all_ids, all_x = np.concatenate([ids, [20] * 30, [33] * 2]), np.concatenate([x, np.repeat(x[20:21], 30, 0), np.repeat(x[33:34], 2, 0)])
    assert found(df, k=10, per_shard=256, per_block=4) == slow(all_ids, all_x, 20, 10)
    assert vp_ann.nearest(df.limit(0)).count() == 0


def test_relaxed_search_keeps_its_recall(spark):
    df = common.table(spark, SMALL.replace("0.001", "0.1"), "embeddings")
    exact, relaxed = (vp_ann.nearest(df, factor=f, per_shard=256).toPandas() for f in (1.0, 1.2))
    assert len(relaxed.merge(exact, on=["query_id", "vec_id"])) / len(exact) >= 0.9


def test_bounds_of_the_regions_hold():
    x = RNG.normal(size=(600, 5))
    made = vp_ann.Regions(x, 16)
    own, q = made.of(x), RNG.normal(size=(40, 5))
    low = made.lower(q)
    assert made.count == 16
    for r in range(16):
        assert (np.linalg.norm(x[own == r][None] - q[:, None], axis=2).min(1) >= low[:, r]).all()
