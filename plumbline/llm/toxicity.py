"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Whether an n-gram of 4 to 6 characters occurs in a text is the feature; its
value is the log of the ratio of its (smoothed) shares among toxic and clean
training texts.  N-grams whose difference between the classes could be chance
(`min_z` standard deviations of a share) or that come after the `max_features`
most different ones are left out, which keeps the model small and the scan of a
text to few hits.  A logistic regression is fitted to the scaled features on a
bounded sample of the labelled texts (`per_class`).

Defined results: a null or empty text has no feature and gets the score of the
intercept; labels that are null are ignored, of repeated labels the larger
holds; without labels every score is 0, with labels of one class only it is
that class; an empty table gives no row.  Repeated rows get the same score; other
columns pass through, but an input column of the name `out` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, char_stream, fit_in_task, gram_hashes, held_out, texts_of, unit_hash

SIZES, BITS = (4, 5, 6), 21


@dataclass
class ToxicityModel:
    slot: np.ndarray  # per hash bucket the feature's number, 0: none
    weight: np.ndarray  # per feature: regression weight x log-count ratio
    bias: float

    def score(self, texts) -> np.ndarray:
        out = [self._part(part) for part in byte_parts(texts, 500_000)]
        return np.concatenate(out) if out else np.zeros(0)

    def _part(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        doc, feature = _hits(texts, self.slot)
        pair = np.unique(doc.astype(np.int64) * len(self.weight) + feature)
        z += np.bincount(pair // len(self.weight), self.weight[pair % len(self.weight)], len(texts))
        return np.where(z < -500, 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _hits(texts: list[str], slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    cps, doc = char_stream(texts)
    docs, features = [], []
    for n, h in gram_hashes(cps, SIZES, BITS):
        inside = doc[: len(h)] == doc[n - 1 :] if slot is None else None
        if slot is None:
            docs.append(doc[: len(h)][inside])
            features.append(h[inside].astype(np.int64))
        else:
            f = slot[h]
            at = np.flatnonzero(f)
            at = at[doc[at] == doc[at + n - 1]]
            docs.append(doc[at])
            features.append(f[at].astype(np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *docs]), np.concatenate([none, *features])


def fit(texts: list[str], toxic: np.ndarray, smoothing: float = 1.0, min_z: float = 4.0, max_features: int = 30_000, rounds: int = 300, l2: float = 1e-3) -> ToxicityModel:
    toxic = np.asarray(toxic, np.float64)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    if not n1 or not n0:
        return ToxicityModel(np.zeros(1 << BITS, np.uint16), np.zeros(1), 1e9 if n1 else -1e9)
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    pairs, first = [], 0
    for part in byte_parts(texts, 300_000):  # twice: counts first, then the rows of the features kept
        doc, h = _hits(part, None)
        key = np.unique(doc.astype(np.int64) << BITS | h)
        y = toxic[first + (key >> BITS)]
        p += np.bincount(key & (1 << BITS) - 1, y, 1 << BITS)
        q += np.bincount(key & (1 << BITS) - 1, 1 - y, 1 << BITS)
        first += len(part)
    share = n1 / (n1 + n0)
    z = np.abs(p - (p + q) * share) / np.sqrt(np.maximum((p + q) * share * (1 - share), 1e-9))
    z[p + q < 3] = 0
    kept = np.sort(np.argsort(-z, kind="stable")[:max_features])
    kept = kept[z[kept] >= min_z]
    ratio = np.log((p[kept] + smoothing) / (p.sum() + smoothing)) - np.log((q[kept] + smoothing) / (q.sum() + smoothing))
    slot = np.zeros(1 << BITS, np.uint16)
    slot[kept] = np.arange(1, len(kept) + 1)
    first = 0
    for part in byte_parts(texts, 300_000):
        doc, f = _hits(part, slot)
        key = np.unique((doc.astype(np.int64) + first) * (len(kept) + 1) + f)
        pairs.append(key)
        first += len(part)
    row = np.concatenate([np.zeros(0, np.int32), *((k // (len(kept) + 1)).astype(np.int32) for k in pairs)])
    feature = np.concatenate([np.zeros(0, np.int32), *((k % (len(kept) + 1)).astype(np.int32) for k in pairs)])
    del pairs, p, q
    value = np.concatenate([[0.0], ratio])
    # features of one text share a unit of weight, so that a step size holds for long texts too
    x = value[feature]
    weight, bias = np.zeros(len(kept) + 1), 0.0
    m_w, v_w, m_b, v_b = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    balance = np.where(toxic == 1, 0.5 / n1, 0.5 / n0)
    for step in range(1, rounds + 1):  # Adam on the whole sample: same input, same model
        pred = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weight[feature] * x, len(texts)), -50, 50)))
        err = (pred - toxic) * balance
        g, gb = np.bincount(feature, err[row] * x, len(weight)) + l2 * weight, err.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * g, 0.99 * v_w + 0.01 * g * g
        m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.99 * v_b + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        weight -= 0.03 * (m_w / c1) / (np.sqrt(v_w / c2) + 1e-6)
        bias -= 0.03 * (m_b / c1) / (np.sqrt(v_b / c2) + 1e-6)
    return ToxicityModel(slot, weight * value, float(bias))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on about `per_class` labelled texts of each class at most, none of them held out.

    The sample is chosen by a hash of the id among the labels, without the texts;
    its expected size is the bound, so it doesn't grow with the corpus.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1))
    size = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size:
        return ToxicityModel(np.zeros(1 << BITS, np.uint16), np.zeros(1), -1e9)
    share = F.coalesce(*(F.when(F.col("_y") == y, F.lit(min(1.0, per_class / n))) for y, n in sorted(size.items())))
    chosen = marks.where(unit_hash(F.col("_id")) < share)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")
    return fit_in_task(rows, _fit_rows) or ToxicityModel(np.zeros(1 << BITS, np.uint16), np.zeros(1), -1e9)


def _fit_rows(rows: pa.Table) -> ToxicityModel:
    order = np.lexsort((rows["_y"].to_numpy(), rows["_id"].to_numpy()))
    texts = rows["_text"].take(pa.array(order)).to_pylist()
    return fit([t or "" for t in texts], rows["_y"].to_numpy()[order])


def with_score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the column `out`, 0 to 1; the other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts_of(texts)), pa.float64())

    return docs.withColumn(out, score(F.col(text)))
