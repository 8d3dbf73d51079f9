"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword; one binary logistic classifier per bit predicts
it from hashed 1- to 3-gram frequencies (square roots of shares, so texts of any
length compare).  Decoding sums the logistic loss of all bits against each
codeword and takes the nearest; a text whose second codeword is almost as near
is flagged ambiguous.

The fit takes a bounded sample (parameters `per_language` and `total`) in one
task, as sparse rows that are spread out block by block.

Defined results: `und` with score 0 for a null text, one without a letter, or
if nothing could be learned; rows with a null language don't teach; with one
language only, that language with score 1; an empty table gives no row.  Repeated
rows get the same result.  Other columns pass through, but input columns named
lang_pred, score or ambiguous are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, char_stream, fit_in_task, free_name, gram_hashes, held_out, texts_of, unit_hash

SIZES, BITS = (1, 2, 3), 12
UNKNOWN = "und"


def codebook(classes: int, bits_per: int = 10, tries: int = 400) -> np.ndarray:
    """Rows of +1 / -1.  Up to 7 classes: every split of the classes once; beyond: the best separated of some random codes."""
    if classes <= 7:
        cols = [[1 if k == 0 or not (m >> (k - 1)) & 1 else -1 for k in range(classes)] for m in range(1, 1 << (classes - 1))]
        return np.array(cols, np.float64).T.reshape(classes, -1)
    length, best, far = int(np.ceil(bits_per * np.log2(classes))), None, -1
    rng = np.random.default_rng(classes)
    for _ in range(tries):
        code = rng.choice([-1.0, 1.0], (classes, length))
        gap = (length - code @ code.T) / 2
        near = (gap + np.eye(classes) * length).min()
        if near > far and (np.abs(code.sum(0)) < classes).all():
            best, far = code, near
    return best


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray  # classes x bits
    weight: np.ndarray  # features x bits
    bias: np.ndarray
    margin: float

    def predict(self, texts: list[str | None]):
        """(names, scores, ambiguous) per text"""
        names, scores, close = [], [], []
        for part in byte_parts(texts, 1_000_000):
            n, s, c = self._part(part)
            names += n
            scores.append(s)
            close.append(c)
        none = np.zeros(0)
        return names, np.concatenate([none, *scores]), np.concatenate([none.astype(bool), *close])

    def _part(self, texts: list[str]):
        lettered = np.array([any(map(str.isalpha, t)) for t in texts])
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if len(self.names) == 1:
            return [self.names[0] if x else UNKNOWN for x in lettered], lettered.astype(float), np.zeros(len(texts), bool)
        loss = np.empty((len(texts), len(self.names)))
        for a, x in features(texts):
            m = x @ self.weight + self.bias
            loss[a : a + len(x)] = np.logaddexp(0, -m) @ (self.code == 1).T + np.logaddexp(0, m) @ (self.code == -1).T
        best = loss.argmin(1)
        low = loss[np.arange(len(texts)), best]
        share = 1 / np.exp(np.clip(low[:, None] - loss, -700, 0)).sum(1)
        second = np.partition(loss, 1, 1)[:, 1]
        names = [self.names[k] if x else UNKNOWN for k, x in zip(best, lettered)]
        return names, np.where(lettered, share, 0.0), lettered & (second - low < self.margin)


def features(texts: list[str], block: int = 64):
    """(first text, matrix) per block: square roots of the shares of hashed n-grams."""
    width = 1 << BITS
    for a in range(0, len(texts), block):
        part = texts[a : a + block]
        cps, doc = char_stream(part)
        base = doc.astype(np.int64) << BITS
        x = np.zeros(len(part) * width)
        for n, h in gram_hashes(cps, SIZES, BITS):
            inside = doc[: len(h)] == doc[n - 1 :]
            x += np.bincount((base[: len(h)] | h)[inside], minlength=len(x))
        x = x.reshape(len(part), width).astype(np.float32)
        yield a, np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))


class Sparse:
    """Rows of `features`, kept as the places and values that aren't zero."""

    def __init__(self, texts: list[str]):
        at, values, sizes = [], [], []
        for _, m in features(texts):
            row, col = np.nonzero(m)
            at.append(col.astype(np.uint16))
            values.append(m[row, col])
            sizes.append(np.bincount(row, minlength=len(m)))
        self.at, self.values = np.concatenate(at), np.concatenate(values)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def blocks(self, size: int = 512):
        """(first row, dense block)"""
        for a in range(0, len(self.first) - 1, size):
            b = min(a + size, len(self.first) - 1)
            lo, hi = self.first[a], self.first[b]
            x = np.zeros((b - a, 1 << BITS), np.float32)
            x[np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1])), self.at[lo:hi]] = self.values[lo:hi]
            yield a, x


def fit(texts: list[str], langs: list[str], rounds: int = 150, l2: float = 1e-5, margin: float = 1.0) -> LanguageModel:
    names = sorted(set(langs))
    if len(names) < 2:
        return LanguageModel(names, np.zeros((len(names), 0)), np.zeros((1 << BITS, 0)), np.zeros(0), margin)
    code = codebook(len(names))
    place = {n: k for k, n in enumerate(names)}
    y = np.array([place[x] for x in langs])
    rows = Sparse(texts)
    want = code[y].astype(np.float32)
    share = ((1 / np.bincount(y, minlength=len(names)))[y][:, None] / len(names)).astype(np.float32)
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, rounds + 1):  # Adam on the whole sample
        gw, gb = l2 * w, np.zeros_like(b)
        for a, x in rows.blocks():
            t = want[a : a + len(x)]
            g = -t / (1 + np.exp(t * (x @ w + b))) * share[a : a + len(x)]
            gw += x.T @ g
            gb += g.sum(0)
        for k, (par, grad) in enumerate(((w, gw), (b, gb))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            par -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return LanguageModel(names, code, w, b, margin)


def train(docs: DataFrame, per_language: int = 800, total: int = 20_000, lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> LanguageModel:
    """Fit on about `per_language` texts of each language and `total` in all at most, none of them held out; the sample is chosen by a hash of the id."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).where(F.col("_lang").isNotNull() & ~held_out(F.col("_id")))
    size = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size:
        return fit([], [])
    per_language = min(per_language, max(1, total // len(size)))
    share = F.coalesce(*(F.when(F.col("_lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(size.items())))
    sample = rows.where((unit_hash(F.col("_id")) < share) & F.col("_text").isNotNull())
    return fit_in_task(sample, _fit_rows) or fit([], [])


def _fit_rows(rows: pa.Table) -> LanguageModel:
    pick = pa.array(np.lexsort((rows["_lang"].to_numpy(zero_copy_only=False), rows["_id"].to_numpy())))
    return fit(rows["_text"].take(pick).to_pylist(), rows["_lang"].take(pick).to_pylist())


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores, close = shared.value.predict(texts_of(texts))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], ["lang_pred", "score", "ambiguous"])

    found = free_name(docs, "found")
    rest = [F.col(c) for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    return docs.withColumn(found, predict(F.col(text))).select(*rest, f"{found}.*")
