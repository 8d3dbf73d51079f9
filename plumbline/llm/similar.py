"""SimHash near-duplicates at a similarity of word shingles instead of a few bits.

A pair of texts whose five-word shingle sets have a Jaccard similarity of 0.8
differs in ten of 64 fingerprint bits on average.  No exact scheme of buckets
over the bits reaches that far, so min-hashes of the shingle set, in bands, are
the buckets: sets that share a band are joined into coarse groups, and inside a
coarse group all fingerprints are compared as bit planes (`simhash.close`) with
a radius that hardly any such pair exceeds.  What is left is decided by the
whole shingle sets, nearest fingerprints first, as long as it could still join
two groups; no link rests on an estimate.  A pair at a similarity of exactly 0.8
is missed with a chance of less than 1 in 10,000: no common band (8 in 100,000),
or fingerprints over 26 bits apart (13 in a million for sets of four and five
shingles, less than one in a million for larger ones).
A large group is cut into blocks that meet pairwise; nothing is
capped.

Defined results as in `simhash`: texts without a word are one group; fewer
words than a shingle needs: the whole sequence is the one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import hot_join, materialize, texts_of
from .components import components
from .simhash import close, keep, majority, named, row_hash, shingle_hashes

BANDS, ROWS = 40, 7
RADIUS = 26  # bits
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 17  # of a block of a large group, about
_RNG = np.random.default_rng(42)
FACTOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
OFFSET = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of the different word shingles, ascending."""
    return np.unique(shingle_hashes(text, words))


def bands(found: np.ndarray) -> np.ndarray:
    """A bucket per band; a set without shingles has none."""
    if not len(found):
        return np.zeros(0, np.uint64)
    h, least = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 1024):
        np.minimum(least, (h[a : a + 1024, None] * FACTOR + OFFSET).min(0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def with_bands(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """`docs` with _s: fp (a hash of the whole shingle set), n (its size) and bands."""

    @F.arrow_udf("struct<fp: long, n: long, bands: array<long>>")
    def run(texts: pa.Array) -> pa.Array:
        keys, sizes, lists = [], [], []
        for t in texts_of(texts):
            s = shingles(t, words)
            keys.append(set_key(s))
            sizes.append(len(s))
            lists.append(bands(s).view(np.int64))
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        fields = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        return pa.StructArray.from_arrays(fields, ["fp", "n", "bands"])

    return docs.withColumn("_s", run(F.col(text)))


def set_key(found: np.ndarray) -> int:
    return xxh64_intdigest(found.tobytes(), 7) if len(found) else 0


def near(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Boolean matrix of the pairs whose similarity is `least` or more."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in no intersection
    column = (np.cumsum(shared) - 1)[number]
    owner, column = owner[shared[number]], column[shared[number]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        has = np.zeros((len(sets), min(4096, int(shared.sum()) - a)), np.float32)
        has[owner[lo:hi], column[lo:hi] - a] = 1
        both += has @ has.T
    return both >= np.float64(least) * (sizes[:, None] + sizes[None, :] - both.astype(np.float64)) - 1e-9


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b) - 1e-9:
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def joined(texts: list, least: float, words: int) -> np.ndarray:
    """For each text the first one of its group: groups are chains of similar texts."""
    sets = [shingles(t, words) for t in texts]
    prints = np.array([majority(h) for h in sets], np.uint64)
    a, b = np.nonzero(np.triu(close(prints, RADIUS), 1))
    many = len(a) > 16 * len(texts)  # then one product of the whole sets is cheaper than pair by pair
    if many:
        a, b = np.nonzero(np.triu(near(sets, least), 1))
    else:
        by = np.argsort(np.bitwise_count(prints[a] ^ prints[b]), kind="stable")
        a, b = a[by], b[by]
    label = list(range(len(texts)))

    def first(i: int) -> int:
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = first(i), first(j)
        if x != y and (many or similar(sets[i], sets[j], least)):
            label[max(x, y)] = min(x, y)
    return np.array([first(i) for i in range(len(texts))], np.int64)


def _link_cells(least: float, words: int):
    def found(fps, texts):
        label = joined(texts, least, words)
        at = np.flatnonzero(label != np.arange(len(fps)))
        fps = np.array(fps, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[label[at]])], ["u", "v"])

    def run(batches):
        now, fps, texts = None, [], []
        for batch in batches:
            for root, cell, fp, text in zip(*(batch.column(k).to_pylist() for k in ("root", "cell", "fp", "text"))):
                if (root, cell) != now:
                    if len(fps) > 1:
                        yield found(fps, texts)
                    now, fps, texts = (root, cell), [], []
                fps.append(fp)
                texts.append(text)
        if len(fps) > 1:
            yield found(fps, texts)

    return run


def links(sets: DataFrame, docs: DataFrame, least: float, words: int) -> DataFrame:
    """(u, v): links that span all groups of similar sets.  `sets`: fp (each once), size, bands, and the row_hash of a row of `docs` (doc_id, text) that has the set."""
    keyed = sets.select("fp", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("_most"), F.count(F.lit(1)).alias("n")).where("v < _most").select("key", "v", "n")
    coarse = components(hot_join(keyed, shared, "key", "n", "fp").select(F.col("fp").alias("u"), "v"))
    member = materialize(coarse.select(F.col("node").alias("fp"), "root").join(sets.select("fp", "size", "row_hash"), "fp"), "coarse")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK_SETS))), F.ceil(F.sum("size") / F.lit(float(BLOCK_SHINGLES)))).cast("long")
    groups = member.groupBy("root").agg(blocks.alias("nb"), F.count(F.lit(1)).alias("n"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("nb"))
    zero = F.lit(0).cast("long")
    other = F.when(F.col("nb") == 1, F.array(zero)).otherwise(F.filter(F.sequence(zero, F.col("nb") - 1), lambda s: s != F.col("mine")))
    cells = F.transform("other", lambda o: F.least("mine", o) * F.col("nb") + F.greatest("mine", o))
    placed = hot_join(member, groups, "root", "n", "fp").withColumn("mine", mine).withColumn("other", other).select("row_hash", "fp", "root", cells.alias("cells"))
    texts = docs.select(row_hash("doc_id", "text").alias("row_hash"), "text").groupBy("row_hash").agg(F.first("text").alias("text"))
    dealt = texts.join(placed, "row_hash").select("root", F.explode("cells").alias("cell"), "fp", "text")
    return dealt.repartition("root", "cell").sortWithinPartitions("root", "cell").mapInArrow(_link_cells(least, words), "u long, v long")


def assign(docs: DataFrame, least: float = 0.8, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_key, component_id, row_hash) for every row of `docs`; fp stands for the whole shingle set."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(with_bands(docs, words).select("doc_id", row_hash("doc_id", "text").alias("row_hash"), F.col("_s.fp").alias("fp"), F.col("_s.n").alias("size"), "_s.bands"), "sets")
    # Equal sets have equal bands; of many rows one is taken.
    one = F.min(F.struct("doc_id", "row_hash")).alias("one")
    sets = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), one, F.first("size").alias("size"), F.first("bands").alias("bands")), "distinct-sets")
    return named(rows.select("doc_id", "fp", "row_hash"), sets.select("fp", "least", "n"), links(sets.select("fp", "size", "bands", "one.row_hash"), docs, least, words))


def keep_one(docs: DataFrame, least: float = 0.8, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each group of similar texts, by the rules of `simhash.keep_one`."""
    return keep(docs, assign(docs, least, words, doc_id, text), doc_id, text)
