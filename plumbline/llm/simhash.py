"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of
its word shingles.  Equal fingerprints collapse first.  Two fingerprints within
three bits agree in one of four 16-bit blocks and, of the 48 bits left, in one
of four 12-bit blocks; so every link meets in at least one of sixteen 28-bit
buckets.  Inside a bucket, fingerprints are stored as bit planes; distances to
many at a time grow in carry-save counters, and a block is given up once all
its counters are past the radius.  A bucket of any size is cut into blocks that
meet pairwise, so no task holds more than two blocks; a cell emits a spanning
forest, not its pairs.  Components are then found over fingerprints.

Defined results: null and empty texts have no word and the fingerprint zero,
which links like any other; fewer words than a shingle needs: the whole
sequence is the one shingle; repeated rows share their component.  A null id
never is a component's smallest id unless it has no other.  Other columns than
the id and the text don't matter to `assign`; `keep_one` returns them unchanged.

Near copies by a shingle similarity instead of a few bits are in `similar`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import hot_join, materialize, texts_of
from .components import components

BLOCK = 1024  # fingerprints a block of a large bucket holds, about


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hash of every word shingle in turn; none without a word, that of the whole sequence if it is shorter than a shingle."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: only A-Z, only ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def with_fingerprint(docs: DataFrame, words: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for t in texts_of(texts)], np.uint64).view(np.int64))

    return docs.withColumn(out, prints(F.col(text)))


def planes(fps: np.ndarray) -> np.ndarray:
    """[64, words]: plane b holds bit b of all fingerprints, 64 to a word."""
    width = -(-len(fps) // 64) * 64
    padded = np.zeros(width, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close(fps: np.ndarray, radius: int = 3, step: int = 8) -> np.ndarray:
    """Boolean matrix of the pairs at most `radius` bits apart; any radius below 64."""
    n, plane = len(fps), planes(fps)
    digits = int(radius).bit_length()
    limit_bits = [(radius + 1 >> k) & 1 for k in range(digits + 1)]
    out = np.zeros((n, n), bool)
    rows = np.arange(n)
    counter = [np.zeros((n, plane.shape[1]), np.uint64) for _ in range(digits + 1)]
    past = np.zeros((n, plane.shape[1]), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        mask = np.where((fps[rows] >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))[:, None]
        carry = plane[b][None, :] ^ mask
        for k in range(digits + 1):  # carry-save: each counter digit is a plane of its own
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        reached = np.full_like(past, full)
        for k, want in enumerate(limit_bits):
            reached &= counter[k] if want else ~counter[k]
        past |= reached
        if b % step == step - 1:
            alive = np.flatnonzero((past != full).any(1))
            if len(alive) < len(rows):
                rows, past = rows[alive], past[alive]
                counter = [c[alive] for c in counter]
            if not len(rows):
                break
    if len(rows):
        out[rows] = np.unpackbits((~past).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    return out


def spanning(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row of its component."""
    label = np.arange(len(near))
    while True:
        best = np.where(near, label[None, :], len(near)).min(1)
        new = np.minimum(label, best)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def forest(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of the close pairs within each group."""
    label = spanning(close(fps, radius) & (group[:, None] == group[None, :]))
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


def _link_cells(radius: int):
    def run(batches):
        key, cell, fps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def flush(k, c, f, last):
            """Whole groups of the sorted rows, packed into comparisons of a few hundred rows; returns where the rest begins."""
            if not len(k):
                return 0, []
            cut = np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1])) + 1
            begin = np.concatenate([[0], cut])
            end = np.concatenate([cut, [len(k)]])
            if not last:
                begin, end = begin[:-1], end[:-1]
            number = np.repeat(np.arange(len(begin)), end - begin)
            found, i = [], 0
            while i < len(begin):
                j = i + 1
                while j < len(begin) and end[j] - begin[i] <= 256:
                    j += 1
                a, b = begin[i], end[j - 1]
                if b - a > 1:
                    u, v = forest(f[a:b].view(np.uint64), number[a:b], radius)
                    if len(u):
                        found.append(pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]))
                i = j
            return (int(end[-1]) if len(end) else 0), found

        for batch in batches:
            for store, name in ((key, "key"), (cell, "cell"), (fps, "fp")):
                store.append(batch.column(name).to_numpy(zero_copy_only=False))
            if sum(map(len, key)) < 16 * BLOCK:
                continue
            k, c, f = map(np.concatenate, (key, cell, fps))
            done, found = flush(k, c, f, False)
            yield from found
            key, cell, fps = [k[done:]], [c[done:]], [f[done:]]
        yield from flush(*map(np.concatenate, (key, cell, fps)), True)[1]

    return run


def bucket_keys(fp: str = "fp"):
    """The sixteen buckets of a fingerprint, as an array of longs."""
    block = [F.shiftrightunsigned(F.col(fp), 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = []
    for i in range(4):
        rest = [block[k] for k in range(4) if k != i]
        tail = rest[0].bitwiseOR(F.shiftleft(rest[1], 16)).bitwiseOR(F.shiftleft(rest[2], 32))
        for j in range(4):
            part = F.shiftrightunsigned(tail, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit(i * 4 + j).cast("long") * F.lit(1 << 28) + F.shiftleft(block[i], 12) + part)
    return F.array(*keys)


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v): links between different fingerprints of `prints` (fp, each once) that span all its near groups."""
    if not 0 <= radius <= 3:
        raise ValueError("the buckets find links of up to 3 bits")
    keyed = prints.select("fp", F.explode(bucket_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("long")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("nb"))
    other = F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), lambda s: s != F.col("mine"))))
    cells = (
        keyed.join(shared, "key")
        .withColumn("nb", blocks)
        .withColumn("mine", mine)
        .withColumn("other", other)
        .select("key", (F.least("mine", "other") * F.col("nb") + F.greatest("mine", "other")).alias("cell"), "fp")
    )
    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_link_cells(radius), "u long, v long")


def assign(docs: DataFrame, radius: int = 3, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_key, component_id, row_hash) for every row of `docs`."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(with_fingerprint(docs, words).select("doc_id", "fp", row_hash("doc_id", "text").alias("row_hash")), "prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-prints")
    return named(rows, prints, links(prints.select("fp"), radius))


def row_hash(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text), F.lit("row"))


def named(rows: DataFrame, prints: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` (fp, doc_id, row_hash) with the component_key and component_id that the links between `prints` (fp, least id, n rows) give."""
    linked = components(links)
    joined = materialize(linked.join(prints, linked.node == prints.fp).select("fp", "root", "least"), "linked")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    grouped = hot_join(joined, smallest, "root", "size", "fp").select("fp", "root", "component_id")
    by_print = prints.join(grouped, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("component_key"), F.coalesce("component_id", "least").alias("component_id"))
    return hot_join(rows, by_print, "fp", "n", "row_hash").select("doc_id", "fp", "component_key", "component_id", "row_hash")


def keep_one(docs: DataFrame, radius: int = 3, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each near group, one of the group's smallest id.

    Of several rows with that id the one of the smallest row hash stays, of
    repeated rows one; rows that share an id but no group don't touch each other.
    A row with a null id stays only where its group has no other.
    """
    return keep(docs, assign(docs, radius, words, doc_id, text), doc_id, text)


def keep(docs: DataFrame, groups: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of `docs` that `keep_one` leaves of `groups`, as `assign` gives them."""
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_key").agg(F.min(F.struct("row_hash", "doc_id")).alias("m"))
    kept = first.select(F.coalesce("m.doc_id", F.lit(0).cast("long")).cast("string").alias("_id"), F.col("m.row_hash").alias("_h"))
    # Repeated rows fall together before any is moved, so a row of a third of the table is no hot key.
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")).cast("string").alias("_id"), row_hash(doc_id, text).alias("_h"))
    return keyed.groupBy("_id", "_h").agg(F.first("_row").alias("_row")).join(kept, ["_id", "_h"], "left_semi").select("_row.*")
