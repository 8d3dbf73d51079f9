"""Benchmark decontamination: BM25 retrieval of test items with block-max WAND, then a check of question and answer.

Test items are indexed by word; an item's weights are divided by its score
against itself, so 1 is a full match and one threshold serves all.  Every
training text is cut into overlapping passages at least twice as long as the
longest item of the index, so a planted item lies whole in one passage.  Per
passage, the sums of block maxima (vectorised over all passages) leave few
blocks of items that could pass; the pivoting search then scores those and
returns every item above the threshold.  A hit stands if enough of the word
sequences of the item's question and of its answer (its last sentence) occur in
the passage.

Items of fewer words than `min_words` hold too little for a score: they are
found where the text has their whole word sequence.  In scripts without spaces
every character is a word, so a sentence isn't one.

Test sets of any size are dealt over shards of a bounded number of items and
characters.  Executors build the shards' indexes and write them as rows; texts
meet one shard after the other, and one index of bounded size is broadcast at a
time.  Defined results: null and empty texts have no hit; a null item or one
without a word is never hit; repeated rows of an item are one item; a null item
id is reported as null; other columns pass through, but an input column of the
name `out` is replaced.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, free_name, materialize, texts_of

SHARD_ITEMS, SHARD_CHARS = 20_000, 10_000_000
HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
# Thai to Khmer, kana, CJK ideographs: written without spaces.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_word = re.compile(f"[{_ALONE}]|[^\\W{_ALONE}]+")
_stop = re.compile(r"[.!?]\s+|\n+")


def words(text: str) -> list[str]:
    return _word.findall(text.lower())


class LengthClass:
    """Postings of the items of up to `longest` words; `local` turns numbers of the index's vocabulary into terms of the class."""

    def __init__(self, items: list[tuple[int | None, str]], longest: int, k1: float, b: float, shingle: int, vocabulary: dict[str, int], max_blocks: int = 64):
        self.stride, self.ids = longest, [i for i, _ in items]
        toks = [words(t) for _, t in items]
        df = Counter(w for t in toks for w in set(t))
        n, mean = len(items), sum(map(len, toks)) / len(items)
        self.vocab = {w: k for k, w in enumerate(df)}
        self.local = np.full(len(vocabulary) + 1, -1, np.int64)  # the last: unknown words
        self.local[[vocabulary[w] for w in df]] = np.arange(len(df))
        idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
        weights = []
        for t in toks:
            x = {w: idf[w] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / mean)) for w, f in Counter(t).items()}
            own = sum(x.values())
            weights.append({w: v / own for w, v in x.items()})
        self.size = max(8, -(-n // max_blocks))  # items to a block
        self.blocks = -(-n // self.size)
        self.block_max = np.zeros((len(df), self.blocks), np.float32)
        self.postings: list[list[tuple[int, float]]] = [[] for _ in df]
        for i, x in enumerate(weights):
            for w, v in x.items():
                k = self.vocab[w]
                self.postings[k].append((i, v))
                self.block_max[k, i // self.size] = max(self.block_max[k, i // self.size], np.nextafter(np.float32(v), np.float32(2)))
        self.term_max = self.block_max.max(1)
        self.question, self.answer = [], []
        for (_, text), t in zip(items, toks):
            parts = [p for p in _stop.split(text.strip()) if words(p)]
            tail = len(words(parts[-1])) if len(parts) > 1 else -(-len(t) // 3)
            tail = min(max(tail, min(shingle, len(t) - 1)), len(t) - 1)
            self.question.append(_shingles(t[: len(t) - tail], shingle))
            self.answer.append(_shingles(t[len(t) - tail :], shingle))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose weights over `terms` sum up to the threshold."""
        cursors = [[self.postings[t], 0, float(self.term_max[t]), t] for t in terms]
        found, size, slack = [], self.size, 1e-6
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= threshold - slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][1]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // size
            near = sum(float(self.block_max[c[3], block]) for c in cursors[: pivot + 1])
            if near < threshold - slack:  # nothing in this block before the next other cursor
                goal = (block + 1) * size
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0][cursors[pivot + 1][1]][0])
                goal = max(goal, item + 1)
                self._advance(cursors, range(pivot + 1), goal)
            elif cursors[0][0][cursors[0][1]][0] == item:
                score = sum(c[0][c[1]][1] for c in cursors[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                self._advance(cursors, range(pivot + 1), item + 1)
            else:
                self._advance(cursors, [k for k in range(pivot) if cursors[k][0][cursors[k][1]][0] < item], item)
        return found

    @staticmethod
    def _advance(cursors, which, goal: int) -> None:
        done = []
        for k in which:
            c = cursors[k]
            posting, at = c[0], c[1]
            while at < len(posting) and posting[at][0] < goal:
                at += 1
            c[1] = at
            if at == len(posting):
                done.append(k)
        for k in reversed(done):
            del cursors[k]


def _shingles(t: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(t))
    return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} if n else set()


def _share(wanted: set[tuple[str, ...]], t: list[str]) -> float:
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    return len(wanted & {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}) / len(wanted)


class ItemIndex:
    def __init__(self, items: list[tuple[int | None, str]], k1: float = 1.2, b: float = 0.75, shingle: int = 5, min_words: int = 5):
        self.shingle, classes = shingle, {}
        self.short: dict[tuple[str, ...], list] = {}
        self.vocab: dict[str, int] = {}
        for i, t in items:
            found = words(t)
            for w in found:
                self.vocab.setdefault(w, len(self.vocab))
            if len(found) >= min_words:
                classes.setdefault(max(5, (len(found) - 1).bit_length()), []).append((i, t))
            elif found:
                self.short.setdefault(tuple(found), []).append(i)
        self.classes = [LengthClass(x, 1 << k, k1, b, shingle, self.vocab) for k, x in sorted(classes.items())]
        self.begins = np.zeros(len(self.vocab) + 1, bool)  # words a short item begins with
        self.begins[[self.vocab[t[0]] for t in self.short]] = True
        self.lengths = sorted({len(t) for t in self.short})

    def hits(self, texts: list[str | None], threshold: float, overlap: float) -> list[list[tuple]]:
        """Per text its verified hits (item id, score, question share, answer share), the best passage of each item."""
        toks = [words(t) if t else [] for t in texts]
        sizes = np.array([len(t) for t in toks], np.int64)
        term = np.fromiter(map(self.vocab.get, chain.from_iterable(toks), repeat(len(self.vocab))), np.int64, int(sizes.sum()))
        best: list[dict] = [{} for _ in texts]
        for cls in self.classes:
            for doc, at in cls_passages(cls, cls.local[term], sizes, threshold):
                passage = toks[doc][at : at + 2 * cls.stride]
                terms = {cls.vocab[w] for w in set(passage) if w in cls.vocab}
                for k, score in cls.search(sorted(terms), threshold):
                    q, a = _share(cls.question[k], passage), _share(cls.answer[k], passage)
                    if q >= overlap and a >= overlap:
                        key, hit = (cls.stride, k), (cls.ids[k], score, q, a)
                        if key not in best[doc] or hit[1:] > best[doc][key][1:]:
                            best[doc][key] = hit
        if self.short:
            at = np.flatnonzero(self.begins[term])
            ends = np.cumsum(sizes)
            for doc, k in zip(np.searchsorted(ends, at, side="right").tolist(), at.tolist()):
                place = k - int(ends[doc] - sizes[doc])
                for n in self.lengths:
                    found = tuple(toks[doc][place : place + n])
                    if len(found) == n and found in self.short:
                        best[doc][0, found] = tuple(self.short[found])
        return [[h for (size, _), d in b.items() for h in ([d] if size else [(i, 1.0, 1.0, 1.0) for i in d])] for b in best]


def cls_passages(cls: LengthClass, term: np.ndarray, sizes: np.ndarray, threshold: float):
    """(text, first word) of the passages of which some block's bound reaches the threshold.  `term`: of each word of all texts, -1 if the class hasn't it."""
    half = cls.stride
    halves = -(-sizes // half)
    first = np.cumsum(halves) - halves
    at = np.flatnonzero(term >= 0)
    if not len(at):
        return
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, at, side="right")
    part = first[doc] + (at - (ends - sizes)[doc]) // half
    key = np.unique(part * len(cls.vocab) + term[at])  # a word counts once in each half passage
    part, term = key // len(cls.vocab), key % len(cls.vocab)
    owner = np.repeat(np.arange(len(sizes)), halves)
    # a passage is a half and the next one of the same text; a word of the second half that the first has too counts once
    inner = np.flatnonzero(np.append(False, owner[1:] == owner[:-1])[part])
    key = np.unique(np.concatenate([key, key[inner] - len(cls.vocab)]))
    part, term = key // len(cls.vocab), key % len(cls.vocab)
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    # first by the terms' maxima, then by block for what is left
    able = np.add.reduceat(cls.term_max[term], begin) >= threshold - 1e-3
    keep = np.repeat(able, np.diff(begin, append=len(part)))
    part, term = part[keep], term[keep]
    if not len(part):
        return
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    bound = np.add.reduceat(cls.block_max[term], begin, axis=0)
    for k in part[begin[(bound >= threshold - 1e-3).any(1)]].tolist():
        d = int(owner[k])
        yield d, int(k - first[d]) * half


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(shard, index): the pickled index of each shard of items, built and written by executors."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars")).first()
    shards = max(1, -(-size["n"] // SHARD_ITEMS), -(-(size["chars"] or 0) // SHARD_CHARS))

    def build(key, rows):
        found = sorted(zip(rows["i"].to_pylist(), rows["t"].to_pylist()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(ItemIndex(found), 5)], pa.binary())})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInArrow(build, "shard int, index binary"), "item-index")


_opened: list = [None, None]  # of this worker: the broadcast bytes and the index they hold


def _open(blob) -> ItemIndex:
    if _opened[0] is not blob:
        _opened[:] = blob, pickle.loads(blob)
    return _opened[1]


def _looker(shared, threshold: float, overlap: float):
    names = ("item_id", "score", "question_overlap", "answer_overlap")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in names[1:])]))

    def look(texts: pa.Array) -> pa.Array:
        index = _open(shared.value)
        found = [hits for part in byte_parts(texts_of(texts), 1_000_000) for hits in index.hits(part, threshold, overlap)]
        return pa.array([[dict(zip(names, h)) for h in hits] for hits in found], kind)

    return look


def with_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, text: str = "text", out: str = "hits", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with the array `out` of verified hits."""
    context = docs.sparkSession.sparkContext
    stored = indexes(benchmark, item_id, item_text)
    shards = [r["shard"] for r in stored.select("shard").orderBy("shard").collect()]
    if not shards:
        return docs.withColumn(out, F.array().cast(HITS))

    def look(shard: int):
        shared = context.broadcast(bytes(stored.where(F.col("shard") == shard).first()["index"]))
        return shared, F.arrow_udf(_looker(shared, threshold, overlap), HITS)

    if len(shards) == 1:
        return docs.withColumn(out, look(shards[0])[1](F.col(text)))
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(F.col(text), 256))
    parts = []
    for shard in shards:  # one index at a time; only texts with a hit are kept
        shared, find = look(shard)
        found = keyed.select(F.col(key).alias("_key"), find(F.col(text)).alias("_found")).where(F.size("_found") > 0)
        parts.append(materialize(found.groupBy("_key").agg(F.first("_found").alias("_found")), "shard-hits"))
        shared.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("_key").agg(F.flatten(F.collect_list("_found")).alias("_found"))
    found = free_name(docs, "found")
    rest = [F.col(c) for c in docs.columns if c != out]
    joined = keyed.join(merged.select(F.col("_key").alias(key), F.col("_found").alias(found)), key, "left")
    return joined.select(*rest, F.coalesce(found, F.array().cast(HITS)).alias(out))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified pair."""
    found = with_hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **limits)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents without a verified hit, columns unchanged."""
    hits = free_name(docs, "hits")
    return with_hits(docs, benchmark, text=text, out=hits, **limits).where(F.size(hits) == 0).drop(hits)
