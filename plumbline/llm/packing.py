"""Order-preserving packing of token streams into windows by dynamic programming.

Documents keep their id order.  A window may be cut at the end of a document
(no penalty), after a sentence (a small one) or, only inside a sentence longer
than a window, anywhere on a grid (a large one).  The cost of a packing is its
padding plus its penalties; best[j] = min over cuts i at most one window before
j of best[i] + window - (pos j - pos i) + penalty j, and as best[i] + pos i is
all that depends on i, a monotone queue gives the minimum in constant time.
A task packs its range of documents block by block and carries the last window
over, so memory is bounded by a block and its longest document.  Within a block
the packing is the cheapest; a block ends at its cheapest cut within the last
window, so the whole can cost up to a window's padding more per block than the
cheapest packing of all.

Defined results: a null or empty text is its end id alone; an empty table has
no piece; repeated rows are packed each for itself; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import word_ids
from .token_store import encode_ordered, in_order

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def sentence_ends(tokenizer: str) -> np.ndarray:
    """Per id: whether its text ends a sentence."""
    words = word_ids.spellings(tokenizer)
    out = np.zeros(max(words) + 1025, bool)
    for i, w in words.items():
        out[i] = w.endswith((b".", b"!", b"?")) or b"\n" in w
    return out


def cuts(length: int, doc_ends: np.ndarray, sentences: np.ndarray, window: int, p_sentence: float, p_hard: float, grid: int = 128):
    """(positions, penalties) where windows may be cut, 0 and the stream's length included."""
    pos = np.unique(np.concatenate([[0], sentences, doc_ends, [length]]).astype(np.int64))
    gap = np.flatnonzero(np.diff(pos) > window)
    if len(gap):
        grid = max(1, min(grid, window // 2))
        more = [np.arange(pos[g] + grid, pos[g + 1], grid) for g in gap.tolist()]
        hard = np.concatenate(more)
        pos = np.union1d(pos, hard)
    else:
        hard = np.zeros(0, np.int64)
    penalty = np.full(len(pos), p_sentence)
    penalty[np.isin(pos, hard)] = p_hard
    penalty[np.isin(pos, doc_ends)] = 0.0
    penalty[0] = penalty[-1] = 0.0
    return pos, penalty


def best_cuts(pos: np.ndarray, penalty: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """(previous cut of each cut on its best path, order) by a monotone queue."""
    p, pen = pos.tolist(), penalty.tolist()
    before, cost = [0] * len(p), [0.0] * len(p)
    queue: deque = deque()
    value = [0.0] * len(p)
    for j in range(1, len(p)):
        i = j - 1
        value[i] = v = cost[i] + p[i]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
        far = p[j] - window
        while p[queue[0]] < far:
            queue.popleft()
        i = queue[0]
        before[j] = i
        cost[j] = value[i] + window - p[j] + pen[j]
    return before, cost


def pack_stream(runs, sentence_end: np.ndarray, window: int, block: int, p_sentence: float, p_hard: float):
    """Pieces of an ordered stream of (doc ids, ids, counts) runs; yields column arrays block by block."""
    ids, names, counts = np.zeros(0, np.int32), [], []  # not packed yet; the first document may be begun
    skipped, sequence = 0, 0  # ids of the first document packed already

    def settle(last: bool):
        nonlocal ids, names, counts, skipped, sequence
        left = np.array(counts, np.int64)
        left[0] -= skipped
        doc_ends = np.cumsum(left)
        pos, penalty = cuts(len(ids), doc_ends, np.flatnonzero(sentence_end[ids]) + 1, window, p_sentence, p_hard)
        before, cost = best_cuts(pos, penalty, window)
        j = len(pos) - 1
        if not last:  # the best cut within the last window ends this block
            first = int(np.searchsorted(pos, len(ids) - window))
            j = min(range(max(first, 1), len(pos)), key=lambda k: cost[k])
        path = [j]
        while path[-1]:
            path.append(before[path[-1]])
        edge = pos[path[::-1]]
        done = int(edge[-1])
        points = np.union1d(edge, doc_ends[doc_ends <= done])
        a, b = points[:-1], points[1:]
        win = np.searchsorted(edge, a, side="right") - 1
        doc = np.searchsorted(doc_ends, a, side="right")
        begin = (doc_ends - left)[doc]
        start = a - begin + np.where(doc == 0, skipped, 0)
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
        total = np.array(counts, np.int64)
        out = ([names[k] for k in doc.tolist()], start, b - a, np.array(crc, np.int64), total[doc], sequence + win, a - edge[win])
        sequence += len(edge) - 1
        whole = int(np.searchsorted(doc_ends, done, side="right"))
        rest = done - (int(doc_ends[whole - 1]) if whole else 0)
        skipped = rest + (skipped if whole == 0 else 0)
        ids, names, counts = ids[done:], names[whole:], counts[whole:]
        return out

    for doc_ids, new, per in runs:
        ids = np.concatenate([ids, new])
        names += doc_ids
        counts += per.tolist()
        if len(ids) >= block:
            yield settle(False)
    if counts:
        yield settle(True)


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, block: int = 1 << 19, sentence_penalty: float = 4.0, hard_penalty: float = 64.0, engine: str = "transducer", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece (SCHEMA); sequence ids ascend with the documents, those of a task apart from all others."""

    def run(batches):
        part = 0

        def runs():
            nonlocal part
            for part, names, ids, counts in encode_ordered(batches, tokenizer, end_id, engine):
                yield names.to_pylist(), ids, counts

        for names, start, length, crc, total, seq, offset in pack_stream(runs(), sentence_ends(tokenizer), window, block, sentence_penalty, hard_penalty):
            cols = [pa.array(names, pa.int64()), *(pa.array(np.asarray(x, np.int64)) for x in (start, length, crc, total, (part << 36) + seq, offset))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return in_order(docs, doc_id, text).mapInArrow(run, SCHEMA)
