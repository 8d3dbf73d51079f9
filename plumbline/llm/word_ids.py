"""Token ids by the tokenizers library, each different pre-token encoded once.

The library encodes a byte-level vocabulary's pre-tokens independently of each
other, so ids of a text are those of its pre-tokens in turn.  Texts are split by
the splitting transducer (see fst_tokenizer), pre-tokens not met before are
given to the library in one batch, and the ids are kept for a bounded number of
words and bytes.  Special strings inside texts become their token, as the library does by
default.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np

from .fst_tokenizer import Splitter, byte_tokens, parts

MAX_WORDS, MAX_BYTES = 400_000, 1 << 24  # of the table of words, after which it starts anew


class WordIds:
    """Same ids as ``tokenizers`` with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.splitter, self.library = Splitter(spec), Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        """Words are numbered; the ids of word k are ids[first[k] : first[k + 1]]."""
        special = self.splitter.special_ids.items()
        self.known = {bytes([b]): k for k, (b, _) in enumerate(special)}
        self.ids, self.first, self.bytes = np.array([i for _, i in special], np.int32), np.arange(len(self.known) + 1), 0

    def _learn(self, new: list[bytes]) -> None:
        found = [e.ids for e in self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        self.bytes += sum(map(len, new))

    def _part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, start, size, upto = self.splitter.cut(texts)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start.tolist(), (start + size).tolist())]
        if len(self.known) > MAX_WORDS or self.bytes > MAX_BYTES:
            self._reset()
        new = list(set(words).difference(self.known))
        if new:
            self._learn(new)
        word = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first = self.first[word]
        per = self.first[word + 1] - first
        end = np.concatenate([[0], np.cumsum(per)])
        ids = self.ids[np.arange(end[-1]) + np.repeat(first - end[:-1], per)]
        return ids, np.diff(end[upto], prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, offsets of the texts)"""
        done = [self._part(part) for part in parts(texts)]
        per = np.concatenate([[0], *(p for _, p in done)]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.int32), *(i for i, _ in done)]), np.cumsum(per)


@lru_cache(2)
def load(path: str) -> WordIds:
    """One per worker process and file."""
    return WordIds(path)


def spellings(path: str) -> dict[int, bytes]:
    """Id to bytes of the ordinary tokens."""
    return {i: b for b, i in byte_tokens(json.load(open(path, encoding="utf-8"))).items()}
