"""Finite-state compilation of a byte-level BPE tokenizer file.

Two deterministic transducers replace the library's encode loop:

* ``SplitMachine`` walks character classes and emits the starts of pre-tokens.
  A text batch is cut into fixed chunks; the map "start state -> end state" of
  every chunk is computed for all chunks in lockstep, the maps are composed by
  a parallel prefix scan, and a second pass with known start states emits.
* ``MergeMachine`` walks the bytes of one pre-token.  Its states stand for all
  that the future can depend on, and each transition carries the change of the
  number of emitted tokens.  States are compiled on demand: a token may follow
  another exactly if the model's merges leave the pair as it is.  The table is
  bounded: it starts anew between slices of pre-tokens once it is too large, and
  a pre-token of over 512 bytes, which would fill it alone, goes to the library.

Both are exact; tests compare them with the library.  Null texts count as
empty.  A special string inside a text becomes its one special token, as the
library does by default.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import regex

# Character classes of the splitting pattern.
OTHER, LETTER, L_STMD, L_R, L_V, L_L, L_E, NUMBER, SPACE, WHITE, QUOTE, STOP = range(12)
N_CLASSES = 12
# States.  Q*: an apostrophe began the pre-token; WHITE1/2: one / more white characters, _O: the last is no space.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_Q, S_QR, S_QV, S_QL, S_DONE, S_W1, S_W1O, S_W2, S_W2O = range(13)
N_STATES = 13
HERE, BEFORE = 1, 2  # a pre-token starts at this character / at the one before

END_CP, SPECIAL_CP = 0x110000, 0x110001  # behind every code point
END_BYTE, SPECIAL_BYTE = 0xFF, 0xF8  # bytes that UTF-8 never has
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _split_tables() -> tuple[np.ndarray, np.ndarray]:
    nxt = np.zeros((N_STATES, N_CLASSES), np.uint8)
    out = np.zeros((N_STATES, N_CLASSES), np.uint8)
    letters = (LETTER, L_STMD, L_R, L_V, L_L, L_E)
    body = {**{c: S_LETTER for c in letters}, NUMBER: S_NUMBER, OTHER: S_OTHER, QUOTE: S_OTHER}
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            white = s in (S_W1, S_W1O, S_W2, S_W2O)
            e = 0
            if c == STOP:
                t, e = S_START, HERE
                if s in (S_QR, S_QV, S_QL):
                    e |= BEFORE
            elif c in (SPACE, WHITE):
                if white:
                    t = S_W2 if c == SPACE else S_W2O
                else:
                    t, e = (S_W1 if c == SPACE else S_W1O), HERE
                    if s in (S_QR, S_QV, S_QL):
                        e |= BEFORE
            elif s == S_W1:  # the single space joins what follows
                t = body[c]
            elif s == S_W2:
                t, e = body[c], BEFORE
            elif s in (S_START, S_DONE, S_W1O, S_W2O):
                t, e = (S_Q if c == QUOTE else body[c]), HERE | (BEFORE if s == S_W2O else 0)
            elif s == S_Q:
                if c == L_STMD:
                    t = S_DONE
                elif c in (L_R, L_V, L_L):
                    t = {L_R: S_QR, L_V: S_QV, L_L: S_QL}[c]
                elif c in (OTHER, QUOTE):
                    t = S_OTHER
                else:
                    t, e = body[c], HERE
            elif s in (S_QR, S_QV, S_QL):
                if c == (L_L if s == S_QL else L_E):
                    t = S_DONE
                else:  # the apostrophe stays alone, the letter began a word
                    e = BEFORE
                    t = S_LETTER
                    if c not in letters:
                        e |= HERE
                        t = S_Q if c == QUOTE else body[c]
            else:  # in a word, a number or other signs
                t = body[c]
                if s == S_OTHER and c in (OTHER, QUOTE):
                    pass
                elif t != s:
                    e = HERE
                    if c == QUOTE:
                        t = S_Q
            nxt[s, c], out[s, c] = t, e
    return nxt, out


class SplitMachine:
    def __init__(self, chunk: int = 256, settle: int = 8):
        self.chunk, self.settle = chunk, settle
        nxt, out = _split_tables()
        self.row, self.out = nxt.ravel().astype(np.int64) * N_CLASSES, out.ravel()  # states as row offsets
        self.low = np.full(256, OTHER, np.uint8)
        for c in range(256):
            self.low[c] = self._class(c)
        self.memo: dict[int, int] = {END_CP: STOP, SPECIAL_CP: STOP}

    _letter, _number, _white = (regex.compile(p).fullmatch for p in (r"\p{L}", r"\p{N}", r"\s"))

    def _class(self, cp: int) -> int:
        ch = chr(cp)
        if ch in "stmd":
            return L_STMD
        if ch in "rvle":
            return {"r": L_R, "v": L_V, "l": L_L, "e": L_E}[ch]
        if ch == "'":
            return QUOTE
        if ch == " ":
            return SPACE
        # U+001C..U+001F are white space to the Python library only
        if self._white(ch) and not 0x1C <= cp <= 0x1F:
            return WHITE
        return LETTER if self._letter(ch) else NUMBER if self._number(ch) else OTHER

    def classes(self, cps: np.ndarray) -> np.ndarray:
        out = self.low[np.minimum(cps, 255)]
        wide = np.flatnonzero(cps > 255)
        if len(wide):
            uniq, back = np.unique(cps[wide], return_inverse=True)
            table = np.empty(len(uniq), np.uint8)
            for k, cp in enumerate(uniq.tolist()):
                c = self.memo.get(cp)
                if c is None:
                    c = self.memo[cp] = self._class(cp)
                table[k] = c
            out[wide] = table[back]
        return out

    def starts(self, cps: np.ndarray) -> np.ndarray:
        """Boolean per code point: a pre-token (or an end mark) starts here."""
        n, size = len(cps), self.chunk
        lanes = max(1, -(-n // size))
        grid = np.full(lanes * size, STOP, np.uint8)
        grid[:n] = self.classes(cps)
        grid = np.ascontiguousarray(grid.reshape(lanes, size).T)
        first = self._prefix(self._maps(grid))
        state, flags = first * N_CLASSES, np.empty((size, lanes), np.uint8)
        for k in range(size):
            at = state + grid[k]
            flags[k] = self.out[at]
            state = self.row[at]
        flat = np.ascontiguousarray(flags.T).ravel()
        begins = (flat & HERE).astype(bool)
        begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return begins[:n]

    def _maps(self, grid: np.ndarray) -> np.ndarray:
        """maps[s, lane]: the state after the lane's chunk if it began in s."""
        size, lanes = grid.shape
        state = np.repeat(np.arange(N_STATES, dtype=np.int64)[:, None] * N_CLASSES, lanes, 1)
        for k in range(min(self.settle, size)):
            state = self.row[state + grid[k]]
        same = (state == state[0]).all(0)
        for which, rows in ((same, 1), (~same, N_STATES)):
            pick = np.flatnonzero(which)
            if len(pick):
                s, part = state[:rows, pick], grid[:, pick]
                for k in range(self.settle, size):
                    s = self.row[s + part[k]]
                state[:, pick] = s
        return state // N_CLASSES

    @staticmethod
    def _prefix(maps: np.ndarray) -> np.ndarray:
        """Start state of every chunk: an inclusive scan that composes maps, doubling the reach each round."""
        scan, lanes, reach = maps.copy(), maps.shape[1], 1
        while reach < lanes:
            left, right = scan[:, :-reach], scan[:, reach:]
            scan = np.concatenate([scan[:, :reach], np.take_along_axis(right, left, 0)], 1)
            reach *= 2
        return np.concatenate([[S_START], scan[S_START, :-1]])


@lru_cache(1)
def byte_chars() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeMachine:
    """Lazily determinised transducer over the bytes of a pre-token."""

    def __init__(self, tokens: dict[bytes, int], ranks: dict[tuple[int, int], int], encode, specials: dict[int, int], max_states: int = 250_000):
        self.encode, self.specials, self.max_states = encode, specials, max_states
        self.ranks = {left << 20 | right: r for (left, right), r in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.spelling: dict[int, bytes] = {t: b for b, t in tokens.items()}
        for word, tid in tokens.items():
            node = 0
            for b in word:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = tid
        self.length = np.zeros(max([*tokens.values(), *specials.values()]) + 1, np.int32)
        for word, tid in tokens.items():
            self.length[tid] = len(word)
        for tid in specials.values():
            self.length[tid] = 1
        self.halves: dict[int, tuple[int, int, int]] = {}
        for (left, right), rank in sorted(ranks.items(), key=lambda x: -x[1]):
            whole = tokens.get(self.spelling[left] + self.spelling[right])
            if whole is not None:
                self.halves[whole] = left, right, rank
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.reset()

    def reset(self) -> None:
        self.keys: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.last = np.full(4096, -1, np.int32)
        self.bits, self.used = 16, 0
        self.table = np.full(1 << self.bits, EMPTY, np.uint64)
        self._state([self._open(0, -1, 0)])

    # A state is the list of places where a token that is still open may have
    # begun: its trie node, the token before it, and the emitted-token count
    # there relative to here.  Each is one 64-bit word.
    @staticmethod
    def _open(node: int, last: int, rel: int) -> int:
        return node << 40 | (last + 1) << 16 | (rel + 32768)

    def _state(self, words: list[int]) -> int:
        key = array("q", words).tobytes()
        s = self.keys.get(key)
        if s is None:
            s = self.keys[key] = len(self.states)
            self.states.append(key)
            if s >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last), -1, np.int32)])
            self.last[s] = (words[-1] >> 16 & 0xFFFFFF) - 1
        return s

    # Transitions live in one open-addressing table of 64-bit words:
    # state and byte (32 bits), next state (24), change of the count (8).
    def _put(self, s: int, byte: int, t: int, change: int) -> None:
        if self.used * 4 > len(self.table):
            old = self.table[self.table != EMPTY]
            self.bits += 1
            self.table = np.full(1 << self.bits, EMPTY, np.uint64)
            at = self._slot(old >> np.uint64(32))
            while len(old):  # place one word per free slot, move the others on
                free = self.table[at] == EMPTY
                self.table[at[free]] = old[free]
                rest = self.table[at] != old
                old, at = old[rest], (at[rest] + 1) & (len(self.table) - 1)
        key = s << 8 | byte
        at = (key * 2654435761 & 0xFFFFFFFF) >> (32 - self.bits)
        while self.table[at] != EMPTY:
            at = (at + 1) & (len(self.table) - 1)
        self.table[at] = key << 32 | t << 8 | (change + 128)
        self.used += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - self.bits)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The table's word per key, EMPTY where none is compiled yet."""
        at = self._slot(key)
        word = self.table[at]
        off = np.flatnonzero((word >> np.uint64(32) != key) & (word != EMPTY))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.table) - 1)
            word[off] = w = self.table[at[off]]
            off = off[(w >> np.uint64(32) != key[off]) & (w != EMPTY)]
        return word

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stood at the token's left (0) or right (1) end while it was merged, each with the rank that ended it."""
        found = self.edges[side].get(token)
        if found is None:
            found, piece, ends = [], token, 1 << 40
            while True:
                found.append((piece, ends))
                if piece not in self.halves:
                    break
                *parts_, ends = self.halves[piece]
                piece = parts_[side]
            self.edges[side][token] = found
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Whether the model leaves the two tokens apart: no merge across the border comes before those that use up its parts.

        At equal rank the leftmost merge goes first: the one over the border before one inside the right token, after one inside the left.
        """
        key = left << 20 | right
        ok = self.pairs.get(key)
        if ok is None:
            if left < 0:
                ok = self.encode(self.spelling[right]) == [right]
            else:
                ok, ranks = True, self.ranks
                for a, a_ends in self._edge(left, 1):
                    for b, b_ends in self._edge(right, 0):
                        rank = ranks.get(a << 20 | b)
                        if rank is not None and rank < a_ends and rank <= b_ends:
                            ok = False
                            break
                    if not ok:
                        break
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def _compile(self, s: int, byte: int) -> tuple[int, int]:
        if byte in self.specials:
            t = self._state([self._open(0, self.specials[byte], 0)])
            self._put(s, byte, t, 1)
            return t, 1
        words = array("q")
        words.frombytes(self.states[s])
        open_, new, count = [], -1, 0
        for w in words:
            node, last, rel = w >> 40, (w >> 16 & 0xFFFFFF) - 1, (w & 0xFFFF) - 32768
            child = self.children[node].get(byte)
            if child is None:
                continue
            tid = self.token_at[child]
            if tid >= 0 and new < 0 and self._fits(last, tid):
                new, count = tid, rel + 1
            if self.children[child]:
                open_.append((child, last, rel))
        if new < 0:
            raise ValueError(f"no token ends after byte {byte}; not a byte-level merge vocabulary")
        t = self._state([*(self._open(n, l, r - count) for n, l, r in open_), self._open(0, new, 0)])
        self._put(s, byte, t, count)
        return t, count

    def _step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = states << np.uint64(8) | data
        word = self._find(key)
        missing = np.flatnonzero(word == EMPTY)
        if len(missing):
            for x in np.unique(key[missing]).tolist():
                self._compile(x >> 8, x & 255)
            word[missing] = self._find(key[missing])
        return (word & np.uint64(0xFFFFFFFF)) >> np.uint64(8), (word & np.uint64(255)).astype(np.int16) - 128

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: bool, slice_bytes: int = 1 << 19):
        """Counts per pre-token and, if ids, all token ids in order."""
        total = np.cumsum(size)
        cut = np.searchsorted(total, np.arange(slice_bytes, int(total[-1]) if len(total) else 0, slice_bytes), side="right")
        edges = np.unique(np.concatenate([[0], cut, [len(start)]]))
        done = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if len(self.states) > self.max_states:
                self.reset()
            done.append(self._run(data, start[a:b], size[a:b], ids))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(p for p, _ in done)]), np.concatenate([none.astype(np.int32), *(i for _, i in done)]) if ids else None

    def _run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: bool, long: int = 512):
        n = len(start)
        order = np.argsort((long + 1 - np.minimum(size, long + 1)).astype(np.uint16), kind="stable")
        begin, left = start[order], size[order]
        n_long = int((left > long).sum())
        states, counts = np.zeros(n, np.uint64), np.zeros(n, np.int32)
        seen = np.zeros(len(data), np.int32) if ids else None
        whole = {int(order[k]): self.encode(data[begin[k] : begin[k] + left[k]].tobytes()) for k in range(n_long)}
        counts[:n_long] = [len(whole[int(k)]) for k in order[:n_long]]
        alive = np.searchsorted(-left[n_long:], -np.arange(1, long + 1), side="right") + n_long
        for k in range(long):
            m = int(alive[k])
            if m <= n_long:
                break
            at = begin[n_long:m] + k
            nxt, change = self._step(states[n_long:m], data[at])
            states[n_long:m] = nxt
            counts[n_long:m] += change
            if ids:
                seen[at] = nxt
        per = np.empty(n, np.int64)
        per[order] = counts
        if not ids:
            return per, None
        out = np.empty(int(per.sum()), np.int32)
        lane = np.cumsum(per) - 1
        for k, found in whole.items():
            out[lane[k] + 1 - len(found) : lane[k] + 1] = found
        short = np.flatnonzero(size <= long)
        where, floor, lane = (start + size - 1)[short], start[short], lane[short]
        while len(where):
            tok = self.last[seen[where]]
            out[lane] = tok
            where = where - self.length[tok]
            more = np.flatnonzero(where >= floor)
            where, lane, floor = where[more], lane[more] - 1, floor[more]
        return per, out


def parts(texts: list[str], chars: int = 400_000):
    """Runs of texts of about that many characters: arrays stay small."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


class Splitter:
    """A vocabulary file's special strings and pre-tokens, without its merges."""

    def __init__(self, spec: dict):
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE with the standard splitting pattern can be compiled")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if len(added) > 6 or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens of this kind can't be compiled")
        self.special = {c: (SPECIAL_CP + k, SPECIAL_BYTE + k) for k, c in enumerate(added)}
        self.special_ids = {self.special[c][1]: i for c, i in added.items()}
        self.pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.machine = SplitMachine()
        for cp, _ in self.special.values():
            self.machine.memo[cp] = STOP

    def _stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cps, raw = [], []
        end_cp, end_byte = np.array([END_CP], np.uint32), bytes([END_BYTE])
        for text in texts:
            parts = self.pattern.split(text) if self.pattern and any(s in text for s in self.special) else [text]
            for part in parts:
                if part in self.special:
                    cp, b = self.special[part]
                    cps.append(np.array([cp], np.uint32))
                    raw.append(bytes([b]))
                elif part:
                    cps.append(np.frombuffer(part.encode("utf-32-le"), np.uint32))
                    raw.append(part.encode())
            cps.append(end_cp)
            raw.append(end_byte)
        return np.concatenate(cps), np.frombuffer(b"".join(raw), np.uint8)

    def cut(self, texts: list[str]):
        """(bytes, start and size of each pre-token, pre-tokens up to the end of each text); a special string is one byte."""
        cps, data = self._stream(texts)
        begins = np.flatnonzero(self.machine.starts(cps))
        start = np.flatnonzero((data & 0xC0) != 0x80)[begins]
        end = np.flatnonzero(cps[begins] == END_CP)  # one per text
        size = np.diff(start, append=len(data))
        return data, np.delete(start, end), np.delete(size, end), end - np.arange(len(end))


class FstTokenizer:
    """Same ids as ``tokenizers`` with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.splitter = Splitter(spec)
        model, chars = spec["model"], byte_chars()
        tokens = byte_tokens(spec)
        bpe = Tokenizer.from_file(path).model
        encode = lambda word: [t.id for t in bpe.tokenize("".join(chars[b] for b in word))]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ranks = {(model["vocab"][x], model["vocab"][y]): r for r, (x, y) in enumerate(pairs)}
        self.merges = MergeMachine(tokens, ranks, encode, self.splitter.special_ids)

    def _run(self, texts: list[str], ids: bool):
        """(token counts per text, ids or None)"""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        data, start, size, upto = self.splitter.cut(texts)
        per, out = self.merges.run(data, start, size, ids)
        before = np.concatenate([[0], np.cumsum(per)])[upto]
        return np.diff(before, prepend=0), out

    def counts(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self._run(part, False)[0] for part in parts(texts))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, offsets of the texts)"""
        done = [self._run(part, True) for part in parts(texts)]
        per = np.concatenate([[0], *(p for p, _ in done)]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.int32), *(i for _, i in done)]), np.cumsum(per)


def byte_tokens(spec: dict) -> dict[bytes, int]:
    """The ordinary tokens' bytes and ids."""
    codes = {c: b for b, c in byte_chars().items()}
    added = {t["content"] for t in spec["added_tokens"]}
    return {bytes(codes[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}


@lru_cache(2)
def load(path: str) -> FstTokenizer:
    """One compiled machine per worker process and file."""
    return FstTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
