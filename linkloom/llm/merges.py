"""BPE merges of many plain words at once, over numpy arrays.

Plain words are lower-case Latin letters only: no normaliser changes them and no splitter
cuts them, so their tokens are what the vocabulary's merges make of their bytes. The merges
are applied as the algorithm says, the pair of least rank first, leftmost first; what is
array-wise is that each round makes one merge in every word of a batch.
"""

from __future__ import annotations

import json

import numpy as np


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next free one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, free = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(free)
            free += 1
    return [table[b] for b in range(256)]


class Merges:
    """Ranks of a vocabulary's merges, looked up by an open hash table of pairs."""

    def __init__(self, path: str, suffix: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        symbols = byte_symbols()
        self.inner = np.array([vocabulary.get(s, -1) for s in symbols])
        self.last = np.array([vocabulary.get(s + suffix, -1) for s in symbols])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        code = left << 20 | right
        _, first = np.unique(code, return_index=True)
        self.bits = int(np.ceil(np.log2(len(code)))) + 2
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        todo, step = np.sort(first), 0
        while len(todo):  # each round every pair left claims its next place
            place = (self._slot(code[todo]) + step) & ((1 << self.bits) - 1)
            free = self.keys[place] < 0
            _, claim = np.unique(np.where(free, place, -1 - np.arange(len(place))), return_index=True)
            claim = claim[free[claim]]
            self.keys[place[claim]], self.ranks[place[claim]] = code[todo[claim]], todo[claim]
            todo, step = np.delete(todo, claim), step + 1
        self.steps = step

    def _slot(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 20 | right
        slot = self._slot(code)
        out = np.where(self.keys[slot] == code, self.ranks[slot], self.none)
        open_ = np.flatnonzero((self.keys[slot] != code) & (self.keys[slot] >= 0))
        step = 0
        while len(open_):
            step += 1
            if step >= self.steps:
                break
            s = (slot[open_] + step) & ((1 << self.bits) - 1)
            hit = self.keys[s] == code[open_]
            out[open_[hit]] = self.ranks[s[hit]]
            open_ = open_[~hit & (self.keys[s] >= 0)]
        out[(left < 0) | (right < 0)] = self.none
        return out

    def tokens(self, words: list[bytes], kind: np.dtype) -> list[bytes]:
        """Ids of each word, packed as kind; words of about the same length go together."""
        out = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            for i, ids in zip(part, self._batch([words[i] for i in part], kind), strict=True):
                out[i] = ids
        return out

    def _batch(self, words: list[bytes], kind: np.dtype) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        wide = int(sizes.max())
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        ids = self.inner[raw]
        ids[np.arange(wide)[None] >= sizes[:, None]] = -1
        rows = np.arange(len(words))
        ids[rows, sizes - 1] = self.last[raw[rows, sizes - 1]]
        # Flat arrays with one spare place behind each word; a merge unlinks the right one of two neighbours.
        span = wide + 1
        token = np.full((len(words), span), -1, np.int64)
        token[:, :wide] = ids
        rank = np.full((len(words), span), self.none, np.int32)
        if wide > 1:
            rank[:, : wide - 1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), wide - 1)
        token, flat = token.ravel(), rank.ravel()
        after = np.minimum(np.arange(1, token.size + 1), token.size - 1)
        before = np.arange(-1, token.size - 1)
        live = rows
        while len(live):
            at = live * span + rank[live].argmin(1)
            least = flat[at]
            go = least < self.none
            live, at, least = live[go], at[go], least[go]
            if not len(live):
                break
            gone = after[at]
            to = after[gone]
            token[at] = self.made[least]
            token[gone] = -1
            flat[gone] = self.none
            after[at] = to
            before[to] = at
            flat[at] = self.rank(token[at], token[to])
            back = np.flatnonzero(at > live * span)
            prior = before[at[back]]
            flat[prior] = self.rank(token[prior], token[at[back]])
        token = token.reshape(len(words), span)
        there = token >= 0
        every = token[there].astype(kind).tobytes()
        ends = (np.cumsum(there.sum(1)) * kind.itemsize).tolist()
        return [every[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
