"""Ids of all words of many texts at once, over numpy and Arrow arrays.

Where white space between words leaves no trace in the ids, a text's ids are those of its words in a row. The
texts' distinct words are found array-wise, each is encoded once, and the ids of all texts
are gathered from theirs. Words of Latin letters, with or without signs behind them, are
cut into letters and signs; letters are lower-cased by a table and encoded by the
vocabulary's merges, all other words by the library. Of the letters' ids, up to `most` are kept
for later texts, those of the latest texts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words with more bytes of letters go to the library: merges hold words of about one length together, padded.
LONGEST = 64
LEAD, LEADS = 0xC2, 8  # first bytes of the letters U+0080 to U+024F


def _lower() -> tuple[np.ndarray, np.ndarray]:
    """By byte, the lower-case ASCII letter; by pair of bytes, those of the lower-case letter below U+0250. 0 where there is none of the same length."""
    one, two = np.zeros(256, np.uint8), np.zeros(LEADS * 64, np.uint16)
    for c in range(0x250):
        low = chr(c).lower()
        if not chr(c).isalpha() or len(low) != 1 or not low.isalpha() or low >= "ɐ":
            continue
        old, new = chr(c).encode(), low.encode()
        if len(old) == len(new) == 1:
            one[old[0]] = new[0]
        elif len(old) == len(new) == 2:
            two[(old[0] - LEAD) * 64 + old[1] - 0x80] = new[0] << 8 | new[1]
    return one, two


LOWER, LOWER2 = _lower()


def _marked(signs: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _within(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a range; ranges don't overlap."""
    step = np.zeros(n + 1, np.int8)
    some = stops > starts
    step[starts[some]] += 1
    step[stops[some]] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of pool behind each other."""
    return pool[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def split(texts: list[bytes], spaces: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and for each text how many words end with it."""
    whole = np.frombuffer(b"".join(x for t in texts for x in (t, spaces[:1])), np.uint8)
    inside = ~_marked(spaces)[whole]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, stops = edges[::2], edges[1::2]
    return _binary(whole[inside], stops - starts), np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


class Words:
    def __init__(self, codec, spaces: bytes, tail: bytes, most: int = 400_000):
        self.codec, self.spaces, self.tail, self.most = codec, spaces, _marked(tail), most
        self.known, self.ids, self.sizes = pa.array([], pa.binary()), np.zeros(0, codec.kind), np.zeros(0, np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        words, ends = split(texts, self.spaces)
        if not len(words):
            return [np.zeros(0, self.codec.kind)] * len(texts)
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        pool, starts, sizes = self.pieces(coded.dictionary)
        # Two pieces for each word: the letters, or the whole word, and the signs behind.
        each = np.concatenate([[0], np.cumsum(sizes.sum(1)[at])])
        ids = _gathered(pool, starts[at].ravel(), sizes[at].ravel())
        ends = each[np.concatenate([[0], ends])]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where the two pieces of each word start and how long they are; words are distinct and none is empty."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        low = LOWER[data]
        lead = np.flatnonzero((data >= LEAD) & (data < LEAD + LEADS))
        pair = LOWER2[(data[lead].astype(np.int64) - LEAD) * 64 + data[lead + 1] - 0x80]
        low[lead], low[lead + 1] = pair >> 8, pair & 0xFF
        stops = np.maximum(np.maximum.reduceat(np.where(self.tail[data], -1, np.arange(len(data))), starts) + 1, starts)
        bad = np.concatenate([[0], np.cumsum(low == 0)])
        plain = (stops > starts) & (stops - starts <= LONGEST) & (bad[stops] == bad[starts]) & (self.codec.merges is not None)
        a, b, c = starts[plain], stops[plain], ends[plain]
        letters = _binary(low[_within(a, b, len(data))], b - a).dictionary_encode()
        signs = _binary(data[_within(b, c, len(data))], c - b).dictionary_encode()
        tables = [self.of_letters(letters.dictionary), self.by_library(signs.dictionary.to_pylist()), self.by_library(words.filter(pa.array(~plain)).to_pylist())]
        pool, length = np.concatenate([ids for ids, _ in tables]), np.concatenate([sizes for _, sizes in tables])
        begin = np.cumsum(length) - length
        piece = np.zeros((len(words), 2), np.int64)
        n, m = len(letters.dictionary), len(signs.dictionary)
        piece[plain, 0], piece[plain, 1] = letters.indices.to_numpy(), n + signs.indices.to_numpy()
        piece[~plain, 0] = n + m + np.arange(len(words) - plain.sum())
        sizes = length[piece]
        sizes[~plain, 1] = 0
        return pool, begin[piece], sizes

    def by_library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has; asked for once and kept with the codec's words."""
        kept = self.codec.words
        fresh = kept.fetch(words)
        for w, ids in zip(fresh, self.codec.by_library(fresh), strict=True):
            kept.put(w, ids)
        return self.packed([kept.young[w] for w in words])

    def packed(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        kind = self.codec.kind
        return np.frombuffer(b"".join(ids), kind), np.array([len(x) for x in ids], np.int64) // kind.itemsize

    def of_letters(self, letters: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct words of lower-case letters, by what is known and by merges."""
        at = pc.fill_null(pc.index_in(letters, value_set=self.known), -1).to_numpy()
        fresh = np.flatnonzero(at < 0)
        at = at.astype(np.int64)
        at[fresh] = len(self.known) + np.arange(len(fresh))
        new, sizes = self.packed(self.codec.merges.tokens(letters.take(pa.array(fresh)).to_pylist(), self.codec.kind) if len(fresh) else [])
        pool, length = np.concatenate([self.ids, new]), np.concatenate([self.sizes, sizes])
        begin = np.cumsum(length) - length
        ids, sizes = _gathered(pool, begin[at], length[at]), length[at]
        unused = np.ones(len(self.known), bool)
        unused[at[at < len(self.known)]] = False
        rest = np.flatnonzero(unused)[: max(0, self.most - len(letters))]
        here = np.arange(min(len(letters), self.most))
        self.known = pa.concat_arrays([letters.slice(0, len(here)), self.known.take(pa.array(rest))])
        self.ids = np.concatenate([ids[: sizes[here].sum()], _gathered(pool, begin[rest], length[rest])])
        self.sizes = np.concatenate([sizes[here], length[rest]])
        return ids, sizes
