"""Exact removal of repeated passages with a count-min prefilter.

A window is `width` consecutive words of one text. Its anchor is the least hash (the first one, on
ties) among the hashes of the runs of two thirds as many words within it: equal windows have equal anchors, at
places of their own, and neighbouring windows mostly share one, so there are some seven times
fewer anchors than windows, and an anchor's count is at least that of each of its windows. Three passes run over texts that are
dealt, once, into bundles of bounded size:

1. Each bundle sketches its anchors: a count-min sketch of `ROWS` rows of counters, whose
   width follows from the number of words. A bundle's sketch has few counters that aren't
   zero, so just those are written, by range of counters. The bundles' sketches are merged by
   adding counters range by range (up to two, since more than one is all that is asked). The estimate of an
   anchor is the least of its counters; it only ever overestimates, so a window whose
   estimate is one is unique. Back to each bundle goes one bit per counter that it wrote.
2. Each bundle writes a 128-bit hash of the words of only those windows that are estimated
   as repeated. They are grouped exactly, range by range; one bit per window goes back.
3. Each bundle removes the words that truly repeated windows cover.

A window that a third of all texts hold is one counter per row and bundle, since a bundle writes each
counter and each hash once (with a mark if it has it twice), so there is no hot key. Bundles grow with the input,
within bounds, and ranges of counters too, and partitions are at most `most_parts`, so what is written stays in proportion to the input.

Windows are judged on the input. Null texts have no words, and texts shorter than a window
lose nothing. Repeated rows are texts of their own and repeat each other. Null ids stay
null. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches

_U = np.uint64
#: An odd base of the rolling hash, 3 modulo 8, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, bits_: int) -> np.ndarray:
    out = np.ones(1 << bits_, _U)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full((1 << bits_) - 1, base, _U), out=out[1:])
    return out


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base; those up to the next power of two are kept."""
    return _powers(base, max(16, int(n).bit_length()))[:n]


#: Rows of the sketch, and what multiplies a hash in each of them (fixed, odd).
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


#: Fixed by rule: a value for each byte; none for the space between words.
VALUES = np.array([0 if b == 0x20 else xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], _U)
#: What marks replies of the exact pass, among the sketch's rows.
EXACT = len(ROWS)


def word_hashes(text: bytes, starts: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A hash of each word of text, whose words stand at starts with one space between: sums of its bytes' values times powers, some words together."""
    raw, out = np.frombuffer(text, np.uint8), np.zeros(len(starts), _U)
    edges = np.append(starts, len(raw) + 1)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + block, side="right")) - 1)
        here = raw[edges[lo] : min(edges[hi], len(raw))]
        wide = np.diff(edges[lo : hi + 1])
        place = np.arange(len(here)) - np.repeat(edges[lo:hi] - edges[lo], wide)[: len(here)]
        with np.errstate(over="ignore"):
            x = np.add.reduceat(VALUES[here] * powers(BASE, int(wide.max()))[place], edges[lo:hi] - edges[lo])
            x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        out[lo:hi] = x ^ (x >> _U(32))
        lo = hi
    return out


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbours in h: sums of values times powers, put back to the run's start."""
    n = len(h)
    if n < width:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, _U)
        np.cumsum(h * powers(BASE, n), out=sums[1:])
        x = (sums[width:] - sums[:-width]) * powers(INVERSE, n - width + 1)
        x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def least_places(x: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each `span` neighbours in x, the first one on ties; by doubling."""
    v, p, done = x, np.arange(len(x)), 1
    while done < span:
        step = min(done, span - done)
        right = v[step:] < v[:-step]
        v, p = np.where(right, v[step:], v[:-step]), np.where(right, p[step:], p[:-step])
        done += step
    return p


def once(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether each is there more than once."""
    v = np.sort(values)
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(new)
    return v[at], np.diff(np.append(at, len(v))) > 1


def pack(cells: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as gaps, byte plane by byte plane."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class Shape:
    """Widths that all bundles share: of a window, of an anchor's run, of the sketch and its ranges, and of the exact pass's ranges (as bits)."""

    def __init__(self, width: int, size: int):
        self.width, self.run = width, max(1, width * 2 // 3)
        windows = max(1, size // 6)  # at six bytes a word
        # Four counters a row for each anchor; two in span + 1 windows have an anchor of their own.
        anchors = 2 * windows / (width - self.run + 2)
        self.sketch = min(48, max(10, int(np.ceil(np.log2(4 * anchors + 1)))))
        self.range = min(self.sketch, max(20, min(28, self.sketch - 12)))
        self.exact = max(4, int(np.ceil(np.log2(max(1, windows / 500_000)))))


class Bundle:
    """The texts of one bundle, and what their windows say."""

    def __init__(self, texts: list[str], shape: Shape):
        self.shape = shape
        each = [b" ".join((t or "").encode().split()) for t in texts]
        self.counts = np.array([w.count(b" ") + 1 if w else 0 for w in each], int)
        self.first = np.cumsum(self.counts) - self.counts
        #: All words, one space between them; where each starts and stops.
        self.text = b" ".join([w for w in each if w])
        del each
        gaps = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 0x20)
        there = bool(self.text)
        self.starts, self.stops = np.append(0, gaps + 1)[: len(gaps) + there], np.append(gaps, len(self.text))[: len(gaps) + there]
        h = word_hashes(self.text, self.starts)
        runs_ = run_hashes(h, shape.run)
        # Windows by their first word; those that would reach into the next text are left out.
        inside = np.arange(len(h)) + shape.width <= np.repeat(self.first + self.counts, self.counts)
        self.windows = np.flatnonzero(inside)
        place = least_places(runs_, shape.width - shape.run + 1)[self.windows] if len(self.windows) else self.windows
        # Two texts' windows may meet at a place, but not at an anchor: a run lies in one text.
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        self.anchor = np.cumsum(new) - 1
        anchors = runs_[place[new]]
        self.rows = []
        for odd in ROWS:
            with np.errstate(over="ignore"):
                cell = (anchors * _U(odd)) >> _U(64 - shape.sketch)
            cells, twice = once(cell)
            self.rows.append((cell, cells, twice, (cells >> _U(shape.range)).astype(int)))

    def sketch(self) -> list[tuple[int, int, bytes, bytes]]:
        """Row, range, its counters that aren't zero, and which of them the bundle has more than once."""
        low = _U((1 << self.shape.range) - 1)
        return [(k, int(r), pack((cells[a:b] & low).astype(np.uint32)), bits(twice[a:b])) for k, (_, cells, twice, ranges) in enumerate(self.rows) for r, a, b in runs(ranges)]

    def suspect(self, replies: dict[tuple[int, int], bytes]) -> np.ndarray:
        """First words of the windows whose estimate is more than one."""
        more = np.ones(self.anchor[-1] + 1 if len(self.anchor) else 0, bool)
        for k, (cell, cells, _, ranges) in enumerate(self.rows):
            hot = np.zeros(len(cells), bool)
            for r, a, b in runs(ranges):
                hot[a:b] = flags(replies[k, int(r)], b - a)
            more &= hot[np.searchsorted(cells, cell)]
        return self.windows[more[self.anchor]] if len(self.anchor) else self.windows

    def exact(self, begin: np.ndarray) -> np.ndarray:
        """128-bit hashes of the words of the windows that begin at these words, as rows of two numbers."""
        if not len(begin):
            return np.zeros((0, 2), _U)
        text, digest = self.text, xxhash.xxh3_128_digest
        out = [digest(text[lo:hi]) for lo, hi in zip(self.starts[begin].tolist(), self.stops[begin + self.shape.width - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(out), ">u8").reshape(-1, 2).astype(_U)

    def kept(self, begin: np.ndarray) -> tuple[list[int], list[int], list[str]]:
        """Words, removed words and the digest of the kept words of every text, if the windows that begin at these words go."""
        n = len(self.starts)
        depth = np.zeros(n + 1, int)
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + self.shape.width, -1)
        stay = np.cumsum(depth[:-1]) == 0
        before = np.concatenate([[0], np.cumsum(stay)])
        left = before[self.first + self.counts] - before[self.first]
        digests = []
        for a, count, k in zip(self.first.tolist(), self.counts.tolist(), left.tolist(), strict=True):
            if k == 0:
                parts = []
            elif k == count:
                parts = [(a, a + count)]
            else:
                edges = np.flatnonzero(np.diff(stay[a : a + count].astype(np.int8), prepend=0, append=0)) + a
                parts = zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
            digests.append(hashlib.sha256(b" ".join([self.text[self.starts[x] : self.stops[y - 1]] for x, y in parts])).hexdigest())
        return self.counts.tolist(), (self.counts - left).tolist(), digests


def runs(values: np.ndarray):
    """(value, start, stop) of each run of equal values."""
    if not len(values):
        return
    at = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield values[a], int(a), int(b)


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 128-bit keys in order, whether each is there more than once, and which of them each key is."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    v = keys[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]).any(1)
    at = np.flatnonzero(new)
    which = np.empty(len(v), int)
    which[order] = np.cumsum(new) - 1
    return v[at], np.diff(np.append(at, len(v))) > 1, which


def remove_repeats(docs: DataFrame, width: int = 35, bundle_bytes: int | None = None, most_parts: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs. A bundle has a hundred thousandth of all bytes, but 8 MB to 64 MB, or bundle_bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bundles = max(least, -(-size // (bundle_bytes or min(64 << 20, max(8 << 20, size // 100_000)))))
    parts = max(least, min(bundles, most_parts))
    shape = Shape(width, size)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(bundles)).cast("int").alias("bundle")).repartition(parts, "bundle")

    sketches = texts.groupBy("bundle").applyInArrow(_sketch(shape), "row int, range int, bundle int, cells binary, twice binary")
    replies = sketches.repartition(parts, "row", "range").sortWithinPartitions("row", "range")
    replies = arrow_map(replies, _merge_cells(shape), "bundle int, stage int, range int, reply binary").repartition(parts, "bundle")
    suspects = texts.groupBy("bundle").cogroup(replies.groupBy("bundle")).applyInArrow(_suspects(shape), "row int, range int, bundle int, keys binary, twice binary")
    verdicts = suspects.repartition(parts, "range").sortWithinPartitions("range")
    verdicts = arrow_map(verdicts, _merge_keys, "bundle int, stage int, range int, reply binary").repartition(parts, "bundle")
    return texts.groupBy("bundle").cogroup(replies.unionByName(verdicts).groupBy("bundle")).applyInArrow(_remove(shape), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _bundle(table: pa.Table, shape: Shape) -> Bundle:
    return Bundle(table.column("text").to_pylist(), shape)


def _sketch(shape: Shape):
    def run(table: pa.Table) -> pa.Table:
        found = _bundle(table, shape).sketch()
        bundle = table.column("bundle")[0].as_py()
        return pa.table({
            "row": pa.array([f[0] for f in found], pa.int32()), "range": pa.array([f[1] for f in found], pa.int32()), "bundle": pa.array([bundle] * len(found), pa.int32()),
            "cells": pa.array([f[2] for f in found], pa.binary()), "twice": pa.array([f[3] for f in found], pa.binary()),
        })

    return run


def _by_range(batches, names):
    """((row, range), columns) of each range of sorted batches."""
    key, held = None, None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("row", "range", *names)]
        for row in zip(*columns, strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], [[] for _ in names]
            for h, v in zip(held, row[2:], strict=True):
                h.append(v)
    if held:
        yield key, held


def _merge_cells(shape: Shape):
    def run(batches):
        for (row, key), (bundle, cells, twice) in _by_range(batches, ("bundle", "cells", "twice")):
            counters = np.zeros(1 << shape.range, np.uint8)
            lists = [unpack(c) for c in cells]
            for c, t in zip(lists, twice, strict=True):
                counters[c] = np.minimum(counters[c] + 1 + flags(t, len(c)), 2)
            yield {"bundle": bundle, "stage": [row] * len(bundle), "range": [key] * len(bundle), "reply": [bits(counters[c] > 1) for c in lists]}

    return run


def _replies(table: pa.Table) -> dict[tuple[int, int], bytes]:
    """By stage (a row of the sketch, or EXACT) and range."""
    return dict(zip(zip(table.column("stage").to_pylist(), table.column("range").to_pylist(), strict=True), table.column("reply").to_pylist(), strict=True))


def _suspects(shape: Shape):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {"range": [], "bundle": [], "keys": [], "twice": []}
        if texts.num_rows:
            bundle = _bundle(texts, shape)
            keys, twice, _ = ordered(bundle.exact(bundle.suspect(_replies(replies))))
            for r, a, b in runs(keys[:, 0] >> _U(64 - shape.exact)):
                out["range"].append(int(r))
                out["bundle"].append(texts.column("bundle")[0].as_py())
                out["keys"].append(keys[a:b].astype("<u8").tobytes())
                out["twice"].append(bits(twice[a:b]))
        return pa.table({"row": pa.array([EXACT] * len(out["range"]), pa.int32()), "range": pa.array(out["range"], pa.int32()), "bundle": pa.array(out["bundle"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "twice": pa.array(out["twice"], pa.binary())})

    return run


def _merge_keys(batches):
    for (_, key), (bundle, keys, twice) in _by_range(batches, ("bundle", "keys", "twice")):
        lists = [np.frombuffer(k, "<u8").reshape(-1, 2).astype(_U) for k in keys]
        again = [flags(t, len(k)) for t, k in zip(twice, lists, strict=True)]
        _, more, which = ordered(np.concatenate(lists + [k[a] for k, a in zip(lists, again, strict=True)]))
        ends = np.cumsum([len(k) for k in lists])
        yield {"bundle": bundle, "stage": [EXACT] * len(bundle), "range": [key] * len(bundle), "reply": [bits(more[which[e - len(k) : e]]) for k, e in zip(lists, ends, strict=True)]}


def _remove(shape: Shape):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        out = ([], [], [])
        if texts.num_rows:
            bundle, told = _bundle(texts, shape), _replies(replies)
            begin = bundle.suspect(told)
            keys, _, which = ordered(bundle.exact(begin))
            repeated = np.zeros(len(keys), bool)
            for r, a, b in runs(keys[:, 0] >> _U(64 - shape.exact)):
                repeated[a:b] = flags(told[EXACT, int(r)], b - a)
            out = bundle.kept(begin[repeated[which]])
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "kept_sha256": pa.array(out[2], pa.string())})

    return run
