"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are made from word shingles, repeats included. For a radius r the
bits are grouped into m partitions, correlated bits together, and partition i gets a
threshold t_i of -1 (not probed) or more, with the sum of (t_i + 1) equal to r + 1: two
codes that differ in at most r bits differ in at most t_i bits of some partition i. The
thresholds, unequal where that is cheaper, come from dynamic programming on estimated
candidate counts; the estimates come from bit statistics of all fingerprints. Then every
fingerprint probes the keys within t_i of its own in each partition, and candidates are
verified.

Null and empty texts have fingerprint 0, which links like any other. Null ids get the
component of their fingerprint's other ids, or null if there is none. Repeated rows each
return a row. Exact ties need no order, since components are least ids. Other columns
aren't read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import verified
from .common import arrow_map, small_batches, written
from .components import components

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(w), seed) for w in zip(*(words[i:] for i in range(shingle)), strict=False)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 65_536):
        ones += np.unpackbits(h[lo : lo + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(h)))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (xxhash64 of the text) and code (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            codes = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "code": codes.view(np.int64)}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, row_key long, code long")


def bit_statistics(codes: DataFrame) -> tuple[int, np.ndarray]:
    """How many codes there are, and how often each pair of bits is set together: 4,096 sums, whatever the input."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            c = batch.column("code").to_numpy().astype("<i8")
            m = np.unpackbits(c.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += m.T @ m
            n += len(c)
        if n:
            yield {"at": np.arange(BITS * BITS + 1), "sum": np.append(total.ravel(), n).astype(np.int64)}

    sums = {r["at"]: r["sum"] for r in arrow_map(codes.select("code"), run, "at int, sum long").groupBy("at").agg(F.sum("sum").alias("sum")).collect()}
    together = np.array([sums.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)
    return sums.get(BITS * BITS, 0), together


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of about equal width, each grown by the bit that correlates most with the group."""
    share = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(share, share)
    spread = np.sqrt(np.maximum(np.outer(share * (1 - share), share * (1 - share)), 1e-18))
    related = np.abs(cov / spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for p in range(parts):
        width = len(free) // (parts - p)
        first = max(sorted(free), key=lambda b: related[b, sorted(free)].sum())
        group = [first]
        free.remove(first)
        while len(group) < width:
            nxt = max(sorted(free), key=lambda b: related[b, group].sum())
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def within(chances: np.ndarray, most: int) -> list[float]:
    """Chance of at most 0, 1, ... most differences, for bits that differ with these chances."""
    d = np.zeros(most + 1)
    d[0] = 1
    for p in chances:
        d[1:] = d[1:] * (1 - p) + d[:-1] * p
        d[0] *= 1 - p
    return list(np.cumsum(d))


def allocate(n: int, together: np.ndarray, radius: int, row_cost: float = 200.0) -> tuple[list[list[int]], list[int]]:
    """The cheapest partitions and thresholds: dynamic programming over partitions and the radius they share, for each number of partitions."""
    share = np.diag(together) / max(n, 1)
    differ = 2 * share * (1 - share)
    best: tuple[float, list[list[int]], list[int]] | None = None
    for parts in range(1, radius + 2):
        groups = group_bits(n, together, parts)
        costs = []
        for g in groups:
            chance = within(differ[g], radius)
            # A threshold of -1 costs nothing; t costs the keys it writes and the candidates they meet.
            costs.append([0.0] + [row_cost * n * (sum(comb(len(g), k) for k in range(t + 1)) + (t > 0)) + n * n * chance[t] for t in range(radius + 1)])
        # state: units of radius + 1 spent so far -> cost and thresholds
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, ts) in states.items():
                for t in range(-1, radius + 1):
                    if (to := spent + t + 1) <= radius + 1 and (to not in new or cost + c[t + 1] < new[to][0]):
                        new[to] = (cost + c[t + 1], [*ts, t])
            states = new
        cost, ts = states[radius + 1]
        if best is None or cost < best[0]:
            best = (cost, groups, ts)
    return best[1], best[2]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def probes(codes: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """part, key, code, probe: the code's own keys (probe 0) and those within the thresholds (probe 1)."""
    out = None
    for part, (group, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        mask = signed(sum(1 << b for b in group))
        own = codes.select(F.lit(part).alias("part"), F.col("code").bitwiseAND(F.lit(mask)).alias("key"), "code", F.lit(0).alias("probe"))
        out = own if out is None else out.unionByName(own)
        if t > 0:
            flips = [signed(sum(1 << b for b in c)) for k in range(1, t + 1) for c in combinations(group, k)]
            near = codes.select("code", F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip"))
            out = out.unionByName(near.select(F.lit(part).alias("part"), F.col("code").bitwiseAND(F.lit(mask)).bitwiseXOR(F.col("flip")).alias("key"), "code", F.lit(1).alias("probe")))
    return out


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, **columns: str) -> DataFrame:
    """doc_id, row_key, fingerprint (16 hex digits) and component_id of every row of docs."""
    table = written(fingerprints(docs, shingle, **columns), "fingerprints")
    least = written(table.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    n, together = bit_statistics(least)
    groups, thresholds = allocate(n, together, radius)
    linked = components(verified(probes(least.select("code"), groups, thresholds), radius))
    rooted = least.join(linked, F.col("code") == F.col("node"), "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_code = rooted.join(named, "root").select("code", "component_id")
    return table.join(of_code, "code").select("doc_id", "row_key", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
