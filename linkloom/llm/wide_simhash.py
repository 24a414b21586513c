"""Near-duplicate texts by wide SimHash fingerprints, for a word-shingle similarity of 0.8 or more.

Two texts whose shingle sets have a Jaccard similarity s differ in each fingerprint bit with the chance
arccos(2 s / (1 + s)) / pi, about 0.15 at 0.8: too much for 64 bits and a small radius. So a fingerprint has
`blocks` times 64 bits. As in `simhash`, correlated bits are grouped into partitions, and dynamic programming on
estimated candidate counts gives each partition its threshold (-1, 0 or 1); what the thresholds must reach is not a
sure radius but the chance `recall` that a pair at just the least similarity meets in some partition. Every
fingerprint probes the keys within its thresholds, and candidates are verified: on all bits, then, where the bits
leave doubt, by the exact similarity of the shingle sets.

A bucket gives back a spanning forest of its pairs, those of fewest differing bits first, never all pairs; large
buckets are cut into chunks, and every pair of chunks is a group with a forest of its own. A link that a forest leaves
out lies between texts that links of no more differing bits connect; if one of those fails the exact check, the pair may
be parted although it is similar itself. Tests measure recall against brute force. Chunks and ties follow the codes, not
their numbers, places or batches: which links a forest keeps is the same on every run.

Texts that differ only in the case of A-Z or in white space are one class. Texts without words are one class too,
and links with none other. Texts of fewer words than a shingle are one shingle. Null texts count as empty. Null ids come
last when the one that stays is chosen. Repeated rows are one class, of which one row stays. An empty table gives no rows.
"""

from __future__ import annotations

from math import log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import BUCKET
from .common import arrow_map, fresh, small_batches, written
from .components import components, local_forest
from .simhash import group_bits, within

_U = np.uint64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, A-Z in lower case; repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, _U)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], _U)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(w), 42) for w in zip(*(words[i:] for i in range(shingle)), strict=False)], _U)


def fingerprint(hashes: np.ndarray, blocks: int) -> bytes:
    """64 x blocks bits of the distinct shingles; a bit is 1 if it is set in over half of them. Blocks behind the first come from mixed hashes."""
    h = np.unique(hashes)
    ones = np.zeros((blocks, 64), np.int64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(h), 8192):
            x = h[lo : lo + 8192][None] + np.arange(blocks, dtype=_U)[:, None] * _U(0x9E3779B97F4A7C15)
            x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
            x ^= x >> _U(31)
            ones += np.unpackbits(x.view(np.uint8).reshape(blocks, -1, 8), axis=2, bitorder="little").sum(1, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, shingle: int, blocks: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key (xxhash64 of the text), code and words (whether there are any) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t, shingle) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "code": [fingerprint(h, blocks) for h in hashes], "words": [len(h) > 0 for h in hashes]}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, row_key long, code binary, words boolean")


def bit_statistics(codes: DataFrame, blocks: int) -> tuple[int, np.ndarray]:
    """How many codes there are, and by block how often each pair of bits is set together: blocks x 4,096 sums, whatever the input."""

    def run(batches):
        total, n = np.zeros((blocks, 64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, blocks, 8), axis=2, bitorder="little").astype(np.float32)
            total += np.einsum("nbi,nbj->bij", bits, bits, optimize=True)
            n += len(bits)
        if n:
            yield {"at": np.arange(total.size + 1), "sum": np.append(total.ravel(), n).astype(np.int64)}

    got = {r["at"]: r["sum"] for r in arrow_map(codes.select("code"), run, "at int, sum long").groupBy("at").agg(F.sum("sum").alias("sum")).collect()}
    size = blocks * 4096
    return got.get(size, 0), np.array([got.get(i, 0) for i in range(size)], float).reshape(blocks, 64, 64)


def difference(similarity: float) -> float:
    """The chance that a bit differs between two sets of this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / pi)


def allocate(n: int, together: np.ndarray, similarity: float, recall: float, row_cost: float = 200.0, units: int = 400) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """The cheapest partitions (block, bits) and thresholds whose pairs meet with the chance `recall`: dynamic programming over partitions and the logarithm of the chance of missing each other."""
    goal, p = -log(1 - recall), difference(similarity)
    best: tuple[float, list, list[int]] | None = None
    for parts in (6, 5, 4, 3, 2):
        groups, options = [], []
        for block, counts in enumerate(together):
            share = np.diag(counts) / max(n, 1)
            differ = 2 * share * (1 - share)
            for g in group_bits(n, counts, parts):
                near, random = within(np.full(len(g), p), 1), within(differ[g], 1)
                rows = [1, 2 + len(g)]
                groups.append((block, g))
                options.append([(0.0, 0)] + [(row_cost * n * rows[t] + n * n * random[t], int(-log(1 - near[t]) / goal * units)) for t in (0, 1)])
        state = {0: (0.0, [])}
        for each in options:
            new: dict[int, tuple[float, list[int]]] = {}
            for got, (cost, ts) in state.items():
                for t, (more, gain) in enumerate(each):
                    to = min(units, got + gain)
                    if to not in new or cost + more < new[to][0]:
                        new[to] = (cost + more, [*ts, t - 1])
            state = new
        reached = max(state)
        if best is None or (reached >= units and state[reached][0] < best[0]):
            best = (state[reached][0] if reached >= units else float("inf"), groups, state[reached][1])
    return best[1], best[2]


def probes(codes: DataFrame, groups: list[tuple[int, list[int]]], thresholds: list[int]) -> DataFrame:
    """part, key, cid, code, probe of every code: its own keys (probe 0) and those within the thresholds (probe 1)."""
    masks = [(part, block, _U(sum(1 << b for b in g)), [_U(1 << b) for b in g] if t else []) for part, ((block, g), t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]

    def run(batches):
        for batch in batches:
            cid, raw = batch.column("cid"), batch.column("code")
            words = np.frombuffer(b"".join(raw.to_pylist()), "<u8").reshape(len(batch), -1)
            for part, block, mask, flips in masks:
                key = words[:, block] & mask
                for probe, flip in [(0, _U(0)), *((1, f) for f in flips)]:
                    yield {"part": np.full(len(key), part), "key": (key ^ flip).view(np.int64), "cid": cid, "code": raw, "probe": np.full(len(key), probe)}

    return arrow_map(codes.select("cid", "code"), run, "part int, key long, cid long, code binary, probe int")


def marks(code: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each code (rows of words), that orders codes alike on every run."""
    out = np.zeros(len(code), _U)
    with np.errstate(over="ignore"):
        for word in code.T:
            out = (out ^ word.astype(_U)) * _U(0xBF58476D1CE4E5B9)
            out ^= out >> _U(29)
    return out


def spanning(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the edges of a least spanning forest, edges being compared as `order` lists them: each round takes the least edge out of every component."""
    if not len(a):
        return np.zeros(0, int)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, taken = np.arange(len(nodes)), []
    x, y = x[order], y[order]
    live = np.arange(len(order))
    while True:
        lx, ly = label[x[live]], label[y[live]]
        apart = lx != ly
        live, lx, ly = live[apart], lx[apart], ly[apart]
        if not len(live):
            break
        least = np.full(len(nodes), len(order))
        np.minimum.at(least, lx, live)
        np.minimum.at(least, ly, live)
        chosen = np.unique(least[least < len(order)])
        taken.append(chosen)
        low, root = local_forest(label[x[chosen]], label[y[chosen]])
        to = np.arange(len(nodes))
        to[low] = root
        label = to[label]
    return order[np.concatenate(taken)] if taken else np.zeros(0, int)


def candidates(rows: DataFrame, radius: int, chunk: int = 1000, few: int = 100_000) -> DataFrame:
    """a, b, bits: a least spanning forest of each group of codes that share a bucket and differ in at most radius bits."""
    heavy = rows.groupBy(*BUCKET).count().filter(F.col("count") > chunk).select(*BUCKET, F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    heavy = written(heavy, "heavy-buckets")
    cut = rows.join(F.broadcast(heavy) if heavy.count() <= few else heavy, list(BUCKET), "left").withColumn("n", F.coalesce("n", F.lit(1)))
    cut = cut.withColumn("c", F.pmod(F.xxhash64("code"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(F.col("c"), o).alias("c1"), F.greatest(F.col("c"), o).alias("c2")))
    group = [*BUCKET, "c1", "c2"]
    dealt = cut.select(*BUCKET, "cid", "code", "probe", F.explode(pairs).alias("p")).select(*BUCKET, "p.c1", "p.c2", "cid", "code", "probe")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "probe")

    def run(batches):
        kept = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*group, "cid", "probe"]]
            columns.append(np.frombuffer(b"".join(batch.column("code").to_pylist()), "<u8").reshape(len(batch), -1))
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            changes = np.zeros(len(columns[0]), bool)
            for c in columns[:4]:
                changes[1:] |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(changes)])
            yield edges(columns, starts[:-1], starts[1:])
            kept = [c[starts[-1] :] for c in columns]
        if kept is not None and len(kept[0]):
            yield edges(kept, np.array([0]), np.array([len(kept[0])]))

    def edges(columns, starts, stops):
        cid, probe, code = columns[4:]
        end = np.repeat(stops, stops - starts)
        at, step, held = np.flatnonzero(probe[: len(end)] == 0), 0, []
        none = np.zeros(0, np.int64)
        mark = marks(code[: len(end)])
        while True:
            step += 1
            at = at[at + step < end[at]]
            if not at.size:
                break
            for lo in range(0, len(at), 100_000):
                x = at[lo : lo + 100_000]
                # the first two words tell most pairs apart
                bits = np.bitwise_count(code[x, :2] ^ code[x + step, :2]).sum(1, dtype=np.int64)
                x = x[bits <= min(radius, 64)]
                bits = np.bitwise_count(code[x] ^ code[x + step]).sum(1, dtype=np.int64)
                ok = bits <= radius
                x, bits = x[ok], bits[ok]
                if len(x):
                    held.append((x, x + step, bits))
            if sum(len(h[0]) for h in held) > 1_000_000:
                held = [forest(held, mark)]
        a, b, bits = forest(held, mark) if held else (none, none, none)
        a, b = cid[a], cid[b]
        return {"a": np.minimum(a, b), "b": np.maximum(a, b), "bits": bits}

    def forest(held, mark):
        # Rows are the nodes, so groups are forests of their own; a row is one code, once in its group.
        a, b, bits = (np.concatenate(x) for x in zip(*held, strict=True))
        at = spanning(a, b, np.lexsort((np.maximum(mark[a], mark[b]), np.minimum(mark[a], mark[b]), bits)))
        return a[at], b[at], bits[at]

    return arrow_map(dealt, run, "a long, b long, bits long").filter("a != b").groupBy("a", "b").agg(F.min("bits").alias("bits"))


def alike(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts (cid, text) have shingle sets of this Jaccard similarity at least."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()

    def sets(batches):
        for batch in batches:
            yield {"cid": batch.column("cid"), "set": [np.unique(shingle_hashes(t, shingle)).astype("<u8").tobytes() for t in batch.column("text").to_pylist()]}

    small_batches(pairs.sparkSession)
    each = written(arrow_map(texts.join(nodes, "cid", "left_semi").select("cid", "text"), sets, "cid long, set binary"), "shingle-sets")
    both = pairs.join(each.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a").join(each.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")

    def verify(batches):
        for batch in batches:
            same = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                n = len(np.intersect1d(x, y, assume_unique=True))
                same.append(n >= similarity * (len(x) + len(y) - n))
            keep = pa.array(same, pa.bool_())
            yield {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    return arrow_map(both.select("a", "b", "x", "y"), verify, "a long, b long")


def near_texts(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, blocks: int = 8, recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, cid) and classes (cid, root): texts of equal root are near-duplicates."""
    table = written(fingerprints(docs, shingle, blocks, id_col, text_col), "wide-fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    # A number of its own for each code; it stays once the table is written.
    one = written(table.groupBy("code").agg(first.alias("f"), F.max("words").alias("words")).withColumn("cid", F.monotonically_increasing_id()), "wide-codes")
    n, together = bit_statistics(one, blocks)
    groups, thresholds = allocate(n, together, similarity, recall)
    p, bits = difference(similarity), 64 * blocks
    spread = float(np.sqrt(bits * p * (1 - p)))
    # Beyond 2.5 deviations above the mean at the least similarity no pair is looked at; 3.5 below it there is no doubt.
    found = written(candidates(probes(one.filter("words"), groups, thresholds), int(bits * p + 2.5 * spread)), "wide-candidates")
    sure = found.filter(F.col("bits") <= int(bits * p - 3.5 * spread)).select("a", "b")
    roots = components(sure)
    named = found.filter(F.col("bits") > int(bits * p - 3.5 * spread))
    for side in ("a", "b"):
        named = named.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    doubtful = written(named.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "wide-doubtful")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    nodes = one.join(doubtful.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi").select("cid", F.col("f.doc_id").alias("i"), F.col("f.row_key").alias("k"))
    texts = nodes.join(keyed, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("row_key"))).select("cid", "text").dropDuplicates(["cid"])
    linked = components(sure.unionByName(alike(doubtful, texts, similarity, shingle)))
    rooted = one.join(linked, F.col("cid") == F.col("node"), "left").select("cid", "code", "f", F.coalesce("root", "cid").alias("root"))
    return table.join(rooted.select("cid", "code"), "code").select("doc_id", "row_key", "cid"), rooted.select("cid", "root", "f")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row of the least id (nulls last), repeated rows once."""
    _, classes = near_texts(docs, id_col=id_col, text_col=text_col, **parameters)
    first = classes.groupBy("root").agg(F.min("f").alias("f"))
    # Ids and texts as two hashes: keys that are never null, for one shuffle of the texts.
    (k,) = fresh(docs, "text_key")
    stay = first.select(F.xxhash64(F.coalesce(F.col("f.doc_id").cast("string"), F.lit("none")), "f.row_key").alias(k))
    keyed = docs.withColumn(k, F.xxhash64(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("none")), F.xxhash64(text_col)))
    return keyed.join(stay, k, "left_semi").dropDuplicates([k]).drop(k)
