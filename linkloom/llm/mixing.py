"""Mixing sources to target weights by Sainte-Laguë apportionment.

A document's size is its number of words. Sources in code point order (null last) weigh
5, 2, 1 in turn and share `total` times all words; a target stops at `most` times its
source's size, and the excess is reshared by weight until none is above. Equal-token
blocks of `block` words are then apportioned to sources by highest quotients
target / (2 seats + 1). A source's seats may be pooled into wider blocks, by doubling up to `widest`
words but not beyond a 256th of its target, so that small sources still meet theirs. Within a source
they go to its shards by highest quotients over their
sizes. A shard of n blocks and quota q takes each block q // n times, and q % n blocks,
selected by a keyed permutation of the shard's blocks, once more. A quota never exceeds `most` times the
shard's blocks; rounding may ask for one or two more, and these are given up. Documents take the
words of theirs that lie in taken blocks, so none exceeds `most` (rounded up) times its size. With `whole`,
a document of up to a block's width is taken as a whole, with the block that its first word lies in.

Null texts have size 0. Repeated rows are documents of their own. Ties in quotients are
ordered by source and shard, so reruns agree. An empty table, or one without words, takes
nothing. Other columns aren't read.

The catalogue of sources is the one thing that meets on the driver, one small row per
source, and `most_sources` is its checked bound. Everything else is spread by source and
shard, of about `shard_words` words each, more beyond `most_shards` shards a source, so a source with a
third of all rows is many groups, and its shards' figures, which meet in one task, are at most so many rows.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, arrow_map, fresh, small_batches, written
from .permute import permute

#: The weights of the first, second and third source, repeating.
WEIGHTS = (5, 2, 1)
WORDS = re.compile(WORD_RE)


def targets(sizes: list[int], weights: list[int], total: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of total x all sizes by weight, each at most most x its size, the excess reshared by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight, out = total * sum(sizes), sum(weights), [0.0] * len(sizes)
    for k, i in enumerate(order):
        if most * sizes[i] * weight >= left * weights[i]:
            for j in order[k:]:
                out[j] = weights[j] * left / weight
            break
        out[i] = most * sizes[i]
        left -= out[i]
        weight -= weights[i]
    return out


def sainte_lague(seats: int, votes: list[float]) -> list[int]:
    """seats by highest quotients votes / (2 given + 1); ties go to the earlier one.

    Starts from rounded quotas, which are the apportionment for another number of seats,
    and gives or takes single seats by quotient, so its time doesn't grow with the seats.
    """
    whole = sum(votes)
    if not whole or seats <= 0:
        return [0] * len(votes)
    given = [int(v * seats / whole + 0.5) for v in votes]
    over = sum(given) - seats
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, given, strict=True))] if over < 0 else [(votes[i] / (2 * g - 1), -i) for i, g in enumerate(given) if g]
    heapq.heapify(heap)
    for _ in range(abs(over)):
        _, i = heapq.heappop(heap)
        i = abs(i)
        given[i] += 1 if over < 0 else -1
        if over < 0:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
        elif given[i]:
            heapq.heappush(heap, (votes[i] / (2 * given[i] - 1), -i))
    return given


def block_width(target: float, block: int, widest: int) -> int:
    """The widest doubling of block that is within widest and a 256th of the target."""
    while 2 * block <= min(widest, target / 256):
        block *= 2
    return block


def mix(docs: DataFrame, total: float = 1.5, most: float = 2.0, block: int = 16, widest: int | None = None, whole: bool = False, shard_words: int = 1 << 18, most_shards: int = 20_000, seed: int = 0, most_sources: int = 100_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row_key, source, size, source_size, target, taken, and spans (of words: start, stop, times) of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark, 10_000)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col, source_col).alias("row_key"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"))
    rows = written(rows, "mix-sizes")
    catalogue = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(most_sources + 1).collect()
    if len(catalogue) > most_sources:
        raise ValueError(f"more than {most_sources} sources; raise most_sources if the driver can hold them")
    names = sorted((r["source"] for r in catalogue), key=lambda s: (s is None, s or ""))
    sizes = {r["source"]: int(r["size"]) for r in catalogue}
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]
    goal = targets([sizes[s] for s in names], weights, total, most)
    seats = sainte_lague(round(sum(goal) / block), goal)
    widths = [block_width(g, block, widest or block) for g in goal]
    plan = spark.createDataFrame(
        [(s, i, sizes[s], g, round(q * block / w), max(1, min(most_shards, -(-sizes[s] // shard_words))), w) for i, (s, g, q, w) in enumerate(zip(names, goal, seats, widths, strict=True))],
        "p_source string, s int, source_size long, target double, seats long, shards long, width long",
    )
    named = rows.join(F.broadcast(plan) if len(names) < 1000 else plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("row_key"))
    named = named.withColumn("place", place).withColumn("shard", F.pmod("place", "shards"))

    # Quotas of shards: rounded shares of the source's seats, then single seats by quotient.
    sums = named.groupBy("s", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"), F.first("source_size").alias("all"), F.first("width").alias("width"))
    sums = sums.filter("words > 0").withColumn("given", F.floor(F.col("seats") * F.col("words") / F.col("all") + 0.5))
    sums = sums.withColumn("short", F.col("seats") - F.sum("given").over(Window.partitionBy("s")))
    moves = sums.filter("short != 0").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    moves = moves.withColumn("by", F.when(F.col("short") > 0, -F.col("words") / (2 * (F.col("given") + F.col("j")) + 1)).when(F.col("given") > F.col("j"), F.col("words") / (2 * (F.col("given") - F.col("j")) - 1)))
    moves = moves.filter("by is not null").withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy("by", "shard", "j"))).filter(F.col("rank") <= F.abs("short"))
    moves = moves.groupBy("s", "shard").agg(F.sum(F.signum("short")).cast("long").alias("moved"))
    blocks = F.ceil(F.col("words") / F.col("width"))
    quota = sums.join(moves, ["s", "shard"], "left").select("s", "shard", blocks.alias("n"), F.least(F.col("given") + F.coalesce("moved", F.lit(0)), F.floor(most * blocks)).alias("quota"))

    within = Window.partitionBy("s", "shard").orderBy("place", "doc_id", "size")
    laid = named.withColumn("stop", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(quota, ["s", "shard"], "left")

    def take(batches):
        for batch in batches:
            stop, size, n, q, s, shard, width = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("stop", "size", "n", "quota", "s", "shard", "width"))
            start = stop - size
            row, a, b, times = taken_blocks(start, stop, n, q, s * 1_000_003 + shard, width, seed, whole)
            spans: list[list] = [[] for _ in range(len(start))]
            for i, x, y, t in zip(row.tolist(), (a - start[row]).tolist(), (b - start[row]).tolist(), times.tolist(), strict=True):
                if t:
                    if spans[i] and spans[i][-1]["stop"] == x and spans[i][-1]["times"] == t:
                        spans[i][-1]["stop"] = y
                    else:
                        spans[i].append({"start": x, "stop": y, "times": t})
            taken = np.bincount(row, (b - a) * times, len(start)).astype(np.int64)
            yield {c: batch.column(c) for c in ("doc_id", "row_key", "source", "size", "source_size", "target")} | {"taken": taken, "spans": spans}

    laid = laid.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "quota")})
    return arrow_map(laid.select("doc_id", "row_key", "source", "size", "source_size", "target", "stop", "n", "quota", "s", "shard", "width"), take, "doc_id long, row_key long, source string, size long, source_size long, target double, taken long, spans array<struct<start:int,stop:int,times:int>>")


def taken_blocks(start: np.ndarray, stop: np.ndarray, n: np.ndarray, quota: np.ndarray, shard: np.ndarray, block: np.ndarray, seed: int, whole: bool = False) -> tuple[np.ndarray, ...]:
    """Row, start, stop and times taken of the pieces that block borders cut each row's words [start, stop) of its shard into."""
    first, last = start // block, np.where(stop > start, (stop - 1) // block + 1, start // block)
    one = (stop > start) & (stop - start <= block) & whole
    spread = np.where(one, 1, last - first)
    row = np.repeat(np.arange(len(start)), spread)
    each = np.arange(len(row)) - np.repeat(np.cumsum(spread) - spread, spread) + first[row]
    size = np.maximum(n, 1)[row]
    extra = permute(each, size, shard[row].astype(np.int64) * 2_654_435_761 + seed) < quota[row] % size
    return row, np.maximum(start[row], each * block[row]), np.where(one[row], stop[row], np.minimum(stop[row], (each + 1) * block[row])), quota[row] // size + extra


def mixed(docs: DataFrame, block: int = 16, widest: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **parameters) -> DataFrame:
    """The mix itself, with the columns of docs: a row's taken words as its text, once more in a further row for what is taken twice. What lies between words stays; spans that don't touch are joined by a line feed."""
    spans = mix(docs, block=block, widest=widest, id_col=id_col, text_col=text_col, source_col=source_col, **parameters).filter("taken > 0")
    # Ids and texts as one hash: a key that is never null, for one shuffle of the texts.
    key, taken_spans = fresh(docs, "mix_key", "mix_spans")
    as_key = lambda i, t: F.xxhash64(F.coalesce(i.cast("string"), F.lit("none")), t).alias(key)
    spans = spans.groupBy(as_key(F.col("doc_id"), F.col("row_key"))).agg(F.collect_list("spans").alias(taken_spans))
    keyed = docs.withColumn(key, as_key(F.col(id_col).cast("long"), F.xxhash64(text_col, source_col))).dropDuplicates([key])
    joined = keyed.join(spans, key).drop(key)
    names = docs.columns
    at = names.index(text_col)

    def cut(batches):
        for batch in batches:
            row, texts = [], []
            for i, (text, each) in enumerate(zip(batch.column(at).to_pylist(), batch.column(taken_spans).to_pylist(), strict=True)):
                words = [m.span() for m in WORDS.finditer(text)]
                for one in each:
                    for level in range(1, max(s["times"] for s in one) + 1):
                        parts: list[list[int]] = []
                        for s in one:
                            if s["times"] >= level:
                                if parts and parts[-1][1] == s["start"]:
                                    parts[-1][1] = s["stop"]
                                else:
                                    parts.append([s["start"], s["stop"]])
                        row.append(i)
                        texts.append("\n".join(text[words[a][0] : words[b - 1][1]] for a, b in parts))
            taken = batch.take(pa.array(row, pa.int64()))
            out = {name: taken.column(k) for k, name in enumerate(names)} | {text_col: texts}
            yield out | ({chars_col: [len(t) for t in texts]} if chars_col in names else {})

    small_batches(docs.sparkSession)
    return arrow_map(joined, cut, docs.schema)
