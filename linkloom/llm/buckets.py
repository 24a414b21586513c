"""Candidate pairs of 64-bit codes that share a bucket, verified without writing all pairs.

Large buckets are cut into chunks and every pair of chunks is a group of its own, so a
bucket with a third of all rows is many bounded groups. A group gives back a forest that
connects what its verified pairs connect, never the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .components import local_forest

BUCKET = ("part", "key")


def chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (part, key, code, probe) with c1 and c2: the pairs of chunks of its bucket that each row belongs to."""
    heavy = rows.groupBy(*BUCKET).count().filter(F.col("count") > chunk).select(*BUCKET, F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    cut = rows.join(heavy, list(BUCKET), "left").withColumn("n", F.coalesce("n", F.lit(1)))
    cut = cut.withColumn("c", F.pmod(F.xxhash64("code"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(F.col("c"), o).alias("c1"), F.greatest(F.col("c"), o).alias("c2")))
    return cut.select(*BUCKET, "code", "probe", F.explode(pairs).alias("p")).select(*BUCKET, "p.c1", "p.c2", "code", "probe")


def verified(rows: DataFrame, radius: int, chunk: int = 2000) -> DataFrame:
    """Edges (a, b) that connect the codes that share a bucket and differ in at most radius bits; probe rows are only held against others."""
    group = [*BUCKET, "c1", "c2"]
    dealt = chunked(rows, chunk).repartition(*group).sortWithinPartitions(*group, "probe")

    def run(batches):
        kept: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*group, "code", "probe"]]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            changes = np.zeros(len(columns[0]), bool)
            for c in columns[:4]:
                changes[1:] |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(changes)])
            yield pairs(columns, starts[:-1], starts[1:])
            kept = [c[starts[-1] :] for c in columns]
        if kept is not None and len(kept[0]):
            yield pairs(kept, np.array([0]), np.array([len(kept[0])]))

    def pairs(columns: list[np.ndarray], starts: np.ndarray, stops: np.ndarray) -> dict:
        code, probe = columns[4].astype(np.uint64), columns[5]
        end = np.repeat(stops, stops - starts)
        at, step, a, b, held = np.flatnonzero(probe[: len(end)] == 0), 0, [], [], 0
        while True:
            step += 1
            at = at[at + step < end[at]]
            if not at.size:
                break
            near = np.bitwise_count(code[at] ^ code[at + step]) <= radius
            if near.any():
                a.append(columns[4][at[near]])
                b.append(columns[4][at[near] + step])
                held += int(near.sum())
                if held > 1_000_000:
                    x, y = local_forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], len(x)
        if not a:
            return {"a": [], "b": []}
        x, y = local_forest(np.concatenate(a), np.concatenate(b))
        return {"a": x, "b": y}

    return arrow_map(dealt, run, "a long, b long")
