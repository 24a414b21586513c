"""Candidate pairs with both records, labels, and deterministic samples and splits. Rows keep their keys throughout."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import true_pairs


def join_records(candidates: DataFrame, references: DataFrame, others: DataFrame, fields: Collection[str] | None = None) -> DataFrame:
    """candidates with structs a (the reference record) and b (the other one), of the named fields or all; pairs without a record are dropped. A record is moved once for each of its pairs, and Catalyst drops no field that a step between makes a struct of. References come last: what follows groups pairs by s1_id, and they lie so."""
    fields = references.columns if fields is None else [c for c in references.columns if c in fields]
    a = references.select(F.col("entity_id").alias("s1_id"), F.struct(*fields).alias("a"))
    b = others.select(F.col("entity_id").alias("cand_id"), F.struct(*fields).alias("b"))
    return candidates.join(b, "cand_id").join(a, "s1_id").select(*candidates.columns, "a", "b")


def each_side(pairs: DataFrame, forms: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs with forms applied to both records, after the shuffles and in place: what forms adds is many times what it reads, so it isn't moved or stored for each pair."""
    for side in ("a", "b"):
        rest, record = [c for c in pairs.columns if c != side], [f"_{c}" for c in pairs.columns if c != side]
        made = forms(pairs.select(*[F.col(c).alias(n) for c, n in zip(rest, record, strict=True)], f"{side}.*"))
        pairs = made.select(*[F.col(n).alias(c) for c, n in zip(rest, record, strict=True)], F.struct(*[c for c in made.columns if c not in record]).alias(side))
    return pairs


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label: 1 for a true pair, else 0."""
    true = true_pairs(truth).withColumn("_true", F.lit(1))
    return pairs.join(true, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("_true", F.lit(0))).drop("_true")


def cap_negatives(labelled: DataFrame, ratio: float = 6.0, seed: int = 42) -> DataFrame:
    """All positives, and at most int(ratio x positives) negatives in hash order; all rows if there is no positive.

    Only the counts of 4,096 hash ranges come to the driver; the range in which the cap
    falls is the only one that is ranked, so no task orders all negatives.
    """
    hashed = labelled.withColumn("_h", F.xxhash64(F.lit(seed), "s1_id", "cand_id")).withColumn("_b", F.shiftrightunsigned("_h", 52))
    counts = {(r["label"], r["_b"]): r["count"] for r in hashed.groupBy("label", "_b").count().collect()}
    positives = sum(n for (label, _), n in counts.items() if label == 1)
    if not positives:
        return labelled
    left, edge = int(ratio * positives), -1
    for edge, n in sorted((b, n) for (label, b), n in counts.items() if label == 0):
        if n > left:
            break
        left -= n
    else:
        return labelled
    negative = F.col("label") == 0
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "s1_id", "cand_id"))
    at_edge = hashed.filter(negative & (F.col("_b") == edge)).withColumn("_r", rank).filter(F.col("_r") <= left).drop("_r")
    return hashed.filter(~negative | (F.col("_b") < edge)).unionByName(at_edge).drop("_h", "_b")


def class_weights(labelled: DataFrame) -> DataFrame:
    """label, n and weight: all rows / (2 x rows of the label). Two rows."""
    counts = labelled.groupBy("label").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(whole)).select("label", "n", (F.col("all") / (2 * F.col("n"))).alias("weight"))


def md5_fold(entity_id: Column, folds: int) -> Column:
    """The md5 digest, as a 128-bit number, modulo folds."""
    half = lambda start: F.conv(F.substring(F.md5(entity_id), start, 16), 16, 10).cast("decimal(20,0)") % folds
    return ((half(1) * (2**64 % folds) + half(17)) % folds).cast("int")
