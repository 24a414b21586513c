"""Candidates by an IDF-weighted token join.

Tokens that more than a share of the indexed records hold are dropped before records meet, so
that a token's fan-out is bounded by that share. Still the hits of all pairs grow with the square of the
records, so `candidates` and `name_scores` add them up where they arise (cells.sums), and only sums are rows. `name_hits` and
`number_hits` are the hits as rows, by two equi-joins, on tokens and on numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import sums
from .metrics import true_pairs

TOP_K, BONUS, LEAST_SCORE, FLOOR, MOST_SHARE = 10, 3.0, 1.5, 0.35, 0.03


def source_of(entity_id):
    return F.split_part(entity_id, F.lit("-"), F.lit(1))


def sample(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n records in hash order: the same ones on every run."""
    return records.orderBy(F.xxhash64(F.lit(seed), "entity_id"), "entity_id").limit(n)


def document_frequency(prepared: DataFrame) -> DataFrame:
    """src, token, df: how many records of a source hold the token."""
    each = prepared.select(source_of(F.col("entity_id")).alias("src"), F.explode(F.array_distinct("tokens")).alias("token"))
    return each.groupBy("src", "token").agg(F.count("*").alias("df"))


def source_sizes(prepared: DataFrame, most_share: float = MOST_SHARE) -> DataFrame:
    """src, n and max_df: a token in more records is a stop token. One row per source."""
    sizes = prepared.groupBy(source_of(F.col("entity_id")).alias("src")).agg(F.count("*").alias("n"))
    return sizes.withColumn("max_df", F.greatest(F.lit(10), F.floor(F.col("n") * most_share)))


def idf(prepared: DataFrame, most_share: float = MOST_SHARE) -> DataFrame:
    """src, token, df, idf of the tokens that are no stop tokens."""
    kept = document_frequency(prepared).join(source_sizes(prepared, most_share), "src").filter("df <= max_df")
    return kept.select("src", "token", "df", (F.ln((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def postings(prepared: DataFrame, most_share: float = MOST_SHARE) -> DataFrame:
    """src, token, cand_id, cand_country, idf."""
    each = prepared.select(source_of(F.col("entity_id")).alias("src"), F.col("entity_id").alias("cand_id"), F.col("country").alias("cand_country"), F.explode(F.array_distinct("tokens")).alias("token"))
    return each.join(idf(prepared, most_share).drop("df"), ["src", "token"])


def no_conflict(a: str, b: str):
    return (F.col(a) == "") | (F.col(b) == "") | (F.col(a) == F.col(b))


def name_hits(references: DataFrame, prepared: DataFrame, most_share: float = MOST_SHARE) -> DataFrame:
    """s1_id, src, cand_id, score of each shared token, times its repeats in the reference name."""
    mine = references.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("s1_country"), F.explode("tokens").alias("token"))
    mine = mine.groupBy("s1_id", "s1_country", "token").agg(F.count("*").alias("times"))
    hits = mine.join(postings(prepared, most_share), "token").filter(no_conflict("s1_country", "cand_country"))
    return hits.select("s1_id", "src", "cand_id", (F.col("times") * F.col("idf")).alias("score"))


def long_numbers():
    return F.filter(F.array_union("nums", "postals"), lambda n: F.length(n) >= 4)


def number_hits(references: DataFrame, prepared: DataFrame, bonus: float = BONUS) -> DataFrame:
    """s1_id, src, cand_id, score of each shared number or postal code of four characters or more."""
    number = F.explode(long_numbers()).alias("number")
    mine = references.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("s1_country"), number)
    theirs = prepared.select(source_of(F.col("entity_id")).alias("src"), F.col("entity_id").alias("cand_id"), F.col("country").alias("cand_country"), number)
    hits = mine.join(theirs, "number").filter(no_conflict("s1_country", "cand_country"))
    return hits.select("s1_id", "src", "cand_id", F.lit(bonus).alias("score"))


def scores(references: DataFrame, prepared: DataFrame, most_share: float = MOST_SHARE, bonus: float = BONUS) -> DataFrame:
    """s1_id, src, cand_id and the sum of all hits, each of them a row."""
    hits = name_hits(references, prepared, most_share).unionByName(number_hits(references, prepared, bonus))
    return hits.groupBy("s1_id", "src", "cand_id").agg(F.sum("score").alias("score"))


def best(scored: DataFrame, top_k: int = TOP_K, least: float = LEAST_SCORE, floor: float = FLOOR) -> DataFrame:
    """Per reference record and source the top_k scores that reach least and floor times the best. Ties go to the lesser id."""
    # Rounded for ranking only: sums of the same hits in another order mustn't rank differently.
    per = Window.partitionBy("s1_id", "src").orderBy(F.round("score", 9).desc(), "cand_id")
    ranked = scored.filter(F.round("score", 9) >= least).withColumn("rank", F.row_number().over(per)).filter(F.col("rank") <= top_k)
    ranked = ranked.withColumn("top", F.max(F.round("score", 9)).over(Window.partitionBy("s1_id", "src")))
    return ranked.filter(F.round("score", 9) >= F.greatest(F.lit(least), F.round(floor * F.col("top"), 9))).select("s1_id", "cand_id", "score")


def name_scores(references: DataFrame, prepared: DataFrame, most_share: float = MOST_SHARE) -> DataFrame:
    """s1_id, cand_id, score: the sum of name_hits of every pair that has one."""
    return sums(references, prepared, idf(prepared, most_share), source_of(F.col("entity_id")), None, 0.0, None)


def candidates(references: DataFrame, prepared: DataFrame, top_k: int = TOP_K, bonus: float = BONUS, least: float = LEAST_SCORE, most_share: float = MOST_SHARE) -> DataFrame:
    """s1_id, cand_id, score; every source in prepared is blocked for itself, in one pass."""
    summed = sums(references, prepared, idf(prepared, most_share), source_of(F.col("entity_id")), long_numbers(), bonus, (top_k, least, FLOOR))
    return best(summed.withColumn("src", source_of(F.col("cand_id"))), top_k, least)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: recall over true pairs (1 if there are none), mean and total candidates over the truth's entities."""
    pairs = true_pairs(truth)
    hit = pairs.join(found.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi")
    counts = truth.select("s1_id").distinct().join(found.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left")
    return (
        pairs.agg(F.count("*").alias("true_pairs"))
        .crossJoin(hit.agg(F.count("*").alias("found_pairs")))
        .crossJoin(counts.agg(F.avg(F.coalesce("n", F.lit(0))).alias("avg_candidates"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_candidates")))
        .select(F.when(F.col("true_pairs") > 0, F.col("found_pairs") / F.when(F.col("true_pairs") > 0, F.col("true_pairs"))).otherwise(1.0).alias("recall"), F.coalesce("avg_candidates", F.lit(0.0)).alias("avg_candidates"), "total_candidates", "true_pairs", "found_pairs")
    )
