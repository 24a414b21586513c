"""Scores blended, guarded and turned into matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a missing feature counts as in the guards and blends; all others count as 0.
NEUTRAL = {"addr_postal_exact_match": 0.5, "addr_street_num_match": 0.5, "baseline_prob": 0.5}

#: The features that blend_ensemble and guarded read.
BLENDED = ("baseline_prob", "name_base_levenshtein_sim", "name_token_jaccard", "addr_levenshtein_sim", "addr_token_jaccard")
GUARDED = """
name_exact_match name_base_exact_match name_levenshtein_sim name_base_levenshtein_sim name_token_jaccard name_is_substring
addr_exact_match addr_levenshtein_sim addr_token_jaccard addr_numeric_overlap_count addr_has_postal_a addr_has_postal_b
addr_postal_exact_match addr_street_num_match country_conflict
""".split()


def _value(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(NEUTRAL.get(name, 0.0))) if name in df.columns else F.lit(NEUTRAL.get(name, 0.0))


def blend_ml(df: DataFrame, alpha: float = 0.40) -> Column:
    return alpha * _value(df, "baseline_prob") + (1 - alpha) * F.col("ml_prob")


def blend_ensemble(df: DataFrame) -> Column:
    name = (_value(df, "name_base_levenshtein_sim") + _value(df, "name_token_jaccard")) * 0.5
    addr = (_value(df, "addr_levenshtein_sim") + _value(df, "addr_token_jaccard")) * 0.5
    return 0.50 * _value(df, "baseline_prob") + 0.30 * F.col("ml_prob") + 0.12 * name + 0.08 * addr


def guarded(df: DataFrame, score: Column) -> Column:
    """The score after the guards against false merges, within [0, 1]; never above the score."""
    v = lambda n: _value(df, n)
    name = F.greatest(v("name_exact_match"), v("name_base_exact_match"), v("name_levenshtein_sim"), v("name_base_levenshtein_sim"), v("name_token_jaccard"), v("name_is_substring") * 0.7)
    addr = F.greatest(v("addr_exact_match"), v("addr_levenshtein_sim"), v("addr_token_jaccard"), F.least(F.lit(1.0), v("addr_numeric_overlap_count")))
    exact = (v("name_exact_match") > 0.5) | (v("name_base_exact_match") > 0.5)
    postal = (v("addr_has_postal_a") > 0.5) & (v("addr_has_postal_b") > 0.5) & (v("addr_postal_exact_match") < 0.2) & ~exact
    street = (v("addr_street_num_match") < 0.2) & ~exact & (addr < 0.60)
    lowered = score * F.when(postal, 0.50).otherwise(1.0) * F.when(street, 0.75).otherwise(1.0)
    none = (v("country_conflict") > 0.5) | ((name < 0.35) & (addr < 0.35))
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), lowered)))


def _with_top(scored: DataFrame) -> DataFrame:
    return scored.withColumn("top", F.max("score").over(Window.partitionBy("s1_id")))


def decide(scored: DataFrame, threshold: float, margin: float, hurdle: float | None = None) -> DataFrame:
    """The matches: nothing for an entity whose best score is below the hurdle, else scores of threshold or more within margin of the best."""
    hurdle = threshold if hurdle is None else hurdle
    return _with_top(scored).filter((F.col("top") >= hurdle) & (F.col("score") >= threshold) & (F.col("top") - F.col("score") <= margin)).select("s1_id", "cand_id", "score")


def decide_reranked(scored: DataFrame, threshold: float, margin: float, hurdle: float, sure: float = 0.70) -> DataFrame:
    """As decide, but a score of `sure` or more needn't be within the margin."""
    near = (F.col("score") >= F.col("top") - margin) | (F.col("score") >= sure)
    return _with_top(scored).filter((F.col("top") >= hurdle) & (F.col("score") >= threshold) & near).select("s1_id", "cand_id", "score")
